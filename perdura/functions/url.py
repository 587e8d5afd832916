"""URL features as native column expressions.

The split follows Python's ``urlparse``: scheme in lower case, netloc with user
info and port, ``;params`` cut off the last path segment, fragment dropped.
``parse_url`` is not used because it raises on URLs with stray characters and
loses the port.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
NETLOC_RE = r"^//([^/?#]*)"
TLD_RE = r"^[a-zA-Z]{2,63}$"

# The host suffixes that get an indicator column of their own.
DUMMY_SUFFIXES = ("int", "org", "gov", "in", "eu", "cn", "kr", "en")


def _clean(url: Column) -> Column:
    lead = F.regexp_replace(url, r"^[\x00-\x20]+", "")
    return F.regexp_replace(lead, r"[\t\r\n]", "")


def _after_scheme(url: Column) -> Column:
    return F.regexp_replace(_clean(url), SCHEME_RE, "")


def _after_netloc(url: Column) -> Column:
    rest = F.regexp_replace(_after_scheme(url), NETLOC_RE, "")
    return F.regexp_extract(rest, r"^([^#]*)", 1)


def url_length(url: Column) -> Column:
    return F.length(url)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(_clean(url), SCHEME_RE, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), NETLOC_RE, 1)


def path(url: Column) -> Column:
    whole = F.regexp_extract(_after_netloc(url), r"^([^?]*)", 1)
    return F.regexp_replace(whole, r";[^/]*$", "")


def query(url: Column) -> Column:
    """Query string; blank or absent gives null."""
    text = F.regexp_extract(_after_netloc(url), r"\?(.*)$", 1)
    return F.when(~text.rlike(r"^\s*$"), text)


def count_char(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def depth(path_col: Column) -> Column:
    """Slashes in the path; a trailing one is not counted, an empty path is 0."""
    return count_char(F.regexp_replace(path_col, "/$", ""), "/")


def has_www(netloc_col: Column) -> Column:
    return F.startswith(netloc_col, F.lit("www.")).cast("int")


def subdomain_level(netloc_col: Column) -> Column:
    return count_char(netloc_col, ".")


def param_count(query_col: Column) -> Column:
    return F.when(query_col.isNotNull(), count_char(query_col, "&") + 1).otherwise(0)


def suffix(netloc_col: Column) -> Column:
    """Text after the last dot, port still on; null without a dot."""
    return F.when(
        F.contains(netloc_col, F.lit(".")), F.substring_index(netloc_col, ".", -1)
    )


def suffix_name(suffix_col: Column) -> Column:
    return F.substring_index(suffix_col, ":", 1)


def is_port_access(suffix_col: Column) -> Column:
    """1 when more than one non-blank part stands between the colons."""
    return suffix_col.rlike(r"[^:\s].*:.*[^:\s]").cast("int")


def is_valid_tld(suffix_name_col: Column) -> Column:
    return suffix_name_col.rlike(TLD_RE)


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Add scheme, netloc, path and params, each evaluated once per row."""
    col = F.col(url)
    return df.withColumns(
        {
            "scheme": scheme(col),
            "netloc": netloc(col),
            "path": path(col),
            "params": query(col),
        }
    )


def url_features(df: DataFrame, url: str = "url") -> DataFrame:
    """All URL features; rows whose host has no dot are dropped."""
    parts = split_url(df, url).withColumn("suffix", suffix(F.col("netloc")))
    return parts.filter(F.col("suffix").isNotNull()).withColumns(
        {
            "url_length": url_length(F.col(url)),
            "url_depth": depth(F.col("path")),
            "has_www": has_www(F.col("netloc")),
            "subdomain_level": subdomain_level(F.col("netloc")),
            "param_cnt": param_count(F.col("params")),
            "suffix_idx": suffix_name(F.col("suffix")),
            "is_port_access": is_port_access(F.col("suffix")),
        }
    )
