"""HTML features by regular expression, plus the registry users extend.

Comments and script / style bodies are blanked first, so that markup inside
them is not counted. Tags are then matched with their attribute list walked
name by name, so an attribute name inside a quoted value is never taken for an
attribute. Known limits: an unbalanced quote inside a tag hides that tag, and of
a repeated attribute any occurrence counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Possessive quantifiers keep the Java matcher from backtracking, and make it loop
# where it would otherwise recurse, so a tag of any length cannot overflow the stack.
# An opening without its end takes the rest of the page at once; else each of many such
# openings would scan to the end, in time that grows with the square of the page.
_REST = r"""(?:[\s/](?:[^"'>]++|"[^"]*+"|'[^']*+')*+)?(?:>|\z)"""


def _attrs_before(name: str) -> str:
    """The attributes of a tag up to the first one called ``name``, and its name."""
    value = r"""(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""
    other = rf"""[\s/]+(?!{name}[\s=/>])[^\s"'<>/=]++{value}"""
    return rf"(?:{other})*+[\s/]+{name}"


HIDDEN_RE = (
    r"(?is)<!--(?:.*?-->|.*+\z)"
    rf"|(<script{_REST})(?:.*?</script\s*>|.*+\z)"
    rf"|(<style{_REST})(?:.*?</style\s*>|.*+\z)"
)
TITLE_RE = r"(?is)<title(?:\s[^<>]*+)?>(?:(.*?)</title|.*+\z)"
ENTITY_RE = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);"
SCRIPT_SRC_RE = rf"(?i)<script{_attrs_before('src')}[\s=/>]"
SCRIPT_HTTP_RE = rf"""(?i:<script{_attrs_before("src")})\s*=\s*["']?http"""
CHARSET_RE = rf"""(?i)<meta{_attrs_before("charset")}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]*)"""
IFRAME_RE = r"(?i)<iframe[\s/>]"
LINK_RE = rf"""(?i)<a{_attrs_before("href")}\s*=\s*["']?http"""

HtmlFeature = Callable[[Column], Column]


def visible_markup(html: Column) -> Column:
    """Markup without comments and without script and style bodies."""
    return F.regexp_replace(html, HIDDEN_RE, "$1$2")


def code_size(html: Column) -> Column:
    return F.coalesce(F.length(html), F.lit(0))


def is_html5(html: Column) -> Column:
    flat = F.regexp_replace(F.regexp_replace(html, r"[\r\n]", ""), r"^\s+", "")
    start = F.lower(F.substring(flat, 1, 15))
    return F.coalesce((start == "<!doctype html>").cast("int"), F.lit(0))


def _matches(markup: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(markup, F.lit(pattern)), F.lit(0))


def title_length(markup: Column) -> Column:
    """Characters of the first title, 0 without one or when it holds tags."""
    title = F.regexp_extract(markup, TITLE_RE, 1)
    plain = F.regexp_replace(title, ENTITY_RE, "_")
    return F.when(title.rlike(r"<[a-zA-Z/!?]"), 0).otherwise(
        F.coalesce(F.length(plain), F.lit(0))
    )


def external_js_count(markup: Column) -> Column:
    return _matches(markup, SCRIPT_HTTP_RE)


def internal_js_count(markup: Column) -> Column:
    return _matches(markup, SCRIPT_SRC_RE) - _matches(markup, SCRIPT_HTTP_RE)


def charset(markup: Column) -> Column:
    found = F.regexp_extract(markup, CHARSET_RE, 1)
    return F.coalesce(F.translate(F.lower(found), "\"'", ""), F.lit(""))


def iframe_count(markup: Column) -> Column:
    return _matches(markup, IFRAME_RE)


def no_iframe(markup: Column) -> Column:
    """The study's ``has_iframe`` column is 1 when there is no iframe."""
    return (iframe_count(markup) == 0).cast("int")


def hyperlink_count(markup: Column) -> Column:
    return _matches(markup, LINK_RE)


class HtmlFeatureRegistry:
    """Named per-page expressions; users add their own with :meth:`add`."""

    def __init__(self) -> None:
        self._features: dict[str, HtmlFeature] = {}

    def add(self, name: str, feature: HtmlFeature) -> HtmlFeatureRegistry:
        self._features[name] = feature
        return self

    def names(self) -> list[str]:
        return list(self._features)

    def apply(
        self, df: DataFrame, html: str = "html_text", names: Iterable[str] | None = None
    ) -> DataFrame:
        chosen = self.names() if names is None else list(names)
        markup = F.col("_markup")
        return (
            df.withColumn("_markup", visible_markup(F.col(html)))
            .withColumns({n: self._features[n](markup) for n in chosen})
            .drop("_markup")
        )


def default_registry() -> HtmlFeatureRegistry:
    return (
        HtmlFeatureRegistry()
        .add("title_length", title_length)
        .add("internal_js_cnt", internal_js_count)
        .add("external_js_cnt", external_js_count)
        .add("charset", charset)
        .add("has_iframe", no_iframe)
        .add("hyperlink_cnt", hyperlink_count)
    )


def content_type(header: Column) -> Column:
    """``content-type`` of a header written as a map literal, in lower case."""
    entries = F.map_entries(F.from_json(header, "map<string,string>"))
    hits = F.filter(entries, lambda e: F.lower(e["key"]) == "content-type")
    return F.lower(F.get(F.reverse(hits), 0)["value"])
