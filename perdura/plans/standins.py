"""The study's tables derived from the given ones, in Spark and in SQL.

Web resources come from ``pages``; a fixed rule on ``page_id`` gives hosts,
markup, stamps and labels the variety the generated pages lack. Papers come
from ``orders`` and publication features from ``lineitem``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perdura.plans.registry import table

RESOURCE_SQL = """
res AS (
  SELECT page_id,
    printf('%08x', 1104537600 + (page_id * 7919 % 5000) * 86400) || printf('%016x', page_id) AS id,
    CASE page_id % 8
      WHEN 1 THEN replace(url, '.com/', '.gov/')
      WHEN 2 THEN replace(url, '.net/', '.edu:8080/')
      WHEN 3 THEN replace(url, '.org/', '.int/')
      WHEN 4 THEN 'HTTP' || substr(url, 5)
      WHEN 5 THEN replace(url, '.com/', '.k2/') || ';v=1'
      WHEN 6 THEN CASE WHEN page_id % 16 = 6 THEN 'https://DOI.org/10.1/' || page_id
                       ELSE replace(url, '.net/', '.eu/a;b/') END
      ELSE url END AS url,
    CASE WHEN page_id % 11 <> 0 THEN CAST(1995 + page_id % 20 AS DOUBLE) END AS first_appear,
    CASE WHEN page_id % 5 <> 0
         THEN (2000 + page_id % 20) * CAST(10000000000 AS DOUBLE) + 708093011 END
      AS last_available_timestamp,
    CASE page_id % 4
      WHEN 0 THEN '{"Content-Type": "Text/HTML; charset=UTF-8", "Server": "a"}'
      WHEN 1 THEN '{"server": "b", "content-type": "application/pdf"}'
      WHEN 2 THEN '{"Server": "c", "CONTENT-TYPE": "application/json"}'
      ELSE '{"server": "d"}' END AS header,
    CASE WHEN page_id % 9 <> 0 THEN
      replace(replace(replace(replace(replace(html,
        '</head>', CASE page_id % 4
          WHEN 1 THEN '<script src="http://cdn/x.js"></script><SCRIPT async src=''/y.js''></SCRIPT></head>'
          WHEN 2 THEN '<!-- <script src="http://no/z.js"> --><script defer src=//cdn/q.js></script></head>'
          ELSE '</head>' END),
        '<body>', CASE WHEN page_id % 3 = 0 THEN '<body><iframe src="x"></iframe>' ELSE '<body>' END),
        'href="/', CASE WHEN page_id % 2 = 0 THEN 'class="n" HREF="HTTP://h/' ELSE 'href="/' END),
        '"utf-8"', CASE page_id % 5 WHEN 0 THEN '"ISO-8859-1"' WHEN 1 THEN 'GBK' ELSE '"utf-8"' END),
        '<!DOCTYPE html>', CASE WHEN page_id % 6 = 0 THEN '<!DOCTYPE html PUBLIC "x">'
          ELSE '<!DOCTYPE html>' END)
    END AS html_text,
    CAST(page_id % 2 AS INTEGER) AS from_waybackmachine,
    CAST(page_id % 3 AS INTEGER) - 1 AS label
  FROM pages)
"""

MAG_SQL = """
mag AS (
  SELECT l_orderkey AS paperId,
    CAST(count(*) AS DOUBLE) AS total_num_of_paper_citing,
    CAST(sum(l_linenumber) AS DOUBLE) AS total_num_of_author_citing,
    CAST(count(DISTINCT l_suppkey) AS DOUBLE) AS total_num_of_affiliation_citing,
    CAST(max(l_linenumber) - min(l_linenumber) AS DOUBLE) AS total_num_of_journal_citing,
    CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS DOUBLE)
      AS total_num_of_author_self_citation,
    CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE)
      AS total_num_of_affiliation_self_citation,
    CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE)
      AS total_num_of_journal_self_citation,
    round(CAST(sum(year(l_shipdate)) AS DOUBLE) / count(*), 6) AS avg_year,
    CAST(min(year(l_shipdate)) AS DOUBLE) AS min_year,
    CAST(max(year(l_shipdate)) AS DOUBLE) AS max_year,
    CAST(min(l_linenumber) AS DOUBLE) AS median,
    CAST(max(l_linenumber) AS DOUBLE) AS num_of_author,
    sum(l_quantity) AS num_of_author_citing,
    max(l_quantity) AS num_of_affiliation_citing,
    min(l_quantity) AS num_of_journal_citing,
    round(sum(l_discount) / count(*), 6) AS avg_hindex,
    nullif(min(l_discount), 0) AS first_author_hindex,
    nullif(max(l_discount), 0.1) AS last_author_hindex,
    round(sum(l_tax) / count(*), 6) AS avg_mid_author_hindex,
    CAST(count(DISTINCT l_suppkey) AS DOUBLE) AS paper_unique_affiliation
  FROM lineitem GROUP BY l_orderkey)
"""

STUDY_SQL = (
    RESOURCE_SQL
    + ","
    + MAG_SQL
    + """,
study AS (
  SELECT r.*, m.* FROM res r
  JOIN orders o ON o.o_orderkey = r.page_id
  JOIN mag m ON m.paperId = o.o_orderkey
  WHERE r.label IN (0, 1) AND r.first_appear IS NOT NULL AND lower(r.url) NOT LIKE '%doi.org%')
"""
)

URL_SQL = r"""
u0 AS (SELECT *, regexp_replace(regexp_replace(url, '^[\x00-\x20]+', ''), '[\t\r\n]', '', 'g') AS cu
       FROM res),
u1 AS (SELECT *, lower(regexp_extract(cu, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS scheme,
         regexp_replace(cu, '^[A-Za-z][A-Za-z0-9+.\-]*:', '') AS rest FROM u0),
u2 AS (SELECT *, regexp_extract(rest, '^//([^/?#]*)', 1) AS netloc,
         regexp_extract(regexp_replace(rest, '^//[^/?#]*', ''), '^([^#]*)', 1) AS after FROM u1),
u3 AS (SELECT *, regexp_replace(regexp_extract(after, '^([^?]*)', 1), ';[^/]*$', '') AS path,
         nullif(trim(regexp_extract(after, '\?(.*)$', 1)), '') AS params FROM u2),
u4 AS (SELECT *, CASE WHEN contains(netloc, '.') THEN split_part(netloc, '.', -1) END AS suffix
       FROM u3),
parts AS (SELECT *,
    CAST(length(url) AS INTEGER) AS url_length,
    CAST(length(regexp_replace(regexp_replace(path, '/$', ''), '[^/]', '', 'g')) AS INTEGER) AS url_depth,
    CASE WHEN netloc LIKE 'www.%' THEN 1 ELSE 0 END AS has_www,
    CAST(length(regexp_replace(netloc, '[^.]', '', 'g')) AS INTEGER) AS subdomain_level,
    CAST(CASE WHEN params IS NULL THEN 0
         ELSE length(regexp_replace(params, '[^&]', '', 'g')) + 1 END AS INTEGER) AS param_cnt,
    split_part(suffix, ':', 1) AS suffix_idx,
    CASE WHEN len(list_filter(string_split(suffix, ':'), lambda t: trim(t) <> '')) > 1
         THEN 1 ELSE 0 END AS is_port_access
  FROM u4)
"""

_ATTRS = r"""(?:[\s/]+[^\s"''>/=]+(?:\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+))?)*?[\s/]+"""
_REST = r"""(?:[\s/](?:[^"''>]|"[^"]*"|''[^'']*'')*)?>"""
HTML_SQL = rf"""
h0 AS (SELECT *, regexp_replace(html_text,
   '(?is)<!--.*?-->|(<script{_REST}).*?</script\s*>|(<style{_REST}).*?</style\s*>',
   '\1\2', 'g') AS mk FROM res),
h1 AS (SELECT *, regexp_extract(mk, '(?is)<title(?:\s[^>]*)?>(.*?)</title', 1) AS title FROM h0),
marks AS (SELECT *,
   CAST(coalesce(length(html_text), 0) AS INTEGER) AS code_size,
   CASE WHEN lower(regexp_replace(regexp_replace(html_text, '[\r\n]', '', 'g'), '^\s+', ''))
        LIKE '<!doctype html>%' THEN 1 ELSE 0 END AS is_html5,
   CAST(CASE WHEN regexp_matches(title, '<[a-zA-Z/!?]') THEN 0 ELSE coalesce(length(regexp_replace(
     title, '&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);', '_', 'g')), 0) END AS INTEGER)
     AS title_length,
   CAST(coalesce(len(regexp_extract_all(mk, '(?i:<script{_ATTRS}src)\s*=\s*["'']?http')), 0) AS INTEGER)
     AS external_js_cnt,
   CAST(coalesce(len(regexp_extract_all(mk, '(?i)<script{_ATTRS}src(?:[\s=/>])')), 0)
     - coalesce(len(regexp_extract_all(mk, '(?i:<script{_ATTRS}src)\s*=\s*["'']?http')), 0) AS INTEGER)
     AS internal_js_cnt,
   coalesce(replace(replace(lower(regexp_extract(mk,
     '(?i)<meta{_ATTRS}charset\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]*)', 1)), '"', ''), '''', ''), '')
     AS charset,
   CASE WHEN coalesce(len(regexp_extract_all(mk, '(?i)<iframe[\s/>]')), 0) = 0 THEN 1 ELSE 0 END
     AS has_iframe,
   CAST(coalesce(len(regexp_extract_all(mk, '(?i)<a{_ATTRS}href\s*=\s*["'']?http')), 0) AS INTEGER)
     AS hyperlink_cnt
  FROM h1)
"""

LINE_X = ("l_extendedprice", "l_discount", "l_tax")


def _case(col: Column, branches: dict[int, Column | str], otherwise: Column | str) -> Column:
    out = None
    for value, then in branches.items():
        out = F.when(col == value, then) if out is None else out.when(col == value, then)
    return out.otherwise(otherwise)


def _swap(text: Column, old: str, new: Column | str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new) if isinstance(new, str) else new)


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    n, url, html = F.col("page_id"), F.col("url"), F.col("html")
    epoch = F.lit(1104537600) + (n * 7919 % 5000) * 86400
    oid = F.concat(
        F.lower(F.lpad(F.hex(epoch), 8, "0")), F.lower(F.lpad(F.hex(n), 16, "0"))
    )
    head = _case(
        n % 4,
        {
            1: '<script src="http://cdn/x.js"></script>'
            "<SCRIPT async src='/y.js'></SCRIPT></head>",
            2: '<!-- <script src="http://no/z.js"> -->'
            "<script defer src=//cdn/q.js></script></head>",
        },
        "</head>",
    )
    page = _swap(html, "</head>", head)
    page = _swap(
        page, "<body>", _case(n % 3, {0: '<body><iframe src="x"></iframe>'}, "<body>")
    )
    page = _swap(page, 'href="/', _case(n % 2, {0: 'class="n" HREF="HTTP://h/'}, 'href="/'))
    page = _swap(page, '"utf-8"', _case(n % 5, {0: '"ISO-8859-1"', 1: "GBK"}, '"utf-8"'))
    page = _swap(
        page,
        "<!DOCTYPE html>",
        _case(n % 6, {0: '<!DOCTYPE html PUBLIC "x">'}, "<!DOCTYPE html>"),
    )
    doi = F.concat(F.lit("https://DOI.org/10.1/"), n.cast("string"))
    return pages.select(
        "page_id",
        oid.alias("id"),
        _case(
            n % 8,
            {
                1: _swap(url, ".com/", ".gov/"),
                2: _swap(url, ".net/", ".edu:8080/"),
                3: _swap(url, ".org/", ".int/"),
                4: F.concat(F.lit("HTTP"), F.substr(url, F.lit(5))),
                5: F.concat(_swap(url, ".com/", ".k2/"), F.lit(";v=1")),
                6: F.when(n % 16 == 6, doi).otherwise(_swap(url, ".net/", ".eu/a;b/")),
            },
            url,
        ).alias("url"),
        F.when(n % 11 != 0, (1995 + n % 20).cast("double")).alias("first_appear"),
        F.when(n % 5 != 0, (2000 + n % 20) * F.lit(1e10) + 708093011).alias(
            "last_available_timestamp"
        ),
        _case(
            n % 4,
            {
                0: '{"Content-Type": "Text/HTML; charset=UTF-8", "Server": "a"}',
                1: '{"server": "b", "content-type": "application/pdf"}',
                2: '{"Server": "c", "CONTENT-TYPE": "application/json"}',
            },
            '{"server": "d"}',
        ).alias("header"),
        F.when(n % 9 != 0, page).alias("html_text"),
        (n % 2).cast("int").alias("from_waybackmachine"),
        ((n % 3).cast("int") - 1).alias("label"),
    )


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = resources(spark, sf_dir).select("id", "page_id")
    doi = F.concat(F.lit("10."), F.col("page_id").cast("string"))
    return ids.select("id", F.col("page_id").cast("string").alias("pmid"), doi.alias("doi"))


def paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    doi = F.concat(F.lit("10."), F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select(
        doi.alias("doi"), F.col("o_orderkey").alias("paperId")
    )


def publication_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    def number(col: Column) -> Column:
        return col.cast("double")

    def flagged(cond: Column) -> Column:
        return number(F.sum(cond.cast("int")))

    year = F.year("l_shipdate")
    distinct_supp = number(F.count_distinct("l_suppkey"))
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("paperId"))
        .agg(
            number(F.count("*")).alias("total_num_of_paper_citing"),
            number(F.sum("l_linenumber")).alias("total_num_of_author_citing"),
            distinct_supp.alias("total_num_of_affiliation_citing"),
            number(F.max("l_linenumber") - F.min("l_linenumber")).alias(
                "total_num_of_journal_citing"
            ),
            flagged(F.col("l_returnflag") == "A").alias("total_num_of_author_self_citation"),
            flagged(F.col("l_returnflag") == "R").alias(
                "total_num_of_affiliation_self_citation"
            ),
            flagged(F.col("l_linestatus") == "F").alias("total_num_of_journal_self_citation"),
            F.round(number(F.sum(year)) / F.count("*"), 6).alias("avg_year"),
            number(F.min(year)).alias("min_year"),
            number(F.max(year)).alias("max_year"),
            number(F.min("l_linenumber")).alias("median"),
            number(F.max("l_linenumber")).alias("num_of_author"),
            F.sum("l_quantity").alias("num_of_author_citing"),
            F.max("l_quantity").alias("num_of_affiliation_citing"),
            F.min("l_quantity").alias("num_of_journal_citing"),
            F.round(F.sum("l_discount") / F.count("*"), 6).alias("avg_hindex"),
            F.nullif(F.min("l_discount"), F.lit(0.0)).alias("first_author_hindex"),
            F.nullif(F.max("l_discount"), F.lit(0.1)).alias("last_author_hindex"),
            F.round(F.sum("l_tax") / F.count("*"), 6).alias("avg_mid_author_hindex"),
            distinct_supp.alias("paper_unique_affiliation"),
        )
    )


def line_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as model rows: a label censored at 30 and three features."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_returnflag",
        *LINE_X,
        F.least("l_quantity", F.lit(30.0)).alias("label"),
    )
