"""URL, HTML, date and math functions over the derived web resources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perdura.functions import dates, html, numeric, url
from perdura.operators.transforms import FrequencyEncoder, suffix_dummies
from perdura.plans.registry import query, table
from perdura.plans.standins import HTML_SQL, LINE_X, RESOURCE_SQL, URL_SQL, resources

URL_CTE = f"WITH {RESOURCE_SQL}, {URL_SQL} "
HTML_CTE = f"WITH {RESOURCE_SQL}, {HTML_SQL} "
RES_CTE = f"WITH {RESOURCE_SQL} "


@query(
    "url_shape_by_suffix",
    URL_CTE
    + """SELECT suffix_idx, count(*) AS pages, round(avg(url_depth), 6) AS avg_depth,
      round(avg(param_cnt), 6) AS avg_params, CAST(sum(has_www) AS BIGINT) AS www_pages,
      max(subdomain_level) AS max_level
    FROM parts WHERE regexp_matches(suffix_idx, '^[a-zA-Z]{2,63}$') GROUP BY suffix_idx""",
)
def url_shape_by_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = url.url_features(resources(spark, sf_dir))
    return (
        rows.filter(url.is_valid_tld(F.col("suffix_idx")))
        .groupBy("suffix_idx")
        .agg(
            F.count("*").alias("pages"),
            F.round(F.avg("url_depth"), 6).alias("avg_depth"),
            F.round(F.avg("param_cnt"), 6).alias("avg_params"),
            F.sum("has_www").alias("www_pages"),
            F.max("subdomain_level").alias("max_level"),
        )
    )


def _url_query(name: str, *columns: str, keep: str = "true") -> None:
    @query(name, URL_CTE + f"SELECT page_id, {', '.join(columns)} FROM parts WHERE {keep}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        parts = url.split_url(resources(spark, sf_dir))
        netloc = F.col("netloc")
        suffix = url.suffix(netloc)
        made = {
            "url_length": url.url_length(F.col("url")),
            "scheme": F.col("scheme"),
            "netloc": netloc,
            "path": F.col("path"),
            "params": F.col("params"),
            "url_depth": url.depth(F.col("path")),
            "has_www": url.has_www(netloc),
            "subdomain_level": url.subdomain_level(netloc),
            "param_cnt": url.param_count(F.col("params")),
            "suffix": suffix,
            "suffix_idx": url.suffix_name(suffix),
            "is_port_access": url.is_port_access(suffix),
        }
        if name == "url_suffix":
            parts = parts.filter(suffix.isNotNull())
        if name == "valid_tld":
            parts = parts.filter(url.is_valid_tld(url.suffix_name(suffix)))
        return parts.select("page_id", *[made[c].alias(c) for c in columns])


_url_query("url_length", "url_length")
_url_query("url_parts", "scheme", "netloc", "path", "params")
_url_query("url_depth", "url_depth")
_url_query("has_www", "has_www")
_url_query("subdomain_level", "subdomain_level")
_url_query("param_cnt", "param_cnt")
_url_query("url_suffix", "suffix", "suffix_idx", "is_port_access", keep="suffix IS NOT NULL")
_url_query(
    "valid_tld", "suffix_idx", keep="regexp_matches(suffix_idx, '^[a-zA-Z]{2,63}$')"
)


@query(
    "suffix_frequency",
    URL_CTE
    + """, f AS (SELECT suffix, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS freq
         FROM parts WHERE suffix IS NOT NULL AND page_id % 2 = 0 GROUP BY suffix)
    SELECT p.page_id, round(coalesce(f.freq, 0), 9) AS suffix
    FROM parts p LEFT JOIN f ON p.suffix = f.suffix WHERE p.suffix IS NOT NULL""",
)
def suffix_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = url.url_features(resources(spark, sf_dir)).select("page_id", "suffix")
    model = FrequencyEncoder(inputCol="suffix").fit(rows.filter(F.col("page_id") % 2 == 0))
    return model.transform(rows).withColumn("suffix", F.round("suffix", 9))


@query(
    "suffix_dummies",
    URL_CTE
    + "SELECT page_id, "
    + ", ".join(
        f'CAST(suffix_idx = \'{s}\' AS INTEGER) AS "{s}"' for s in url.DUMMY_SUFFIXES
    )
    + " FROM parts WHERE suffix IS NOT NULL",
)
def suffix_dummies_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = url.url_features(resources(spark, sf_dir)).select("page_id", "suffix_idx")
    return suffix_dummies(rows)


@query(
    "content_type",
    RES_CTE
    + """SELECT page_id, nullif(regexp_extract(lower(header), '"content-type": *"([^"]*)"', 1), '')
      AS content_type FROM res""",
)
def content_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resources(spark, sf_dir).select(
        "page_id", html.content_type(F.col("header")).alias("content_type")
    )


# ---------------------------------------------------------------- HTML


def _html_query(name: str, *columns: str) -> None:
    @query(name, HTML_CTE + f"SELECT page_id, {', '.join(columns)} FROM marks")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        registry = html.default_registry()
        found = registry.apply(resources(spark, sf_dir), names=columns)
        return found.select("page_id", *columns)


_html_query("title_length", "title_length")
_html_query("internal_js_cnt", "internal_js_cnt")
_html_query("external_js_cnt", "external_js_cnt")
_html_query("charset", "charset")
_html_query("has_iframe", "has_iframe")
_html_query("hyperlink_cnt", "hyperlink_cnt")


@query("code_size", HTML_CTE + "SELECT page_id, code_size FROM marks")
def code_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resources(spark, sf_dir).select(
        "page_id", html.code_size(F.col("html_text")).alias("code_size")
    )


@query("is_html5", HTML_CTE + "SELECT page_id, is_html5 FROM marks")
def is_html5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resources(spark, sf_dir).select(
        "page_id", html.is_html5(F.col("html_text")).alias("is_html5")
    )


@query(
    "html_features",
    HTML_CTE
    + """SELECT page_id, code_size, is_html5, title_length, internal_js_cnt, external_js_cnt,
      charset, has_iframe, hyperlink_cnt FROM marks""",
)
def html_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resources(spark, sf_dir).withColumns(
        {
            "code_size": html.code_size(F.col("html_text")),
            "is_html5": html.is_html5(F.col("html_text")),
        }
    )
    registry = html.default_registry()
    return registry.apply(rows).select("page_id", "code_size", "is_html5", *registry.names())


@query(
    "lambda_registry",
    HTML_CTE
    + """SELECT page_id, title_length,
      CAST(coalesce(len(regexp_extract_all(mk, '(?i)<p[\\s/>]')), 0) AS INTEGER) AS paragraph_cnt
    FROM marks""",
)
def lambda_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = html.default_registry().add(
        "paragraph_cnt",
        lambda markup: F.coalesce(F.regexp_count(markup, F.lit(r"(?i)<p[\s/>]")), F.lit(0)),
    )
    found = registry.apply(
        resources(spark, sf_dir), names=["title_length", "paragraph_cnt"]
    )
    return found.select("page_id", "title_length", "paragraph_cnt")


# ---------------------------------------------------------------- dates and math

ID_YEAR = "year(make_timestamp(CAST(('0x' || substr(id, 1, 8)) AS BIGINT) * 1000000))"
STAMP_YEAR = "CAST(floor(last_available_timestamp / 10000000000) AS BIGINT)"


@query("objectid_year", RES_CTE + f"SELECT page_id, {ID_YEAR} AS id_year FROM res")
def objectid_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resources(spark, sf_dir).select(
        "page_id", dates.objectid_year(F.col("id")).alias("id_year")
    )


@query("stamp_year", RES_CTE + f"SELECT page_id, {STAMP_YEAR} AS stamp_year FROM res")
def stamp_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resources(spark, sf_dir).select(
        "page_id", dates.stamp_year(F.col("last_available_timestamp")).alias("stamp_year")
    )


@query(
    "tobit_label",
    RES_CTE + f"SELECT page_id, coalesce({STAMP_YEAR}, {ID_YEAR}) - 1990 AS label FROM res",
)
def tobit_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = dates.tobit_label(F.col("last_available_timestamp"), F.col("id"))
    return resources(spark, sf_dir).select("page_id", label.alias("label"))


@query(
    "age_label",
    RES_CTE
    + f"""SELECT page_id, label FROM (SELECT page_id,
        coalesce({STAMP_YEAR}, {ID_YEAR}) - coalesce(first_appear, {ID_YEAR}) AS label FROM res)
      WHERE label >= 0""",
)
def age_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = dates.age_label(
        F.col("first_appear"), F.col("last_available_timestamp"), F.col("id")
    )
    rows = resources(spark, sf_dir).select("page_id", label.alias("label"))
    return rows.filter(F.col("label") >= 0)


@query(
    "chronology",
    RES_CTE + f"SELECT page_id, coalesce({STAMP_YEAR}, {ID_YEAR}) AS timestamp_coef FROM res",
)
def chronology(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = dates.last_year(F.col("last_available_timestamp"), F.col("id"))
    return resources(spark, sf_dir).select("page_id", year.alias("timestamp_coef"))


@query(
    "wayback_label",
    RES_CTE
    + """SELECT page_id, CASE WHEN from_waybackmachine = 1 THEN 0 ELSE 1 END AS wayback_label
      FROM res""",
)
def wayback_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = dates.wayback_label(F.col("from_waybackmachine"))
    return resources(spark, sf_dir).select("page_id", label.alias("wayback_label"))


@query(
    "log_features",
    """SELECT l_orderkey, l_linenumber, l_partkey, """
    + ", ".join(f"round(ln({c} + 1e-11), 6) AS log_{c}" for c in LINE_X)
    + " FROM lineitem",
)
def log_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        *[F.round(numeric.shifted_log(F.col(c)), 6).alias(f"log_{c}") for c in LINE_X],
    )


# Predictions on the scaled label; the fixed mean and deviation undo the scaling.
SPAN_CTE = """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey,
    l_discount * 20 - 0.4 AS prediction, CAST(year(l_shipdate) AS DOUBLE) AS first_appear,
    least(l_quantity, 30) AS label FROM lineitem) """


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        (F.col("l_discount") * 20 - F.lit(0.4)).alias("prediction"),
        F.year("l_shipdate").cast("double").alias("first_appear"),
        F.least("l_quantity", F.lit(30.0)).alias("label"),
    )


@query(
    "life_span",
    SPAN_CTE
    + """SELECT l_orderkey, l_linenumber, l_partkey, round(s, 6) AS life_span FROM (
      SELECT *, prediction * 8.5 + 18.25 + 1990 - first_appear AS s FROM p) WHERE s >= 0""",
)
def life_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = dates.life_span(F.col("prediction"), F.col("first_appear"), 18.25, 8.5)
    return (
        _spans(spark, sf_dir)
        .withColumn("life_span", span)
        .filter(F.col("life_span") >= 0)
        .select("l_orderkey", "l_linenumber", "l_partkey", F.round("life_span", 6).alias("life_span"))
    )


@query(
    "actual_life_span",
    SPAN_CTE
    + """SELECT l_orderkey, l_linenumber, l_partkey, label + 1990 - first_appear AS actual_life_span
      FROM p WHERE label + 1990 - first_appear >= 0""",
)
def actual_life_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = dates.actual_life_span(F.col("label"), F.col("first_appear"))
    return (
        _spans(spark, sf_dir)
        .withColumn("actual_life_span", span)
        .filter(F.col("actual_life_span") >= 0)
        .select("l_orderkey", "l_linenumber", "l_partkey", "actual_life_span")
    )


@query(
    "death_count",
    SPAN_CTE
    + """SELECT l_orderkey, l_linenumber, l_partkey, round(d, 6) AS death_count FROM (
      SELECT *, prediction * 8.5 + 18.25 + 1990 - 2021 AS d FROM p) WHERE d > 0 AND label = 30""",
)
def death_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = dates.years_left(F.col("prediction"), 18.25, 8.5)
    return (
        _spans(spark, sf_dir)
        .withColumn("death_count", left)
        .filter((F.col("death_count") > 0) & (F.col("label") == 30))
        .select(
            "l_orderkey", "l_linenumber", "l_partkey", F.round("death_count", 6).alias("death_count")
        )
    )


@query("scalar_pandas_udf", "SELECT l_orderkey, l_orderkey + 1 AS plus_one FROM lineitem")
def scalar_pandas_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", numeric.plus_one(F.col("l_orderkey")).alias("plus_one")
    )
