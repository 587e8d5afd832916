"""Sources, sinks, filters, joins, aggregates, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perdura.functions import html, numeric
from perdura.operators import aggregates as agg
from perdura.operators import relational as rel
from perdura.operators import sampling
from perdura.plans import standins
from perdura.plans.registry import query, table
from perdura.plans.standins import MAG_SQL, RESOURCE_SQL, STUDY_SQL, resources
from perdura.sources import readers, sinks
from perdura.sources.staging import new_table_path

RES_CTE = f"WITH {RESOURCE_SQL} "
# The hash fraction of hash_fraction(..., seed=77), as SQL.
HASH_SQL = "(('0x' || substr(md5({key} || '|77'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def hash_sql(*keys: str) -> str:
    return HASH_SQL.format(key=" || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys))


# ---------------------------------------------------------------- sources and sinks


@query("scan_parquet", "SELECT n_regionkey, count(*) AS nations FROM nation GROUP BY n_regionkey")
def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    readers.load_dataset(spark, f"{sf_dir}/nation.parquet", "study_nation")
    return spark.sql(
        "SELECT n_regionkey, count(*) AS nations FROM study_nation GROUP BY n_regionkey"
    )


def _json_lines(spark: SparkSession, sf_dir: str) -> str:
    """The web resources exported as JSON lines, every 25th line cut short."""
    rows = resources(spark, sf_dir)
    oid = F.create_map(F.lit("$oid"), F.col("id"))
    line = F.to_json(
        F.struct(
            oid.alias("_id"),
            "url",
            "first_appear",
            # some exports write numbers as text
            F.col("last_available_timestamp").cast("bigint").cast("string").alias(
                "last_available_timestamp"
            ),
            "header",
            "html_text",
            F.when(F.col("page_id") % 7 != 0, F.col("from_waybackmachine")).alias(
                "from_waybackmachine"
            ),
            F.when(F.col("page_id") % 10 != 0, F.col("label")).alias("label"),
        )
    )
    broken = F.col("page_id") % 25 == 24
    path = new_table_path(spark, "export")
    rows.select(F.when(broken, F.substring(line, 1, 60)).otherwise(line).alias("value")).write.text(
        path
    )
    return path


GOOD_LINES = "page_id % 25 <> 24 AND page_id % 7 <> 0 AND page_id % 10 <> 0"


@query(
    "ingest_json",
    RES_CTE
    + f"""SELECT id, url, first_appear, last_available_timestamp, length(html_text) AS html_chars,
      from_waybackmachine, label FROM res WHERE {GOOD_LINES}""",
)
def ingest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_resources(spark, _json_lines(spark, sf_dir)).select(
        "id",
        "url",
        "first_appear",
        "last_available_timestamp",
        F.length("html_text").alias("html_chars"),
        "from_waybackmachine",
        "label",
    )


@query(
    "ingest_bridge",
    RES_CTE + "SELECT id, CAST(page_id AS VARCHAR) AS pmid, '10.' || page_id AS doi FROM res",
)
def ingest_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "bridge")
    oid = F.create_map(F.lit("$oid"), F.col("id")).alias("_id")
    standins.bridge(spark, sf_dir).select(oid, "pmid", "doi").write.json(path)
    return readers.read_bridge(spark, path)


@query(
    "ingest_quarantine",
    f"""SELECT 'ok' AS status, count(*) AS lines FROM pages WHERE {GOOD_LINES}
    UNION ALL SELECT 'corrupt', count(*) FROM pages WHERE page_id % 25 = 24""",
)
def ingest_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = new_table_path(spark, "resources")
    sinks.ingest_resources(spark, _json_lines(spark, sf_dir), target)
    return spark.read.parquet(target).groupBy("status").agg(F.count("*").alias("lines"))


CSV_SCHEMA = "page_id bigint, url_length int, first_appear double, label int"
CSV_SQL = RES_CTE + "SELECT page_id, length(url) AS url_length, first_appear, label FROM res"


def _csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resources(spark, sf_dir).select(
        "page_id", F.length("url").alias("url_length"), "first_appear", "label"
    )


@query("csv_sink", CSV_SQL)
def csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "csv")
    sinks.write_csv(_csv_rows(spark, sf_dir), path)
    return readers.read_csv(spark, path, CSV_SCHEMA)


@query("csv_scan", "SELECT label, count(*) AS cnt FROM (" + CSV_SQL + ") GROUP BY label")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv_sink(spark, sf_dir).groupBy("label").agg(F.count("*").alias("cnt"))


@query("json_cache", RES_CTE + "SELECT id, label FROM res WHERE label IN (0, 1)")
def json_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "cache")

    def compute() -> DataFrame:
        return resources(spark, sf_dir).filter(F.col("label").isin(0, 1)).select("id", "label")

    sinks.cached_table(spark, path, compute)
    return sinks.cached_table(spark, path, compute)


@query("object_counts")
def object_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.object_counts(spark, sf_dir)


# ---------------------------------------------------------------- filters and projections


def _usable_sql(labels: str) -> str:
    return (
        RES_CTE
        + f"""SELECT page_id, url, label FROM res WHERE label IN ({labels})
          AND first_appear IS NOT NULL AND lower(url) NOT LIKE '%doi.org%'"""
    )


@query("resource_filter", _usable_sql("0, 1"))
def resource_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resources(spark, sf_dir).filter(rel.usable_resource()).select("page_id", "url", "label")


@query("truncated_switch", _usable_sql("0"))
def truncated_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = resources(spark, sf_dir).filter(rel.usable_resource(truncated=True))
    return kept.select("page_id", "url", "label")


@query(
    "hindex_gap_count",
    f"""WITH {MAG_SQL} SELECT count(*) AS cnt FROM mag WHERE first_author_hindex IS NOT NULL
      AND last_author_hindex IS NOT NULL AND first_author_hindex - last_author_hindex <> 0""",
)
def hindex_gap_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, last = F.col("first_author_hindex"), F.col("last_author_hindex")
    mag = standins.publication_features(spark, sf_dir)
    kept = mag.filter(first.isNotNull() & last.isNotNull() & (first - last != 0))
    return kept.agg(F.count("*").alias("cnt"))


@query("column_renamer", "SELECT n_nationkey AS nation_id, n_name, n_regionkey FROM nation")
def column_renamer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.rename_existing(
        table(spark, sf_dir, "nation"), {"n_nationkey": "nation_id", "absent": "x"}
    )


@query("feature_picker", "SELECT p_size, p_brand FROM part")
def feature_picker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.pick_existing(table(spark, sf_dir, "part"), ["p_size", "absent", "p_brand"])


@query("feature_remover", "SELECT p_partkey, p_name, p_brand FROM part")
def feature_remover(spark: SparkSession, sf_dir: str) -> DataFrame:
    dropped = ["p_type", "absent", "p_size", "p_retailprice"]
    return table(spark, sf_dir, "part").drop(*dropped)


@query(
    "value_mapper",
    RES_CTE
    + """SELECT page_id, CASE regexp_extract(lower(url), '^([a-z]+):', 1)
      WHEN 'http' THEN 1 WHEN 'https' THEN 0 END AS protocol_type FROM res""",
)
def value_mapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    scheme = F.regexp_extract(F.lower("url"), "^([a-z]+):", 1)
    return resources(spark, sf_dir).select(
        "page_id", numeric.map_values(scheme, {"http": 1, "https": 0}).alias("protocol_type")
    )


@query(
    "nan_to_zero",
    f"""WITH {MAG_SQL} SELECT paperId, coalesce(first_author_hindex, 0) AS first_author_hindex,
      coalesce(last_author_hindex, 0) AS last_author_hindex FROM mag""",
)
def nan_to_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["first_author_hindex", "last_author_hindex"]
    mag = standins.publication_features(spark, sf_dir)
    return mag.fillna(0, names).select("paperId", *names)


@query(
    "dropna_rows",
    RES_CTE
    + """SELECT page_id, first_appear, last_available_timestamp FROM res
      WHERE first_appear IS NOT NULL AND last_available_timestamp IS NOT NULL""",
)
def dropna_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["page_id", "first_appear", "last_available_timestamp"]
    return resources(spark, sf_dir).select(*names).na.drop()


@query(
    "binary_na",
    RES_CTE
    + """SELECT page_id, CASE WHEN first_appear IS NULL THEN 0 ELSE 1 END AS has_first_appear,
      CASE WHEN html_text IS NULL THEN 0 ELSE 1 END AS has_html_text FROM res""",
)
def binary_na(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resources(spark, sf_dir).select(
        "page_id",
        numeric.present(F.col("first_appear")).alias("has_first_appear"),
        numeric.present_text(F.col("html_text")).alias("has_html_text"),
    )


@query("empty_html_filter", RES_CTE + "SELECT page_id, url FROM res WHERE html_text IS NOT NULL")
def empty_html_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resources(spark, sf_dir).dropna(subset=["html_text"]).select("page_id", "url")


@query(
    "questionable_html",
    RES_CTE
    + """, k AS (SELECT html_text, coalesce(regexp_extract(lower(header),
         '"content-type": *"([^"]*)"', 1), '') AS kind FROM res WHERE html_text IS NULL)
    SELECT count(*) AS empty_html,
      count(*) FILTER (WHERE kind LIKE 'application/pdf%') AS empty_pdf,
      count(*) FILTER (WHERE kind NOT LIKE 'application/pdf%') AS empty_not_pdf,
      count(*) FILTER (WHERE kind LIKE 'application/json%') AS empty_json FROM k""",
)
def questionable_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resources(spark, sf_dir).withColumn("kind", html.content_type(F.col("header")))
    return agg.questionable_html(rows, "html_text", "kind")


@query(
    "prefix_exclude",
    RES_CTE + "SELECT page_id, url FROM res WHERE NOT starts_with(url, 'https://DOI.org')",
)
def prefix_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resources(spark, sf_dir)
    return rows.filter(~F.startswith("url", F.lit("https://DOI.org"))).select("page_id", "url")


@query(
    "sample_rows",
    f"SELECT o_orderkey, o_custkey FROM orders WHERE {hash_sql('o_orderkey')} < 0.03",
)
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return sampling.hash_sample(orders, ["o_orderkey"], 0.03)


@query(
    "train_test_split",
    f"""SELECT o_orderkey, CASE WHEN {hash_sql('o_orderkey')} < 0.67 THEN 'Train' ELSE 'Test' END
      AS dataset FROM orders""",
)
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return rel.stack_tagged(*sampling.train_test_split(orders, ["o_orderkey"], 0.67))


@query(
    "stratified_split",
    f"""SELECT o_orderkey, o_orderpriority, CASE WHEN row_number() OVER (
        PARTITION BY o_orderpriority ORDER BY {hash_sql('o_orderkey')})
        <= ceil(0.7 * count(*) OVER (PARTITION BY o_orderpriority)) THEN 1 ELSE 0 END AS is_train
      FROM orders""",
)
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return sampling.stratified_split(orders, "o_orderpriority", ["o_orderkey"], 0.7)


# ---------------------------------------------------------------- joins

LINE_ID = "CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR)"

STAR_SQL = f"""WITH wr AS (SELECT {LINE_ID} AS id, l_orderkey,
    CAST(year(l_shipdate) AS DOUBLE) AS first_appear, l_linenumber % 3 - 1 AS label,
    CASE WHEN l_linenumber = 7 THEN 'https://DOI.org/' ELSE 'http://a.org/' END || l_partkey AS url
    FROM lineitem),
  bridge AS (SELECT DISTINCT {LINE_ID} AS id, l_orderkey AS doi FROM lineitem)
  SELECT wr.id, wr.url, wr.first_appear, wr.label, c.c_custkey AS paperId,
    c.c_acctbal AS avg_hindex, CAST(c.c_nationkey AS DOUBLE) AS num_of_author
  FROM wr JOIN bridge b ON wr.id = b.id JOIN orders o ON b.doi = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  WHERE wr.label IN (0, 1) AND lower(wr.url) NOT LIKE '%doi.org%'"""


@query("resource_star_join", STAR_SQL)
def resource_star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    oid = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey")
    host = F.when(F.col("l_linenumber") == 7, "https://DOI.org/").otherwise("http://a.org/")
    resource = lines.select(
        oid.alias("id"),
        F.concat(host, F.col("l_partkey").cast("string")).alias("url"),
        F.year("l_shipdate").cast("double").alias("first_appear"),
        (F.col("l_linenumber") % 3 - 1).alias("label"),
    )
    bridge = lines.select(oid.alias("id"), F.col("l_orderkey").alias("doi")).distinct()
    paper = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doi"), F.col("o_custkey").alias("paperId")
    )
    mag = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("paperId"),
        F.col("c_acctbal").alias("avg_hindex"),
        F.col("c_nationkey").cast("double").alias("num_of_author"),
    )
    return rel.extract_study_rows(resource, bridge, paper, mag)


@query(
    "study_extract",
    f"WITH {STUDY_SQL} SELECT id, url, label, paperId, avg_year, num_of_author_citing FROM study",
)
def study_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.extract_study_rows(
        resources(spark, sf_dir),
        standins.bridge(spark, sf_dir),
        standins.paper(spark, sf_dir),
        standins.publication_features(spark, sf_dir),
    ).select("id", "url", "label", "paperId", "avg_year", "num_of_author_citing")


META_SQL = """meta AS (SELECT o.o_orderkey AS paper_id, count(l.l_partkey) AS author_cnt,
    count(DISTINCT l.l_suppkey) AS org_cnt
  FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey)"""

# A paper cites the papers its customer's number points at.
REF_SQL = """refs AS (SELECT o_orderkey AS paper_id, o_custkey AS reference_id FROM orders
    WHERE o_orderkey % 5 <> 0
  UNION ALL SELECT o_orderkey, o_orderkey + 1 FROM orders WHERE o_orderkey % 3 = 0)"""


def _papers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    paper = orders.select(F.col("o_orderkey").alias("paper_id"))
    authorship = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("paper_id"),
        F.col("l_partkey").alias("author_id"),
        F.col("l_suppkey").alias("affiliation_id"),
    )
    key = F.col("o_orderkey")
    reference = (
        orders.filter(key % 5 != 0)
        .select(key.alias("paper_id"), F.col("o_custkey").alias("reference_id"))
        .unionByName(
            orders.filter(key % 3 == 0).select(
                key.alias("paper_id"), (key + 1).alias("reference_id")
            )
        )
    )
    return paper, authorship, reference


@query("paper_meta", f"WITH {META_SQL} SELECT * FROM meta")
def paper_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    paper, authorship, _ = _papers(spark, sf_dir)
    return rel.paper_meta(paper, authorship)


REF_COUNT_SQL = f"""WITH {META_SQL}, {REF_SQL}
  SELECT o.o_orderkey AS paper_id, CAST(sum(m.org_cnt) AS BIGINT) AS cnt_org_cited,
    count(m.paper_id) AS cnt_paper_cited, CAST(sum(m.author_cnt) AS BIGINT) AS cnt_author_cited
  FROM orders o LEFT JOIN refs r ON o.o_orderkey = r.paper_id
  LEFT JOIN meta m ON r.reference_id = m.paper_id GROUP BY o.o_orderkey"""


@query("paper_ref_count", REF_COUNT_SQL)
def paper_ref_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    paper, authorship, reference = _papers(spark, sf_dir)
    return rel.reference_counts(paper, reference, rel.paper_meta(paper, authorship))


@query("paper_ref_count_sink", REF_COUNT_SQL)
def paper_ref_count_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "reference-counts")
    sinks.overwrite_parquet(paper_ref_count(spark, sf_dir), path)
    return spark.read.parquet(path)


@query(
    "citation_left_join",
    f"""WITH {REF_SQL} SELECT o.o_orderkey AS paper_id, count(r.reference_id) AS reference_cnt,
      count(c.c_custkey) AS customer_cnt FROM orders o
    LEFT JOIN refs r ON o.o_orderkey = r.paper_id
    LEFT JOIN customer c ON r.reference_id = c.c_custkey GROUP BY o.o_orderkey""",
)
def citation_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    paper, _, reference = _papers(spark, sf_dir)
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("reference_id"), F.lit(1).alias("known")
    )
    # the reference side first: papers without references never meet under one null key
    counts = (
        reference.join(customer, "reference_id", "left")
        .groupBy("paper_id")
        .agg(F.count("reference_id").alias("reference_cnt"), F.count("known").alias("customer_cnt"))
    )
    none = F.lit(0).cast("long")
    return paper.select("paper_id").join(counts, "paper_id", "left").select(
        "paper_id",
        F.coalesce("reference_cnt", none).alias("reference_cnt"),
        F.coalesce("customer_cnt", none).alias("customer_cnt"),
    )


@query(
    "join_first_match",
    """WITH f AS (SELECT l_orderkey, l_quantity, l_partkey, row_number() OVER (
        PARTITION BY l_orderkey ORDER BY l_quantity, l_partkey) AS rn FROM lineitem)
    SELECT o.o_orderkey, o.o_totalprice, f.l_quantity, f.l_partkey
    FROM orders o JOIN f ON o.o_orderkey = f.l_orderkey AND f.rn = 1""",
)
def join_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_quantity", "l_partkey"
    )
    sample = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return rel.join_first_match(sample, full, "o_orderkey", ["l_quantity", "l_partkey"])


# ---------------------------------------------------------------- aggregates


@query(
    "label_proportion",
    STAR_SQL.replace(
        "SELECT wr.id, wr.url", "SELECT label, count(*) AS cnt, count(*) / "
        "CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM (SELECT wr.id, wr.url"
    )
    + ") GROUP BY label",
)
def label_proportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.shares(resource_star_join(spark, sf_dir), "label")


@query(
    "label_distribution",
    """SELECT CASE l_linenumber % 3 - 1 WHEN -1 THEN 'Dead' WHEN 0 THEN 'From Wayback Machine'
      ELSE 'Alive' END AS label_name, count(*) AS cnt,
      count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM lineitem GROUP BY 1""",
)
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = agg.label_names(F.col("l_linenumber") % 3 - 1)
    return agg.shares(table(spark, sf_dir, "lineitem").select(label.alias("label_name")), "label_name")


@query(
    "citing_total",
    f"""WITH {REF_SQL} SELECT count(*) AS row_cnt, CAST(sum(reference_id) AS BIGINT) AS citing_sum,
      count(DISTINCT paper_id) AS distinct_rows FROM refs""",
)
def citing_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, reference = _papers(spark, sf_dir)
    return reference.agg(
        F.count("*").alias("row_cnt"),
        F.sum("reference_id").alias("citing_sum"),
        F.count_distinct("paper_id").alias("distinct_rows"),
    )


COUNTED = ("url", "first_appear", "last_available_timestamp", "html_text", "label")


def _union(rows: list[str]) -> str:
    return RES_CTE + " UNION ALL ".join(rows)


@query(
    "unique_counts",
    _union(
        [
            f"SELECT '{c}' AS column_name, count(DISTINCT {c}) + "
            f"max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS unique_count FROM res"
            for c in COUNTED
        ]
        + ["SELECT 'total', count(*) FROM res"]
    ),
)
def unique_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.unique_counts(resources(spark, sf_dir), COUNTED)


@query(
    "na_counts",
    _union(
        [
            f"SELECT '{c}' AS column_name, count(*) - count({c}) AS na_count FROM res"
            for c in COUNTED
        ]
        + ["SELECT 'total', count(*) FROM res"]
    ),
)
def na_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.na_counts(resources(spark, sf_dir), COUNTED)


@query(
    "dedup_url",
    """SELECT doc_id, lang, n_chars FROM (SELECT *, row_number() OVER (
      PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""",
)
def dedup_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    # texts meet by digest: the texts themselves are neither shuffled nor sorted
    docs = table(spark, sf_dir, "documents").select(F.md5("text").alias("digest"), "doc_id", "lang", "n_chars")
    first = rel.first_per_key(docs, ["digest"], ["doc_id"])
    return first.select("doc_id", "lang", "n_chars")


@query("value_counts", "SELECT lang, count(*) AS cnt FROM documents GROUP BY lang")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.value_counts(table(spark, sf_dir, "documents"), "lang")


@query(
    "mean_trend",
    """SELECT l_returnflag, l_linenumber, round(avg(l_quantity), 6) AS mean_l_quantity,
      round(avg(l_discount), 6) AS mean_l_discount FROM lineitem GROUP BY 1, 2""",
)
def mean_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = ["l_quantity", "l_discount"]
    trend = agg.mean_trend(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linenumber", metrics)
    return trend.withColumns({f"mean_{m}": F.round(f"mean_{m}", 6) for m in metrics})


POLAR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "group_mean_diff",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg({c}) FILTER (WHERE l_returnflag = 'R') - "
        f"avg({c}) FILTER (WHERE l_returnflag <> 'R'), 2) AS mean_diff FROM lineitem"
        for c in POLAR
    ),
)
def group_mean_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.group_mean_diff(
        table(spark, sf_dir, "lineitem"), F.col("l_returnflag") == "R", POLAR
    )


@query(
    "polarity_split",
    """SELECT CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS polarity, l_linestatus,
      count(*) AS cnt, round(avg(l_quantity), 6) AS avg_quantity, round(avg(l_tax), 6) AS avg_tax
    FROM lineitem GROUP BY 1, 2""",
)
def polarity_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    polarity = F.when(F.col("l_returnflag") == "R", 0).otherwise(1)
    rows = table(spark, sf_dir, "lineitem").withColumn("polarity", polarity)
    return rows.groupBy("polarity", "l_linestatus").agg(
        F.count("*").alias("cnt"),
        F.round(F.avg(agg.present("l_quantity")), 6).alias("avg_quantity"),
        F.round(F.avg(agg.present("l_tax")), 6).alias("avg_tax"),
    )


@query(
    "quantile_band",
    """WITH p AS (SELECT round(o_totalprice, -3) AS prediction,
        o_totalprice - round(o_totalprice, -3) AS residual FROM orders),
      q AS (SELECT quantile_cont(prediction, 0.01) AS q01, quantile_cont(prediction, 0.35) AS q35,
        quantile_cont(prediction, 0.75) AS q75, quantile_cont(prediction, 0.9) AS q90,
        min(prediction) AS lo, max(prediction) AS hi FROM p),
      m AS (SELECT prediction AS mid FROM p GROUP BY 1 ORDER BY count(*) DESC, prediction LIMIT 1),
      b AS (SELECT CASE WHEN prediction < q01 THEN 'low'
          WHEN prediction > q35 AND prediction < q75 THEN 'middle'
          WHEN prediction > q90 THEN 'high' END AS band, residual FROM p, q)
    SELECT band, CASE band WHEN 'low' THEN lo WHEN 'middle' THEN mid ELSE hi END AS at,
      round(quantile_cont(residual, 0.1), 6) AS lower, round(quantile_cont(residual, 0.9), 6) AS upper
    FROM b, q, m WHERE band IS NOT NULL GROUP BY band, lo, mid, hi""",
)
def quantile_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    rows = table(spark, sf_dir, "orders").select(
        F.round(price, -3).alias("prediction"), (price - F.round(price, -3)).alias("residual")
    )
    band = agg.quantile_band(rows, "prediction", "residual")
    return band.withColumns({"lower": F.round("lower", 6), "upper": F.round("upper", 6)})


HIST_SQL = """WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
  SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 140.0::DOUBLE)), 139) AS INTEGER) AS bin,
    count(*) AS cnt FROM orders, e GROUP BY 1"""


@query("histogram", HIST_SQL)
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.histogram(table(spark, sf_dir, "orders"), "o_totalprice")


@query(
    "survival_curve",
    f"""SELECT bin, cnt, CAST(sum(cnt) OVER (ORDER BY bin DESC) AS BIGINT) AS alive
      FROM ({HIST_SQL})""",
)
def survival_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.survival_curve(table(spark, sf_dir, "orders"), "o_totalprice")


@query(
    "box_stats",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(quantile_cont({c}, 0.25), 6) AS q1, "
        f"round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q3 "
        "FROM lineitem"
        for c in POLAR
    ),
)
def box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = agg.box_stats(table(spark, sf_dir, "lineitem"), POLAR)
    return found.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


# ---------------------------------------------------------------- sorts, limits, sets


@query(
    "extremes",
    """SELECT * FROM ((SELECT o_orderkey, o_totalprice, 'low' AS side FROM orders
      ORDER BY o_totalprice, o_orderkey LIMIT 3)
    UNION ALL (SELECT o_orderkey, o_totalprice, 'high' FROM orders
      ORDER BY o_totalprice DESC, o_orderkey LIMIT 3))""",
)
def extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return rel.extremes(orders, "o_totalprice", "o_orderkey")


@query("sort_by", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey")
def sort_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return orders.orderBy("o_totalprice", "o_orderkey")


@query("limit_preview", f"SELECT * FROM ({REF_COUNT_SQL}) ORDER BY paper_id LIMIT 10")
def limit_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paper_ref_count(spark, sf_dir).orderBy("paper_id").limit(10)


@query(
    "union_sets",
    f"""SELECT CASE WHEN {hash_sql('o_orderkey')} < 0.7 THEN 'Train' ELSE 'Test' END AS dataset,
      count(*) AS cnt, round(avg(o_totalprice), 4) AS avg_price FROM orders GROUP BY 1""",
)
def union_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = sampling.train_test_split(table(spark, sf_dir, "orders"), ["o_orderkey"], 0.7)
    return (
        rel.stack_tagged(*parts)
        .groupBy("dataset")
        .agg(F.count("*").alias("cnt"), F.round(F.avg("o_totalprice"), 4).alias("avg_price"))
    )
