"""Fitted transforms, models, search and evaluation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.feature import StringIndexer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perdura.functions.numeric import LOG_SHIFT, linear_prediction
from perdura.operators import evaluate, grouptests, search, tobit, trees
from perdura.operators import transforms as t
from perdura.operators.caching import cached
from perdura.operators.linear import (
    REPORT_SCHEMA,
    coefficient_report,
    elastic_net_path,
    grid_scores,
    ols,
    selected_features,
)
from perdura.operators.logistic import grid_auc, grid_report
from perdura.operators.moments import gram
from perdura.operators.relational import stack_tagged, study_sides
from perdura.operators.sampling import fold_column, train_test_split
from perdura.operators.sides import JoinSides
from perdura.operators.stages import DeviationCrossValidator, DeviationEvaluator
from perdura.plans import standins
from perdura.plans.catalog_tables import hash_sql
from perdura.plans.recipe import PAGE_COLUMNS, RECIPES, URL_COLUMNS, Recipe, StudyRecipe, picked_columns
from perdura.plans.registry import query, table
from perdura.plans.standins import HTML_SQL, LINE_X, STUDY_SQL, URL_SQL, line_frame
from perdura.sources.schemas import PUBLICATION_FEATURES
from perdura.sources.staging import stage_table

LINE_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
LIMITS = tobit.Censoring(right=30.0)
TOBIT_SCHEMA = (
    "C double, alpha double, intercept double, "
    + ", ".join(f"{c} double" for c in LINE_X)
    + ", sigma double, loglik double"
)


def cdf_sql(a: str) -> str:
    """Normal CDF by the power series of erf, exact to rounding for |a| < 4."""
    x = f"(({a}) / sqrt(2.0::DOUBLE))"
    terms = (
        f"list_sum(list_transform(range(0, 80), lambda i_: (CASE WHEN i_ % 2 = 0 THEN 1 ELSE -1 END)"
        f" * pow({x}, 2 * i_ + 1) / (gamma(i_ + 1.0::DOUBLE) * (2 * i_ + 1))))"
    )
    return f"(0.5::DOUBLE + {terms} / sqrt(pi()))"


def t_p_value_sql(t: str, df: str) -> str:
    """Two-sided p-value of t for large df, by its normalising transform."""
    z = f"(({t}) * (1 - 1 / (4.0::DOUBLE * ({df}))) / sqrt(1 + ({t}) * ({t}) / (2.0::DOUBLE * ({df}))))"
    return f"CASE WHEN abs({t}) > 5 THEN 0 ELSE 2 * (1 - {cdf_sql(f'abs({z})')}) END"


def zscore_sql(*columns: str) -> str:
    return ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in columns)


def scaled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model rows: z-scored features, label censored at 30."""
    rows = line_frame(spark, sf_dir)
    scaler = t.PopulationScaler(passCols=[*LINE_KEYS, "l_returnflag"])
    return scaler.fit(rows).transform(rows)


# ---------------------------------------------------------------- fitted transforms


@query(
    "frequency_encode",
    """WITH f AS (SELECT lang, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share
      FROM documents WHERE doc_id % 4 <> 0 GROUP BY lang)
    SELECT d.doc_id, round(coalesce(f.share, 0), 9) AS lang
    FROM documents d LEFT JOIN f ON d.lang = f.lang""",
)
def frequency_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    model = t.FrequencyEncoder(inputCol="lang").fit(docs.filter(F.col("doc_id") % 4 != 0))
    return model.transform(docs).withColumn("lang", F.round("lang", 9))


@query(
    "frequency_index",
    """WITH f AS (SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, p_brand) - 1 AS idx
      FROM part GROUP BY p_brand)
    SELECT p_partkey, CAST(idx AS DOUBLE) AS brand_index FROM part JOIN f USING (p_brand)""",
)
def frequency_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    indexer = StringIndexer(
        inputCol="p_brand", outputCol="brand_index", stringOrderType="frequencyDesc"
    )
    return indexer.fit(part).transform(part).select("p_partkey", "brand_index")


ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in LINE_X)


@query(
    "standardize",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, is_return, {ROUNDED}, label FROM (
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {zscore_sql(*LINE_X)},
        CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_return,
        least(l_quantity, 30) AS label FROM lineitem)""",
)
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    rows = line_frame(spark, sf_dir).withColumn("is_return", flag).drop("l_returnflag")
    out = t.PopulationScaler(passCols=list(LINE_KEYS)).fit(rows).transform(rows)
    return out.withColumns({c: F.round(c, 6) for c in LINE_X})


@query(
    "tobit_standardize",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(y AS DOUBLE) AS first_appear,
      round(z, 6) AS scaled_first_appear, round(l_tax, 6) AS l_tax, label FROM (
      SELECT *, year(l_shipdate) AS y,
        (year(l_shipdate) - avg(year(l_shipdate)) OVER ()) / stddev_pop(year(l_shipdate)) OVER () AS z,
        least(l_quantity, 30) AS label FROM (SELECT * REPLACE (
          (l_tax - m) / s AS l_tax) FROM lineitem, (SELECT avg(l_tax) AS m, stddev_pop(l_tax) AS s
          FROM lineitem)))""",
)
def tobit_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        *LINE_KEYS,
        F.year("l_shipdate").cast("double").alias("first_appear"),
        "l_tax",
        F.least("l_quantity", F.lit(30.0)).alias("label"),
    )
    scaler = t.PopulationScaler(passCols=list(LINE_KEYS), keepRaw=["first_appear"])
    out = scaler.fit(rows).transform(rows)
    return out.withColumns({c: F.round(c, 6) for c in ("scaled_first_appear", "l_tax")})


@query(
    "label_scale",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, label, round(
      (label - avg(label) OVER ()) / stddev_pop(label) OVER (), 6) AS scaled, label AS restored
    FROM (SELECT *, least(l_quantity, 30) AS label FROM lineitem)""",
)
def label_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_frame(spark, sf_dir).select(*LINE_KEYS, "label")
    model = t.LabelScaler().fit(rows)
    scaled = model.transform(rows.withColumn("raw", F.col("label")))
    back = model.inverse(scaled.withColumn("restored", F.col("label")), "restored")
    return back.select(
        *LINE_KEYS,
        F.col("raw").alias("label"),
        F.round("label", 6).alias("scaled"),
        F.round("restored", 6).alias("restored"),
    )


@query(
    "low_variance",
    """SELECT l_orderkey, l_quantity, l_extendedprice, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END
      AS is_return FROM lineitem""",
)
def low_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At p = 0.005 the discount and tax columns vary too little and go."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("is_return"),
    )
    return t.LowVarianceFilter(threshold=0.005).fit(rows).transform(rows)


def sides_of_study(spark: SparkSession, sf_dir: str, truncated: bool = False) -> JoinSides:
    return study_sides(
        standins.resources(spark, sf_dir),
        standins.bridge(spark, sf_dir),
        standins.paper(spark, sf_dir),
        standins.publication_features(spark, sf_dir),
        truncated,
    )


def study_rows(spark: SparkSession, sf_dir: str, truncated: bool = False) -> DataFrame:
    return sides_of_study(spark, sf_dir, truncated).joined()


def _recipe_sql(truncated: bool, scaled: bool, with_url: bool) -> str:
    """The recipe over the stand-in tables, step by step in SQL."""
    flags = ["protocol_type", "has_www", "has_iframe", *t.url.DUMMY_SUFFIXES]
    numbers = [
        "url_depth", "subdomain_level", "param_cnt", "title_length", "internal_js_cnt",
        "external_js_cnt", "hyperlink_cnt", *PUBLICATION_FEATURES,
    ]
    filled = ", ".join(f"coalesce({c}, 0) AS {c}" for c in PUBLICATION_FEATURES)
    dummies = ", ".join(
        f"CAST(suffix_idx = '{s}' AS INTEGER) AS \"{s}\"" for s in t.url.DUMMY_SUFFIXES
    )
    stamp = "CAST(floor(last_available_timestamp / 10000000000) AS BIGINT)"
    made = "year(make_timestamp(CAST(('0x' || substr(id, 1, 8)) AS BIGINT) * 1000000))"
    quoted = [f'"{c}"' for c in flags]

    def z(c: str) -> str:
        # a column of fewer than three values stays as it is; the lone value of
        # a wider type is cast so both engines agree
        return (
            f"CASE WHEN count(DISTINCT {c}) OVER () < 3 THEN CAST({c} AS DOUBLE) ELSE "
            f"({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0) END"
        )

    if scaled:
        body = [*quoted, *[f"round({z(c)}, 6) AS {c}" for c in numbers]]
        body += [f"round({z('charset')}, 6) AS charset", "first_appear"]
        body += [f"round({z('first_appear')}, 6) AS scaled_first_appear"]
    else:
        body = [*quoted, *numbers, "charset", "first_appear"]
    body += ["label"] + (["url"] if with_url else [])
    charset = (
        "count(*) OVER (PARTITION BY charset) / CAST(count(*) OVER () AS DOUBLE)"
        if scaled
        else "charset"
    )
    labels = "label = 0" if truncated else "label IN (0, 1)"
    study = STUDY_SQL.replace("r.label IN (0, 1)", f"r.{labels}")
    urls = URL_SQL.replace("FROM res)", "FROM study)", 1)
    pages = HTML_SQL.replace("FROM res)", "FROM parts)", 1)
    return f"""WITH {study}, {urls}, {pages},
      base AS (SELECT coalesce({stamp}, {made}) - 1990 AS label,
        CASE scheme WHEN 'http' THEN 1 WHEN 'https' THEN 0 END AS protocol_type,
        url, first_appear, url_depth, has_www, subdomain_level, param_cnt, title_length,
        internal_js_cnt, external_js_cnt, {charset} AS charset, has_iframe, hyperlink_cnt,
        {filled}, {dummies}
      FROM marks WHERE regexp_matches(suffix_idx, '^[a-zA-Z]{{2,63}}$'))
      SELECT {', '.join(body)} FROM base"""


def _recipe_query(name: str, recipe: str, truncated: bool, sql: str | None) -> None:
    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = StudyRecipe(RECIPES[recipe]).fit_transform(sides_of_study(spark, sf_dir, truncated))
        whole = [c for c, kind in out.dtypes if kind == "double" and c != "first_appear"]
        return out.withColumns({c: F.round(c, 6) for c in whole})


_recipe_query("feature_recipe", "untruncated", False, _recipe_sql(False, True, True))
_recipe_query("feature_recipe_truncated", "truncated", True, _recipe_sql(True, True, False))
_recipe_query("feature_recipe_raw", "raw", False, _recipe_sql(False, False, True))


def _editions_sql() -> str:
    stamp = "CAST(floor(last_available_timestamp / 10000000000) AS BIGINT)"
    made = "year(make_timestamp(CAST(('0x' || substr(id, 1, 8)) AS BIGINT) * 1000000))"
    urls = URL_SQL.replace("FROM res)", "FROM study)", 1)
    parts = [
        f"SELECT 'edition_{i}' AS edition, count(*) AS row_cnt, round(avg(age), 6) AS avg_label "
        f"FROM aged {'WHERE html_text IS NOT NULL' if i == 4 else ''}"
        for i in range(1, 7)
    ]
    return f"""WITH {STUDY_SQL}, {urls},
      aged AS (SELECT html_text, coalesce({stamp}, {made}) - first_appear AS age FROM parts
        WHERE regexp_matches(suffix_idx, '^[a-zA-Z]{{2,63}}$')
          AND coalesce({stamp}, {made}) - first_appear >= 0)
      {' UNION ALL '.join(parts)}"""


@query("recipe_editions", _editions_sql())
def recipe_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and label mean of every edition of the recipe."""
    sides = sides_of_study(spark, sf_dir)
    out = None
    for name in sorted(r for r in RECIPES if r.startswith("edition")):
        made = StudyRecipe(RECIPES[name]).fit_transform(sides)
        line = made.agg(
            F.lit(name).alias("edition"),
            F.count("*").alias("row_cnt"),
            F.round(F.avg("label"), 6).alias("avg_label"),
        )
        out = line if out is None else out.unionByName(line)
    return out


def _edition_sql(name: str, columns: Sequence[str]) -> str:
    """An edition's rows, step by step in SQL; a column that the variance filter drops is null."""
    r = RECIPES[name]
    stamp = "CAST(floor(last_available_timestamp / 10000000000) AS BIGINT)"
    made = "year(make_timestamp(CAST(('0x' || substr(id, 1, 8)) AS BIGINT) * 1000000))"
    age = f"coalesce({stamp}, {made}) - first_appear"
    urls = URL_SQL.replace("FROM res)", "FROM study)", 1)
    pages = HTML_SQL.replace("FROM res)", "FROM parts)", 1)
    share = "count({0}) OVER (PARTITION BY {0}) / CAST(count({0}) OVER () AS DOUBLE)"
    raw = {c: c for c in (*URL_COLUMNS, *PAGE_COLUMNS, "is_port_access", "first_appear")}
    raw |= {c: f"coalesce({c}, 0)" for c in PUBLICATION_FEATURES}
    raw |= {s: f"CAST(suffix_idx = '{s}' AS INTEGER)" for s in t.url.DUMMY_SUFFIXES}
    raw["protocol_type"] = "CASE scheme WHEN 'http' THEN 1 WHEN 'https' THEN 0 END"
    raw["suffix"] = share.format("suffix")
    if r.encode:
        raw[r.encode] = share.format("scheme" if r.encode == "protocol_type" else r.encode)
    quoted = {c: f'"{c}"' for c in columns}

    def z(c: str) -> str:
        q = quoted[c]
        distinct = f"(count(DISTINCT {q}) OVER () + max(CASE WHEN {q} IS NULL THEN 1 ELSE 0 END) OVER ())"
        few, low = f"{distinct} < 3", ""
        if (p := r.low_variance) is not None:
            low = f"WHEN var_pop({q}) OVER () < CASE WHEN {distinct} = 2 THEN {p * (1 - p)} ELSE {p} END THEN NULL "
        return (
            f"round(CASE {low}WHEN {few} THEN CAST({q} AS DOUBLE) ELSE "
            f"({q} - avg({q}) OVER ()) / nullif(stddev_pop({q}) OVER (), 0) END, 6) AS {q}"
        )

    base = ", ".join(f"{raw[c]} AS {quoted[c]}" for c in columns)
    logged = ", ".join(f"CASE WHEN {c} + {LOG_SHIFT} > 0 THEN ln({c} + {LOG_SHIFT}::DOUBLE) END AS {c}" if c in r.log_columns else q for c, q in quoted.items())
    return f"""WITH {STUDY_SQL}, {urls}, {pages},
      base AS (SELECT {base}, {age} AS label FROM marks
        WHERE regexp_matches(suffix_idx, '^[a-zA-Z]{{2,63}}$') AND {age} >= 0
        {"AND html_text IS NOT NULL" if r.drop_empty_html else ""}),
      logged AS (SELECT {logged}, label FROM base)
      SELECT {", ".join(map(z, columns))}, CAST(label AS DOUBLE) AS label FROM logged"""


def _edition_columns(r: Recipe) -> list[str]:
    """Output columns of a recipe before its variance filter, but for the label."""
    names = []
    for c in picked_columns(r):
        names += t.url.DUMMY_SUFFIXES if c == "suffix_idx" else [c]
    return [c for c in names if c not in (*r.drop, "label")]


def _edition_query(name: str, columns: Sequence[str]) -> None:
    @query(f"recipe_{name}", _edition_sql(name, columns))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = StudyRecipe(RECIPES[name]).fit_transform(sides_of_study(spark, sf_dir))
        made = {c: F.col(c) if c in out.columns else F.lit(None) for c in (*columns, "label")}
        return out.select(*(F.round(v.cast("double"), 6).alias(c) for c, v in made.items()))


for _name, _recipe in RECIPES.items():
    if _name.startswith("edition"):
        _edition_query(_name, _edition_columns(_recipe))


# ---------------------------------------------------------------- Tobit


def _tobit_rows(spark: SparkSession, fits: Sequence[tobit.TobitFit]) -> DataFrame:
    return spark.createDataFrame(
        [
            (float(f.c), float(f.alpha), f.intercept, *map(float, f.coef), f.sigma, f.loglik)
            for f in fits
        ],
        TOBIT_SCHEMA,
    )


# A point at which sums are evaluated (intercept, weights, deviation).
PROBE = (20.0, 0.5, -0.25, 0.1, 9.0)


def _probe_sums(spark: SparkSession, sf_dir: str) -> tobit.Sums:
    with tobit.TobitRows(scaled_lines(spark, sf_dir), LINE_X, "label", LIMITS) as rows:
        return rows.sums(np.array(PROBE), rows.products())


def probe_sql(intercept: float = 20.0) -> str:
    """Rows with scaled residual z, censored argument a, and the features."""
    return f"""WITH z AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
        least(l_quantity, 30) AS y, {zscore_sql(*LINE_X)} FROM lineitem),
      q AS (SELECT *, ({intercept} + 0.5 * l_extendedprice - 0.25 * l_discount + 0.1 * l_tax)
        AS xb FROM z),
      r AS (SELECT *, (y - xb) / 9.0::DOUBLE AS z, y >= 30 AS held FROM q),
      c AS (SELECT *, CASE WHEN held THEN {cdf_sql("-z")} END AS cdf FROM r),
      k AS (SELECT *, CASE WHEN held THEN ln(cdf)
          ELSE -0.5 * z * z - ln(9.0::DOUBLE) - 0.5 * ln(2 * pi()) END AS ll,
        CASE WHEN held THEN exp(-0.5 * z * z) / sqrt(2 * pi()) / cdf ELSE z END AS pull,
        CASE WHEN held THEN exp(-0.5 * z * z) / sqrt(2 * pi()) / cdf * z ELSE z * z - 1 END AS down
        FROM c) """


@query(
    "tobit_loglik",
    probe_sql()
    + """SELECT round(sum(ll), 4) AS loglik, round(sum(ll) - 49.8 * (20 + 0.5 + 0.25 + 0.1 + 9), 4)
      AS penalised FROM k""",
)
def tobit_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = float(_probe_sums(spark, sf_dir).value[0])
    cost = tobit.penalty(np.array([PROBE]), np.array([49.8]), np.array([0.0]))
    return spark.createDataFrame(
        [(round(value, 4), round(value - float(cost[0]), 4))], "loglik double, penalised double"
    )


@query(
    "tobit_gradient",
    probe_sql()
    + " UNION ALL ".join(
        f"SELECT '{n}' AS parameter, round(sum({e}) / 9.0::DOUBLE, 4) AS gradient FROM k"
        for n, e in [("intercept", "pull"), *[(c, f"pull * {c}") for c in LINE_X], ("sigma", "down")]
    ),
)
def tobit_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["intercept", *LINE_X, "sigma"]
    gradient = _probe_sums(spark, sf_dir).gradient[0]
    rows = [(n, round(float(g), 4)) for n, g in zip(names, gradient)]
    return spark.createDataFrame(rows, "parameter string, gradient double")


@query("tobit_fit")
def tobit_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    with tobit.TobitRows(scaled_lines(spark, sf_dir), LINE_X, "label", LIMITS) as rows:
        return _tobit_rows(spark, rows.fit([(49.8, 1.0)]))


@query("tobit_fixed_sigma")
def tobit_fixed_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 weight 1..9 with the deviation kept at its least-squares value."""
    with tobit.TobitRows(scaled_lines(spark, sf_dir), LINE_X, "label", LIMITS) as rows:
        settings = [(float(c), 1.0) for c in range(1, 10)]
        return _tobit_rows(spark, rows.fit(settings, fixed_sigma=True))


PREDICT = {"l_extendedprice": 0.5, "l_discount": -0.25, "l_tax": 0.1}


@query(
    "tobit_predict",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(20 + 0.5 * l_extendedprice
      - 0.25 * l_discount + 0.1 * l_tax, 6) AS prediction FROM (
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {zscore_sql(*LINE_X)} FROM lineitem)""",
)
def tobit_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tobit.TobitModel(
        features=list(PREDICT), coefficients=list(PREDICT.values()), intercept=20.0, sigma=9.0
    )
    out = model.transform(scaled_lines(spark, sf_dir))
    return out.select(*LINE_KEYS, F.round("prediction", 6).alias("prediction"))


def _model(**more) -> tobit.TobitModel:
    return tobit.TobitModel(
        features=list(PREDICT), labelCol="label", coefficients=list(PREDICT.values()),
        intercept=20.0, sigma=9.0, censorLeft=LIMITS.left, censorRight=LIMITS.right,
        C=49.8, alpha=1.0, **more,
    )


@query(
    "tobit_row_loglik",
    probe_sql()
    + "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(ll, 6) AS loglik FROM k",
)
def tobit_row_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _model().with_row_loglik(scaled_lines(spark, sf_dir))
    return out.select(*LINE_KEYS, F.round("loglik", 6).alias("loglik"))


@query(
    "tobit_score",
    f"""SELECT a.loglik, b.compat FROM ({probe_sql()} SELECT round(sum(ll), 4) AS loglik FROM k) a,
      ({probe_sql(0.0)} SELECT round(sum(ll) - 49.8 * (0.5 + 0.25 + 0.1 + 9), 4) AS compat FROM k) b""",
)
def tobit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled_lines(spark, sf_dir)
    scores = [tuple(round(_model().score(rows, compat), 4) for compat in (False, True))]
    return spark.createDataFrame(scores, "loglik double, compat double")


@query(
    "censor_split",
    """SELECT CASE WHEN label <= 5 THEN 'left' WHEN label >= 30 THEN 'right' ELSE 'middle' END AS part,
      count(*) AS cnt FROM (SELECT least(l_quantity, 30) AS label FROM lineitem) GROUP BY 1""",
)
def censor_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = tobit.censor_class(F.col("label"), tobit.Censoring(5.0, 30.0))
    return line_frame(spark, sf_dir).groupBy(part.alias("part")).agg(F.count("*").alias("cnt"))


# The penalty grid of the search up to C = 10.
GRID_C = [0.0, *np.logspace(-3, 0, 11).tolist(), *map(float, range(1, 10))]
GRID_ALPHA = np.arange(0.1, 1.05, 0.05).tolist()


@query("tobit_grid")
def tobit_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 399 settings of the grid; every scan serves all of them."""
    settings = [(c, a) for c in GRID_C for a in GRID_ALPHA]
    found = tobit.tobit_grid(scaled_lines(spark, sf_dir), LINE_X, "label", LIMITS, settings)
    return _tobit_rows(spark, [f for f, _ in found])


@query("tobit_grid_cv")
def tobit_grid_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean held-out log-likelihood of all 399 settings over 5 folds; every scan serves all of them."""
    settings = [(c, a) for c in GRID_C for a in GRID_ALPHA]
    found = tobit.tobit_grid(
        scaled_lines(spark, sf_dir), LINE_X, "label", LIMITS, settings, fold_column(LINE_KEYS, 5)
    )
    rows = [(float(f.c), float(f.alpha), f.loglik, score) for f, score in found]
    return spark.createDataFrame(
        rows, "C double, alpha double, loglik double, held_out_loglik double"
    )


@query("kfold_tobit")
def kfold_tobit(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, best = tobit.kfold_best(
        scaled_lines(spark, sf_dir), LINE_X, "label", LIMITS, fold_column(LINE_KEYS, 10), 10
    )
    rows = [(i, s, bool(s == max(scores)), best.sigma) for i, s in enumerate(scores)]
    return spark.createDataFrame(
        rows, "fold int, held_out_loglik double, best boolean, best_sigma double"
    )


@query("bootstrap_tobit")
def bootstrap_tobit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1000 refits at C = 49.8, alpha = 1."""
    fits = tobit.bootstrap(scaled_lines(spark, sf_dir), LINE_X, "label", LIMITS, LINE_KEYS)
    return _tobit_rows(spark, fits)


@query("bootstrap_tobit_stratified")
def bootstrap_tobit_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1000 refits on resamples exact in each label, with their quality on the rows as they are."""
    found = tobit.stratified_bootstrap(scaled_lines(spark, sf_dir), LINE_X, "label", LIMITS, LINE_KEYS)
    lines = [
        (i, r.fit.intercept, *map(float, r.fit.coef), r.fit.sigma, r.pseudo_r2, r.rmse, r.loglik)
        for i, r in enumerate(found)
    ]
    numbers = ", ".join(f"{c} double" for c in ("intercept", *LINE_X, "sigma", "pseudo_r2", "rmse", "loglik"))
    return spark.createDataFrame(lines, f"replicate int, {numbers}")


@query("aic")
def aic(spark: SparkSession, sf_dir: str) -> DataFrame:
    with tobit.TobitRows(scaled_lines(spark, sf_dir), LINE_X, "label", LIMITS) as rows:
        fit = rows.fit([(0.0, 1.0)])[0]
    value = tobit.aic(fit.loglik, len(fit.theta))
    return spark.createDataFrame([(fit.loglik, value)], "loglik double, aic double")


# ---------------------------------------------------------------- linear models

# The elastic-net grid (6 ratios by 20 penalties).
NET_RATIO = [0.0, *np.logspace(-3, 0, 5).tolist()]
NET_ALPHA = np.logspace(-3, -2, 20).tolist()
NET_GRID = [(a, r) for r in NET_RATIO for a in NET_ALPHA]


def _split_gram(spark: SparkSession, sf_dir: str):
    parts = train_test_split(scaled_lines(spark, sf_dir), LINE_KEYS, 0.7)
    return [gram(p, LINE_X, "label")[0] for p in parts]


def _performance(
    spark: SparkSession, sf_dir: str, settings: Sequence[tuple[float, float]]
) -> DataFrame:
    train, test = _split_gram(spark, sf_dir)
    fits = elastic_net_path(train, settings)
    rows = search.performance_rows("Train", train, settings, fits)
    rows += search.performance_rows("Test", test, settings, fits)
    return spark.createDataFrame(rows, search.performance_schema(LINE_X))


@query("elastic_net")
def elastic_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _performance(spark, sf_dir, NET_GRID).filter(F.col("dataset") == "Train")


@query("performance_matrix")
def performance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _performance(spark, sf_dir, NET_GRID)


@query("lasso_select")
def lasso_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = gram(scaled_lines(spark, sf_dir), LINE_X, "label")[0]
    fit = elastic_net_path(stats, [(0.059, 1.0)])[0]
    kept = selected_features(fit, LINE_X, keep=("l_tax",))
    rows = [(f, float(b), f in kept) for f, b in zip(LINE_X, fit.coef)]
    return spark.createDataFrame(rows, "feature string, coefficient double, kept boolean")


@query("grid_search")
def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10-fold mean squared error of the elastic-net grid; one scan for all folds."""
    rows = scaled_lines(spark, sf_dir).withColumn("fold", fold_column(LINE_KEYS, 10))
    folds = gram(rows, LINE_X, "label", "fold", 10)
    scored = [
        (float(a), float(r), mse)
        for (a, r), (mse, _) in zip(NET_GRID, grid_scores(folds, NET_GRID))
    ]
    best = min(s[2] for s in scored)
    return spark.createDataFrame(
        [(*s, s[2] == best) for s in scored],
        "alpha double, l1_ratio double, mse double, best boolean",
    )


@query("grid_search_verbose")
def grid_search_verbose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forest settings fitted side by side, scored on train and test."""
    rows = trees.assemble(scaled_lines(spark, sf_dir), LINE_X)
    train, test = train_test_split(rows, LINE_KEYS, 0.7)
    settings = search.combinations({"depth": [3, 6, 11], "leaf": [100, 232]})
    models = trees.fit_forests(train, [trees.forest(**setting) for setting in settings])
    tagged = train.withColumn("dataset", F.lit("Train")).unionByName(test.withColumn("dataset", F.lit("Test")))
    cells = models[0].cells_of(tagged, "dataset")

    def run(setting: dict) -> list[tuple]:
        scored = models[settings.index(setting)].transform(cells)
        m = evaluate.grouped_metrics(scored, "n", "mean", "variance", "prediction", ["dataset"]).collect()
        m = {r["dataset"]: r for r in m}
        return [(setting["depth"], setting["leaf"], tag, m[tag]["mse"], m[tag]["r2"]) for tag in ("Train", "Test")]

    found = search.fit_each(settings, run)
    return spark.createDataFrame(
        [row for part in found for row in part],
        "depth int, leaf int, dataset string, mse double, r2 double",
    )


@query(
    "param_grid",
    """WITH top AS (SELECT greatest(abs(covar_pop(l_extendedprice, y)), abs(covar_pop(l_discount, y)),
        abs(covar_pop(l_tax, y))) AS l1_max FROM (SELECT *, least(l_quantity, 30) AS y FROM lineitem)),
      a AS (SELECT unnest([1.0, 0.5, 0.1, 0.01]) AS share), r AS (SELECT unnest([0.1, 0.55, 1.0]) AS l1_ratio)
    SELECT round(l1_max * CAST(share AS DOUBLE) / CAST(l1_ratio AS DOUBLE), 6) AS alpha,
      CAST(l1_ratio AS DOUBLE) AS l1_ratio FROM top, a, r""",
)
def param_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Penalty grid below the value at which the data's largest covariance gives
    an empty model, times the ratios: two lists exploded, not a cross join."""
    y = F.col("label")
    top = line_frame(spark, sf_dir).agg(
        F.greatest(*[F.abs(F.covar_pop(F.col(c), y)) for c in LINE_X]).alias("l1_max")
    )
    shares = F.explode(F.array(*[F.lit(s) for s in (1.0, 0.5, 0.1, 0.01)]))
    ratios = F.explode(F.array(*[F.lit(r) for r in (0.1, 0.55, 1.0)]))
    grid = top.withColumn("share", shares).withColumn("l1_ratio", ratios)
    alpha = F.col("l1_max") * F.col("share") / F.col("l1_ratio")
    return grid.select(F.round(alpha, 6).alias("alpha"), "l1_ratio")


@query(
    "generalization_gap",
    f"""WITH s AS (SELECT l_returnflag, CASE WHEN {hash_sql(*LINE_KEYS)} < 0.7 THEN 'Train' ELSE 'Test'
        END AS dataset, least(l_quantity, 30) AS y, 18 + 40 * l_discount AS p FROM lineitem),
      m AS (SELECT l_returnflag, dataset, 1 - avg((y - p) * (y - p)) / var_pop(y) AS r2
        FROM s GROUP BY 1, 2)
    SELECT l_returnflag, round(max(r2) FILTER (WHERE dataset = 'Train')
      - max(r2) FILTER (WHERE dataset = 'Test'), 6) AS gap FROM m GROUP BY 1""",
)
def generalization_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_frame(spark, sf_dir).withColumn("p", 18 + 40 * F.col("l_discount"))
    tagged = stack_tagged(*train_test_split(rows, LINE_KEYS, 0.7))
    scores = tagged.groupBy("l_returnflag", "dataset").agg(
        evaluate.r2(F.col("label"), F.col("p")).alias("r2")
    )
    gap = evaluate.generalization_gap(scores, ["l_returnflag"])
    return gap.withColumn("gap", F.round("gap", 6))


OLS_SQL = f"""WITH z AS (SELECT least(l_quantity, 30) AS y, {zscore_sql(*LINE_X)} FROM lineitem),
  m AS (SELECT count(*) AS n, avg(y) AS my, var_pop(y) AS vy,
    corr(l_extendedprice, l_discount) AS a, corr(l_extendedprice, l_tax) AS b, corr(l_discount, l_tax) AS c,
    covar_pop(l_extendedprice, y) AS c1, covar_pop(l_discount, y) AS c2, covar_pop(l_tax, y) AS c3 FROM z),
  i AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS d FROM m),
  s AS (SELECT *, ((1 - c * c) * c1 + (b * c - a) * c2 + (a * c - b) * c3) / d AS b1,
    ((b * c - a) * c1 + (1 - b * b) * c2 + (a * b - c) * c3) / d AS b2,
    ((a * c - b) * c1 + (a * b - c) * c2 + (1 - a * a) * c3) / d AS b3 FROM i),
  e AS (SELECT *, (vy - b1 * c1 - b2 * c2 - b3 * c3) / (n - 4) AS u FROM s),
  f AS (SELECT 'Constant' AS feature, my AS v, sqrt(u) AS se, n FROM e
    UNION ALL SELECT 'l_extendedprice', b1, sqrt(u * (1 - c * c) / d), n FROM e
    UNION ALL SELECT 'l_discount', b2, sqrt(u * (1 - b * b) / d), n FROM e
    UNION ALL SELECT 'l_tax', b3, sqrt(u * (1 - a * a) / d), n FROM e)
  SELECT feature, round(v, 4) AS coefficient, round(se, 3) AS standard_error,
    round(v / se, 3) AS t_value, round({t_p_value_sql("v / se", "(n - 1)")}, 3) AS probability FROM f"""


@query("ols_report", OLS_SQL)
def ols_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = gram(scaled_lines(spark, sf_dir), LINE_X, "label")[0]
    return spark.createDataFrame(coefficient_report(stats, ols(stats)), REPORT_SCHEMA)


@query(
    "ols_single",
    """SELECT round(regr_slope(l_extendedprice, l_quantity), 5) AS slope,
      round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept,
      round(regr_r2(l_extendedprice, l_quantity), 9) AS r2 FROM lineitem""",
)
def ols_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Gram solver on one feature, against the SQL regression functions."""
    stats = gram(table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice")[0]
    fit = ols(stats)
    row = (
        round(float(fit.coef[0]), 5), round(fit.intercept, 3),
        round(stats.r2(fit.intercept, fit.coef), 9),
    )
    return spark.createDataFrame([row], "slope double, intercept double, r2 double")


# ---------------------------------------------------------------- metrics


def _metric_query(name: str, column: Callable[[Column, Column], Column], sql: str) -> None:
    cte = """WITH s AS (SELECT least(l_quantity, 30) AS y, 18 + 40 * l_discount + 10 * l_tax AS p
      FROM lineitem) """

    @query(name, f"{cte} SELECT round({sql}, 6) AS {name} FROM s")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = linear_prediction({"l_discount": 40.0, "l_tax": 10.0}, 18.0)
        rows = line_frame(spark, sf_dir).withColumn("p", p)
        return rows.agg(F.round(column(F.col("label"), F.col("p")), 6).alias(name))


_metric_query("pseudo_r2", evaluate.pseudo_r2, "pow(corr(y, p), 2)")
_metric_query("mse", evaluate.mse, "avg((y - p) * (y - p))")
_metric_query("rmse", evaluate.rmse, "sqrt(avg((y - p) * (y - p)))")
_metric_query("r2", evaluate.r2, "1 - avg((y - p) * (y - p)) / var_pop(y)")


@query(
    "residual",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      round(least(l_quantity, 30) - (18 + 40 * l_discount), 6) AS residual FROM lineitem""",
)
def residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.col("label") - (18 + 40 * F.col("l_discount"))
    return line_frame(spark, sf_dir).select(*LINE_KEYS, F.round(gap, 6).alias("residual"))


SCORE_CTE = """WITH s AS (SELECT l.quality AS y, d.n_chars / (d.n_chars + 500.0::DOUBLE) AS p
    FROM documents d JOIN labels l USING (doc_id)),
  g AS (SELECT p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg
    FROM s GROUP BY p),
  c AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp,
    sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM g) """


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    score = F.col("n_chars") / (F.col("n_chars") + F.lit(500.0))
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select(
        F.col("quality").alias("y"), score.alias("p"), (score >= 0.5).cast("int").alias("said")
    )


@query("roc_curve", SCORE_CTE + "SELECT p AS threshold, fp / nn AS fpr, tp / np AS tpr FROM c")
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.roc_points(scored_documents(spark, sf_dir), "y", "p")


@query("auc", SCORE_CTE + "SELECT round(sum(neg * (tp - pos / 2)) / (max(np) * max(nn)), 9) AS auc FROM c")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = evaluate.auc(scored_documents(spark, sf_dir), "y", "p")
    return area.withColumn("auc", F.round("auc", 9))


@query(
    "classification_metrics",
    SCORE_CTE
    + """, k AS (SELECT unnest([0, 1]) AS class), e AS (SELECT class,
        count(*) FILTER (WHERE y = class AND CAST(p >= 0.5 AS INTEGER) = class) AS hit,
        count(*) FILTER (WHERE CAST(p >= 0.5 AS INTEGER) = class) AS said,
        count(*) FILTER (WHERE y = class) AS support,
        avg(CASE WHEN y = CAST(p >= 0.5 AS INTEGER) THEN 1.0 ELSE 0.0 END) AS acc,
        avg(greatest(0, 1 - CASE y WHEN 1 THEN p ELSE -p END)) AS hinge FROM s, k GROUP BY class)
    SELECT class, round(hit / said, 6) AS precision, round(hit / support, 6) AS recall,
      round(2 * hit / (said + support), 6) AS f1, support, round(acc, 6) AS accuracy,
      round(hinge, 6) AS hinge_loss FROM e""",
)
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_documents(spark, sf_dir)
    whole = rows.agg(
        F.struct(
            F.round(evaluate.accuracy(F.col("y"), F.col("said")), 6).alias("accuracy"),
            F.round(evaluate.hinge_loss(F.col("y"), F.col("p")), 6).alias("hinge_loss"),
        )
    ).scalar()
    report = evaluate.class_report(rows, "y", "said")
    return report.select(
        "class",
        *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
        "support",
        whole["accuracy"].alias("accuracy"),
        whole["hinge_loss"].alias("hinge_loss"),
    )


# ---------------------------------------------------------------- classification and trees

TEXT_X = ("chars", "lines", "words")


def labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.ln(F.col("n_chars").cast("double") + 1).alias("chars"),
        F.ln(F.regexp_count(text, F.lit("\n")) + F.lit(1.0)).alias("lines"),
        F.ln(F.regexp_count(text, F.lit(" ")) + F.lit(1.0)).alias("words"),
    )
    labels = table(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").cast("double").alias("label")
    )
    rows = docs.join(labels, "doc_id")
    scaler = t.PopulationScaler(passCols=["doc_id"])
    # texts are measured once; the fits read the narrow table
    rows = stage_table(rows, "texts")
    return trees.assemble(scaler.fit(rows).transform(rows), TEXT_X)


# The study's logistic grid (6 ratios by 20 strengths by 2 iteration bounds).
LOGISTIC_GRID = [(c, r, m) for r in NET_RATIO for c in np.logspace(-3, -2, 20).tolist() for m in (10, 50)]

AUC_PAIRS = 1e-3  # share of pairs that may count half: areas are right to half of it


@query("logistic")
def logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean held-out area under the ROC curve of all 240 settings over 10 folds."""
    scores = grid_auc(
        labelled_texts(spark, sf_dir), TEXT_X, "label", LOGISTIC_GRID, fold_column(["doc_id"], 10), 10, AUC_PAIRS
    )
    rows = [(f"C={c},l1_ratio={r},max_iter={m}", score) for (c, r, m), score in zip(LOGISTIC_GRID, scores)]
    return spark.createDataFrame(rows, "setting string, metric double")


@query("logistic_report")
def logistic_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients, and train and test metrics, of all 240 settings; a third of the documents is the test."""
    test = fold_column(["doc_id"], 3) == 0
    return grid_report(labelled_texts(spark, sf_dir), TEXT_X, "label", LOGISTIC_GRID, test, AUC_PAIRS)


@query("random_forest")
def random_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = train_test_split(trees.assemble(scaled_lines(spark, sf_dir), LINE_X), LINE_KEYS)
    model = trees.fit_forest(train, trees.forest())
    scored = model.transform(model.cells_of(test))
    return evaluate.grouped_metrics(scored, "n", "mean", "variance", "prediction")


@query("feature_importance")
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trees.assemble(scaled_lines(spark, sf_dir), LINE_X)
    model = trees.fit_forest(rows, trees.forest())
    found = trees.importance_rows(model, LINE_X)
    return spark.createDataFrame(found, "feature string, importance double")


@query("permutation_importance")
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled_lines(spark, sf_dir)
    model = trees.fit_forest(trees.assemble(rows, LINE_X), trees.forest())
    return trees.permutation_importance(model, rows, LINE_X, "label", LINE_KEYS)


@query("custom_stage")
def custom_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A custom estimator, evaluator and cross-validator working together."""
    rows = scaled_lines(spark, sf_dir).select(*LINE_X, "label", fold_column(LINE_KEYS, 3).alias("fold"))
    validator = DeviationCrossValidator(
        estimator=tobit.TobitRegression(features=list(LINE_X), censorRight=30.0),
        evaluator=DeviationEvaluator(),
        settings=[{"C": 0.0, "alpha": 1.0}, {"C": 49.8, "alpha": 1.0}],
        foldCol="fold",
    )
    return validator.scores(rows)


# ---------------------------------------------------------------- correlation and group tests

CORR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _pairs_sql(pairs: list[tuple[str, str]], extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r FROM lineitem {extra}"
        for a, b in pairs
    )


@query("corr_matrix", _pairs_sql([(a, b) for a in CORR for b in CORR]))
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grouptests.corr_matrix(table(spark, sf_dir, "lineitem").select(*CORR), CORR)
    return found.withColumn("r", F.round("r", 6))


@query(
    "corr_matrix_dead_alive",
    " UNION ALL ".join(
        f"SELECT '{state}' AS state, * FROM ({_pairs_sql([(a, b) for a in CORR[1:] for b in CORR[1:]], where)})"
        for state, where in (("dead", "WHERE l_quantity < 30"), ("alive", "WHERE l_quantity >= 30"))
    ),
)
def corr_matrix_dead_alive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    out = None
    for state, kept in (("dead", F.col("l_quantity") < 30), ("alive", F.col("l_quantity") >= 30)):
        part = grouptests.corr_matrix(rows.filter(kept).select(*CORR[1:]), CORR[1:])
        part = part.select(F.lit(state).alias("state"), "x", "y", F.round("r", 6).alias("r"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "corr_pairs_significant",
    _pairs_sql([(a, b) for i, a in enumerate(CORR) for b in CORR[i + 1 :]]),
)
def corr_pairs_significant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair with its r; level=0.05 keeps the significant ones."""
    found = grouptests.corr_pairs(table(spark, sf_dir, "lineitem").select(*CORR), CORR, None)
    return found.select("x", "y", F.round("r", 6).alias("r"))


def _p_sql(pairs: list[tuple[str, str]]) -> str:
    """(x, y, r, n) per pair with t = r sqrt((n - 2) / (1 - r^2))."""
    rows = " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS r, count(*) AS n FROM lineitem"
        for a, b in pairs
    )
    return f"(SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM ({rows}))"


@query(
    "corr_pairs_p",
    f"""SELECT x, y, round(r, 6) AS r, round({t_p_value_sql("t", "(n - 2)")}, 5) AS p
      FROM {_p_sql([(a, b) for i, a in enumerate(CORR) for b in CORR[i + 1 :]])}""",
)
def corr_pairs_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grouptests.corr_pairs(table(spark, sf_dir, "lineitem").select(*CORR), CORR, None)
    return found.select("x", "y", F.round("r", 6).alias("r"), F.round("p", 5).alias("p"))


@query(
    "corr_pvalues",
    f"""SELECT y AS feature, round(r, 6) AS r, round({t_p_value_sql("t", "(n - 2)")}, 4) AS p
      FROM {_p_sql([("l_quantity", c) for c in CORR[1:]])}""",
)
def corr_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(*CORR)
    found = grouptests.corr_with_target(rows, "l_quantity", CORR[1:])
    return found.withColumn("r", F.round("r", 6))


@query(
    "welch_t_test",
    """WITH g AS (SELECT l_returnflag = 'R' AS f, count(*) AS n, avg(l_quantity) AS m,
        var_samp(l_quantity) AS v FROM lineitem GROUP BY 1)
    SELECT round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t,
      round(pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1)
        + pow(b.v / b.n, 2) / (b.n - 1)), 3) AS df
    FROM g a, g b WHERE a.f AND NOT b.f""",
)
def welch_t_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    found = grouptests.welch_statistic(rows, F.col("l_returnflag") == "R", "l_quantity")
    return found.select(F.round("t", 6).alias("t"), F.round("df", 3).alias("df"))


@query(
    "chi_square",
    """SELECT round(sum(pow(q - m, 2)) / max(m), 3) AS chi_square, count(*) - 1 AS df
      FROM (SELECT q, avg(q) OVER () AS m FROM (
        SELECT pow(least(l_quantity, 30) - (18 + 40 * l_discount), 2) AS q FROM lineitem))""",
)
def chi_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.col("label") - (18 + 40 * F.col("l_discount"))
    found = grouptests.chi_square_statistic(line_frame(spark, sf_dir), gap * gap)
    return found.withColumn("chi_square", F.round("chi_square", 3))
