"""No rows lost to triggers, nulls or NaN; no pattern whose time grows with the square of a page."""

import math
import time

import pytest
from pyspark.sql import functions as F

from perdura.functions import html
from perdura.operators import aggregates, column_stats, evaluate, grouptests
from perdura.operators.quantiles import exact_quantiles, running_totals
from perdura.operators.sampling import stratified_split
from perdura.operators.transforms import FrequencyEncoder
from perdura.streaming import jobs

NAN = float("nan")


@pytest.mark.parametrize("opener", ["<!--", "<script>", "<style>", "<title>", "<script ", "<title "])
def test_a_page_of_unclosed_openers_takes_linear_time(spark, opener):
    page = opener * (1_000_000 // len(opener))
    df = spark.createDataFrame([(page,)], "html_text string")
    start = time.time()
    html.default_registry().apply(df).collect()
    assert time.time() - start < 20  # the square of the page would take minutes


def test_stream_keeps_rows_of_many_triggers_and_drops_replays(spark, tmp_path):
    schema = "id long, ts timestamp, v double"
    rows = spark.range(1000).select(
        F.col("id"), F.timestamp_seconds(F.pmod(F.col("id") * 7919, F.lit(1000)) * 3600).alias("ts"), F.lit(1.0).alias("v")
    )
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for _ in range(2):
        rows.repartition(6).write.mode("append").json(source)
        jobs.ingest_stream(
            jobs.stream_json(spark, source, schema, files_per_trigger=1), target, state, "id", "ts"
        ).awaitTermination()
        stored = spark.read.schema(schema).parquet(target)
        assert (stored.count(), stored.select("id").distinct().count()) == (1000, 1000)


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("per_bin", [5, 1000])
def test_running_totals_keep_null_and_nan(spark, descending, per_bin):
    values = [None, NAN, float("inf"), *map(float, range(48))]
    df = spark.createDataFrame([(v, 1) for v in values], "x double, n int")
    got = running_totals(df, "x", ["n"], descending, per_bin).collect()
    order = sorted(values, key=lambda v: (v is not None, v != v, v if v == v and v is not None else 0), reverse=descending)
    at = {repr(v): i + 1 for i, v in enumerate(order)}
    assert {repr(r["x"]): r["cum_n"] for r in got} == at


def test_nan_is_missing(spark):
    rows = [("a", 1, 1.0, 2.0), ("a", 1, 3.0, 2.5), ("b", 0, 5.0, 5.5), ("b", 0, 8.0, 7.0)]
    spoilt = [*rows, ("a", 1, NAN, 1.0), ("b", 0, NAN, 1.0)]
    schema = "g string, f int, x double, p double"
    results = []
    for data in (rows, spoilt):
        df = spark.createDataFrame(data, schema)
        flag = F.col("f") == 1
        results.append([
            sorted(map(tuple, aggregates.mean_trend(df, None, "g", ["x"]).collect())),
            aggregates.group_mean_diff(df, flag, ["x"]).collect(),
            sorted(map(tuple, aggregates.histogram(df, "x", 4).collect())),
            sorted(map(tuple, aggregates.survival_curve(df, "x", 4).collect())),
            evaluate.regression_metrics(df, "x", "p").collect(),
            grouptests.welch_statistic(df, flag, "x").collect(),
            grouptests.chi_square_statistic(df, F.col("x") * F.col("x")).collect(),
        ])
    assert results[0] == results[1]


@pytest.mark.parametrize("kind, values", [("boolean", [True, True, False, True]), ("double", [1e7, 1e7, 2e7, 1e7])])
def test_frequency_keys_are_those_of_the_cast(spark, kind, values):
    df = spark.createDataFrame([(v,) for v in values], f"c {kind}")
    got = FrequencyEncoder(inputCol="c").fit(df).transform(df)
    assert [r["c"] for r in got.collect()] == [0.75, 0.75, 0.25, 0.75]


def test_quantiles_keep_infinite_values(spark):
    v = [float("-inf"), -1e9, -5.0, 0.0, 2.0, 1e300, -1e300, float("inf"), float("inf"), None, float("nan")]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    got = exact_quantiles(df, "v", [0.0, 0.125, 0.5, 0.9, 1.0])[""]
    assert got == [float("-inf"), -1e300, 0.0, float("inf"), float("inf")]


def test_any_number_of_strata(spark):
    df = spark.range(40_000).select("id", (F.col("id") % 20_000).alias("k"))
    split = stratified_split(df, "k", ["id"], 0.5)
    counts = split.groupBy("k").agg(F.sum("is_train").alias("t"), F.count("*").alias("n"))
    assert counts.count() == 20_000 and counts.where("t <> 1 or n <> 2").count() == 0


def test_column_stats_in_one_scan_tell_one_two_and_more_values(spark, monkeypatch):
    nan, n = float("nan"), 300
    columns = {
        "one": [7.0] * n, "two": [1.0, 2.0] * (n // 2), "three": [1.0, 3.0] * (n // 2 - 1) + [2.0, 1.0],
        "one_gone": [7.0] * (n - 1) + [None], "two_gone": [1.0] * (n - 2) + [2.0, nan], "none": [None] * n,
        "late_two": [None] * (n - 2) + [5.0, 6.0], "late_one": [nan] * (n - 1) + [5.0],
        "late_many": [None] * (n - 3) + [5.0, 6.0, 7.0], "zeros": [0.0, -0.0] * (n // 2), "far": [1e300, -1e300] * (n // 2),
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns)).coalesce(1)
    scans = []
    between = column_stats._strictly_between
    monkeypatch.setattr(column_stats, "_strictly_between", lambda v, b: scans.append(sorted(b)) or between(v, b))
    got = column_stats.column_stats(df, list(columns))
    want = {"one": 1, "two": 2, "three": 3, "one_gone": 2, "two_gone": 3, "none": 1, "late_two": 3, "late_one": 2,
            "late_many": 3, "zeros": 1, "far": 2}
    assert {c: s.distinct for c, s in got.items()} == want
    assert scans == [["v6", "v8"]]
    assert got["three"].mean == sum(columns["three"]) / n and math.isclose(got["two"].variance, 0.25)
    assert math.isnan(got["none"].mean)
    assert column_stats.column_stats(df.limit(0), ["one"])["one"].distinct == 1
