"""Joins, quantiles, running totals, sampling and sources on small and skewed data."""

import json

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from perdura.operators import aggregates as agg
from perdura.operators import quantiles, sampling
from perdura.operators import relational as rel
from perdura.sources import readers, sinks
from perdura.sources.schemas import RESOURCE
from perdura.sources.staging import new_table_path


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key and one value."""
    rng = np.random.default_rng(3)
    n = 30_000
    value = rng.lognormal(sigma=3, size=n)
    value[: n // 3] = 1.0
    key = np.where(np.arange(n) < n // 3, "hot", rng.integers(0, 50, n).astype(str))
    rows = [(int(i), str(k), float(v)) for i, (k, v) in enumerate(zip(key, value))]
    return spark.createDataFrame(rows, "id long, k string, v double").repartition(7).cache()


def test_exact_quantiles_with_small_brackets(spark, skewed, monkeypatch):
    monkeypatch.setattr(quantiles, "COLLECT_ROWS", 50)
    probs = [0.0, 0.01, 0.25, 0.333, 0.5, 0.9, 0.999, 1.0]
    got = quantiles.exact_quantiles(skewed, "v", probs)[""]
    want = np.quantile(np.array([r["v"] for r in skewed.select("v").collect()]), probs)
    assert np.allclose(got, want, rtol=1e-12)


def test_exact_quantiles_per_group(spark, skewed, monkeypatch):
    monkeypatch.setattr(quantiles, "COLLECT_ROWS", 200)
    got = quantiles.exact_quantiles(skewed, "v", [0.1, 0.5], "k")
    pdf = skewed.toPandas()
    for k, part in pdf.groupby("k"):
        assert np.allclose(got[k], np.quantile(part.v, [0.1, 0.5]), rtol=1e-12)


def test_quantiles_leave_missing_values_out(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    assert quantiles.exact_quantiles(df, "v", [0.5])[""] == [2.0]


@pytest.mark.parametrize("most, accuracy", [(50_000, 10_000), (300, 100)])
def test_flat_quantiles_equal_percentiles(spark, monkeypatch, most, accuracy):
    """Several columns at once, with ties, infinite and missing values, through one and many narrowings."""
    monkeypatch.setattr(quantiles, "COLLECT_ROWS", most)
    rng, n, inf = np.random.default_rng(most), 3000, float("inf")
    columns = {
        "smooth": rng.normal(size=n), "ties": rng.integers(0, 3, n).astype(float), "two": np.repeat([1.0, 2.0], n // 2),
        "wide": rng.lognormal(0, 30, n), "ends": np.r_[[inf] * 500, [-inf] * 500, rng.normal(size=n - 1000)],
        "same": np.full(n, 4.0), "near": 1.0 + rng.integers(0, 9, n) * 2.0**-52,
    }
    rows = [(i, *map(float, r)) for i, r in enumerate(zip(*columns.values()))]
    rows += [(n, *[float("nan")] * len(columns)), (n + 1, *[None] * len(columns))]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in columns)).repartition(4)
    probs = [0.0, 0.25, 0.999, 1.0] if most > 1000 else [0.3]
    got = quantiles.flat_quantiles(df, {c: F.col(c) for c in [*columns]} | {"none": F.lit(None)}, probs, accuracy)
    assert got.pop("none") is None
    for c, values in columns.items():
        values = np.sort(values)
        for p, q in zip(probs, got[c]):
            spot = (n - 1) * p
            low, high = values[int(np.floor(spot))], values[int(np.ceil(spot))]
            assert q == (low if low == high else low + (spot - np.floor(spot)) * (high - low)), (c, p)


def test_flat_quantiles_see_a_sketch_that_misses(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "COLLECT_ROWS", 100)
    monkeypatch.setattr(quantiles.F, "percentile_approx", lambda v, ends, a: F.array(*[F.max(v) for _ in ends]))
    df = spark.range(500).select(F.col("id").cast("double").alias("v"))
    assert quantiles.flat_quantiles(df, {"v": F.col("v")}, [0.1, 0.5])["v"] == pytest.approx([49.9, 249.5])


@pytest.mark.parametrize("descending", [True, False])
def test_running_totals_in_bins_equal_one_window(spark, descending):
    rng = np.random.default_rng(1)
    x = np.unique(np.concatenate([rng.normal(size=3000), rng.exponential(size=3000) * 1e6]))
    df = spark.createDataFrame([(float(v), int(i % 5)) for i, v in enumerate(x)], "x double, c int")
    small = quantiles.running_totals(df, "x", ["c"], descending, rows_per_bin=10**6)
    binned = quantiles.running_totals(df, "x", ["c"], descending, rows_per_bin=100)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, binned.collect()))


def test_first_per_key_matches_row_number(spark, skewed):
    got = rel.first_per_key(skewed, ["k"], ["v", "id"])
    pdf = skewed.toPandas().sort_values(["v", "id"]).groupby("k").first()
    assert {r["k"]: r["id"] for r in got.collect()} == pdf["id"].to_dict()
    assert got.columns == skewed.columns


def test_first_match_does_not_multiply_rows(spark, skewed):
    sample = spark.createDataFrame([("hot",), ("hot",), ("7",), ("none",)], "k string")
    out = rel.join_first_match(sample, skewed, "k", ["id"])
    assert sorted(r["k"] for r in out.collect()) == ["7", "hot", "hot"]


def test_reference_counts_on_a_much_cited_paper(spark):
    papers = spark.range(200).withColumnRenamed("id", "paper_id")
    authors = spark.createDataFrame(
        [(0, a, a % 3) for a in range(300)] + [(5, 1, 1), (5, 1, 2)],
        "paper_id long, author_id long, affiliation_id long",
    )
    refs = papers.filter("paper_id < 150").select("paper_id", F.lit(0).cast("long").alias("reference_id"))
    refs = refs.unionByName(spark.createDataFrame([(1, 5), (199, 999)], refs.schema))
    meta = rel.paper_meta(papers, authors)
    got = {r["paper_id"]: r for r in rel.reference_counts(papers, refs, meta).collect()}
    assert len(got) == 200
    assert (got[1]["cnt_org_cited"], got[1]["cnt_paper_cited"], got[1]["cnt_author_cited"]) == (5, 2, 302)
    # no known reference: null sums, zero papers
    assert (got[199]["cnt_org_cited"], got[199]["cnt_paper_cited"]) == (None, 0)


def test_missing_counts_and_unique_counts(spark):
    df = spark.createDataFrame(
        [(1.0, "a"), (float("nan"), "a"), (None, None), (1.0, "b")], "x double, s string"
    )
    na = {r["column_name"]: r["na_count"] for r in agg.na_counts(df, ["x", "s"]).collect()}
    assert na == {"x": 2, "s": 1, "total": 4}
    unique = {r["column_name"]: r["unique_count"] for r in agg.unique_counts(df, ["x", "s"]).collect()}
    assert unique == {"x": 2, "s": 3, "total": 4}


def test_histogram_of_a_constant_has_one_bin(spark):
    df = spark.createDataFrame([(2.0,)] * 5, "x double")
    assert [tuple(r) for r in agg.histogram(df, "x").collect()] == [(0, 5)]


def test_survival_starts_with_all_rows(spark, skewed):
    curve = agg.survival_curve(skewed, "v").orderBy("bin").collect()
    assert curve[0]["alive"] == skewed.count()
    assert all(a["alive"] > b["alive"] for a, b in zip(curve, curve[1:]))


def test_stratified_split_is_exact(spark, skewed, monkeypatch):
    monkeypatch.setattr(quantiles, "COLLECT_ROWS", 100)
    out = sampling.stratified_split(skewed, "k", ["id"], 0.7)
    counts = out.groupBy("k").agg(F.sum("is_train").alias("t"), F.count("*").alias("n")).collect()
    assert all(r["t"] == int(np.ceil(round(0.7 * r["n"], 9))) for r in counts)


def test_folds_cover_all_rows(spark, skewed):
    fold = skewed.select(sampling.fold_column(["id"], 5).alias("f")).groupBy("f").count().collect()
    assert {r["f"] for r in fold} == set(range(5))
    assert all(abs(r["count"] - 6000) < 400 for r in fold)


def test_ingest_keeps_bad_lines_apart(spark, tmp_path):
    def line(i, **more):
        return json.dumps({"_id": {"$oid": f"{i:024x}"}, "url": f"http://h/{i}", **more})

    lines = [
        line(1, from_waybackmachine=1, label=0, first_appear="2001"),
        line(2, from_waybackmachine=0.0, label="1", last_available_timestamp=20150708093011),
        line(3, label=1),
        line(4, from_waybackmachine=1, label="no number"),
        '{"_id": {"$oid": "5"}, "url": ',
        "not json",
    ]
    path = tmp_path / "lines.json"
    path.write_text("\n".join(lines))
    good = readers.read_resources(spark, str(path)).orderBy("id").collect()
    assert [r["id"][-1] for r in good] == ["1", "2"]
    assert good[0]["first_appear"] == 2001.0 and good[1]["label"] == 1
    assert good[1]["last_available_timestamp"] == 20150708093011.0
    target = new_table_path(spark, "ingest")
    sinks.ingest_resources(spark, str(path), target)
    assert sinks.read_ingested(spark, target).count() == 2
    assert sinks.read_ingested(spark, target, "corrupt").count() == 2
    assert set(RESOURCE.names) <= set(spark.read.parquet(target).columns)


def test_cache_computes_once(spark):
    path, calls = new_table_path(spark, "cache"), []

    def compute():
        calls.append(1)
        return spark.range(5)

    assert sinks.cached_table(spark, path, compute).count() == 5
    assert sinks.cached_table(spark, path, compute).count() == 5
    assert len(calls) == 1


def test_cache_computes_only_where_nothing_is_stored(spark, tmp_path):
    (tmp_path / "unfinished").mkdir()
    with pytest.raises(AnalysisException):
        sinks.cached_table(spark, str(tmp_path / "unfinished"), lambda: pytest.fail("computed"))


def test_shared_folder_is_required_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from perdura.sources import staging

    session = SimpleNamespace(
        conf=SimpleNamespace(get=lambda *_: None),
        sparkContext=SimpleNamespace(master="yarn", getCheckpointDir=lambda: None),
    )
    with pytest.raises(ValueError):
        staging.shared_dir(session)
