"""Exact stratified resamples: counts, independence of the partitioning, spread; quality per replicate."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from perdura.operators import resampling, tobit

LIMITS = tobit.Censoring(right=2.0)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 2))
    y = np.minimum(np.round(x @ [1.0, -0.5] + 0.8 * rng.normal(size=900)), 2.0)
    pairs = [(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))]
    return spark.createDataFrame(pairs, "id long, a double, b double, y double")


def copies(df, draw, numbers):
    """{id: copies in each replicate}"""
    got = df.select("id", "_stratum", "_bucket", "_place").toPandas()
    return dict(zip(got["id"], draw.weigh(got[["_stratum", "_bucket", "_place"]].to_numpy(float), numbers, {})))


@pytest.mark.parametrize("bucket_rows", [7, 100, 10**6])
def test_every_stratum_keeps_its_number_of_rows(rows, bucket_rows):
    df, draw = resampling.stratified_places(rows, F.col("y"), ["id"], bucket_rows=bucket_rows)
    found = copies(df, draw, np.arange(30, 130))
    label = {r["id"]: r["y"] for r in rows.collect()}
    for y in set(label.values()):
        mine = np.array([found[i] for i in label if label[i] == y])
        assert (mine.sum(axis=0) == len(mine)).all()
        if len(mine) > 100:
            assert abs(mine.var() - (1 - 1 / len(mine))) < 0.05  # as of even draws
            once = np.corrcoef(mine[: len(mine) // 2].sum(axis=0), mine[::2].sum(axis=0))[0, 1]
            assert abs(once) < 0.6
    assert len(found) == 900


def test_fixed_by_seed_whatever_the_partitioning(rows):
    numbers = np.array([0, 3, 77])
    want = None
    for df in (rows, rows.repartition(7, "y"), rows.orderBy(F.desc("a")).coalesce(1)):
        df, draw = resampling.stratified_places(df, F.col("y"), ["id"], bucket_rows=20)
        got = {i: tuple(c) for i, c in copies(df, draw, numbers).items()}
        want = want or got
        assert got == want
    other, draw = resampling.stratified_places(rows, F.col("y"), ["id"], seed=5, bucket_rows=20)
    assert {i: tuple(c) for i, c in copies(other, draw, numbers).items()} != want


def test_one_hot_stratum_null_stratum_and_too_many(spark, rows, monkeypatch):
    hot = rows.withColumn("s", F.when(F.col("id") == 5, None).otherwise(F.lit("x")))
    df, draw = resampling.stratified_places(hot, F.col("s"), ["id"], bucket_rows=50)
    assert df.select("_bucket").distinct().count() == 16
    found = copies(df, draw, np.arange(60))
    assert (found[5] == 1).all() and (sum(found.values()) == 900).all()
    monkeypatch.setattr(resampling, "MOST_STRATA", 3)
    with pytest.raises(ValueError):
        resampling.stratified_places(rows, F.col("id"), ["id"])


def test_bootstrap_refits_its_resamples_and_rates_them_on_all_rows(spark, rows):
    got = tobit.stratified_bootstrap(rows, ["a", "b"], "y", LIMITS, ["id"], replicates=60, setting=(0.0, 1.0), batch=25)
    assert len(got) == 60
    table = rows.toPandas().sort_values("id")
    x, y = table[["a", "b"]].to_numpy(), table["y"].to_numpy()
    for r in got[::20]:
        predicted = r.fit.intercept + x @ r.fit.coef
        assert r.rmse == pytest.approx(math.sqrt(((y - predicted) ** 2).mean()))
        assert r.pseudo_r2 == pytest.approx(np.corrcoef(y, predicted)[0, 1] ** 2)
        model = tobit.TobitModel(
            features=["a", "b"], labelCol="y", coefficients=list(map(float, r.fit.coef)), intercept=r.fit.intercept,
            sigma=r.fit.sigma, censorLeft=-math.inf, censorRight=2.0,
        )
        assert r.loglik == pytest.approx(model.score(rows))
    # a replicate is the fit of its resample written out
    df, draw = resampling.stratified_places(rows, F.col("y"), ["id"])
    found = copies(df, draw, np.array([30]))
    index = [i for i, c in found.items() for _ in range(int(c[0]))]
    again = spark.createDataFrame(table.set_index("id").loc[index].reset_index(drop=True))
    with tobit.TobitRows(again, ["a", "b"], "y", LIMITS) as one:
        assert one.fit([(0.0, 1.0)])[0].theta == pytest.approx(got[30].fit.theta, abs=1e-5)
