"""Forests grown on cells: the same for any layout of the rows, and as good as Spark's on the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from perdura.operators import evaluate, trees

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(4)
    x = np.c_[rng.normal(size=6000), rng.integers(0, 9, 6000) / 10, rng.integers(0, 2, 6000)]
    y = np.round(3 * x[:, 0] + 8 * x[:, 1] * x[:, 2] + rng.normal(size=6000))
    return spark.createDataFrame(pd.DataFrame(x, columns=NAMES).assign(label=y))


def test_a_forest_does_not_depend_on_the_layout_of_the_rows(spark, frame):
    found = []
    for parts in (2, 9):
        rows = trees.assemble(frame.repartition(parts, "a"), NAMES[1:])  # of few values, so the cuts are exact
        model = trees.fit_forest(rows, trees.forest(trees=4, depth=5, leaf=20))
        scored = model.transform(model.cells_of(rows)).orderBy(*model.bins)
        found.append((model.cuts, [(r["n"], r["prediction"]) for r in scored.collect()]))
    assert found[0][0] == found[1][0]
    assert np.allclose(found[0][1], found[1][1])


def test_a_forest_of_cells_is_as_good_as_one_of_rows(spark, frame):
    rows = trees.assemble(frame, NAMES)
    setting = trees.forest(trees=20, depth=6, leaf=20)
    plain = setting.fit(rows)
    model = trees.fit_forest(rows, setting)
    row_wise = evaluate.regression_metrics(plain.transform(rows), "label", "prediction").first()
    scored = model.transform(model.cells_of(rows))
    cell_wise = evaluate.grouped_metrics(scored, "n", "mean", "variance", "prediction").first()
    assert cell_wise["r2"] == pytest.approx(row_wise["r2"], abs=0.02) and cell_wise["r2"] > 0.7
    assert np.allclose(model.featureImportances, plain.featureImportances, atol=0.1)
    falls = [
        {r["feature"]: r["importance"] for r in trees.permutation_importance(m, frame, NAMES, "label", ["a"]).collect()}
        for m in (plain, model)
    ]
    for n in NAMES:
        assert falls[1][n] == pytest.approx(falls[0][n], abs=0.1)


def test_bags_draw_every_row_once_on_average_and_leaves_keep_the_bound(spark, frame):
    rows = trees.assemble(frame, NAMES)
    model = trees.fit_forest(rows, trees.forest(trees=6, depth=8, leaf=300))
    for tree in model.trees:
        size = tree.trees[0].toDebugString.count("Predict")
        assert 1 < size <= 6400 // 300
    short = trees.fit_forest(rows.limit(3), trees.forest(trees=2, depth=8, leaf=300))
    assert [t.trees[0].depth for t in short.trees] == [0, 0]


def test_metrics_of_groups_are_those_of_their_rows(spark, frame):
    rows = frame.withColumn("p", F.round("a")).withColumn("k", F.col("c") > 0)
    groups = rows.groupBy("k", "p").agg(F.count("label").alias("n"), F.avg("label").alias("m"), F.var_pop("label").alias("v"))
    got = {r["k"]: r for r in evaluate.grouped_metrics(groups, "n", "m", "v", "p", ["k"]).collect()}
    for k in (False, True):
        want = evaluate.regression_metrics(rows.where(F.col("k") == k), "label", "p").first()
        assert [got[k][c] for c in want.asDict()] == pytest.approx(list(want))
    whole = groups.groupBy("p").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("m"))
    assert evaluate.grouped_metrics(whole.withColumn("v", F.lit(0.0)), "n", "m", "v", "p").first()["mse"] > 0
