"""Random forests and what each feature contributes."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perdura.functions.numeric import hash_fraction
from perdura.operators.aggregates import present
from perdura.operators.caching import cached
from perdura.operators.evaluate import grouped_metrics, r2
from perdura.operators.search import fit_each
from perdura.sources.staging import stage_table

ROWS_PER_BUCKET = 10_000
BAG_PARTS = 64  # fixed, so that the bags do not depend on the cluster
CELLS_PER_TASK = 8192


def assemble(df: DataFrame, features: Sequence[str], output: str = "features") -> DataFrame:
    return VectorAssembler(
        inputCols=list(features), outputCol=output, handleInvalid="skip"
    ).transform(df)


def forest(
    label: str = "label",
    trees: int = 30,
    depth: int = 11,
    leaf: int = 232,
    seed: int = 77,
) -> RandomForestRegressor:
    """The study's forest; Spark has no smallest split size, the leaf bound stays."""
    return RandomForestRegressor(
        featuresCol="features",
        labelCol=label,
        numTrees=trees,
        maxDepth=depth,
        minInstancesPerNode=leaf,
        featureSubsetStrategy="sqrt",
        seed=seed,
    )


def bin_cuts(rows: DataFrame, inputs: Sequence[str], bins: int) -> list[list[float]]:
    """Up to bins - 1 cuts of each column: between all its values where they are few, else at its quantiles.

    Quantiles are right to a thousandth of the rows; exact ones took most of a fit's time.
    """
    shares = [i / bins for i in range(1, bins)]
    seen = rows.agg(
        *[F.approx_count_distinct(c).alias(f"n_{c}") for c in inputs],
        *[F.percentile_approx(c, shares, 1000).alias(f"q_{c}") for c in inputs],
    ).first()
    few = [c for c in inputs if seen[f"n_{c}"] <= 2 * bins]
    values = rows.agg(*[F.collect_set(c).alias(c) for c in few]).first().asDict() if few else {}
    cuts = []
    for c in inputs:
        each = sorted(values.get(c) or ())
        exact = c in values and len(each) <= bins
        found = [low + (high - low) / 2 for low, high in zip(each, each[1:])] if exact else seen[f"q_{c}"] or ()
        cuts.append(sorted({x for x in found if math.isfinite(x)}))
    return cuts


def binned(rows: DataFrame, inputs: Sequence[str], cuts: Sequence[Sequence[float]], outputs: Sequence[str]) -> DataFrame:
    """Add the place of each value among its column's cuts, from 1."""
    split = Bucketizer(
        splitsArray=[[-math.inf, *c, math.inf] for c in cuts if c],
        inputCols=[i for i, c in zip(inputs, cuts) if c],
        outputCols=[o for o, c in zip(outputs, cuts) if c],
    )
    placed = split.transform(rows) if any(cuts) else rows
    return placed.withColumns({o: F.col(o) + 1 if c else F.lit(1.0) for o, c in zip(outputs, cuts)})


def _drawn(trees: int, seed: int, features: int):
    """Poisson draws of each tree for groups of equal rows, added up by cell within a batch."""
    names = [f"b{j}" for j in range(features)]
    sums = [f"{kind}{t}" for kind in "wy" for t in range(trees)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.default_rng([seed % (1 << 32), TaskContext.get().partitionId()])
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.stack([batch.column(n).to_numpy() for n in names])
            times = draw.poisson(batch.column("n").to_numpy()[:, None], (batch.num_rows, trees)).astype(np.float64)
            label = batch.column("label").to_numpy(zero_copy_only=False)
            begin = np.flatnonzero(np.r_[True, (cell[:, 1:] != cell[:, :-1]).any(axis=0)])
            parts = [np.add.reduceat(x, begin) for x in (times, times * label[:, None])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in (*cell[:, begin], *parts[0].T, *parts[1].T)], [*names, *sums]
            )

    return run, names, sums


class CellForest:
    """A forest over the cells of binned features: every row of a cell has the same prediction."""

    def __init__(self, cuts: list[list[float]], trees: list[RandomForestRegressionModel], features: str, label: str):
        self.cuts, self.trees, self.features, self.label = cuts, trees, features, label
        self.bins = [f"b{j}" for j in range(len(cuts))]

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802
        """The mean over the trees, summing to 1."""
        total = sum(tree.featureImportances.toArray() for tree in self.trees)
        return DenseVector(total / total.sum() if total.sum() else total)

    def cells(self, rows: DataFrame, *keys: str) -> DataFrame:
        """By key and cell: n, mean and variance of the label."""
        y = present(self.label)
        return stage_table(
            rows.groupBy(*keys, *self.bins)
            .agg(F.count(y).alias("n"), F.avg(y).alias("mean"), F.var_pop(y).alias("variance"))
            .where("n > 0"),
            "cells",
        )

    def cells_of(self, rows: DataFrame, *keys: str) -> DataFrame:
        """cells of rows with a vector of features."""
        inputs = [f"x{j}" for j in range(len(self.cuts))]
        return self.cells(binned(_unpacked(rows, self.features, self.label, *keys), inputs, self.cuts, self.bins), *keys)

    def transform(self, cells: DataFrame) -> DataFrame:
        """Add the prediction, the mean of the trees', to rows with binned features."""
        cells = assemble(cells, self.bins, "cell")
        single = [f"p{t}" for t in range(len(self.trees))]
        for name, tree in zip(single, self.trees):
            cells = tree.copy({tree.featuresCol: "cell", tree.predictionCol: name}).transform(cells)
        mean = sum((F.col(p) for p in single), F.lit(0.0)) / len(single)
        return cells.withColumn("prediction", mean).drop("cell", *single)


def _unpacked(rows: DataFrame, features: str, label: str, *keys: str) -> DataFrame:
    size = rows.schema[features].metadata.get("ml_attr", {}).get("num_attrs")
    if size is None:
        kinds = rows.schema[features].metadata.get("ml_attr", {}).get("attrs", {}).values()
        size = sum(map(len, kinds)) or len(rows.select(features).first()[0])
    values = vector_to_array(features)
    return rows.select(*keys, *[values[j].alias(f"x{j}") for j in range(size)], F.col(label).cast("double").alias(label))


def fit_forests(df: DataFrame, estimators: Sequence[RandomForestRegressor]) -> list[CellForest]:
    """Fit forests of different depth and leaf on the same bags; features, label, bins, trees and seed are the first's.

    A tree sees a row only through its binned features, its label and how often
    the row is in the tree's bag. Rows of one cell (equal bins) and one label are
    counted once, and a bag takes such a group as often as a Poisson draw with
    its size as mean, which is how a Poisson draw of 1 for each row adds up. So
    the rows are read for the cuts and the counts alone, and Spark's trees grow
    on a row for each cell, weighted by its bag: where a split parts cells, the
    spread inside them is on both sides of the gain and cancels out.
    """
    first = estimators[0]
    features, label, trees = first.getFeaturesCol(), first.getLabelCol(), first.getNumTrees()
    rows = cached(_unpacked(df, features, label))
    try:
        inputs = [c for c in rows.columns if c != label]
        cuts = bin_cuts(rows, inputs, first.getMaxBins())
        run, bins, sums = _drawn(trees, first.getSeed(), len(cuts))
        groups = (
            binned(rows, inputs, cuts, bins).select(*bins, F.col(label).alias("label"))
            .groupBy(*bins, "label").agg(F.count("*").alias("n"))
            .repartition(BAG_PARTS, *bins, "label").sortWithinPartitions(*bins, "label")
        )
        drawn = groups.mapInArrow(run, ", ".join(f"{c} double" for c in (*bins, *sums)))
        cells = stage_table(drawn.groupBy(*bins).agg(*[F.sum(c).alias(c) for c in sums]), "bags")
    finally:
        rows.unpersist()
    count, *taken = cells.agg(F.count("*"), *[F.sum(f"w{t}") for t in range(trees)]).first()
    cells = assemble(cells, bins, "cell").coalesce(math.ceil(count / CELLS_PER_TASK) or 1).persist()

    def grow(one: dict) -> RandomForestRegressionModel:
        estimator, t = one["estimator"], one["tree"]
        leaf, size = estimator.getMinInstancesPerNode(), taken[t] or 0
        splits = size >= 2 * leaf
        weight = F.col(f"w{t}")
        single = estimator.copy({
            estimator.numTrees: 1, estimator.bootstrap: False, estimator.seed: estimator.getSeed() + t,
            estimator.featuresCol: "cell", estimator.labelCol: "label", estimator.weightCol: "weight",
            # the leaf bound counts rows, not cells; weights are whole numbers
            estimator.minInstancesPerNode: 1, estimator.minWeightFractionPerNode: (leaf - 0.5) / size if splits else 0.0,
            estimator.maxDepth: estimator.getMaxDepth() if splits else 0,
            # beyond the square of this number Spark would look for splits in a sample
            estimator.maxBins: max(estimator.getMaxBins(), math.isqrt(count) + 1),
        })
        label = F.when(weight > 0, F.col(f"y{t}") / weight).otherwise(0.0)
        return single.fit(cells.select("cell", label.alias("label"), weight.alias("weight")))

    try:
        grown = fit_each([{"estimator": e, "tree": t} for e in estimators for t in range(trees)], grow, threads=8)
    finally:
        cells.unpersist()
    return [CellForest(cuts, grown[i * trees : (i + 1) * trees], features, label) for i in range(len(estimators))]


def fit_forest(df: DataFrame, estimator: RandomForestRegressor) -> CellForest:
    return fit_forests(df, [estimator])[0]


def importance_rows(
    model: CellForest | RandomForestRegressionModel, features: Sequence[str]
) -> list[tuple[str, float]]:
    return sorted(
        zip(features, map(float, model.featureImportances.toArray())), key=lambda r: -r[1]
    )


def shuffled_columns(
    df: DataFrame, features: Sequence[str], keys: Sequence[str], seed: int = 77
) -> DataFrame:
    """Add ``_s_<f>``: the column's values exchanged between random rows.

    Rows fall into buckets of bounded size by a hash of their key. In the hash
    order of a bucket, each column swaps values between neighbouring stretches
    of its own length, so one shuffle serves all columns and every value is used
    exactly once. A row without a partner keeps its value.
    """
    buckets = max(1, math.ceil(df.count() / ROWS_PER_BUCKET))
    cols = [F.col(k) for k in keys]
    at = F.floor(hash_fraction(*cols, seed=seed, method="xxhash64") * buckets)
    order = hash_fraction(*cols, seed=seed + 1, method="xxhash64")
    rows = df.withColumns({"_bucket": at, "_order": order})
    w = Window.partitionBy("_bucket").orderBy("_order", *keys)
    rows = rows.withColumns(
        {"_row": F.row_number().over(w), "_size": F.count("*").over(Window.partitionBy("_bucket"))}
    )
    made = {}
    for stretch, f in enumerate(features, start=1):
        ahead = F.floor((F.col("_row") - 1) / stretch) % 2 == 0
        made[f"_s_{f}"] = (
            F.when(~ahead, F.lag(f, stretch).over(w))
            .when(F.col("_row") + stretch <= F.col("_size"), F.lead(f, stretch).over(w))
            .otherwise(F.col(f))
        )
    return rows.withColumns(made).drop("_bucket", "_order", "_row", "_size")


def permutation_importance(
    model: CellForest | RandomForestRegressionModel,
    df: DataFrame,
    features: Sequence[str],
    label: str,
    keys: Sequence[str],
    seed: int = 77,
) -> DataFrame:
    """Fall in R^2 when a feature's values are moved to other rows, in one job."""
    rows = shuffled_columns(df, features, keys, seed)
    y = F.col(label)
    plans = {"_base": list(features)}
    for f in features:
        plans[f] = [f"_s_{f}" if g == f else g for g in features]
    if isinstance(model, CellForest):
        scores = _cell_scores(model, rows, features, plans)
    else:
        for name, inputs in plans.items():
            scorer = model.copy(
                {model.featuresCol: f"_v_{name}", model.predictionCol: f"_p_{name}"}
            )
            rows = scorer.transform(assemble(rows, inputs, f"_v_{name}")).drop(f"_v_{name}")
        scores = rows.agg(*[r2(y, F.col(f"_p_{n}")).alias(n) for n in plans])
    pairs = [
        F.struct(F.lit(f).alias("feature"), (F.col("_base") - F.col(f)).alias("importance"))
        for f in features
    ]
    return scores.select(F.inline(F.array(*pairs)))


def _cell_scores(
    model: CellForest, rows: DataFrame, features: Sequence[str], plans: dict[str, list[str]]
) -> DataFrame:
    """R^2 of each plan: every row is binned once and counted in one cell of each plan."""
    inputs = [*features, *[f"_s_{f}" for f in features]]
    places = dict(zip(inputs, [f"_b_{c}" for c in inputs]))
    rows = binned(rows.na.drop(subset=inputs), inputs, [*model.cuts, *model.cuts], list(places.values()))
    each = F.array(*[
        F.struct(F.lit(name).alias("plan"), *[F.col(places[c]).alias(b) for b, c in zip(model.bins, taken)])
        for name, taken in plans.items()
    ])
    cells = model.cells(rows.select(model.label, F.inline(each)), "plan")
    found = grouped_metrics(model.transform(cells), "n", "mean", "variance", "prediction", ["plan"])
    return found.agg(*[F.max(F.when(F.col("plan") == n, F.col("r2"))).alias(n) for n in plans])
