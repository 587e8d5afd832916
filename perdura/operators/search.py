"""Grids, cross-validation, and one result row per setting."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import product

from pyspark.ml import Estimator
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession

from perdura.operators.linear import LinearFit
from perdura.operators.moments import Gram


def combinations(grid: Mapping[str, Sequence]) -> list[dict]:
    """Every combination of the listed values, first key slowest."""
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def cross_validate(
    estimator: Estimator,
    grid: Mapping[str, Sequence],
    evaluator: Evaluator,
    df: DataFrame,
    fold: str,
    folds: int = 10,
    parallelism: int = 4,
) -> CrossValidatorModel:
    """Cross-validation on given folds; fits of a fold run side by side."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    return CrossValidator(
        estimator=estimator,
        estimatorParamMaps=builder.build(),
        evaluator=evaluator,
        numFolds=folds,
        foldCol=fold,
        parallelism=parallelism,
    ).fit(df)


def cv_rows(spark: SparkSession, model: CrossValidatorModel) -> DataFrame:
    """One row per setting: its parameters and mean metric."""
    rows = []
    for params, metric in zip(model.getEstimatorParamMaps(), model.avgMetrics):
        text = {p.name: v for p, v in params.items()}
        rows.append((",".join(f"{k}={text[k]}" for k in sorted(text)), float(metric)))
    return spark.createDataFrame(rows, "setting string, metric double")


def fit_each(
    settings: Sequence[dict], run: Callable[[dict], tuple], threads: int = 4
) -> list[tuple]:
    """Run one Spark fit per setting from a small pool; the work is on executors."""
    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(run, settings))


def logistic(
    rows: int, c: float, l1_ratio: float = 0.0, max_iter: int = 100, label: str = "label"
) -> LogisticRegression:
    """Logistic loss summed over rows times C, plus the elastic-net penalty."""
    return LogisticRegression(
        featuresCol="features",
        labelCol=label,
        regParam=1 / (c * rows),
        elasticNetParam=l1_ratio,
        maxIter=max_iter,
        standardization=False,
    )


def performance_rows(
    tag: str,
    stats: Gram,
    settings: Sequence[tuple[float, float]],
    fits: Sequence[LinearFit],
) -> list[tuple]:
    """(alpha, l1_ratio, dataset, mse, r2, intercept, coefficients...) per setting."""
    return [
        (
            float(a), float(r), tag, stats.mse(f.intercept, f.coef), stats.r2(f.intercept, f.coef),
            f.intercept, *map(float, f.coef),
        )
        for (a, r), f in zip(settings, fits)
    ]


def performance_schema(features: Sequence[str]) -> str:
    head = "alpha double, l1_ratio double, dataset string, mse double, r2 double"
    return ", ".join([head, "intercept double", *[f"`{f}` double" for f in features]])
