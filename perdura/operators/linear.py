"""Least squares, elastic net and lasso on Gram statistics.

One scan gives the cross products of every fold; the whole grid is then solved
on p-by-p matrices. The objective is

    ||y - b0 - Xb||^2 / 2n + alpha * (l1_ratio ||b||_1 + (1 - l1_ratio) ||b||^2 / 2)
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from perdura.functions.numeric import linear_prediction
from perdura.functions.probability import t_two_sided
from perdura.operators.moments import Gram, gram

SWEEPS = 5000
TOLERANCE = 1e-12


@dataclass(frozen=True)
class LinearFit:
    intercept: float
    coef: np.ndarray


def elastic_net_path(
    stats: Gram, settings: Sequence[tuple[float, float]]
) -> list[LinearFit]:
    """Exact minimisers for all (alpha, l1_ratio) settings, by coordinate descent
    run on all settings at once."""
    c = stats.centred / stats.n
    xx, xy = c[:-1, :-1], c[:-1, -1]
    alpha = np.array([s[0] for s in settings], float)
    ratio = np.array([s[1] for s in settings], float)
    l1, l2 = alpha * ratio, alpha * (1 - ratio)
    b = np.zeros((len(settings), len(xy)))
    free = (l1 == 0) & (l2 == 0)
    if free.any():
        b[free] = np.linalg.lstsq(xx, xy, rcond=None)[0]
    work = ~free
    bw, l1w, l2w = b[work], l1[work], l2[work]
    for _ in range(SWEEPS if work.any() else 0):
        moved = 0.0
        for j in range(len(xy)):
            if xx[j, j] <= 0:
                continue
            pull = xy[j] - bw @ xx[j] + bw[:, j] * xx[j, j]
            new = np.sign(pull) * np.maximum(np.abs(pull) - l1w, 0) / (xx[j, j] + l2w)
            moved = max(moved, float(np.max(np.abs(new - bw[:, j])) * np.sqrt(xx[j, j])))
            bw[:, j] = new
        if moved < TOLERANCE * max(1.0, float(np.sqrt(c[-1, -1]))):
            break
    b[work] = bw
    mean = stats.mean
    return [LinearFit(float(mean[-1] - mean[:-1] @ row), row) for row in b]


def ols(stats: Gram) -> LinearFit:
    return elastic_net_path(stats, [(0.0, 0.0)])[0]


def coefficient_report(stats: Gram, fit: LinearFit) -> list[tuple]:
    """(name, coefficient, standard error, t, p) rows, largest coefficient first.

    The error variance is SSE / (n - p) with the intercept counted in p; p-values
    use n - 1 degrees of freedom, as the study does.
    """
    n, mean, c = stats.n, stats.mean, stats.centred
    inv = np.linalg.pinv(c[:-1, :-1])
    m = mean[:-1]
    diag = np.append(1 / n + m @ inv @ m, np.diag(inv))
    error = stats.sse(fit.intercept, fit.coef) / (n - len(m) - 1)
    values = np.append(fit.intercept, fit.coef)
    rows = []
    for name, b, d in zip(("Constant", *stats.features), values, diag):
        se = float(np.sqrt(max(error * d, 0.0)))
        t = float(b / se) if se > 0 else float("inf") if b else 0.0
        rows.append(
            (name, round(float(b), 4), round(se, 3), round(t, 3), round(t_two_sided(t, n - 1), 3))
        )
    return sorted(rows, key=lambda r: -r[1])


REPORT_SCHEMA = (
    "feature string, coefficient double, standard_error double, t_value double, "
    "probability double"
)


def selected_features(fit: LinearFit, features: Sequence[str], keep: Sequence[str] = ()) -> list[str]:
    """Features of non-zero weight, plus those named."""
    return [f for f, b in zip(features, fit.coef) if b != 0 or f in keep]


def grid_scores(
    folds: Sequence[Gram], settings: Sequence[tuple[float, float]]
) -> list[tuple[float, list[LinearFit]]]:
    """Mean held-out MSE of each setting, with the fits of all folds."""
    total = folds[0]
    for f in folds[1:]:
        total = total + f
    errors = np.zeros((len(folds), len(settings)))
    fits: list[list[LinearFit]] = [[] for _ in settings]
    for i, held in enumerate(folds):
        for j, fit in enumerate(elastic_net_path(total - held, settings)):
            errors[i, j] = held.mse(fit.intercept, fit.coef)
            fits[j].append(fit)
    return [(float(errors[:, j].mean()), fits[j]) for j in range(len(settings))]


def _param(name: str, doc: str, convert) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=convert)


class ElasticNetRegression(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Elastic net on named columns; one scan for the means, one for the products."""

    features = _param("features", "feature columns", TypeConverters.toListString)
    labelCol = _param("labelCol", "label column", TypeConverters.toString)
    alpha = _param("alpha", "penalty", TypeConverters.toFloat)
    l1Ratio = _param("l1Ratio", "share of the L1 part", TypeConverters.toFloat)

    def __init__(self, **values) -> None:
        super().__init__()
        self._setDefault(labelCol="label", alpha=1.0, l1Ratio=0.5)
        self._set(**values)

    def _fit(self, df: DataFrame) -> LinearModel:
        names = self.getOrDefault("features")
        stats = gram(df, names, self.getOrDefault("labelCol"))[0]
        setting = (self.getOrDefault("alpha"), self.getOrDefault("l1Ratio"))
        fit = elastic_net_path(stats, [setting])[0]
        return LinearModel(
            features=names, coefficients=list(map(float, fit.coef)), intercept=fit.intercept
        )


class LinearModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    features = _param("features", "feature columns", TypeConverters.toListString)
    coefficients = _param("coefficients", "weights", TypeConverters.toListFloat)
    intercept = _param("intercept", "intercept", TypeConverters.toFloat)
    predictionCol = _param("predictionCol", "output", TypeConverters.toString)

    def __init__(self, **values) -> None:
        super().__init__()
        self._setDefault(predictionCol="prediction")
        self._set(**values)

    def _transform(self, df: DataFrame) -> DataFrame:
        weights = dict(zip(self.getOrDefault("features"), self.getOrDefault("coefficients")))
        return df.withColumn(
            self.getOrDefault("predictionCol"),
            linear_prediction(weights, self.getOrDefault("intercept")),
        )
