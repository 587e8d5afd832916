"""Sums of per-partition vectors, and cross-product (Gram) statistics from them.

A task turns its Arrow batches into a matrix, adds up one vector per key with
BLAS and emits it once; Spark adds the vectors element by element. What reaches
the driver is one vector per key, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# (batch matrix) -> [keys, length] contributions
Kernel = Callable[[np.ndarray], np.ndarray]

ROWS_PER_BLOCK = 8192


def batch_matrix(batch: pa.RecordBatch) -> np.ndarray:
    """A batch of double columns as a row-by-column matrix, nulls as NaN."""
    columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
    return np.column_stack(columns).astype(float, copy=False)


def sum_over_rows(
    df: DataFrame, columns: Sequence[str], kernel: Kernel, block: int = ROWS_PER_BLOCK
) -> np.ndarray:
    """Sum of ``kernel`` over all rows, as a [keys, length] array."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = batch_matrix(batch)
            for start in range(0, len(rows), block):
                part = kernel(rows[start : start + block])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(len(total)), pa.int32()),
                    pa.array(list(total), pa.list_(pa.float64())),
                ],
                ["k", "v"],
            )

    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    sums = (
        doubles.mapInArrow(partial, "k int, v array<double>")
        .groupBy("k")
        .agg(Summarizer.sum(array_to_vector("v")).alias("v"))
        .collect()
    )
    if not sums:
        raise ValueError("no rows to sum over")
    return np.array([r["v"].toArray() for r in sorted(sums, key=lambda r: r["k"])])


@dataclass(frozen=True)
class Gram:
    """Sums of 1, v and v v' over rows v = (features, label), taken about ``shift``.

    Statistics with the same shift add and subtract, so the training part of
    each fold is the total less the fold.
    """

    features: tuple[str, ...]
    shift: np.ndarray
    n: float
    first: np.ndarray
    second: np.ndarray

    def __add__(self, other: Gram) -> Gram:
        return Gram(
            self.features, self.shift, self.n + other.n,
            self.first + other.first, self.second + other.second,
        )

    def __sub__(self, other: Gram) -> Gram:
        return Gram(
            self.features, self.shift, self.n - other.n,
            self.first - other.first, self.second - other.second,
        )

    @property
    def mean(self) -> np.ndarray:
        return self.shift + self.first / self.n

    @property
    def centred(self) -> np.ndarray:
        """Sum of (v - mean)(v - mean)'."""
        return self.second - np.outer(self.first, self.first) / self.n

    def sse(self, intercept: float, coef: np.ndarray) -> float:
        """Sum of squared errors of any linear prediction, without a scan."""
        w = np.append(-np.asarray(coef), 1.0)
        bias = float(self.mean @ w) - intercept
        return float(max(w @ self.centred @ w, 0.0) + self.n * bias * bias)

    def mse(self, intercept: float, coef: np.ndarray) -> float:
        return self.sse(intercept, coef) / self.n

    def r2(self, intercept: float, coef: np.ndarray) -> float:
        return 1 - self.sse(intercept, coef) / float(self.centred[-1, -1])

    def pseudo_r2(self, coef: np.ndarray) -> float | None:
        """corr(y, prediction)^2; None for a constant prediction."""
        c, b = self.centred, np.asarray(coef)
        spread = float(b @ c[:-1, :-1] @ b)
        if spread <= 0 or c[-1, -1] <= 0:
            return None
        return float((b @ c[:-1, -1]) ** 2 / (spread * c[-1, -1]))


def gram(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    fold: str | None = None,
    folds: int = 1,
) -> list[Gram]:
    """One :class:`Gram` per fold; rows with a missing value are left out."""
    names = [*features, label]
    clean = df.select(*names, *([fold] if fold else [])).na.drop()
    means = clean.agg(*[F.avg(c).alias(c) for c in names]).first()
    if means[0] is None:
        raise ValueError("no complete rows")
    shift = np.array([float(means[c]) for c in names])
    size = len(names)

    def kernel(rows: np.ndarray) -> np.ndarray:
        v = rows[:, :size] - shift
        which = rows[:, size].astype(int) if fold else np.zeros(len(rows), int)
        out = np.zeros((folds, 1 + size + size * size))
        for f in np.unique(which):
            part = v[which == f]
            out[f] = np.concatenate(
                ([len(part)], part.sum(axis=0), (part.T @ part).ravel())
            )
        return out

    sums = sum_over_rows(clean, clean.columns, kernel)
    return [
        Gram(
            tuple(features), shift, float(s[0]), s[1 : 1 + size], s[1 + size :].reshape(size, size)
        )
        for s in sums
    ]
