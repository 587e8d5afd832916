"""Correlations and group tests from one-pass moments."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perdura.operators.aggregates import present
from perdura.functions.probability import chi_square_upper, t_two_sided
from perdura.operators.moments import sum_over_rows


NOISE = 1e-13  # spread below this share of the squares summed is rounding, so the column is constant


def correlations(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pearson matrix and rows of each pair, over the rows in which both values are present.

    One scan sums the masked cross products. NaN where one of the two is constant in the pair's rows.
    """
    names = list(columns)
    size = len(names)
    doubles = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    means = doubles.agg(*[F.avg(present(c)).alias(c) for c in doubles.columns]).first()
    shift = np.array([m if m is not None and math.isfinite(m) else 0.0 for m in means])
    if all(m is None for m in means):
        return np.full((size, size), np.nan), np.zeros((size, size))

    def kernel(rows: np.ndarray) -> np.ndarray:
        here = ~np.isnan(rows)
        v, mask = np.where(here, rows - shift, 0.0), here.astype(float)
        return np.concatenate([x.ravel() for x in (mask.T @ mask, v.T @ mask, (v * v).T @ mask, v.T @ v)])[None, :]

    n, first, second, cross = sum_over_rows(doubles, doubles.columns, kernel)[0].reshape(4, size, size)
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = second - first * first / n  # of x in the rows of (x, y)
        spread[~(spread > NOISE * second)] = np.nan
        r = (cross - first * first.T / n) / np.sqrt(spread * spread.T)
    return np.clip(r, -1.0, 1.0), n


def corr_p_value(r: float, n: float) -> float:
    if not math.isfinite(r) or n < 3:
        return float("nan")
    if abs(r) >= 1:
        return 0.0
    return t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long form: one row per ordered pair, null where a column is constant."""
    r, _ = correlations(df, columns)
    rows = [
        (a, b, float(r[i, j]) if math.isfinite(r[i, j]) else None)
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
    ]
    return df.sparkSession.createDataFrame(rows, "x string, y string, r double")


def corr_pairs(
    df: DataFrame, columns: Sequence[str], level: float | None = 0.05, compat: bool = False
) -> DataFrame:
    """Pairs of the upper triangle with p <= level / 2 (all pairs for None).

    ``compat`` takes p between two rows of the correlation matrix, as the study
    does, instead of between the data columns.
    """
    r, n = correlations(df, columns)
    rows = []
    for i, a in enumerate(columns):
        for j in range(i + 1, len(columns)):
            if compat:
                p = corr_p_value(float(np.corrcoef(r[i], r[j])[0, 1]), len(columns))
            else:
                p = corr_p_value(float(r[i, j]), float(n[i, j]))
            if level is None or p <= level / 2:
                rows.append((a, columns[j], float(r[i, j]), p))
    return df.sparkSession.createDataFrame(rows, "x string, y string, r double, p double")


def corr_with_target(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """r and its p-value (4 decimals) of each column with the target, lowest r first."""
    r, n = correlations(df, [*columns, target])
    rows = sorted(
        (c, float(r[i, -1]), round(corr_p_value(float(r[i, -1]), float(n[i, -1])), 4))
        for i, c in enumerate(columns)
    )
    rows.sort(key=lambda row: row[1])
    return df.sparkSession.createDataFrame(rows, "feature string, r double, p double")


def welch_statistic(df: DataFrame, flag: Column, value: str) -> DataFrame:
    """t and degrees of freedom of the unequal-variance test, flagged less others."""
    x = present(value)
    groups = df.groupBy(flag.alias("_flag")).agg(
        F.count(x).alias("n"), F.avg(x).alias("m"), F.var_samp(x).alias("v")
    )

    def part(name: str, wanted: bool) -> Column:
        return F.max(F.when(F.col("_flag") == F.lit(wanted), F.col(name)))

    e1, e2 = part("v", True) / part("n", True), part("v", False) / part("n", False)
    t = (part("m", True) - part("m", False)) / F.sqrt(e1 + e2)
    dof = (e1 + e2) * (e1 + e2) / (
        e1 * e1 / (part("n", True) - 1) + e2 * e2 / (part("n", False) - 1)
    )
    return groups.agg(t.alias("t"), dof.alias("df"))


def welch_t_test(df: DataFrame, flag: Column, value: str) -> tuple[float, float, float]:
    row = welch_statistic(df, flag, value).first()
    return row["t"], row["df"], t_two_sided(row["t"], row["df"])


def chi_square_statistic(df: DataFrame, squared: Column) -> DataFrame:
    """Goodness of fit of non-negative values to a constant: sum((x - m)^2) / m."""
    squared = present(squared)
    return df.agg(
        (F.var_pop(squared) * F.count(squared) / F.avg(squared)).alias("chi_square"),
        (F.count(squared) - 1).alias("df"),
    )


def chi_square_test(df: DataFrame, squared: Column) -> tuple[float, int, float]:
    row = chi_square_statistic(df, squared).first()
    return row["chi_square"], row["df"], chi_square_upper(row["chi_square"], row["df"])
