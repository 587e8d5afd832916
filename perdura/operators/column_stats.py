"""Per-column statistics the fitted stages need, without shuffling any values."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perdura.operators.aggregates import missing_for


@dataclass(frozen=True)
class ColumnStats:
    mean: float
    variance: float  # population
    distinct: int  # 1, 2 or 3, where 3 stands for more; missing counts as a value

    @property
    def std(self) -> float:
        return self.variance**0.5


HEAD = 100  # rows in which a column's anchor is looked for
SIDE = 8


def _values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(
        *(F.when(~missing_for(df, c), F.col(c).cast("double")).alias(f"v{i}") for i, c in enumerate(columns))
    )


def _sums(values: DataFrame, anchors: Sequence[float | None]) -> list[tuple]:
    """mean, variance, least and greatest value besides the anchor, missing and known rows of each column.

    One scan. Columns are aggregated side by side, SIDE of them at most, as more would outgrow
    what Spark compiles well; a row gives one line for each further SIDE columns.
    """
    sides = [range(i, min(i + SIDE, len(anchors))) for i in range(0, len(anchors), SIDE)]
    lines = [
        F.struct(F.lit(k).alias("side"), *(
            part
            for j in range(SIDE) for i in [side[j] if j < len(side) else None]
            for part in (
                (F.lit(None).cast("double") if i is None else F.col(f"v{i}")).alias(f"x{j}"),
                F.lit(None if i is None else anchors[i]).cast("double").alias(f"a{j}"),
            )
        ))
        for k, side in enumerate(sides)
    ]
    sums = []
    for j in range(SIDE):
        v, anchor = F.col(f"x{j}"), F.col(f"a{j}")
        other = F.when(anchor.isNull() | (v != anchor), v)
        sums += [F.avg(v), F.var_pop(v), F.min(other), F.max(other), F.count_if(v.isNull()), F.count(v)]
    cut = values.select(F.inline(F.array(*lines))) if len(lines) > 1 else values.select(lines[0].alias("l")).select("l.*")
    rows = cut.groupBy("side").agg(*(c.alias(f"s{n}") for n, c in enumerate(sums))).collect()
    found: list[tuple] = [(None, None, None, None, 0, 0)] * len(anchors)
    for r in rows:
        for j, i in enumerate(sides[r["side"]]):
            found[i] = tuple(r[f"s{6 * j + m}"] for m in range(6))
    return found


def _strictly_between(values: DataFrame, bounds: dict[str, tuple[float, float]]) -> dict[str, bool]:
    """Which columns have a value strictly between two bounds."""
    if not bounds:
        return {}
    inside = [F.bool_or((F.col(v) > lo) & (F.col(v) < hi)).alias(v) for v, (lo, hi) in bounds.items()]
    return {v: bool(found) for v, found in values.agg(*inside).first().asDict().items()}


def column_stats(df: DataFrame, columns: Sequence[str]) -> dict[str, ColumnStats]:
    """Mean, population variance and whether a column has 1, 2 or more values, in one scan.

    Any value of a column, found among the first rows, is its anchor. The least and the greatest
    of the values that differ from the anchor tell one, two and more values apart: there are
    none, they are equal, or they differ. A column with no value in the first rows has no
    anchor; only for such columns a second scan looks between minimum and maximum.
    """
    if not columns:
        return {}
    values = _values(df, columns)
    head = values.limit(HEAD).collect()
    anchors = [next((r[i] for r in head if r[i] is not None), None) for i in range(len(columns))]
    found = _sums(values, anchors)
    loose = {f"v{i}": found[i][2:4] for i, a in enumerate(anchors) if a is None and found[i][5] and found[i][2] < found[i][3]}
    between = _strictly_between(values, loose)
    out = {}
    for i, c in enumerate(columns):
        mean, variance, lo, hi, gone, n = found[i]
        if not n:
            out[c] = ColumnStats(float("nan"), float("nan"), 1)
            continue
        if anchors[i] is None:
            distinct = 1 if lo == hi else 3 if between[f"v{i}"] else 2
        else:
            distinct = 1 if lo is None else 2 if lo == hi else 3
        out[c] = ColumnStats(mean, variance, min(distinct + (1 if gone else 0), 3))
    return out


def numeric_columns(df: DataFrame) -> list[str]:
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [c for c, t in df.dtypes if t in kinds or t.startswith("decimal")]
