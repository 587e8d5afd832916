"""Counts, shares, trends, histograms and survival curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perdura.functions.dates import missing
from perdura.operators.quantiles import flat_quantiles

# What the label codes stand for.
LABEL_NAMES = {-1: "Dead", 0: "From Wayback Machine", 1: "Alive"}


def missing_for(df: DataFrame, name: str) -> Column:
    """Null, and NaN where the type has it."""
    kind = dict(df.dtypes)[name]
    return missing(F.col(name)) if kind in ("double", "float") else F.col(name).isNull()


def shares(df: DataFrame, key: str, count: str = "cnt", share: str = "share") -> DataFrame:
    """Rows per key and their part of all rows."""
    counts = df.groupBy(key).agg(F.count("*").alias(count))
    total = counts.agg(F.sum(count)).scalar()
    return counts.withColumn(share, F.col(count) / total)


def label_names(label: Column) -> Column:
    out = None
    for code, name in LABEL_NAMES.items():
        out = F.when(label == code, name) if out is None else out.when(label == code, name)
    return out


def value_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), key)


def _long(wide: DataFrame, names: Sequence[str], column: str, value: str) -> DataFrame:
    """A one-row frame to one row per column."""
    pairs = [F.struct(F.lit(n).alias(column), F.col(n).alias(value)) for n in names]
    return wide.select(F.inline(F.array(*pairs)))


def unique_counts(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """Distinct values per column, a missing value counting as one, and the rows.

    Texts are counted by their 128-bit digest, so long ones are not shuffled.
    """
    count = F.approx_count_distinct if approx else F.count_distinct
    kinds = dict(df.dtypes)
    aggs = []
    for c in columns:
        gone = missing_for(df, c)
        value = F.md5(F.col(c)) if kinds[c] == "string" else F.col(c)
        known = count(F.when(~gone, value))
        aggs.append((known + F.max(gone.cast("int"))).cast("bigint").alias(c))
    wide = df.agg(*aggs, F.count("*").alias("total"))
    return _long(wide, [*columns, "total"], "column_name", "unique_count")


def na_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    wide = df.agg(
        *[F.count_if(missing_for(df, c)).alias(c) for c in columns],
        F.count("*").alias("total"),
    )
    return _long(wide, [*columns, "total"], "column_name", "na_count")


def present(column: str | Column) -> Column:
    """The value as a double; NaN counts as missing, like null."""
    x = (F.col(column) if isinstance(column, str) else column).cast("double")
    return F.nullif(x, F.lit(float("nan")))


def mean_trend(
    df: DataFrame, facet: str | None, x: str, metrics: Sequence[str]
) -> DataFrame:
    """Mean of each metric per x, within each facet."""
    keys = [x] if facet is None else [facet, x]
    return df.groupBy(*keys).agg(*[F.avg(present(m)).alias(f"mean_{m}") for m in metrics])


def group_mean_diff(
    df: DataFrame, flag: Column, features: Sequence[str], digits: int = 2
) -> DataFrame:
    """Per feature: mean where the flag holds minus mean where it does not."""
    wide = df.agg(
        *[
            F.round(
                F.avg(F.when(flag, present(c))) - F.avg(F.when(~flag, present(c))), digits
            ).alias(c)
            for c in features
        ]
    )
    return _long(wide, features, "feature", "mean_diff")


def box_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact quartiles per column, highest median first; a column of no values is left out."""
    found = flat_quantiles(df, {c: F.col(c) for c in columns}, [0.25, 0.5, 0.75])
    return df.sparkSession.createDataFrame(
        sorted(((f, *q) for f, q in found.items() if q), key=lambda r: -r[2]),
        "feature string, q1 double, median double, q3 double",
    )


def mode_value(df: DataFrame, column: str) -> DataFrame:
    """Most frequent value, the smallest of equals; combines before the shuffle."""
    counts = df.groupBy(column).agg(F.count("*").alias("_n"))
    best = F.max_by(column, F.struct("_n", -F.col(column)))
    return counts.agg(best.alias("mode"))


def quantile_band(df: DataFrame, prediction: str, residual: str) -> DataFrame:
    """10 % and 90 % residual quantiles at low, middle and high predictions."""
    p, r = F.col(prediction), F.col(residual)
    cuts = flat_quantiles(df, {prediction: p}, [0.0, 0.01, 0.35, 0.75, 0.9, 1.0])[prediction]
    schema = "band string, at double, lower double, upper double"
    if cuts is None:
        return df.sparkSession.createDataFrame([], schema)
    low, p01, p35, p75, p90, high = cuts
    bands = {"low": p < p01, "middle": (p > p35) & (p < p75), "high": p > p90}
    found = flat_quantiles(df, {b: F.when(inside, r) for b, inside in bands.items()}, [0.1, 0.9])
    at = {"low": low, "middle": mode_value(df, prediction).first()["mode"], "high": high}
    return df.sparkSession.createDataFrame(
        [(b, float(at[b]), *q) for b, q in found.items() if q], schema
    )


def histogram(df: DataFrame, column: str, bins: int = 140) -> DataFrame:
    """Rows per equal-width bin between minimum and maximum; empty bins absent."""
    x = present(column)
    span = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    ends = span.select(F.struct("lo", "hi")).scalar()
    width = (ends["hi"] - ends["lo"]) / F.lit(float(bins))
    at = F.when(width > 0, F.least(F.floor((x - ends["lo"]) / width), F.lit(bins - 1)))
    return (
        df.filter(x.isNotNull())
        .groupBy(F.coalesce(at, F.lit(0)).cast("int").alias("bin"))
        .agg(F.count("*").alias("cnt"))
    )


def survival_curve(df: DataFrame, column: str, bins: int = 140) -> DataFrame:
    """Rows at or beyond each bin: the histogram summed from the top."""
    # at most `bins` rows reach the one-partition window
    w = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return histogram(df, column, bins).withColumn("alive", F.sum("cnt").over(w))


def questionable_html(df: DataFrame, html: str, content_type: str) -> DataFrame:
    """Pages without html by content type, in one pass."""
    empty = F.col(html).isNull()
    kind = F.coalesce(F.col(content_type), F.lit(""))
    pdf = F.startswith(kind, F.lit("application/pdf"))
    json = F.startswith(kind, F.lit("application/json"))
    return df.agg(
        F.count_if(empty).alias("empty_html"),
        F.count_if(empty & pdf).alias("empty_pdf"),
        F.count_if(empty & ~pdf).alias("empty_not_pdf"),
        F.count_if(empty & ~pdf & json).alias("empty_json"),
    )
