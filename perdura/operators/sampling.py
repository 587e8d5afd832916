"""Samples and splits fixed by a hash of the row's key, whatever the partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perdura.functions.numeric import hash_fraction
from perdura.operators.quantiles import rank_values

BITS = float(1 << 52)


def hash_sample(df: DataFrame, keys: Sequence[str], fraction: float, seed: int = 77) -> DataFrame:
    return df.filter(hash_fraction(*[F.col(k) for k in keys], seed=seed) < fraction)


def train_test_split(
    df: DataFrame, keys: Sequence[str], train: float = 0.7, seed: int = 77
) -> tuple[DataFrame, DataFrame]:
    cut = hash_fraction(*[F.col(k) for k in keys], seed=seed) < train
    return df.filter(cut), df.filter(~cut)


def fold_column(keys: Sequence[str], folds: int, seed: int = 77) -> Column:
    """Fold number 0..folds-1 of a row."""
    u = hash_fraction(*[F.col(k) for k in keys], seed=seed)
    return F.floor(u * folds).cast("int")


def stratified_split(
    df: DataFrame, stratum: str, keys: Sequence[str], train: float = 0.7, seed: int = 77
) -> DataFrame:
    """Add ``is_train``: per stratum the ceil(train * n) rows of lowest hash.

    The cut-off hash of each stratum is found by rank selection, so no stratum
    is ever sorted in one task. Rows sharing the cut-off hash stay together.
    """
    u = (hash_fraction(*[F.col(k) for k in keys], seed=seed) * F.lit(BITS)).alias("_u")
    ranked = df.select(F.col(stratum).cast("string").alias("_g"), u)
    cuts = rank_values(ranked, "_u", "_g", lambda n: [F.ceil(F.round(n * F.lit(float(train)), 9)) - 1])
    return (
        df.withColumn("_g", F.col(stratum).cast("string"))
        .join(cuts.select(F.col("g").alias("_s"), F.col("x").alias("_cut")), F.col("_g").eqNullSafe(F.col("_s")), "left")
        .withColumn("is_train", (u <= F.col("_cut")).cast("int"))
        .drop("_g", "_s", "_cut")
    )
