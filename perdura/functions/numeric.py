"""Small numeric and value expressions, and the Arrow UDF of the surface."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perdura.functions.dates import missing

LOG_SHIFT = 1e-11


def map_values(col: Column, mapping: Mapping[object, object]) -> Column:
    """Look values up; a value not in the mapping becomes null."""
    out = None
    for key, value in mapping.items():
        hit = col == F.lit(key)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return F.lit(None) if out is None else out


def present(col: Column) -> Column:
    return (~missing(col)).cast("int")


def present_text(col: Column) -> Column:
    return col.isNotNull().cast("int")


def shifted_log(col: Column) -> Column:
    """ln(x + 1e-11); null where the argument is not positive."""
    arg = col + F.lit(LOG_SHIFT)
    return F.when(arg > 0, F.ln(arg))


def linear_prediction(
    features: Mapping[str, float], intercept: float = 0.0
) -> Column:
    """intercept + sum of coefficient * column."""
    out = F.lit(float(intercept))
    for name, weight in features.items():
        out = out + F.col(name) * F.lit(float(weight))
    return out


def hash_fraction(*keys: Column, seed: int = 77, method: str = "md5") -> Column:
    """A number in [0, 1) fixed by the keys and the seed alone.

    ``md5`` can be repeated by other engines; ``xxhash64`` costs less. A null key
    keeps its place, so (null, a) and (a, null) differ.
    """
    text = F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("\0")) for k in keys], F.lit(str(seed)))
    if method == "xxhash64":
        return F.pmod(F.xxhash64(text), F.lit(1 << 52)) / F.lit(float(1 << 52))
    # 13 hex digits are 52 bits, exact in a double
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return bits / F.lit(float(1 << 52))


@F.pandas_udf(T.LongType())
def plus_one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for values in batches:
        yield values + 1
