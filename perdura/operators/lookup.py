"""Joining a lookup table whose size is checked before it is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def join_lookup(
    df: DataFrame, lookup: DataFrame, on: str, how: str = "left", max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Join on a key that is unique in ``lookup``.

    The row count is taken up to the bound only. Beyond it the join is left to
    a shuffle, where adaptive execution splits hot keys of the large side.
    """
    small = lookup.limit(max_rows + 1).count() <= max_rows
    return df.join(F.broadcast(lookup) if small else lookup, on, how)
