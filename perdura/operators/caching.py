"""Caching narrow rows that several jobs read."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_ROWS = 8192
PART_ROWS = 1_000_000  # about 100 MB of narrow rows


def cached(df: DataFrame) -> DataFrame:
    """Persist narrow rows, spread over at least one partition per core.

    A small input comes as one split and would keep one core busy. A split of a
    compressed file may hold many millions of rows; where one holds over
    PART_ROWS, the rows are spread so that a task reads about that many at most,
    however large the input. The rows are counted by source partition before
    anything is kept, so no large block is made. A lost executor's part is
    recomputed from the source.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    seen = parts.agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.max("n").alias("most")).first()
    rows = seen["n"] or 0
    if (seen["parts"] >= cores or rows < SMALL_ROWS) and (seen["most"] or 0) <= PART_ROWS:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    spread = df.repartition(max(cores, math.ceil(rows / PART_ROWS))).persist(StorageLevel.MEMORY_AND_DISK)
    spread.count()
    return spread
