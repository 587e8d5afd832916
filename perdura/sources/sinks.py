"""Writers, and the cache that replaces a local file of the extract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perdura.sources.readers import read_json_lines
from perdura.sources.schemas import RESOURCE


def ingest_resources(spark: SparkSession, source: str, target: str) -> None:
    """Append JSON lines as Parquet in one pass over the source.

    Layout: ``status=ok|corrupt`` above ``label``; rows without origin flag or
    label are dropped, unreadable lines are kept beside the good ones.
    """
    corrupt = F.col("_corrupt_record").isNotNull()
    complete = F.col("from_waybackmachine").isNotNull() & F.col("label").isNotNull()
    (
        read_json_lines(spark, source, RESOURCE)
        .filter(corrupt | complete)
        .withColumn("status", F.when(corrupt, "corrupt").otherwise("ok"))
        .write.mode("append")
        .partitionBy("status", "label")
        .parquet(target)
    )


def read_ingested(spark: SparkSession, target: str, status: str = "ok") -> DataFrame:
    """Rows of one status; the filter prunes folders, not rows."""
    return spark.read.parquet(target).filter(F.col("status") == status)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def overwrite_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def cached_table(
    spark: SparkSession, path: str, compute: Callable[[], DataFrame]
) -> DataFrame:
    """Read the table at ``path``, computing and writing it when it is absent."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        compute().write.mode("errorifexists").parquet(path)
        return spark.read.parquet(path)
