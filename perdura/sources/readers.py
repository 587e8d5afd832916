"""Scans: Parquet views, JSON lines, CSV, object listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perdura.sources.schemas import BRIDGE, RESOURCE, raw_json


def load_dataset(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Read Parquet and register it as a named view."""
    df = spark.read.parquet(path)
    df.createOrReplaceTempView(name)
    return df


def _number(text: Column, kind: T.DataType) -> Column:
    value = text.try_cast("double")
    if isinstance(kind, T.DoubleType):
        return value
    return F.when(~F.isnan(value), value.try_cast(kind))


def typed_columns(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast the text fields of JSON lines; the single ``_id`` value is the id."""
    out = []
    for field in schema:
        if field.name == "id":
            col = F.get(F.map_values(F.col("_id")), 0)
        elif isinstance(field.dataType, T.StringType):
            col = F.col(field.name)
        else:
            col = _number(F.col(field.name), field.dataType)
        out.append(col.alias(field.name))
    return raw.select(*out, "_corrupt_record")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed rows plus ``_corrupt_record``, set where a line is no JSON object."""
    raw = (
        spark.read.schema(raw_json(schema))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
    )
    return typed_columns(raw, schema)


def split_corrupt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, unreadable lines)."""
    bad = F.col("_corrupt_record").isNotNull()
    good = rows.filter(~bad).drop("_corrupt_record")
    # the id rides along: a scan of the corrupt column alone is not allowed
    return good, rows.filter(bad).select("id", "_corrupt_record")


def read_resources(spark: SparkSession, path: str) -> DataFrame:
    """Web resources; rows without origin flag or label are dropped."""
    good, _ = split_corrupt(read_json_lines(spark, path, RESOURCE))
    return good.dropna(subset=["from_waybackmachine", "label"])


def read_bridge(spark: SparkSession, path: str) -> DataFrame:
    good, _ = split_corrupt(read_json_lines(spark, path, BRIDGE))
    return good


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def object_counts(spark: SparkSession, root: str) -> DataFrame:
    """Objects and bytes per first-level folder, with a total row (null bucket).

    Only paths and sizes are read; the content column is pruned.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .select("path", "length")
    )
    tail = F.element_at(F.split(F.col("path"), F.lit(root.rstrip("/") + "/"), 2), -1)
    return (
        files.withColumn("bucket", F.substring_index(tail, "/", 1))
        .rollup("bucket")
        .agg(F.count("*").alias("objects"), F.sum("length").alias("bytes"))
    )
