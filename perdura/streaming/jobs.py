"""Continuous ingest of JSON lines, and running counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def stream_json(
    spark: SparkSession, source: str, schema: T.StructType | str, files_per_trigger: int = 100
) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(source)
    )


def _orderable(df: DataFrame) -> Column:
    """All columns as one value that can be compared; maps count by their JSON."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    has_map = lambda kind: "map<" in kind.simpleString()
    return F.struct(*(F.to_json(F.struct(c)) if has_map(k) else F.col(c) for c, k in kinds.items()))


class KeyIndex:
    """The keys stored so far, in folders by day and, below, by batch.

    A batch reads the folders of its own days alone: other days are neither listed nor
    opened, so what a batch reads does not grow with the table. A batch that runs again
    replaces its folders.
    """

    def __init__(self, spark: SparkSession, path: str, key: T.StructField):
        self.spark, self.path = spark, path
        self.schema = T.StructType([key, T.StructField("batch", T.LongType()), T.StructField("day", T.StringType())])

    def _folders(self, days: Sequence[str]) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        paths = [f"{self.path}/day={d}" for d in sorted(days)]
        return [p for p in paths if (at := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(at)]

    def keys(self, days: Sequence[str], besides: int) -> DataFrame:
        """(key, day) stored for these days by other batches."""
        folders = self._folders(days)
        if not folders:
            return self.spark.createDataFrame([], self.schema).drop("batch")
        rows = self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*folders)
        return rows.where(F.col("batch") != besides).drop("batch")

    def add(self, keyed: DataFrame, batch: int) -> None:
        """Replace what this batch has stored for the days of ``keyed``."""
        writer = keyed.withColumn("batch", F.lit(batch)).write.mode("overwrite").partitionBy("day", "batch")
        writer.option("partitionOverwriteMode", "dynamic").parquet(self.path)


def ingest_stream(
    rows: DataFrame,
    target: str,
    checkpoint: str,
    key: str,
    event_time: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Append to Parquet, dropping replays of a key; no row is too late.

    A replay is a row with the key and event day of a stored one, or of another row of its
    batch, of which the least in column order stays. Days come from the event time, ``none``
    where there is none. Each batch is written to a folder of its own number, so one that runs
    again replaces itself with the same rows; it is compared with the ``KeyIndex`` beside the
    table (``<target>-keys``). Rows without a key are all kept. A batch's distinct days pass
    through the driver.
    """
    spark = rows.sparkSession
    day = F.coalesce(F.to_date(event_time).cast("string"), F.lit("none")).alias("day")
    index = KeyIndex(spark, f"{target}-keys", rows.schema[key])
    spark.createDataFrame([], rows.schema).write.mode("append").parquet(target)  # a table even if no row comes

    def store(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            named = batch.select("*", day)
            keyed = named.where(F.col(key).isNotNull())
            days = [r["day"] for r in keyed.select("day").distinct().collect()]
            least = F.min_by(F.struct(*batch.columns), _orderable(batch)).alias("least")
            fresh = (
                keyed.join(index.keys(days, number), [key, "day"], "left_anti")
                .groupBy(F.col(key).alias("_key"), "day").agg(least).select("least.*", "day")
            )
            folder = f"{target}/batch={number}"
            fresh.unionByName(named.where(F.col(key).isNull())).write.mode("overwrite").partitionBy("day").parquet(folder)
            stored = spark.read.schema(named.schema).parquet(folder).where(F.col(key).isNotNull())
            index.add(stored.select(key, "day"), number)
        finally:
            batch.unpersist()

    writer = (
        rows.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(store)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def running_count(rows: DataFrame) -> DataFrame:
    """Rows so far; one state entry."""
    return rows.groupBy().agg(F.count("*").alias("cnt"))


def windowed_counts(
    rows: DataFrame, event_time: str, width: str = "1 hour", delay: str | None = None
) -> DataFrame:
    """Rows per tumbling window; with ``delay`` closed windows leave the state."""
    timed = rows.withWatermark(event_time, delay) if delay else rows
    return timed.groupBy(F.window(event_time, width).alias("w")).agg(F.count("*").alias("cnt"))


def table_of_counts(
    counts: DataFrame, target: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Keep a Parquet table of the counts, written anew at each trigger; ``read_counts`` reads it.

    Each trigger writes a folder of its own, and the one before it stays, so a reader never
    meets a table that is being replaced. Without ``every`` (the study polls at "300 seconds")
    the stream takes what is there and stops.
    """
    spark = counts.sparkSession
    counts.sparkSession.createDataFrame([], counts.schema).write.mode("ignore").parquet(f"{target}/version=-1")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/version={number}")
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/version={number - 2}")
        old.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(old, True)

    writer = (
        counts.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
    )
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def read_counts(spark: SparkSession, target: str) -> DataFrame:
    """The last complete version of a table of counts."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    system = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    done = []
    for status in system.listStatus(place):
        folder = status.getPath()
        mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")
        if folder.getName().startswith("version=") and system.exists(mark):
            done.append(int(folder.getName().removeprefix("version=")))
    return spark.read.parquet(f"{target}/version={max(done)}")
