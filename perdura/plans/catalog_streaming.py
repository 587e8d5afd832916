"""Streaming ingest and counts over the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perdura.plans.registry import query, table
from perdura.sources.staging import new_table_path
from perdura.streaming import jobs

EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value"]
    return table(spark, sf_dir, "events").select(*names)


@query(
    "stream_ingest",
    """SELECT event_type, count(*) AS cnt, count(DISTINCT event_id) AS ids, round(sum(value), 2) AS total
      FROM events GROUP BY event_type""",
)
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON files in, Parquet out, in several triggers; then all arrive once more and add nothing."""
    source, target, state = (
        new_table_path(spark, name) for name in ("events-json", "events", "events-state")
    )
    for _ in range(2):
        _events(spark, sf_dir).repartition(6).write.mode("append").json(source)
        rows = jobs.stream_json(spark, source, EVENT_SCHEMA, files_per_trigger=4)
        jobs.ingest_stream(rows, target, state, "event_id", "ts").awaitTermination()
    return (
        spark.read.schema(EVENT_SCHEMA)
        .parquet(target)
        .groupBy("event_type")
        .agg(
            F.count("*").alias("cnt"),
            F.count_distinct("event_id").alias("ids"),
            F.round(F.sum("value"), 2).alias("total"),
        )
    )


def _by_start(counts: DataFrame) -> DataFrame:
    start = F.date_format(F.col("w.start"), "yyyy-MM-dd HH:mm:ss")
    return counts.select(start.alias("window_start"), "cnt")


HOURS_SQL = """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
  count(*) AS cnt FROM events GROUP BY 1"""


@query("stream_count", HOURS_SQL)
def stream_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per hour, kept up to date by a stream that overwrites a small table."""
    target, state = new_table_path(spark, "hours"), new_table_path(spark, "hours-state")
    rows = (
        spark.readStream.schema(table(spark, sf_dir, "events").schema)
        .parquet(f"{sf_dir}/events*.parquet")
        .select(F.col("ts").cast("timestamp").alias("ts"))
    )
    jobs.table_of_counts(jobs.windowed_counts(rows, "ts"), target, state).awaitTermination()
    return _by_start(jobs.read_counts(spark, target))


@query("windowed_count_batch", HOURS_SQL)
def windowed_count_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_start(jobs.windowed_counts(_events(spark, sf_dir), "ts"))
