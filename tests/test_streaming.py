"""Ingest: replays add nothing, late rows stay, a batch reads its own days' keys alone."""

import os

from pyspark.sql import functions as F

from perdura.streaming import jobs

SCHEMA = "id long, ts timestamp, v double, tags map<string,string>"


def rows_of(spark, days, n=10, v=1.0):
    made = [(day * 1000 + i, f"2024-01-{day:02d} 0{i % 10}:00:00", v, {"b": "1", "a": str(i)}) for day in days for i in range(n)]
    return spark.createDataFrame(made, "id long, ts string, v double, tags map<string,string>").withColumn("ts", F.col("ts").cast("timestamp"))


class Feed:
    def __init__(self, spark, folder):
        self.spark = spark
        self.source, self.target, self.state = (str(folder / x) for x in ("in", "out", "state"))

    def send(self, rows):
        rows.coalesce(1).write.mode("append").json(self.source)
        stream = jobs.stream_json(self.spark, self.source, SCHEMA)
        jobs.ingest_stream(stream, self.target, self.state, "id", "ts").awaitTermination()

    def stored(self):
        return self.spark.read.schema(SCHEMA).parquet(self.target)


def test_replays_add_nothing_and_late_rows_stay(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.send(rows_of(spark, [9, 10]))
    feed.send(rows_of(spark, [9, 10], v=2.0))  # replays, whatever else they say
    feed.send(rows_of(spark, [1]))  # far behind the others
    feed.send(rows_of(spark, [10], n=12))
    got = feed.stored()
    assert got.count() == 32 and got.select("id").distinct().count() == 32
    assert got.where("v <> 1.0").isEmpty()


def test_least_row_of_a_key_stays_with_maps_and_nulls(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    rows = [(1, "2024-01-01", 5.0, {"k": "b"}), (1, "2024-01-01", 5.0, {"k": "a"}), (1, "2024-01-01", 6.0, None),
            (None, "2024-01-01", 1.0, None), (None, "2024-01-01", 1.0, None), (2, None, 1.0, None), (2, None, 1.0, None)]
    feed.send(spark.createDataFrame(rows, "id long, ts string, v double, tags map<string,string>"))
    got = sorted((r["id"] or 0, r["v"], str(r["tags"])) for r in feed.stored().collect())
    assert got == [(0, 1.0, "None"), (0, 1.0, "None"), (1, 5.0, "{'k': 'a'}"), (2, 1.0, "None")]


def test_files_read_by_a_batch_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    read = []
    keys = jobs.KeyIndex.keys

    def watched(self, days, besides):
        found = keys(self, days, besides)
        read.append(sorted({f.split("day=")[1].split("/")[0] for f in found.inputFiles()}))
        return found

    monkeypatch.setattr(jobs.KeyIndex, "keys", watched)
    feed = Feed(spark, tmp_path)
    for day in range(1, 9):
        feed.send(rows_of(spark, [day]))
    feed.send(rows_of(spark, [3, 20]))
    assert read == [[]] * 8 + [["2024-01-03"]]
    assert feed.stored().count() == 90


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.send(rows_of(spark, [1]))
    feed.send(rows_of(spark, [1, 2], n=15))
    before = sorted(map(str, feed.stored().collect()))
    for mark in (f"{feed.state}/commits/1", f"{feed.state}/commits/.1.crc"):
        os.remove(mark)  # as if the second batch had been cut off before its commit
    stream = jobs.stream_json(spark, feed.source, SCHEMA)
    jobs.ingest_stream(stream, feed.target, feed.state, "id", "ts").awaitTermination()
    assert sorted(map(str, feed.stored().collect())) == before and len(before) == 30
    keys = spark.read.parquet(f"{feed.target}-keys")
    assert keys.count() == 30


def test_counts_keep_whole_versions(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for day in (1, 2, 3):
        rows_of(spark, [day]).write.mode("append").json(source)
        jobs.table_of_counts(jobs.running_count(jobs.stream_json(spark, source, SCHEMA)), target, state).awaitTermination()
        assert jobs.read_counts(spark, target).first()["cnt"] == 10 * day
    os.makedirs(f"{target}/version=99")  # one that is being written
    assert jobs.read_counts(spark, target).first()["cnt"] == 30
    assert sorted(os.listdir(target)) == ["version=-1", "version=1", "version=2", "version=99"]
