"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only.

Method: every document has a 60-bit hash of its id and text. A source whose target is
q times its size and a rest takes each document q times, and once more those whose
hash lies below the source's threshold. Thresholds are found from histograms: sizes
are summed by source and the next 12 bits of the hash, the bucket in which the rest
runs out is found from running totals, and only that bucket is summed again by its
next 12 bits. The bucket left after all 60 bits holds equal hashes; it is taken if
that brings the source nearer to its target. No rows are sorted, and a source of any
size is only a key that is summed before the shuffle.

Targets: sources in code point order, null last, weigh 3, 1, 2, repeating. They share
`share` times all sizes; none exceeds `limit` times its size, and what that leaves is
shared among the others by weight.

Rows: a null text has size 0. Rows with equal id and text have the same hash and are
taken alike. A null source is a source. A table without words takes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perdura.llm.names import unused
from perdura.sources.staging import stage_table

WEIGHTS = (3, 1, 2)
SHARE, LIMIT = 1.5, 2
BITS, PASSES = 12, 5
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def row_hash() -> Column:
    """60 bits of the md5 of id and text."""
    name = F.concat(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    )
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, hash) of every row, written once."""
    return stage_table(
        docs.select("doc_id", F.col("source").cast("string"), size_of(F.col("text")).alias("size"), row_hash().alias("hash")),
        "sized",
    )


def targets(rows: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(source, source_size, target). The one window runs over a row per source, not over documents."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    values = F.array(*[F.lit(float(w)) for w in weights])
    sources = (
        rows.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", values[(F.row_number().over(order) - 1) % len(weights)])
        .withColumn("cap", F.col("source_size") * float(limit))
    )
    # in rising order of cap per weight, those before the first source that is not full are full;
    # from that one on the level falls, so it is the greatest of the levels that fit
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    return (
        sources.withColumn("total", F.sum("source_size").over(everything) * float(share))
        .withColumn("full_before", F.sum("cap").over(filling) - F.col("cap"))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.sum("weight").over(filling) + F.col("weight"))
        .withColumn("level", (F.col("total") - F.col("full_before")) / F.col("weight_left"))
        .withColumn("open_level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything))
        .select(
            "source", "source_size",
            F.when(F.col("open_level").isNull(), F.col("cap"))
            .otherwise(F.least("cap", F.col("open_level") * F.col("weight")))
            .alias("target"),
        )
    )


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, below): rows with a hash under it are taken once more.

    goals: (source, source_size, target, times, rest).
    """
    bound = stage_table(
        goals.select(F.col("source").alias("of"), F.lit(0).cast("long").alias("below"), F.col("rest").cast("double").alias("rest")),
        "bounds",
    )
    for step in range(PASSES):
        shift = BITS * (PASSES - 1 - step)
        width = 1 << shift
        inside = rows.join(bound, _same(F.col("source"), F.col("of"))).where(
            F.lit(True) if step == 0
            else F.shiftright("hash", shift + BITS) == F.shiftright("below", shift + BITS)
        )
        histogram = inside.groupBy("of", F.shiftright("hash", shift).alias("bucket")).agg(
            F.sum("size").alias("size"), F.first("rest").alias("rest")
        )
        running = Window.partitionBy("of").orderBy("bucket")
        edge = (
            histogram.withColumn("upto", F.sum("size").over(running))
            .groupBy("of")
            .agg(
                F.min(F.when(F.col("upto") > F.col("rest"), F.col("bucket"))).alias("bucket"),
                F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))).alias("taken"),
                F.min(F.when(F.col("upto") > F.col("rest"), F.col("upto"))).alias("over"),
                F.max("bucket").alias("last"),
                F.first("rest").alias("rest"),
            )
            .withColumn("taken", F.coalesce("taken", F.lit(0)))
        )
        left = F.col("rest") - F.col("taken")
        if step == PASSES - 1:  # equal hashes: all or none, whichever is nearer
            nearer = F.when(F.col("over") - F.col("rest") < left, F.col("bucket") + 1).otherwise(F.col("bucket"))
            below = F.coalesce(nearer, F.col("last") + 1)
        else:
            below = F.coalesce("bucket", F.col("last") + 1)
        bound = stage_table(edge.select("of", (below * width).alias("below"), left.alias("rest")), "bounds")
    return bound.select(F.col("of").alias("source"), "below")


def _plan(rows: DataFrame, weights: Sequence[float], share: float, limit: float) -> DataFrame:
    """(of, source_size, target, times, below): what the mix takes of each source."""
    goals = stage_table(
        targets(rows, weights, share, limit)
        .withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("rest", F.col("target") - F.col("times") * F.col("source_size")),
        "goals",
    )
    limits = thresholds(rows, goals.where("source_size > 0")).withColumnRenamed("source", "of")
    return stage_table(
        goals.join(limits, _same(F.col("source"), F.col("of")), "left").select(
            F.col("source").alias("of"), "source_size", "target", "times", F.coalesce("below", F.lit(0)).alias("below")
        ),
        "plan",
    )


def _copies(limit: float, hash_: str = "hash", plan: str = "") -> Column:
    below, times = F.col(f"{plan}below"), F.col(f"{plan}times")
    again = F.when((F.col(hash_) < below) & (times < limit), 1).otherwise(0)
    return (times + again).cast("long")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """doc_id, size, source_size, target, taken; one row per row of docs."""
    rows = sized(docs)
    plan = _plan(rows, weights, share, limit)
    return rows.join(plan, _same(F.col("source"), F.col("of"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * _copies(limit)).alias("taken")
    )


def mixed_documents(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: float = LIMIT
) -> DataFrame:
    """The rows of docs that the mix takes, with mix_size, mix_target and mix_copies beside their columns.

    Columns of docs that have one of these three names are replaced; all others stay.
    """
    made = ("mix_size", "mix_target", "mix_copies")
    kept = [c for c in docs.columns if c.lower() not in made]
    found, name = unused(docs.columns, "_plan"), unused(docs.columns, "_hash")
    plan = _plan(sized(docs), weights, share, limit).select(F.struct("of", "target", "times", "below").alias(found))
    rows = docs.withColumn(name, row_hash())
    return (
        rows.join(plan, _same(F.col("source").cast("string"), F.col(f"{found}.of")))
        .where(_copies(limit, name, f"{found}.") > 0)
        .select(
            *[F.col(f"`{c}`") for c in kept], size_of(F.col("text")).alias("mix_size"),
            F.col(f"{found}.target").alias("mix_target"), _copies(limit, name, f"{found}.").alias("mix_copies"),
        )
    )
