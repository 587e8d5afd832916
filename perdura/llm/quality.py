"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Method: words (A-Z lower-cased) and word pairs are hashed into `buckets`. The raw model
counts them over all documents, the target model over documents labelled as good that
are not held out (at most `most`, those with the least hash). A text's log weight is
the mean log ratio of the two models over its n-grams times `stretch`: the weight of a
stretch of that many n-grams, so that a text's length does not decide. To each log
weight a Gumbel variate is added, drawn by hashing the row; the k greatest sums are a
sample without replacement by weight. The k-th greatest is found by histograms of the
sums' leading bits, refined in the boundary bucket only; nothing is sorted.

Rows: a null or empty text has log weight 0. Equal rows (id and text) have equal sums
and are taken alike. Without usable labels all weights are 0, so the sample is uniform.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perdura.llm.mixing import thresholds
from perdura.llm.textkit import LOWER, RollingHash, bytes_of, mix, slices, word_spans
from perdura.llm.toxicity import held_out
from perdura.sources.staging import stage_table

BUCKETS = 10_000
STRETCH = 100
SMOOTHING = 1.0
U64 = np.uint64


def _ngrams(part: pa.RecordBatch, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of all words and word pairs."""
    data, offsets = bytes_of(part.column("text"))
    start, end, first = word_spans(data, offsets)
    words = RollingHash(LOWER[data]).spans(start, end)
    row = np.repeat(np.arange(part.num_rows), np.diff(first))
    same = row[1:] == row[:-1]
    pairs = mix(words[:-1] * U64(0x9E3779B97F4A7C15) + words[1:])[same]
    bucket = (np.concatenate([words, pairs]) % U64(buckets)).astype(np.int64)
    return bucket, np.concatenate([row, row[1:][same]])


def _counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                total += np.bincount(_ngrams(part, buckets)[0], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    return run


def model(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Log probabilities of the buckets over all texts."""
    rows = (
        texts.select(F.col("text").cast("string")).mapInArrow(_counts(buckets), "bucket long, n long")
        .groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    )
    counts = np.full(buckets, SMOOTHING)
    for r in rows:
        counts[r["bucket"]] += r["n"]
    return np.log(counts / counts.sum())


def good_documents(docs: DataFrame, labels: DataFrame, most: int = 40_000) -> tuple[DataFrame, float]:
    """(documents labelled good, share of good among labelled ones), without held-out rows."""
    usable = (
        labels.where("doc_id is not null and quality in (0, 1)").where(~held_out())
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
    )
    row = usable.agg(F.avg("quality").alias("share")).first()
    sample = usable.where("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id")
    return docs.join(F.broadcast(sample), "doc_id", "leftsemi"), 1.0 if row["share"] is None else row["share"]


def _weigh(ratio: np.ndarray, stretch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                bucket, row = _ngrams(part, len(ratio))
                n = np.bincount(row, minlength=part.num_rows)
                total = np.bincount(row, weights=ratio[bucket], minlength=part.num_rows)
                weight = pa.array(stretch * total / np.maximum(n, 1))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("draw"), weight], ["doc_id", "draw", "log_weight"])

    return run


def resample(
    docs: DataFrame, labels: DataFrame, share: float | None = None, buckets: int = BUCKETS, stretch: int = STRETCH, seed: int = 1
) -> DataFrame:
    """doc_id, held_out, log_weight, key, kept; one row per row of docs.

    share of the rows is kept; by default the share of good ones among the labelled.
    """
    good, usual = good_documents(docs, labels)
    has_target = good.limit(1).count() > 0
    ratio = model(good, buckets) - model(docs, buckets) if has_target else np.zeros(buckets)
    kind = docs.schema["doc_id"].dataType.simpleString()
    # the draw: 52 bits of a hash of the row, as a number between 0 and 1
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), 12) + 0.5) / float(1 << 52)
    rows = stage_table(
        docs.select("doc_id", draw.alias("draw"), F.col("text").cast("string"))
        .mapInArrow(_weigh(ratio, stretch), f"doc_id {kind}, draw double, log_weight double")
        .select("doc_id", "log_weight", (F.col("log_weight") - F.log(-F.log("draw"))).alias("key")),
        "weights",
    )
    # 60 bits that rise as the key falls; keys lie well within +-2**20
    rank = F.floor((F.lit(float(1 << 20)) - F.greatest(F.lit(-1.0e6), F.least("key", F.lit(1.0e6)))) * float(1 << 38)).cast("long")
    ranked = rows.select("*", rank.alias("hash"), F.lit(None).cast("string").alias("source"), F.lit(1).cast("long").alias("size"))
    goal = ranked.groupBy("source").agg(
        F.floor(F.count("*") * (usual if share is None else share)).cast("double").alias("rest")
    )
    below = thresholds(ranked, goal).select(F.col("below"))
    return ranked.join(F.broadcast(below), F.lit(True)).select(
        "doc_id", held_out().alias("held_out"), "log_weight", "key", (F.col("hash") < F.col("below")).alias("kept")
    )
