"""Repeated passages of texts, found exactly by a depth-limited radix sort of suffixes.

Method: every 400-byte string (the threshold) is a suffix cut at that depth; those that
occur more than once are wanted. Suffixes are ordered by most-significant-digit passes,
and each pass keeps equal groups only:

* The first digit of a string is its sample: the 32 bytes in it whose hash is least
  (the first of these). Equal strings have the same sample at the same place, and
  neighbouring strings share it, so one record stands for a whole run of strings.
* Later passes cut the runs that still share their digits into cells of 48, 6 and 1
  strings by their distance from the sample. A cell's digit is what all its strings
  have in common; it grows with each pass from 32 bytes to the full depth.
* A cell all of whose bytes occur again is finished: its strings are repeated. One
  record of each such group goes on, as partner for the others. Cells whose digit
  occurs once hold no repeated string and are dropped.

At the last pass a cell is one string, so its equal groups are exactly the repeated
strings. Digits are compared as 64-bit hashes. Groups are only counted, before and
after the shuffle, so a passage in a third of all texts is one key of a sum.

Rows: a null or empty text, or one shorter than the threshold, loses nothing. Equal
texts repeat each other wholly. Repeated rows and ties are equal texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perdura.llm.names import unused
from perdura.llm.textkit import RollingHash, bytes_of, mix, slices
from perdura.sources.staging import stage_table

LENGTH, SAMPLE = 400, 32
CELLS = (48, 6, 1)
PART_BYTES = 512 << 10  # a dozen arrays of 8 bytes a byte are held at once

U64 = np.uint64
LOW = U64(0xFFFFFFFF)
SALT = U64(0xBF58476D1CE4E5B9)
RUNS = "core long, full long, at int, lo int, hi int"
RECORD = ("k1", "k2", "at", "lo", "hi")


def text_key() -> list[Column]:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2")]


def sampled_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, sample: int = SAMPLE):
    """(core, full, at, lo, hi, text): runs of strings lo..hi with one sample at `at`, in buffer positions."""
    n = len(data)
    if n < length:
        return (np.zeros(0, U64), np.zeros(0, U64), *(np.zeros(0, np.int64) for _ in range(4)))
    rolling, width, count = RollingHash(data), length - sample + 1, n - length + 1
    place = np.arange(n - sample + 1)
    hashes = rolling.spans(place, place + sample)
    # the least of each `width` neighbours: from running minima of blocks, forward and backward
    ranked = np.full(-(-len(place) // width) * width, ~U64(0))
    ranked[: len(place)] = (hashes & ~LOW) | place.astype(U64)
    blocks = ranked.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(back[:count], ahead[width - 1 : width - 1 + count]) & LOW).astype(np.int64)
    del place, ranked, blocks, ahead, back
    edges = np.zeros(count + 1, np.int64)
    long = np.flatnonzero(np.diff(offsets) >= length)
    np.add.at(edges, offsets[long], 1)
    np.add.at(edges, offsets[long + 1] - length + 1, -1)
    inside = np.cumsum(edges)[:count] > 0
    changed = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])
    changed[offsets[(offsets > 0) & (offsets < count)] - 1] = True
    lo = np.flatnonzero(inside & np.r_[True, changed])
    hi = np.flatnonzero(inside & np.r_[changed, True])
    at = at[lo]
    owner = np.searchsorted(offsets, lo, side="right") - 1
    return hashes[at], _full(rolling, at, lo, hi, length), at, lo, hi, owner


def _full(rolling: RollingHash, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all bytes of the strings lo..hi with their place around the sample."""
    return mix(rolling.spans(lo, hi + length) + (at - lo).astype(U64) * SALT)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _sample(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                data, offsets = bytes_of(part.column("text"))
                core, full, at, lo, hi, owner = sampled_runs(data, offsets, length)
                begin = offsets[owner]
                yield pa.RecordBatch.from_arrays(
                    [part.column("k1").take(pa.array(owner)), part.column("k2").take(pa.array(owner)),
                     _signed(core), _signed(full), *(pa.array((x - begin).astype(np.int32)) for x in (at, lo, hi))],
                    ["k1", "k2", "core", "full", "at", "lo", "hi"],
                )

    return run


def _bodies(length: int):
    """The bytes of each run, cut from its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                for row in part.to_pylist():
                    text = row["text"].encode()
                    places = row["runs"]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["k1"]] * len(places), pa.int64()), pa.array([row["k2"]] * len(places), pa.int64()),
                         *(pa.array([p[c] for p in places], pa.int32()) for c in ("at", "lo", "hi")),
                         pa.array([text[p["lo"] : p["hi"] + length] for p in places], pa.binary())],
                        ["k1", "k2", "at", "lo", "hi", "body"],
                    )

    return run


def _cut(size: int, length: int):
    """The cells of `size` strings within each parts[] range of a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body", PART_BYTES):
                data, offsets = bytes_of(part.column("body"))
                rolling = RollingHash(data)
                at, first = (part.column(c).to_numpy().astype(np.int64) for c in ("at", "lo"))
                ranges = part.column("parts")
                row = np.repeat(np.arange(part.num_rows), np.diff(ranges.offsets.to_numpy()))
                flat = ranges.flatten()
                lo, hi = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lo", "hi"))
                # distances from the sample fall as strings go right
                high, low = (at[row] - lo) // size, (at[row] - hi) // size
                number = high - low + 1
                which = np.repeat(np.arange(len(row)), number)
                cell = low[which] + np.arange(len(which)) - np.repeat(np.cumsum(number) - number, number)
                row, lo, hi = row[which], lo[which], hi[which]
                here = at[row]
                whole_lo, whole_hi = here - cell * size - size + 1, here - cell * size
                lo, hi = np.maximum(lo, whole_lo), np.minimum(hi, whole_hi)
                shift = offsets[row] - first[row]
                core = mix(rolling.spans(whole_hi + shift, whole_lo + length + shift) + cell.astype(U64) * SALT)
                full = core if size == 1 else _full(rolling, here + shift, lo + shift, hi + shift, length)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column("k1").take(take), part.column("k2").take(take), _signed(core), _signed(full),
                     *(pa.array(x.astype(np.int32)) for x in (here, lo, hi))],
                    ["k1", "k2", "core", "full", "at", "lo", "hi"],
                )

    return run


def _pass(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records whose bytes all occur again, records that share their digit with other bytes).

    Most digits occur once. Their records are dropped first, so that only the others are moved by their bytes.
    """
    often = records.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
    records = stage_table(records.join(often, "core", "leftsemi").select(*records.columns), "met_again")
    groups = stage_table(
        records.groupBy("full").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("core", *RECORD)]),
        "groups",
    )
    repeated = records.join(groups.where("n > 1").select("full"), "full", "leftsemi").select("k1", "k2", "lo", "hi")
    shared = stage_table(groups.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"), "shared")
    return repeated, groups.join(shared, "core", "leftsemi").select(*RECORD)


def repeated_ranges(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(k1, k2, ranges): byte ranges [lo, hi) of each different text that hold a repeated string."""
    texts = docs.select(*text_key(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(
        F.octet_length("text") >= length
    )
    records = stage_table(texts.mapInArrow(_sample(length), f"k1 long, k2 long, {RUNS}"), "runs")
    repeated, going = _pass(records)
    found = [stage_table(repeated.distinct(), "repeated")]
    runs = going.groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "lo", "hi")).alias("runs"))
    bodies = stage_table(
        texts.groupBy("k1", "k2").agg(F.first("text").alias("text")).join(runs, ["k1", "k2"])
        .mapInArrow(_bodies(length), "k1 long, k2 long, at int, lo int, hi int, body binary"),
        "bodies",
    )
    parts = bodies.withColumn("parts", F.array(F.struct("lo", "hi")))
    for size in CELLS:
        records = stage_table(parts.mapInArrow(_cut(size, length), f"k1 long, k2 long, {RUNS}"), "cells")
        repeated, going = _pass(records)
        found.append(stage_table(repeated.distinct(), "repeated"))
        if size > 1:
            ranges = going.groupBy("k1", "k2", "at").agg(F.collect_list(F.struct("lo", "hi")).alias("parts"))
            parts = bodies.join(ranges, ["k1", "k2", "at"])
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    ranges = F.sort_array(F.collect_list(F.struct("lo", (F.col("hi") + length).alias("hi"))))
    return stage_table(every.groupBy("k1", "k2").agg(ranges.alias("ranges")), "ranges")


def _kept(text: bytes, ranges: list[dict]) -> tuple[bytes, int]:
    """(the bytes outside the ranges, number of maximal removed runs); ranges rise by lo."""
    kept, spans, at, last = [], 0, 0, -1
    for r in ranges:
        if r["lo"] > last:
            spans += 1
            kept.append(text[at : r["lo"]])
        last = max(last, r["hi"])
        at = last
    kept.append(text[at:])
    return b"".join(kept), spans


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            rows = []
            for text, ranges in zip(part.column("text").to_pylist(), part.column("ranges").to_pylist()):
                data = text.encode()
                kept, spans = _kept(data, ranges or [])
                rows.append((len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )


def _with_ranges(docs: DataFrame, columns: list[Column], length: int) -> DataFrame:
    found = repeated_ranges(docs, length)
    return docs.select(*columns, *text_key()).join(found, ["k1", "k2"], "left").drop("k1", "k2")


def removed_passages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; one row per row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_ranges(docs, [F.col("doc_id"), text], length).mapInArrow(
        _report, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def without_passages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the repeated bytes taken out of their texts, and n_chars to match.

    A letter cut in two by a removed run goes too, so that the text stays valid. Texts
    without repeated bytes, null ones among them, are as before.
    """
    names = docs.columns
    k1, k2, cuts = (unused(names, c) for c in ("_k1", "_k2", "_ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                texts = part.column("text").to_pylist()
                cut = [
                    t if not r else _kept(t.encode(), r)[0].decode("utf-8", "ignore")
                    for t, r in zip(texts, part.column(cuts).to_pylist())
                ]
                columns = [pa.array(cut, pa.string()) if n == "text" else part.column(n) for n in names]
                yield pa.RecordBatch.from_arrays(columns, names)

    found = repeated_ranges(docs, length).select(
        F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("ranges").alias(cuts)
    )
    one, two = text_key()
    cleaned = (
        docs.withColumns({k1: one, k2: two}).join(found, [k1, k2], "left")
        .select(*[F.col(f"`{n}`") for n in names], cuts)
        .mapInArrow(run, docs.schema)
    )
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn(
            "n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind)
        )
    return cleaned
