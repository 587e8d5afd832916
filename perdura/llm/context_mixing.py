"""Language-model scores by logistic context mixing over bits.

Method: a text is its words (A-Z lower-cased) with one space between and an end byte,
so its probability is that of its token sequence. Each bit of a byte is predicted from
the bytes before it: for orders 1 to 6 and for the current word's beginning, from how
often the bit was 0 and 1 after the same context and the byte's earlier bits. The log
odds are added up with weights that two gates choose (the byte's earlier bits; the
longest context seen and the bit's place), and the sum is refined by a table of what
such sums came to, by the byte's earlier bits.

Counts: every distinct seven-byte window of the corpus is counted; these counts grow with
the text, contexts are told apart by their bytes, and counts are whole numbers. The texts
are dealt to slices, and each slice hands on its distinct windows once, packed by bucket:
the bucket hangs on the four nearest bytes of context, so one holds all windows of its
contexts of four to six bytes, and their log odds come from its rows alone. Contexts of one
to three bytes are counted level by level over the strings of five bytes, which are few,
and come to the buckets that meet them. The log odds of a byte's bits are packed into a long.

Training: documents outside fold 0 (crc32 of doc_id modulo 10). With the counts of folds
1 to 8, fold 9 trains the weights online, in small steps over its windows, and then the
refinement, so that both see counts that have not met their text. Partitions train apart
and are averaged after each round. Scores use the counts of folds 1 to 9. All bits of a
byte depend on its window alone, so each distinct window is scored once; the scores go
back to the slices packed in the order in which the slice had sent its windows, without
the windows. A document's score does not depend on others outside the training folds, and
a task that runs again gives the same.

The base score is that of a smoothed unigram model of the same tokens; words are told
apart by 64-bit hashes, packed by bucket and counted as windows are; nothing that grows is
broadcast.

Rows: a null or empty text, or one without words, is the end token alone. A row without
doc_id is held out. Without training documents c, N and V are 0 and the base score 0.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perdura.llm.textkit import LOWER, RollingHash, bytes_of, mix, slices, word_spans
from perdura.sources.staging import stage_table

FOLDS, TUNE = 10, 9
HISTORY = 6
CONTEXTS = HISTORY + 1  # orders 1 to 6, and the word's beginning
END = 0x0A
SCALE = 15.5  # of log odds in a signed byte
LEVELS = 33
STEPS = 1 << 20  # of a window's score
RATE, STEP, ROUNDS = 0.15, 4096, 2
SLICE = 2 << 20  # of windows
WHOLE = 16 << 20  # of text
LEVEL = 6  # of its compression
HELD = 2 << 20  # windows of a slice, before they are added up
NEAR = 3  # contexts up to these bytes are counted level by level, the others in the buckets
BUCKETS = 256  # at least
BUCKET_BYTES = 4 << 20  # of text, where there are more
GROUP = 1 << 20  # windows or words that are looked at together, in whole buckets

PACKED = "bucket int, slice long, n int, keys binary, fit binary, tune binary"
VALUES = "slice long, bucket int, n int, values binary"

U64 = np.uint64


def fold() -> Column:
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS).cast("int")


def streams(data: np.ndarray, offsets: np.ndarray, spans: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(windows, first window of each text): each byte of the texts' streams with the HISTORY before it."""
    start, end, first = spans
    words, length = np.diff(first), end - start
    letters = np.r_[0, np.cumsum(length)]
    size = letters[first[1:]] - letters[first[:-1]] + np.maximum(words - 1, 0) + 1
    base = np.r_[0, np.cumsum(size + HISTORY)]
    out = np.full(base[-1], 0x20, dtype=np.uint8)
    text = np.repeat(np.arange(len(words)), words)
    place = base[text] + HISTORY + letters[:-1] - letters[first[text]] + np.arange(len(start)) - first[text]
    # the letters keep their order, so two masks of one byte a letter will do
    source, target = np.zeros(len(data) + 1, np.int8), np.zeros(len(out) + 1, np.int8)
    for edges, begin in ((source, start), (target, place)):
        edges[begin] += 1
        edges[begin + length] -= 1
    out[np.cumsum(target, dtype=np.int8)[:-1].astype(bool)] = data[np.cumsum(source, dtype=np.int8)[:-1].astype(bool)]
    head = np.add.outer(base[:-1], np.arange(HISTORY))
    out[head] = END
    out[base[1:] - 1] = END
    wide = out.astype(U64)
    window = wide[HISTORY:].copy()
    for k in range(1, HISTORY + 1):
        window |= wide[HISTORY - k : len(wide) - k] << U64(8 * k)
    real = np.ones(len(out), dtype=bool)
    real[head] = False
    return window[real[HISTORY:]], np.r_[0, np.cumsum(size)]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, rising, and the sums of their counts."""
    values = np.concatenate(keys)
    order = np.argsort(values, kind="stable")  # made for runs that rise
    values = values[order]
    begin = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])[: len(values)]
    counts = np.concatenate(counts)[order]
    return values[begin], np.add.reduceat(counts, begin, dtype=np.int64) if len(values) else counts


def _slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have WHOLE bytes at most, each as one compressed value."""
    part_id, number, rest = TaskContext.get().partitionId(), 0, None

    def row(part: pa.RecordBatch) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", LEVEL))) as stream:
            stream.write_batch(part)
        size = len(bytes_of(part.column("text"))[0])
        rows = pa.array([sink.getvalue().to_pybytes()], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([(part_id << 32) | number]), pa.array([size]), rows], ["slice", "size", "rows"])

    for batch in batches:
        table = pa.Table.from_batches([batch] if rest is None else [rest, batch])
        parts = [part for one in table.combine_chunks().to_batches() for part in slices(one, "text", WHOLE)]
        for part in parts[:-1]:
            yield row(part)
            number += 1
        rest = parts[-1] if parts else None
    if rest is not None:
        yield row(rest)


def _rows_of(blob: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob.as_buffer()).read_next_batch()


def _pressed(values: np.ndarray) -> bytes:
    """The bytes of an array, first bytes first, compressed."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T), "zstd", asbytes=True)


def _restored(blob: pa.Scalar, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(blob.as_buffer(), n * size, "zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(kind).ravel()


def _rows_by_bucket(bucket: np.ndarray, slice_id: int, keys: np.ndarray, *counts: np.ndarray) -> pa.RecordBatch:
    """A packed row for each bucket; keys come by bucket and rise in each."""
    begin = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])[: len(bucket)]
    edges = [*zip(begin, np.r_[begin[1:], len(bucket)])] if len(bucket) else []
    binary = [pa.array([_pressed(np.diff(keys[i:j], prepend=U64(0))) for i, j in edges], pa.binary())]
    binary += [pa.array([_pressed(c[i:j]) for i, j in edges], pa.binary()) for c in counts]
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[begin].astype(np.int32)), pa.array(np.full(len(edges), slice_id)),
         pa.array([j - i for i, j in edges], pa.int32()), *binary],
        ["bucket", "slice", "n", "keys", "fit", "tune"][: 3 + len(binary)],
    )


def _turned(window: np.ndarray) -> np.ndarray:
    """The window with its context backwards, so that the nearest byte leads; turned twice it is itself."""
    return (((window >> U64(8)).byteswap() >> U64(16)) << U64(8)) | (window & U64(0xFF))


def _bucket(turned: np.ndarray, buckets: int) -> np.ndarray:
    """By the nearest bytes; those that differ in a space or end as the oldest come together."""
    near = turned >> U64(8 * (HISTORY - NEAR))
    near = np.where(near & U64(0xFF) == U64(END), near ^ U64(END ^ 0x20), near)
    return (mix(near) & U64(buckets - 1)).astype(np.uint16)


def _by_bucket(turned: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, place) of rising turned windows in the order in which they are packed."""
    bucket = _bucket(turned, buckets)
    place = np.argsort(bucket, kind="stable")
    return bucket[place], place


def _turned_streams(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = bytes_of(part.column("text"))
    data = LOWER[data]
    window, first = streams(data, offsets, word_spans(data, offsets))
    return _turned(window), first


def _pack_windows(buckets: int):
    """The distinct windows of each slice with their counts in folds 1 to 8 and in the tuning fold."""

    def packed(slice_id: int, rows: pa.RecordBatch) -> pa.RecordBatch:
        keys, counts = [], []
        for part in slices(rows, "text", SLICE):
            turned, first = _turned_streams(part)
            fold_of = part.column("fold").to_numpy()
            kind = np.where(fold_of == 0, U64(2), np.where(fold_of == TUNE, U64(1), U64(0)))
            key, n = np.unique((turned << U64(2)) | np.repeat(kind, np.diff(first)), return_counts=True)
            keys.append(key)
            counts.append(n.astype(np.int32))
            if sum(map(len, keys)) > HELD:
                keys, counts = ([x] for x in _summed(keys, counts))
        key, n = _summed(keys, counts)
        turned = key >> U64(2)
        begin = np.flatnonzero(np.r_[True, turned[1:] != turned[:-1]])
        # of held-out windows only the names
        counts = [np.add.reduceat(np.where(key & U64(3) == kind, n, 0), begin) for kind in (U64(0), U64(1))]
        turned = turned[begin]
        bucket, place = _by_bucket(turned, buckets)
        return _rows_by_bucket(bucket, slice_id, turned[place], *(c[place] for c in counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slice_id, blob in zip(batch.column("slice").to_pylist(), batch.column("rows")):
                yield packed(slice_id, _rows_of(blob))

    return run


def _pack_counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows that come with their counts, as slice 0."""
    for batch in batches:
        turned = _turned(batch.column("window").to_numpy().view(U64))
        rise = np.argsort(turned)
        bucket, place = _by_bucket(turned[rise], BUCKETS)
        place = rise[place]
        yield _rows_by_bucket(bucket, 0, turned[place], *(batch.column(c).to_numpy()[place] for c in ("fit", "tune")))


def _bits(window: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, byte's earlier bits with a leading 1, bit) for the eight bits of the last byte."""
    byte = (window & U64(0xFF)).astype(np.int64)
    for place in range(8):
        yield place, (1 << place) | (byte >> (8 - place)), (byte >> (7 - place)) & 1


def _odds(string: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Log odds of the eight bits of each string's last byte after the bytes before it, as signed bytes in a long.

    string: distinct and rising, with all strings of a context; count: how often each was met.
    """
    met = []
    for place in range(9):  # strings with the same context and the same first bits
        prefix = string >> U64(8 - place)
        begin = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]])[: len(string)]
        met.append(np.repeat(np.add.reduceat(count, begin), np.diff(np.r_[begin, len(string)])))
    out = np.empty((len(string), 8), dtype=np.int8)
    for place, _, bit in _bits(string):
        same, other = met[place + 1], met[place] - met[place + 1]
        odds = np.clip(np.log((same + 0.4) / (other + 0.4)), -8, 8) * np.where(bit == 1, 1, -1)
        out[:, place] = np.round(odds * SCALE)
    return out.view(np.int64).ravel()


def _word_odds(string: np.ndarray, count: np.ndarray) -> np.ndarray:
    """_odds when the space or end before a word's beginning counts as one."""
    each, place, (total,) = _added_up(string, [count])
    return _odds(each, total)[place]


def _level(order: int):
    """Adds the log odds of one order, from rows that come by context: of folds 1 to 8 (f) and of all that train (a)."""
    kinds = ("f", "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settled(table: pa.Table) -> pa.Table:
            string = table.column("string").to_numpy().view(U64)
            rise = np.argsort(string, kind="stable")
            table, string = table.take(pa.array(rise)), string[rise]
            fit, tune = table.column("fit").to_numpy(), table.column("tune").to_numpy()
            inside = np.ones(len(string), dtype=bool)
            for n in range(1, order + 1):
                byte = (string >> U64(8 * n)) & U64(0xFF)
                inside &= (byte != U64(0x20)) & (byte != U64(END))
            oldest = string >> U64(8 * order + 8)
            begins = inside & ((oldest == U64(0x20)) | (oldest == U64(END)))
            plain = string & U64((1 << 8 * (order + 1)) - 1)
            columns = {n: table.column(n) for n in table.column_names if n != "key"}
            for kind, count in zip(kinds, (fit, fit + tune)):
                odds = _odds(string, count)
                word = columns[f"{kind}w"].to_numpy().copy()
                if begins.any():
                    word[begins] = _word_odds(plain[begins], count[begins])
                columns[f"{kind}{order}"], columns[f"{kind}w"] = pa.array(odds), pa.array(word)
            return pa.table([columns[n] for n in _columns(order)], names=_columns(order))

        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            key = table.column("key").to_numpy()
            whole = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last context may go on
            rest = table.slice(whole)
            if whole:
                yield from settled(table.slice(0, whole)).combine_chunks().to_batches()
        if rest is not None and rest.num_rows:
            yield from settled(rest).combine_chunks().to_batches()

    return run


def _columns(order: int) -> list[str]:
    return ["string", "fit", "tune", *[f"{kind}{k}" for kind in "fa" for k in [*range(order + 1), "w"]]]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings of the nearest bytes that make the buckets, with their counts."""
    for batch in batches:
        for table in _whole_buckets([batch]):
            bucket = np.repeat(table.column("bucket").to_numpy(), table.column("n").to_numpy())
            keys, fit, tune = _entries(table)
            string, place, total = _added_up(_near_string(keys), [fit, tune])
            where = np.zeros(len(string), np.int32)
            where[place] = bucket
            yield pa.RecordBatch.from_arrays(
                [pa.array(where), pa.array(string.view(np.int64)), *map(pa.array, total)],
                ["bucket", "window", "fit", "tune"],
            )


def _near_string(turned: np.ndarray) -> np.ndarray:
    string = _turned(turned) & U64((1 << 8 * (NEAR + 2)) - 1)
    oldest = U64(8 * (NEAR + 1))
    return np.where(string >> oldest == U64(END), string ^ (U64(END ^ 0x20) << oldest), string)


def _near_odds(packed: DataFrame) -> DataFrame:
    """bucket, near (the string of each window's nearest bytes) and the log odds of its contexts of up to NEAR bytes."""
    near = stage_table(
        packed.mapInArrow(_near, "bucket int, window long, fit long, tune long")
        .groupBy("bucket", "window").agg(F.sum("fit").alias("fit"), F.sum("tune").alias("tune")),
        "near",
    )
    known = None
    for order in range(NEAR):
        strings = near.groupBy(F.col("window").bitwiseAND((1 << 8 * (order + 2)) - 1).alias("string")).agg(
            F.sum("fit").alias("fit"), F.sum("tune").alias("tune")
        )
        if known is None:
            rows = strings.select("*", *[F.lit(0).cast("long").alias(f"{kind}w") for kind in "fa"])
        else:
            rows = strings.withColumn("end", F.col("string").bitwiseAND((1 << 8 * (order + 1)) - 1)).join(
                known.drop("fit", "tune").withColumnRenamed("string", "end"), "end"
            ).drop("end")
        # strings that differ in a space or end as the oldest byte come together
        context, oldest = F.shiftright("string", 8), F.shiftright("string", 8 * order + 8)
        key = F.when(oldest == END, context + ((0x20 - END) << 8 * order)).otherwise(context)
        known = rows.withColumn("key", key).repartition("key").sortWithinPartitions("key").mapInArrow(
            _level(order), ", ".join(f"{n} long" for n in _columns(order))
        )
    end = F.col("window").bitwiseAND((1 << 8 * (NEAR + 1)) - 1).alias("string")
    rows = near.select("bucket", F.col("window").alias("near"), end).join(known.drop("fit", "tune"), "string").drop("string")
    return stage_table(rows, "near_odds")


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that come by bucket, in whole buckets of about GROUP windows together, if not one bucket has more."""
    rest = None
    for batch in chain(batches, [None]):
        tables = [t for t in (rest, None if batch is None else pa.Table.from_batches([batch])) if t is not None and t.num_rows]
        if not tables:
            continue
        table = pa.concat_tables(tables)
        bucket = table.column("bucket").to_numpy()
        begin = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        end = len(bucket) if batch is None else begin[-1]  # the last bucket may go on
        number, start = np.r_[0, np.cumsum(table.column("n").fill_null(0).to_numpy())], 0
        for stop in np.r_[begin[1:], len(bucket)]:
            if start < stop <= end and (stop == end or number[stop] - number[start] >= GROUP):
                yield table.slice(start, stop - start)
                start = stop
        rest = table.slice(end)


def _entries(table: pa.Table) -> list[np.ndarray]:
    """The keys of packed rows, and their counts, one row after the other."""
    n = table.column("n").to_pylist()
    columns = [[np.cumsum(_restored(blob, k, U64), dtype=U64) for blob, k in zip(table.column("keys"), n)]]
    columns += [[_restored(b, k, np.int64) for b, k in zip(table.column(c), n)] for c in ("fit", "tune") if c in table.column_names]
    return [np.concatenate(parts) for parts in columns]


def _added_up(keys: np.ndarray, counts: list[np.ndarray], kind: str | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(distinct keys, rising; each entry's place among them; sums of the counts)."""
    order = np.argsort(keys, kind=kind)
    rising = keys[order]
    new = np.r_[True, rising[1:] != rising[:-1]][: len(rising)]
    begin, place = np.flatnonzero(new), np.empty(len(keys), np.uint32)
    place[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
    return rising[begin], place, [np.add.reduceat(c[order], begin) if len(begin) else c for c in counts]


def _odds_in(turned: np.ndarray, count: np.ndarray, near: pa.Table, place: np.ndarray, kind: str) -> list[np.ndarray]:
    """The log odds of orders 1 to HISTORY and of the word; windows distinct and rising, of whole buckets."""
    symbol = turned & U64(0xFF)
    far = [
        _word_odds(((turned >> U64(8 * (HISTORY - order))) << U64(8)) | symbol, count) for order in range(NEAR, HISTORY - 1)
    ] + [_odds(turned, count)]
    word = near.column(f"{kind}w").to_numpy()[place]
    inside = np.ones(len(turned), dtype=bool)
    for letters in range(HISTORY + 1):  # windows whose word has so many
        if letters == HISTORY:
            word[inside] = far[-1][inside]  # six letters: the order says the same
            break
        oldest = (turned >> U64(8 * (HISTORY - letters))) & U64(0xFF)
        begins = inside & ((oldest == U64(0x20)) | (oldest == U64(END)))
        if letters >= NEAR and begins.any():
            plain = ((turned >> U64(8 * (HISTORY + 1 - letters))) << U64(8)) | symbol
            word[begins] = _word_odds(plain[begins], count[begins])
        inside &= ~begins
    return [*(near.column(f"{kind}{k}").to_numpy()[place] for k in range(NEAR)), *far, word]


def _counted(table: pa.Table, kinds: str) -> tuple:
    """(packed rows, turned windows, each entry's place among them, fit, tune, log odds by kind) of whole buckets."""
    packed, near = table.filter(table.column("slice").is_valid()), table.filter(table.column("near").is_valid()).sort_by("near")
    keys, *counts = _entries(packed)
    turned, place, (fit, tune) = _added_up(keys, counts, "stable")
    at = np.searchsorted(near.column("near").to_numpy(), _near_string(turned).view(np.int64))
    odds = {kind: _odds_in(turned, fit if kind == "f" else fit + tune, near, at, kind) for kind in kinds}
    return packed, turned, place, fit, tune, odds


ODDS = [*range(HISTORY), "w"]


def _odds_rows(kinds: str, tuned: bool):
    """A row for each window, or for each that the tuning fold has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_buckets(batches):
            _, turned, _, fit, tune, odds = _counted(table, kinds)
            keep = tune > 0 if tuned else slice(None)
            columns = [_turned(turned).view(np.int64), fit, tune, *(o for kind in kinds for o in odds[kind])]
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], _odds_columns(kinds))

    return run


def _odds_columns(kinds: str) -> list[str]:
    return ["string", "fit", "tune", *[f"{kind}{k}" for kind in kinds for k in ODDS]]


def _bucketed(packed: DataFrame, near: DataFrame) -> DataFrame:
    rows = packed.unionByName(near, allowMissingColumns=True)
    return rows.repartition("bucket").sortWithinPartitions("bucket", "slice")


def _window_odds(packed: DataFrame, near: DataFrame, kinds: str = "fa", tuned: bool = False) -> DataFrame:
    schema = ", ".join(f"{n} long" for n in _odds_columns(kinds))
    return _bucketed(packed, near).mapInArrow(_odds_rows(kinds, tuned), schema)


def context_odds(windows: DataFrame) -> DataFrame:
    """string (the window), fit, tune, and the packed log odds of its contexts by both counts."""
    packed = stage_table(windows.select("window", "fit", "tune").mapInArrow(_pack_counted, PACKED), "windows")
    return _window_odds(packed, _near_odds(packed))


def _unpacked(batch: pa.RecordBatch, kind: str) -> np.ndarray:
    """(context, row, place) log odds."""
    names = [f"{kind}{k}" for k in ODDS]
    return np.stack([np.ascontiguousarray(batch.column(n).to_numpy()).view(np.int8).reshape(-1, 8) for n in names])


class Mixer:
    """Gated weights and refinement; the probability of each window's last byte from its contexts' log odds."""

    def __init__(self):
        self.by_node = np.full((256, CONTEXTS), 0.3)
        self.by_reach = np.zeros((8 * (CONTEXTS + 1), CONTEXTS))
        self.refined = np.tile(1 / (1 + np.exp(-np.linspace(-8, 8, LEVELS))), (256, 1))

    def inputs(self, odds: np.ndarray, place: int) -> tuple[np.ndarray, np.ndarray]:
        x = odds[:, :, place].astype(np.float32)
        reach = np.zeros(x.shape[1], dtype=np.int64)
        for k in range(HISTORY):
            reach[x[k] != 0] = k + 1
        x /= SCALE
        return x, reach * 8 + place

    def mixed(self, x: np.ndarray, node: np.ndarray, gate: np.ndarray) -> np.ndarray:
        total = np.zeros(x.shape[1])
        for k in range(CONTEXTS):
            total += (self.by_node[:, k][node] + self.by_reach[:, k][gate]) * x[k]
        return np.clip(total, -7.99, 7.99)

    def refine(self, total: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The chance of a 1: half the mix, half what such mixes came to."""
        at = (total + 8) * (LEVELS - 1) / 16
        low = at.astype(np.int64)
        part = at - low
        table = self.refined
        return 0.5 / (1 + np.exp(-total)) + 0.5 * (table[node, low] * (1 - part) + table[node, low + 1] * part)

    def log2_of(self, window: np.ndarray, odds: np.ndarray) -> np.ndarray:
        total = np.zeros(len(window))
        for place, node, bit in _bits(window):
            x, gate = self.inputs(odds, place)
            one = self.refine(self.mixed(x, node, gate), node)
            total += np.log2(np.where(bit == 1, one, 1 - one))
        return total

    def learn(self, window: np.ndarray, weight: np.ndarray, whole: np.ndarray) -> None:
        """One online pass: after each small step the weights move against its errors."""
        for start in range(0, len(window), STEP):
            part, n = window[start : start + STEP], weight[start : start + STEP]
            odds = whole[:, start : start + STEP]
            for place, node, bit in _bits(part):
                x, gate = self.inputs(odds, place)
                error = (bit - 1 / (1 + np.exp(-self.mixed(x, node, gate)))) * n
                for weights, chosen in ((self.by_node, node), (self.by_reach, gate)):
                    seen = np.bincount(chosen, n, len(weights)) + 1e-9
                    for k in range(CONTEXTS):
                        weights[:, k] += RATE * np.bincount(chosen, error * x[k], len(weights)) / np.maximum(seen, n.mean())

    def outcomes(self, window: np.ndarray, weight: np.ndarray, odds: np.ndarray) -> np.ndarray:
        """(node, level, bit) counts of what mixes came to."""
        seen = np.zeros((2, 256 * LEVELS))
        for place, node, bit in _bits(window):
            x, gate = self.inputs(odds, place)
            level = np.rint((self.mixed(x, node, gate) + 8) * (LEVELS - 1) / 16).astype(np.int64)
            for value in (0, 1):
                seen[value] += np.bincount(node * LEVELS + level, weight * (bit == value), 256 * LEVELS)
        return seen


def _tuning(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        weight = batch.column("tune").to_numpy().astype(np.float64)
        yield batch.column("string").to_numpy().view(U64), weight, _unpacked(batch, "f")


def _train(model: Mixer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, total = copy.deepcopy(model), 0.0
        for window, weight, odds in _tuning(batches):
            mixer.learn(window, weight, odds)
            total += weight.sum()
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array([total]), pa.array([(mixer.by_node * total).tobytes()], pa.binary()),
                 pa.array([(mixer.by_reach * total).tobytes()], pa.binary())],
                ["total", "by_node", "by_reach"],
            )

    return run


def _observe(model: Mixer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((model.outcomes(*t) for t in _tuning(batches)), np.zeros((2, 256 * LEVELS)))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["seen"])

    return run


def _sum_of(column: str):
    """Adds up arrays of doubles of one key: the first of two steps before the driver."""

    def run(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, dtype=np.float64) for b in table.column(column).to_pylist())
        return pa.table([pa.array([total.tobytes()], pa.binary())], names=[column])

    return run


def _added(rows: DataFrame, column: str) -> np.ndarray | None:
    """The sum of a column of arrays, added in 16 groups on the executors first."""
    parts = (
        rows.select(column, F.pmod(F.xxhash64(column), F.lit(16)).alias("part"))
        .groupBy("part").applyInArrow(_sum_of(column), f"{column} binary").collect()
    )
    return sum(np.frombuffer(r[column], dtype=np.float64) for r in parts) if parts else None


def train(odds: DataFrame) -> Mixer:
    """From the log odds by the counts of folds 1 to 8."""
    mixer = Mixer()
    tune = odds.where("tune > 0").select("string", "tune", *[f"f{k}" for k in ODDS])
    # small steps want windows of all kinds side by side
    draw = F.xxhash64("string")
    tune = stage_table(tune.repartition(draw).sortWithinPartitions(draw), "tune")
    for _ in range(ROUNDS):
        rows = tune.mapInArrow(_train(mixer), "total double, by_node binary, by_reach binary")
        rows = stage_table(rows, "weights")
        total = rows.agg(F.sum("total")).first()[0]
        if total:
            by_node, by_reach = _added(rows, "by_node"), _added(rows, "by_reach")
            mixer.by_node = by_node.reshape(mixer.by_node.shape) / total
            mixer.by_reach = by_reach.reshape(mixer.by_reach.shape) / total
    seen = _added(tune.mapInArrow(_observe(mixer), "seen binary"), "seen")
    if seen is not None:
        zero, one = seen.reshape(2, 256, LEVELS)
        prior = 20.0
        mixer.refined = (one + prior * mixer.refined) / (zero + one + prior)
    return mixer


def _window_scores(model: Mixer):
    """log2 of the chance of each window's last byte, to each slice in the order in which it sent its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_buckets(batches):
            packed, turned, place, _, _, odds = _counted(table, "a")
            window, value = _turned(turned), np.empty(len(turned), np.int32)
            for start in range(0, len(turned), GROUP // 4):
                part = slice(start, start + GROUP // 4)
                whole = np.stack([np.ascontiguousarray(o[part]).view(np.int8).reshape(-1, 8) for o in odds["a"]])
                value[part] = np.rint(model.log2_of(window[part], whole) * STEPS)
            yield _answers(packed, value[place])

    return run


def _answers(packed: pa.Table, value: np.ndarray) -> pa.RecordBatch:
    """The values of the keys of packed rows, row by row."""
    edge = np.r_[0, np.cumsum(packed.column("n").to_numpy())]
    values = pa.array([_pressed(value[i:j]) for i, j in zip(edge[:-1], edge[1:])], pa.binary())
    return pa.RecordBatch.from_arrays(
        [*(packed.column(c).combine_chunks() for c in ("slice", "bucket", "n")), values], ["slice", "bucket", "n", "values"]
    )


def window_scores(texts: DataFrame, buckets: int) -> DataFrame:
    """The scores of the windows of each slice, packed by bucket."""
    packed = stage_table(texts.mapInArrow(_pack_windows(buckets), PACKED), "windows")
    near = _near_odds(packed)
    model = train(_window_odds(packed, near, "f", tuned=True))
    return _bucketed(packed, near).mapInArrow(_window_scores(model), VALUES)


def _tokens(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, its text, words of each text) of a slice; the end token is the word of hash 0, once for each text."""
    words, tokens = [], []
    for part in slices(rows, "text", SLICE // 2):
        data, offsets = bytes_of(part.column("text"))
        data = LOWER[data]
        spans = word_spans(data, offsets)
        words.append(np.diff(spans[2]))
        tokens.append(RollingHash(data).spans(spans[0], spans[1]) | U64(1))
    words, n = np.concatenate(words), np.arange(rows.num_rows)
    return np.concatenate([*tokens, np.zeros(len(n), U64)]), np.r_[np.repeat(n, words), n], words


def _pack_words(buckets: int):
    """The distinct tokens of each slice with their counts outside fold 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slice_id, blob in zip(batch.column("slice").to_pylist(), batch.column("rows")):
                rows = _rows_of(blob)
                token, text, _ = _tokens(rows)
                each, count = _summed([token], [(rows.column("fold").to_numpy() != 0)[text]])
                yield _rows_by_bucket((each >> U64(48)) * U64(buckets) >> U64(16), slice_id, each, count)

    return run


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each slice the corpus counts of its tokens; in a row without slice what they add up to, and how many there are."""
    for packed in _whole_buckets(batches):
        keys, count = _entries(packed)
        _, place, (total,) = _added_up(keys, [count], "stable")
        answers = _answers(packed, total[place])
        yield pa.RecordBatch.from_arrays([*answers.columns, *[pa.nulls(len(answers), pa.int64())] * 2], [*answers.schema.names, "total", "met"])
        nulls = [pa.nulls(1, kind) for kind in answers.schema.types]
        sums = [pa.array([int(total.sum())]), pa.array([int((total > 0).sum())])]
        yield pa.RecordBatch.from_arrays([*nulls, *sums], [*answers.schema.names, "total", "met"])


def _base(rows: pa.RecordBatch, count: np.ndarray, total: int, spread: float) -> tuple[np.ndarray, ...]:
    """(n_tokens, n_known, train_tokens, base_score) of the texts of a slice; count: of its distinct tokens, rising."""
    token, text, words = _tokens(rows)
    n, c = rows.num_rows, count[_added_up(token, [])[1]]
    value = np.log10((c + 0.1) / spread) if total else np.zeros(len(c))
    return words + 1, np.bincount(text, c > 0, n).astype(np.int64), np.full(n, total), np.bincount(text, value, n)


def _score(buckets: int, total: int, spread: float):
    """The scores of the texts of one slice, from the counts of its tokens (kind 0) and the scores of its windows (kind 1)."""

    def run(texts: pa.Table, values: pa.Table) -> pa.Table:
        rows = _rows_of(texts.column("rows")[0])
        values = values.sort_by([("kind", "ascending"), ("bucket", "ascending")])
        kinds = values.column("kind").to_numpy()
        answers = [
            np.concatenate([_restored(b, n, kind) for b, n in zip(part.column("values"), part.column("n").to_pylist())])
            for part, kind in ((values.filter(pa.array(kinds == 0)), np.int64), (values.filter(pa.array(kinds == 1)), np.int32))
        ]
        base = _base(rows, answers[0], total, spread)
        parts, known = [], np.zeros(0, U64)
        for part in slices(rows, "text", SLICE):
            turned, first = _turned_streams(part)
            each, place, _ = _added_up(turned, [])
            parts.append((each, place, first[:-1]))
            known = np.sort(np.concatenate([known, each]))
            known = known[np.r_[True, known[1:] != known[:-1]]]
        value = np.empty(len(known))
        value[_by_bucket(known, buckets)[1]] = answers[1] / STEPS
        scores = [np.add.reduceat(value[np.searchsorted(known, each)][place], first) for each, place, first in parts]
        return pa.table({
            "doc_id": rows.column("doc_id"), "held_out": pa.array(rows.column("fold").to_numpy() == 0),
            **{n: pa.array(x) for n, x in zip(("n_tokens", "n_known", "train_tokens", "base_score"), base)},
            "score": pa.array(np.concatenate(scores) * np.log10(2)),
        })

    return run


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability); one row per row of docs."""
    texts = docs.select(
        F.col("doc_id").cast("long"), fold().alias("fold"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    texts = stage_table(texts.mapInArrow(_slice, "slice long, size long, rows binary"), "slices")
    size = texts.agg(F.sum("size")).first()[0] or 0
    buckets = min(max(BUCKETS, 1 << (size // BUCKET_BYTES).bit_length()), 1 << 16)
    words = stage_table(
        texts.mapInArrow(_pack_words(buckets), "bucket int, slice long, n int, keys binary, fit binary")
        .repartition("bucket").sortWithinPartitions("bucket", "slice")
        .mapInArrow(_count_words, f"{VALUES}, total long, met long"),
        "word_counts",
    )
    whole = words.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("met"), F.lit(0)).alias("v")).first()
    total, spread = whole["n"], whole["n"] + 0.1 * (whole["v"] + 1)
    values = words.where("slice is not null").select(F.lit(0).alias("kind"), "slice", "bucket", "n", "values").unionByName(
        window_scores(texts, buckets).withColumn("kind", F.lit(1))
    )
    return texts.select("slice", "rows").groupBy("slice").cogroup(values.groupBy("slice")).applyInArrow(
        _score(buckets, total, float(spread)),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
