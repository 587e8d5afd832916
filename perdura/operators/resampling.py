"""Stratified resampling with replacement, exact in every stratum, over distributed rows.

A resample draws as many rows of each stratum as the stratum has. Counts are split from the
top down a tree over hash buckets: at a node the draws of a stratum go left or right by a
binomial draw with the stratum's share of rows on the left, and in a bucket they fall on its
rows evenly. Each node's draw has a generator of its own, seeded by (seed, block of
replicates, stratum, node), so any task can redo the path to its bucket alone: nothing is
exchanged per replicate, and the result is the same whatever the partitioning.

A row belongs to a bucket by the hash of its key, and is numbered in it by hash and key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perdura.functions.numeric import hash_fraction

BUCKET_ROWS = 4096
MOST_STRATA = 10_000
MOST_CELLS = 1 << 21  # strata by buckets, sent to every task
BLOCK = 50  # replicates drawn by one generator
HELD = 8  # buckets whose draws a task keeps
RUN = 64  # neighbouring buckets that one task holds, for they share most of their draws' path


@dataclass(frozen=True)
class ExactDraw:
    """The draws of all replicates. ``upto[s, b]`` is the rows of stratum s in buckets before b."""

    upto: np.ndarray
    seed: int

    def in_runs(self) -> bool:
        """Whether neighbouring buckets were dealt to tasks together."""
        return self.upto.shape[1] - 1 > RUN

    def drawn(self, stratum: int, bucket: int, block: int, path: dict | None = None) -> np.ndarray:
        """Draws that fall into a bucket of a stratum, by replicate of the block.

        ``path`` keeps the nodes on the way to the last bucket, for one nearby.
        """
        path = {} if path is None else path
        kept = {}
        upto = self.upto[stratum]
        low, high = 0, len(upto) - 1
        count = np.full(BLOCK, upto[-1], dtype=np.int64)
        while high - low > 1:
            middle = (low + high) // 2
            whole, left = upto[high] - upto[low], upto[middle] - upto[low]
            node = (stratum, block, low, high)
            to_left = path.get(node)
            if to_left is None:
                rng = np.random.default_rng([self.seed, block, stratum, low, high])
                to_left = rng.binomial(count, left / whole if whole else 0.0)
            kept[node] = to_left
            if bucket < middle:
                count, high = to_left, middle
            else:
                count, low = count - to_left, middle
        path.clear()
        path.update(kept)
        return count

    def copies(self, stratum: int, bucket: int, block: int, path: dict | None = None) -> np.ndarray:
        """How often each row of a bucket is drawn: [replicates of the block, rows]."""
        rows = int(self.upto[stratum, bucket + 1] - self.upto[stratum, bucket])
        rng = np.random.default_rng([self.seed, block, stratum, bucket])
        drawn = self.drawn(stratum, bucket, block, path)
        spots = rng.integers(0, rows, int(drawn.sum())) + np.repeat(np.arange(BLOCK) * rows, drawn)
        counts = np.bincount(spots, minlength=BLOCK * rows).reshape(BLOCK, rows)
        return counts.astype(np.uint16 if rows < 1 << 16 else np.uint32)

    def weigh(self, places: np.ndarray, numbers: np.ndarray, held: dict) -> np.ndarray:
        """[rows, numbers]: copies of rows, given (stratum, bucket, place), in the numbered replicates.

        ``held`` keeps the last buckets' draws, for neighbouring rows.
        """
        out = np.zeros((len(places), len(numbers)))
        blocks = np.unique(numbers // BLOCK)
        spots, which = np.unique((places[:, 0] * MOST_CELLS + places[:, 1]).astype(np.int64), return_inverse=True)
        for i, spot in enumerate(spots.tolist()):
            stratum, bucket = divmod(spot, MOST_CELLS)
            mine = np.flatnonzero(which == i)
            place = places[mine, 2].astype(np.int64)
            for block in blocks.tolist():
                key = (stratum, bucket, block)
                if key not in held:
                    paths = held.setdefault("paths", {})
                    while len(held) > HELD * len(blocks):
                        held.pop(next(k for k in held if k != "paths"))
                    held[key] = np.ascontiguousarray(self.copies(*key, paths.setdefault(block, {})).T)
                wanted = np.flatnonzero(numbers // BLOCK == block)
                copies, own = held[key][place], numbers[wanted] % BLOCK
                if len(own) < BLOCK or (np.diff(own) != 1).any() or (np.diff(wanted) != 1).any():
                    out[np.ix_(mine, wanted)] = copies[:, own]
                else:
                    out[mine, wanted[0] : wanted[0] + BLOCK] = copies
        return out


def stratified_places(
    df: DataFrame, stratum: Column, keys: Sequence[str], seed: int = 77, bucket_rows: int = BUCKET_ROWS
) -> tuple[DataFrame, ExactDraw]:
    """df with ``_stratum``, ``_bucket`` and ``_place``, and the draws over it.

    A null stratum is one of its own. Rows equal in all keys are interchangeable. More than
    MOST_STRATA strata raise an error; with so many, resampling would leave most as they are.
    """
    named = df.withColumn("_value", stratum.cast("string"))
    values = [r["_value"] for r in named.select("_value").distinct().limit(MOST_STRATA + 1).collect()]
    if len(values) > MOST_STRATA:
        raise ValueError(f"over {MOST_STRATA} strata")
    values.sort(key=lambda v: (v is not None, v or ""))
    codes = df.sparkSession.createDataFrame(list(zip(values, range(len(values)))), "_known string, _stratum int")
    most = max(1, min(named.count() // bucket_rows, MOST_CELLS // max(1, len(values))))
    buckets = 1 << (int(most).bit_length() - 1)
    share = hash_fraction(*[F.col(k) for k in keys], seed=seed, method="xxhash64")
    placed = (
        named.join(F.broadcast(codes), F.col("_value").eqNullSafe(F.col("_known")))
        .drop("_value", "_known")
        .withColumn("_share", share)
        .withColumn("_bucket", F.floor(F.col("_share") * buckets).cast("int"))
    )
    upto = np.zeros((len(values), buckets + 1), dtype=np.int64)
    for r in placed.groupBy("_stratum", "_bucket").count().toLocalIterator():
        upto[r["_stratum"], r["_bucket"] + 1] = r["count"]
    runs = placed.withColumn("_run", F.floor(F.col("_bucket") / RUN))
    if buckets > RUN:
        runs = runs.repartition("_stratum", "_run")
    order = Window.partitionBy("_stratum", *(["_run"] if buckets > RUN else []), "_bucket").orderBy("_share", *keys)
    rows = runs.withColumn("_place", F.row_number().over(order) - 1).drop("_share", "_run")
    return rows, ExactDraw(np.cumsum(upto, axis=1), seed)
