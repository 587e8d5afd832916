"""The prefix trie of conversations, its subtree totals summed by time-forward processing.

Method: a node is a distinct sequence of first turns. Nodes are sorted externally in reverse
level order, so a node comes after all its children; each node sends its subtree totals to
its parent through a priority queue ordered like the nodes, which spills sorted runs beyond
MEMORY messages. The trie is cut into shards, and this runs within each shard; the totals of
shard roots are then summed by parent and the same is done across them, over what lies above.

The cut: a node with over M members is heavy, M being the root of the number of conversations
(SMALL at least); a light node with a heavy parent is a shard root. So a shard holds at most M
conversations however common a first turn is, and there are at most (conversations / M) heavy
nodes at each depth. The heavy nodes alone are one task's work.

Keys: a turn's digest has 128 bits; a sequence's key is the XOR, over its turns, of the digest
scrambled with its position. Prefix keys are running sums over conversations in order, dealt by
range: where one conversation lies in several partitions, each adds the totals of those before
it, so a conversation of any length is split too.

Digests of ends: conversations that end at a node are sorted by range of (node, id). A short run
within a partition is hashed there. Long runs and those at a partition's border become packed
blocks of BLOCK ids, and only those meet in one task, which SHA-256 demands.

A queue's spilled runs are unnamed files that end with the task; nothing else reads them.

Rows: without conv_id they take no part. Null roles and texts are empty; turns go by number,
null first, ties by role and text; repeated rows are turns of their own. A base conversation is
conv_id - conv_id % 5, the remainder with the sign of conv_id. An empty table gives no nodes.
Columns beside the four are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import tempfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from perdura.llm.textkit import BASE, U64, mix
from perdura.sources.staging import stage_table

HEADS = 8  # a conversation takes over fewer turns than this plus one
SMALL = 64
MEMORY = 200_000
BLOCK = 4_096
READ = 4_096
NONE = hashlib.sha256(b"").hexdigest()
KEY = ["depth", "lo", "hi"]


# turns and keys


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order: partition, place within the conversation there, digest, bytes."""
    part, conv, place = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        places, lows, highs, sizes = [], [], [], []
        ids = batch.column("conv_id").to_pylist()
        for at, role, text in zip(ids, batch.column("role").to_pylist(), batch.column("text").to_pylist()):
            place = place + 1 if at == conv else 1
            conv = at
            role, text = role.encode(), text.encode()
            digest = xxhash.xxh3_128_digest(len(role).to_bytes(8, "little") + role + text)
            places.append(place)
            lows.append(int.from_bytes(digest[:8], "little", signed=True))
            highs.append(int.from_bytes(digest[8:], "little", signed=True))
            sizes.append(len(text))
        longs = [pa.array(x, pa.int64()) for x in (ids, places, lows, highs, sizes)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(ids), pa.int32()), *longs], ["part", "conv_id", "place", "lo", "hi", "size"]
        )


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix keys, and those of the parents, of rebuilt conversations in order, counted from where the partition begins."""
    part, conv, carry = TaskContext.get().partitionId(), None, [U64(0), U64(0)]
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, depth = batch.column("conv_id").to_numpy(), batch.column("depth").to_numpy().astype(U64)
        begins = np.r_[ids[0] != conv, ids[1:] != ids[:-1]]
        first = np.flatnonzero(begins)
        run = np.cumsum(begins) - 1
        out = []
        for lane, name in enumerate(("lo", "hi")):
            value = mix(mix(batch.column(name).to_numpy().astype(U64) + U64(lane)) + depth * BASE)
            total = np.bitwise_xor.accumulate(value)
            start = np.zeros(len(first) + 1, dtype=U64)  # what the running total holds from before each run
            start[1:] = np.r_[U64(0), total][first]
            start[0] = carry[lane]  # a run that goes on from the last batch
            key = total ^ start[run + 1]
            out += [key, key ^ value]
            carry[lane] = key[-1]
        conv = ids[-1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(ids), part, dtype=np.int32)), *(batch.column(c) for c in ("conv_id", "depth", "length", "size")),
             *(pa.array(x.astype(np.int64)) for x in out)],
            ["part", "conv_id", "depth", "length", "size", "lo", "parent_lo", "hi", "parent_hi"],
        )


def _earlier() -> WindowSpec:
    return Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)


def _carried(rows: DataFrame, total: dict[str, Column]) -> DataFrame:
    """(conv_id, part, totals of the partitions before), of conversations that lie in several; two rows a partition at most."""
    ends = rows.groupBy("part").agg(F.min("conv_id").alias("a"), F.max("conv_id").alias("b"))
    split = ends.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("conv_id")).groupBy("conv_id").count().where("count > 1")
    sums = rows.join(F.broadcast(split.select("conv_id")), "conv_id").groupBy("conv_id", "part").agg(
        *(c.alias(name) for name, c in total.items())
    )
    return stage_table(sums, "carried")


def positions(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), lo, hi, size: every turn's place, digest and bytes."""
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    )
    by = F.col("turn").asc_nulls_first()
    dealt = turns.repartitionByRange("conv_id", by, F.substring("role", 1, 16)).sortWithinPartitions("conv_id", by, "role", "text")
    rows = stage_table(dealt.mapInArrow(_digests, "part int, conv_id long, place long, lo long, hi long, size long"), "turns")
    own = _carried(rows, {"own": F.max("place")})
    before = own.select("conv_id", "part", F.sum("own").over(_earlier()).alias("before"))
    return rows.join(F.broadcast(before), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "lo", "hi", "size"
    )


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length) of every rebuilt conversation, and its turns: conv_id, depth, length, lo, hi, size."""
    turn = F.struct("place", "lo", "hi", "size")
    each = turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("place") <= HEADS, turn))).alias("heads")
    ).select(
        F.expr("conv_id - conv_id % 5").alias("base"), "conv_id", "n", "heads",
        F.expr(f"cast(crc32(cast(string(conv_id) as binary)) % {HEADS + 1} as int)").alias("h"),
    )
    # a base has five conversations that take from it, nine around 0
    block = each.groupBy("base").agg(
        F.max(F.when(F.col("conv_id") == F.col("base"), F.col("heads"))).alias("heads"),
        F.collect_list(F.struct("conv_id", "n", "h")).alias("members"),
    ).select("heads", F.explode("members").alias("m")).select(
        "m.*", F.expr("slice(coalesce(heads, array()), 1, m.h)").alias("taken")
    )
    convs = stage_table(
        block.withColumn("kept", F.size("taken").cast("long"))
        .withColumn("length", F.col("kept") + F.greatest(F.lit(0), F.col("n") - F.col("h"))),
        "conversations",
    )
    taken = convs.select("conv_id", "length", F.explode("taken").alias("t")).select(
        "conv_id", F.col("t.place").alias("depth"), "length", "t.lo", "t.hi", "t.size"
    )
    own = turns.join(convs.select("conv_id", "length", "kept", "h"), "conv_id").where("place > h").select(
        "conv_id", F.expr("kept + place - h").alias("depth"), "length", "lo", "hi", "size"
    )
    return convs.select("conv_id", "length"), taken.unionByName(own)


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """conv_id, depth, length, size, key (lo, hi) and parent's key of every prefix of a rebuilt conversation."""
    dealt = rebuilt.select("conv_id", "depth", "length", "lo", "hi", "size").repartitionByRange("conv_id", "depth")
    rows = stage_table(
        dealt.sortWithinPartitions("conv_id", "depth").mapInArrow(
            _keys,
            "part int, conv_id long, depth long, length long, size long, lo long, parent_lo long, hi long, parent_hi long",
        ),
        "prefixes",
    )
    step = {lane: F.bit_xor(F.col(lane).bitwiseXOR(F.col(f"parent_{lane}"))) for lane in ("lo", "hi")}
    own = _carried(rows, step)
    before = own.select("conv_id", "part", *(F.bit_xor(c).over(_earlier()).alias(f"before_{c}") for c in ("lo", "hi")))
    joined = rows.join(F.broadcast(before), ["conv_id", "part"], "left")
    shifted = [
        F.col(c).bitwiseXOR(F.coalesce(f"before_{c[-2:]}", F.lit(0))).alias(c) for c in ("lo", "hi", "parent_lo", "parent_hi")
    ]
    return joined.select("conv_id", "depth", "length", "size", *shifted)


# digests of ends


def _short_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of runs of one node's ids that lie within the partition; blocks of the others."""
    key, ids, whole, made = None, [], False, []

    def block() -> tuple:
        steps = np.diff(np.array(ids, dtype=np.int64), prepend=np.int64(0))
        return (*key, ids[0], zlib.compress(steps.tobytes(), 1), None)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, kinds)], ["lo", "hi", "first", "body", "ends_sha256"]
        )

    for batch in batches:
        for lo, hi, conv in zip(*(batch.column(c).to_pylist() for c in ("lo", "hi", "conv_id"))):
            if (lo, hi) != key:
                if whole:
                    made.append((*key, ids[0], None, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()))
                elif ids:
                    made.append(block())
                whole, key, ids = key is not None, (lo, hi), []
            elif len(ids) >= BLOCK:
                made.append(block())
                whole, ids = False, []
            ids.append(conv)
        yield batch_of(made)
        made = []
    if ids:
        yield batch_of([block()])


def _long_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of nodes whose ids come as blocks, in order."""
    key, sha, made = None, None, []
    out = lambda: pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(list(zip(*made)) or [()] * 3, (pa.int64(), pa.int64(), pa.string()))], ["lo", "hi", "ends_sha256"]
    )
    for batch in batches:
        for lo, hi, body in zip(*(batch.column(c).to_pylist() for c in ("lo", "hi", "body"))):
            text = ",".join(map(str, np.cumsum(np.frombuffer(zlib.decompress(body), dtype=np.int64)).tolist())).encode()
            if (lo, hi) != key:
                if key is not None:
                    made.append((*key, sha.hexdigest()))
                key, sha = (lo, hi), hashlib.sha256(text)
            else:
                sha.update(b"," + text)
        yield out()
        made = []
    if key is not None:
        made.append((*key, sha.hexdigest()))
        yield out()


def _end_digests(ends: DataFrame) -> DataFrame:
    """lo, hi, ends_sha256 of every node at which a conversation ends."""
    dealt = ends.repartitionByRange("lo", "hi", "conv_id").sortWithinPartitions("lo", "hi", "conv_id")
    runs = stage_table(
        dealt.mapInArrow(_short_ends, "lo long, hi long, first long, body binary, ends_sha256 string"), "ends"
    )
    blocks = runs.where("ends_sha256 is null").repartition("lo", "hi").sortWithinPartitions("lo", "hi", "first")
    long = blocks.select("lo", "hi", "body").mapInArrow(_long_ends, "lo long, hi long, ends_sha256 string")
    return runs.where("ends_sha256 is not null").select("lo", "hi", "ends_sha256").unionByName(long)


# time-forward processing


class SpillingQueue:
    """A priority queue of integer tuples of one length; beyond `most` in memory it spills a sorted run."""

    def __init__(self, width: int, most: int):
        self.width, self.most = width, most
        self.heap: list[tuple] = []
        self.heads: list[tuple] = []  # (least tuple, number, iterator) of each run

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.most:
            self.heap.sort()
            file = tempfile.TemporaryFile()
            np.array(self.heap, dtype=np.int64).tofile(file)
            self.heap = []
            self._advance(self._read(file))

    def _read(self, file) -> Iterator[tuple]:
        file.seek(0)
        with file:
            while len(rows := np.fromfile(file, dtype=np.int64, count=READ * self.width)):
                yield from map(tuple, rows.reshape(-1, self.width).tolist())

    def _advance(self, rest: Iterator[tuple]) -> None:
        item = next(rest, None)
        if item is not None:
            heapq.heappush(self.heads, (item, id(rest), rest))

    def pop(self, key: tuple) -> Iterator[tuple]:
        """All that begin with key, which is not above what any other begins with."""
        n = len(key)
        while self.heap and self.heap[0][:n] == key:
            yield heapq.heappop(self.heap)
        while self.heads and self.heads[0][0][:n] == key:
            item, _, rest = heapq.heappop(self.heads)
            yield item
            self._advance(rest)


def _forward(memory: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Subtree totals of nodes in reverse level order; a node marked `top` sends nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = SpillingQueue(5, memory)
        for batch in batches:
            kids, leaves, saved = [], [], []
            columns = ("depth", "lo", "hi", "parent_lo", "parent_hi", "top", "n_convs", "size", "kids", "leaves", "saved")
            for depth, lo, hi, up_lo, up_hi, top, n, size, c, l, s in zip(*(batch.column(x).to_pylist() for x in columns)):
                s += (n - 1) * size
                for message in queue.pop((-depth, lo, hi)):
                    c, l, s = c + 1, l + message[3], s + message[4]
                l = l if c else 1
                if not top:
                    queue.push((1 - depth, up_lo, up_hi, l, s))
                kids.append(c)
                leaves.append(l)
                saved.append(s)
            same = ["depth", "lo", "hi", "parent_lo", "parent_hi", "conv_id", "n_convs"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in same), *(pa.array(x, pa.int64()) for x in (kids, leaves, saved))],
                [*same, "n_children", "n_leaves", "saved_tokens"],
            )

    return run


def _totals(nodes: DataFrame, steps: DataFrame, most: int) -> DataFrame:
    """Nodes with n_children, n_leaves and saved_tokens. most: members of a shard root."""
    kinds = ", ".join(f"{c} long" for c in (
        "depth", "lo", "hi", "parent_lo", "parent_hi", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"
    ))
    order = [F.col("depth").desc(), "lo", "hi"]
    heavy = stage_table(nodes.where((F.col("n_convs") > most) | (F.col("depth") == 0)), "heavy")
    above = heavy.select((F.col("depth") + 1).alias("depth"), F.col("lo").alias("parent_lo"), F.col("hi").alias("parent_hi"))
    # each conversation's first light node names the shard of all light nodes that it stands for
    shard = steps.join(above, ["depth", "parent_lo", "parent_hi"], "left_semi").join(heavy.select(*KEY), KEY, "left_anti").select(
        "conv_id", F.col("depth").alias("at"), F.col("lo").alias("shard_lo"), F.col("hi").alias("shard_hi")
    )
    light = (
        nodes.where((F.col("n_convs") <= most) & (F.col("depth") > 0)).join(shard, "conv_id")
        .withColumn("top", F.col("depth") == F.col("at"))
        .withColumns({c: F.lit(0).cast("long") for c in ("kids", "leaves", "saved")})
    )
    within = stage_table(
        light.repartition("shard_lo", "shard_hi").sortWithinPartitions(*order).mapInArrow(_forward(MEMORY), kinds), "within"
    )
    sent = within.join(above, ["depth", "parent_lo", "parent_hi"], "left_semi").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("parent_lo").alias("lo"), F.col("parent_hi").alias("hi")
    ).agg(F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    crown = heavy.join(sent, KEY, "left").na.fill(0, ["kids", "leaves", "saved"]).withColumn("top", F.col("depth") == 0)
    across = crown.repartition(1).sortWithinPartitions(*order).mapInArrow(_forward(MEMORY), kinds)
    return within.unionByName(across)


def prefix_trie(conversations: DataFrame, small: int = SMALL) -> DataFrame:
    """One row per node: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs, rebuilt = rebuild(positions(conversations))
    steps = prefixes(rebuilt)
    inner = steps.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("size").alias("size"),
        F.min("parent_lo").alias("parent_lo"), F.min("parent_hi").alias("parent_hi"),
    )
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        *(zero.alias(c) for c in KEY), "conv_id", "n_convs", *(zero.alias(c) for c in ("size", "parent_lo", "parent_hi"))
    )
    nodes = stage_table(inner.unionByName(root), "nodes")
    most = max(small, math.isqrt(convs.count()))
    totals = stage_table(_totals(nodes, steps, most), "totals")
    ends = steps.where("depth = length").select("lo", "hi", "conv_id").unionByName(
        convs.where("length = 0").select(zero.alias("lo"), zero.alias("hi"), "conv_id")
    )
    parent = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("lo").alias("parent_lo"), F.col("hi").alias("parent_hi"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    return (
        totals.join(_end_digests(ends), ["lo", "hi"], "left")
        .join(parent, ["depth", "parent_lo", "parent_hi"], "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"),
        )
    )
