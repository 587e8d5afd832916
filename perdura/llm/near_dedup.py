"""Near-duplicate documents: MinHash signatures, banding, exact confirmation, star components.

Method: the set of a document is its distinct five-word shingles (A-Z lower-cased;
fewer words: the whole sequence as one shingle). Each set gets the minima of 192
random linear hash functions; 32 bands of 6 minima make the candidate buckets, so
a pair at the similarity bound is missed with a chance of 3e-7 at 0.85 and of 6e-5 at 0.8. Documents with
equal sets are one node from the start. Links are confirmed on the full sets.

Pairs are never all written out. Each node is first confirmed against the least
member of its buckets. Then, twice, each bucket in which several components meet
confirms one member of each against its least member. Only the candidates that
then remain between different components are compared, in blocks of bounded size,
by signature, and those near enough are confirmed within the block on their full
sets, so that pairs which are no links are never written out. After each of these
steps only the links between components are joined up, not those within.

Rows: a null or empty text, or one without words, has an empty set and is linked
with nothing. Rows that share a doc_id are judged each by its own text, links count for
the doc_id; the filter drops the texts that are copies, not the doc_id. A row without
doc_id is linked with nothing; its component is null and it is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perdura.llm.components import connected_components
from perdura.llm.textkit import bytes_of, shingle_hashes, slices
from perdura.sources.staging import stage_table

WORDS = 5
ROWS, BANDS = 6, 32
HASHES = ROWS * BANDS
BLOCK, BLOCK_SHINGLES = 512, 2 << 20
PART_BYTES = 512 << 10  # of text hashed at once
DEVIATIONS = 5  # by which a signature may fall below the similarity asked for before its pair is confirmed
SEED = 20240601


def _functions() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED)
    factor = draw.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    return factor, draw.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set."""
    factor, shift = _functions()
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for start in range(0, len(low), 8192):
        part = low[start : start + 8192]
        np.minimum(least, (factor[:, None] * part[None, :] + shift[:, None]).min(axis=1), out=least)
    return least


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                sizes, ids, signs = [], [], []
                for shingles in shingle_hashes(*bytes_of(part.column("text")), words):
                    sizes.append(len(shingles))
                    ids.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
                    signs.append(signature(shingles).tobytes() if len(shingles) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()),
                     pa.array(signs, pa.binary())],
                    ["doc_id", "n_shingles", "set_id", "signature"],
                )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                sets = [s.view(np.int64) for s in shingle_hashes(*bytes_of(part.column("text")), words)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"]
                )

    return run


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, set_id, signature); the last two are null for an empty set."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _sign(words), "doc_id long, n_shingles long, set_id binary, signature binary"
    )


def _close(near: int, columns: list[str]):
    """The pairs whose signatures agree in `near` places or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = (
                bytes_of(batch.column(c))[0].view(np.uint32).reshape(-1, HASHES) for c in ("sign_a", "sign_b")
            )
            yield batch.select(columns).filter(pa.array((one == other).sum(axis=1) >= near))

    return run


def confirm(pairs: DataFrame, signs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of pairs whose sets a and b share at least percent/100 of their union.

    Pairs with distant signatures go first; of the sets only those of the pairs left are moved.
    """
    schema = ", ".join(f"{c} long" for c in pairs.columns)
    near = stage_table(
        pairs.join(signs.toDF("b", "sign_b"), "b").join(signs.toDF("a", "sign_a"), "a")
        .select(*pairs.columns, "sign_a", "sign_b").mapInArrow(_close(_near(percent), pairs.columns), schema),
        "near",
    )
    ends = stage_table(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
    few = sets.join(ends, "node", "leftsemi")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - shared
    return (
        near.join(few.select("node", "shingles").toDF("b", "set_b"), "b")
        .join(few.select("node", "shingles").toDF("a", "set_a"), "a")
        .where(100 * shared >= percent * union).select(*pairs.columns)
    )


def _near(percent: int) -> int:
    """In how many places the signatures of a pair must agree before its sets are compared."""
    share = percent / 100
    return int(HASHES * share - DEVIATIONS * (HASHES * share * (1 - share)) ** 0.5)


def _merged(component: DataFrame, links: DataFrame) -> DataFrame:
    """The components after links between them, as (at_a, at_b), have been added."""
    into = stage_table(
        connected_components(links, "at_a", "at_b").select(
            F.col("node").alias("component"), F.col("component").alias("into")
        ).where("component <> into"),
        "into",
    )
    return stage_table(
        component.join(into, "component", "left").select(
            "node", F.coalesce("into", "component").alias("component")
        ),
        "component",
    )


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two rising arrays have in common."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    return int((large[at] == small).sum())


def _block_links(near: int, percent: int):
    """Links between components in a block pair, as many as join them up.

    Pairs whose signatures agree in `near` places or more are confirmed on their full
    sets. A pair that meets in several bands is taken in the first of them only.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, band, i, j = key
        sign = np.stack([np.frombuffer(s, dtype=np.uint32) for s in rows["signature"]])
        sets = [np.asarray(s, dtype=np.int64).view(np.uint64) for s in rows["shingles"]]
        node, comp = rows["node"].to_numpy(), rows["component"].to_numpy()
        block, size = rows["block"].to_numpy(), np.array([len(s) for s in sets])
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        _, at = np.unique(comp, return_inverse=True)  # components as far as joined in this block pair
        found = []
        for p in left:
            q = right[(at[right] != at[p]) & ((node[right] > node[p]) | (i != j))]
            q = q[100 * np.minimum(size[q], size[p]) >= percent * np.maximum(size[q], size[p])]
            if not len(q):
                continue
            same = sign[q] == sign[p]
            close = same.sum(axis=1) >= near
            first = same.reshape(len(q), BANDS, ROWS).all(axis=2).argmax(axis=1)
            for r in q[close & (first == band)]:
                if at[r] == at[p]:
                    continue
                shared = _shared(sets[p], sets[r])
                if 100 * shared >= percent * (size[p] + size[r] - shared):
                    found.append((comp[p], comp[r]))
                    at[at == at[r]] = at[p]
        return pd.DataFrame(found, columns=["at_a", "at_b"], dtype="int64")

    return run


def _bands_of(buckets_of: DataFrame, component: DataFrame) -> DataFrame:
    """(node, component, band, key) of every shared bucket of every node."""
    return buckets_of.join(component, "node").select("node", "component", "size", F.inline("buckets"))


def _across(buckets_of: DataFrame, component: DataFrame) -> DataFrame:
    """In each bucket of several components, the least node of each beside the least of all."""
    least = stage_table(
        _bands_of(buckets_of, component).groupBy("key", "component").agg(F.min("node").alias("node")), "least_of"
    )
    low = least.groupBy("key").agg(
        F.min(F.struct("node", "component")).alias("low"), F.max("component").alias("last"),
        F.min("component").alias("first"),
    ).where("first <> last").select("key", "low")
    return least.join(low, "key").where("component <> low.component").select(
        F.col("low.node").alias("a"), F.col("node").alias("b"),
        F.col("low.component").alias("at_a"), F.col("component").alias("at_b"),
    ).distinct()


def _remaining(
    buckets_of: DataFrame, signs: DataFrame, sets: DataFrame, component: DataFrame, percent: int
) -> DataFrame:
    """Links between components, from the buckets in which several meet.

    Blocks are cut by members and by the size of their sets, so both bound a task's memory.
    """
    placed = _bands_of(buckets_of, component)
    mixed = stage_table(
        placed.groupBy("key").agg(
            F.min("component").alias("low"), F.max("component").alias("high"),
            F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"),
        ).where("low <> high").select("key", "blocks"),
        "mixed",
    )
    rows = (
        placed.drop("size").join(mixed, "key")
        .join(signs, "node")
        .join(sets, "node")
        .withColumn("block", F.expr("cast(pmod(xxhash64(node, key), blocks) as int)"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .withColumn("i", F.least("block", "other"))
        .withColumn("j", F.greatest("block", "other"))
    )
    return rows.groupBy("key", "band", "i", "j").applyInPandas(
        _block_links(_near(percent), percent), "at_a long, at_b long"
    )


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links), kept; one row per row of docs."""
    signed = stage_table(signatures(docs, words), "signatures")
    classes = stage_table(
        signed.where("n_shingles > 0 and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("node")),
        "classes",
    )
    nodes = stage_table(
        signed.join(classes, (signed["doc_id"] == classes["node"]) & (signed["set_id"] == classes["set_id"]),
                    "leftsemi").select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("size"), "signature"),
        "nodes",
    )
    width = 4 * ROWS
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("signature", b * width + 1, width)) for b in range(BANDS)])
    bands = nodes.select("node", "size", F.posexplode(keys).alias("band", "key"))
    leaders = bands.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where(
        "leader <> last"
    )
    buckets_of = stage_table(  # at most BANDS buckets a node
        bands.join(leaders, "key").groupBy("node").agg(
            F.collect_set(F.struct("band", "key")).alias("buckets"),
            F.min("leader").alias("leader"), F.max("size").alias("size"),
        ),
        "buckets",
    )
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    wanted = stage_table(buckets_of.select("node"), "wanted")  # ids alone: 8 bytes a node
    # repeated rows are one node: one signature and one set of it
    signs = stage_table(nodes.join(wanted, "node", "leftsemi").select("node", "signature").distinct(), "signs")
    sets = stage_table(
        texts.join(wanted.select(F.col("node").alias("doc_id")), "doc_id", "leftsemi")
        .mapInArrow(_sets(words), "node long, shingles array<long>")
        .groupBy("node", F.xxhash64("shingles").alias("set_key")).agg(F.first("shingles").alias("shingles"))
        .drop("set_key"),
        "sets",
    )
    first = buckets_of.where("leader <> node").select(
        F.col("leader").alias("a"), F.col("node").alias("b"), F.col("leader").alias("at_a"), F.col("node").alias("at_b")
    )
    component = classes.select("node", F.col("node").alias("component")).distinct()
    component = _merged(component, confirm(first, signs, sets, percent))
    for _ in range(2):
        component = _merged(component, confirm(_across(buckets_of, component), signs, sets, percent))
    component = _merged(component, _remaining(buckets_of, signs, sets, component, percent))

    placed = stage_table(
        classes.join(component, "node").select("set_id", F.col("component").alias("component_id")), "placed"
    )
    return (
        signed.select("doc_id", "n_shingles", "set_id").join(placed, "set_id", "left")
        .withColumn(
            "component_id",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")),
        )
        .select("doc_id", "n_shingles", "component_id",
                F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )


def _named_texts(several: DataFrame, docs: DataFrame) -> DataFrame:
    """(real, text_key, node): a node of its own for each text of an id; the first text keeps the id."""
    texts = several.select(F.col("doc_id").cast("long").alias("real"), _text_key().alias("text_key")).distinct()
    texts = texts.join(texts.groupBy("real").agg(F.min("text_key").alias("first")), "real")
    ends = docs.agg(F.min(F.col("doc_id").cast("long")).alias("low"), F.max(F.col("doc_id").cast("long")).alias("high")).first()
    fresh = F.monotonically_increasing_id() + 1
    if ends["high"] is not None and ends["high"] >= 1 << 62:
        fresh = F.lit(ends["low"]) - fresh
    else:
        fresh = F.lit(ends["high"] or 0) + fresh
    return stage_table(
        texts.select("real", "text_key", F.when(F.col("text_key") == F.col("first"), F.col("real")).otherwise(fresh).alias("node")), "named"
    )


def _text_key() -> Column:
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))


def keep_one_of_each_group(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs without near copies of a kept row, by least doc_id.

    Rows that share a doc_id and a text give one row, the least as JSON; different texts under one id are each judged.
    """
    again = stage_table(
        docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again"
    )
    if not again.limit(1).count():
        gone = near_duplicates(docs, percent).where("not kept").select("doc_id").distinct()
        return docs.join(gone, "doc_id", "leftanti").select(*docs.columns)
    several = docs.join(again, "doc_id", "leftsemi").select(*docs.columns)
    named = _named_texts(several, docs)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    whole = several.select(
        F.col("doc_id").cast("long").alias("real"), _text_key().alias("text_key"), row.alias("row"),
        F.to_json(row, {"ignoreNullFields": "false"}).alias("order"),
    )
    whole = stage_table(
        whole.groupBy("real", "text_key").agg(F.min_by("row", "order").alias("row")).join(named, ["real", "text_key"])
        .select("node", "row"),
        "several",
    )
    single = docs.join(again, "doc_id", "leftanti")
    judged = near_duplicates(
        single.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .unionByName(whole.select(F.col("node").alias("doc_id"), F.col("row.text").cast("string").alias("text"))),
        percent,
    )
    members = stage_table(
        judged.where("doc_id is not null").select(F.col("doc_id").alias("node"), "component_id").join(named, "node", "left")
        .select("component_id", "node", F.coalesce("real", "node").alias("real"), F.coalesce("text_key", F.lit("")).alias("text_key")),
        "members",
    )
    least = members.groupBy("component_id").agg(F.min(F.struct("real", "text_key", "node")).alias("least"))
    gone = stage_table(members.join(least, "component_id").where("node <> least.node").select("node"), "gone")
    single = single.join(gone.select(F.col("node").alias("doc_id")), "doc_id", "leftanti").select(*docs.columns)
    return single.unionByName(whole.join(gone, "node", "leftanti").select("row.*"))
