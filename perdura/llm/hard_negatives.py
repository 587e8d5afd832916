"""Hard negatives by lists that the anchors of a cluster share, walked until certified.

Method (after MAXIMUS): the anchors' directions are clustered by spherical k-means. No
member of a cluster lies further from its centre than the cluster's radius r, so a vector q
at angle t from the centre scores at most |a| |q| cos(max(0, t - r)) with any member a. For
each cluster the candidates are put in order of that bound once; every member walks the
list and stops where the bound of the next candidate can no longer change its result.

On Spark: members of a cluster are dealt to blocks, and candidates to shards, each of a
bounded size, so a hot cluster is many groups; a group walks the list of one shard for one
block, and the best of all shards are merged. A candidate goes only to clusters in which its
bound reaches what some member still needs: for positives what a bounded sample of the
candidates already gives that member, for negatives the lower end of the score range of its
positives. Both are certain bounds, so nothing is lost.

Numbers: components are floor(scale * x) as integers, scores are exact integers. Angles carry
a slack over their rounding. A vector whose squared length does not fit a long takes no part.

Rows: those with a null id, label or vector, or with a null or non-finite component, take no
part. Rows equal in id, label and vector count once. Two different rows under one id are two
candidates (and two anchors); ties go by id, then by digest of the vector. Vectors of
different lengths are never compared. A zero vector scores 0 with all. Columns beside
vec_id, embedding and label are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perdura.llm.embedding_dedup import spherical_centres
from perdura.sources.staging import stage_table

SAMPLE_BYTES = 8 << 20  # of anchors for the centres, and of candidates for first bounds
MOST_CLUSTERS = 512
BLOCK_BYTES = 1 << 20  # of members of a block
SHARD_BYTES = 4 << 20  # of candidates of a list
STEP = 512  # candidates that a walk takes at once
SLACK = 1e-6
EXACT = 1 << 53

ROW = "vec_id long, label long, uid long, size int, norm double, body binary"


def _integers(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Usable rows with their integer components in the narrowest form."""
        for batch in batches:
            rows = []
            vectors = batch.column("embedding")
            for i, (vec_id, label) in enumerate(zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist())):
                vector = vectors[i].values
                if vec_id is None or label is None or vector is None or vector.null_count:
                    continue
                x = np.floor(vector.to_numpy(zero_copy_only=False) * scale)
                if not np.isfinite(x).all() or float(x @ x) >= 2.0**62:
                    continue
                most = np.abs(x).max(initial=0)
                kind = next(k for k, top in (("<i1", 127), ("<i2", 32_767), ("<i4", 2**31 - 1), ("<i8", np.inf)) if most <= top)
                body = kind[2].encode() + x.astype(kind).tobytes()
                rows.append((vec_id, label, xxhash.xxh3_64_intdigest(body) - (1 << 63), len(x), float(np.sqrt(x @ x)), body))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.binary()))],
                ["vec_id", "label", "uid", "size", "norm", "body"],
            )

    return run


def _matrix(bodies) -> np.ndarray:
    """Rows of integers: as doubles if every product of two rows is exact in them, else as 64-bit integers."""
    rows = [np.frombuffer(b, dtype=f"<i{b[:1].decode()}", offset=1) for b in bodies]
    return np.stack([r.astype(np.int64) for r in rows]) if rows else np.zeros((0, 0), np.int64)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def _angles(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ centres.T, -1, 1))


def _sample(rows: DataFrame) -> dict[int, list[dict]]:
    """Rows of the least hashes, SAMPLE_BYTES of bodies at most, by vector length."""
    longest = rows.agg(F.max(F.length("body"))).first()[0]
    if longest is None:
        return {}
    most = max(1, SAMPLE_BYTES // (longest + 64))
    picked: dict[int, list[dict]] = {}
    for r in rows.orderBy(F.xxhash64("uid", "vec_id"), "uid", "vec_id", "label").limit(most).collect():
        picked.setdefault(r["size"], []).append(r.asDict())
    return picked


def fit_clusters(anchors: DataFrame) -> dict[int, np.ndarray]:
    """Centres by vector length, fitted on a bounded sample: about half the root of the anchors, MOST_CLUSTERS at most."""
    total, centres = anchors.count(), {}
    for size, rows in _sample(anchors).items():
        x = _unit(_matrix([r["body"] for r in rows]))
        x = x[x.any(axis=1)]
        k = max(1, min(MOST_CLUSTERS, round(np.sqrt(total) / 2), len(x) // 4))
        centres[size] = spherical_centres(x, k) if len(x) else np.eye(1, size)
    return centres


def _first_centre(size: int) -> np.ndarray:
    return np.eye(1, size)


def _homes(centres: dict[int, np.ndarray], sample: dict[int, list[dict]], k: int):
    """Cluster, angle from its centre, and a score that k positives are sure to reach."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, rows in batch.groupby("size"):
                known = sample.get(size, [])
                others = _matrix([r["body"] for r in known])
                labels, ids, uids = (np.array([r[c] for r in known], dtype=np.int64) for c in ("label", "vec_id", "uid"))
                for start in range(0, len(rows), STEP):
                    part = rows.iloc[start : start + STEP]
                    x = _matrix(part["body"])
                    angle = _angles(_unit(x), centres.get(size, _first_centre(size)))
                    sure = np.full(len(part), -np.inf)
                    if len(known):
                        score = _scores(x, others).astype(np.float64)
                        mine = part["label"].to_numpy()[:, None] == labels
                        mine &= (part["vec_id"].to_numpy()[:, None] != ids) | (part["uid"].to_numpy()[:, None] != uids)
                        score[~mine] = -np.inf
                        if score.shape[1] >= k:
                            sure = -np.partition(-score, k - 1, axis=1)[:, k - 1]
                    cluster = angle.argmin(axis=1)
                    yield part.assign(cluster=cluster, angle=angle[np.arange(len(part)), cluster], sure=sure)

    return run


def _needed(homes: DataFrame, sure: Column) -> dict[int, dict[int, tuple[float, float]]]:
    """(radius, least score a unit member still needs) of each cluster that has members; one row per cluster."""
    rows = homes.groupBy("size", "cluster").agg(
        F.max("angle").alias("radius"),
        F.min(F.when(F.col("norm") > 0, sure / F.col("norm")).otherwise(F.lit(float("-inf")))).alias("needs"),
    )
    found: dict[int, dict[int, tuple[float, float]]] = {}
    for r in rows.collect():
        found.setdefault(r["size"], {})[r["cluster"]] = (r["radius"], r["needs"])
    return found


def _visits(centres: dict[int, np.ndarray], needed: dict[int, dict[int, tuple[float, float]]]):
    """Each candidate with every cluster that it may matter to, and its bound there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, rows in batch.groupby("size"):
                if size not in needed:
                    continue
                clusters = np.array(sorted(needed[size]))
                radius, needs = (np.array([needed[size][c][i] for c in clusters]) for i in (0, 1))
                for start in range(0, len(rows), STEP):
                    part = rows.iloc[start : start + STEP]
                    angle = _angles(_unit(_matrix(part["body"])), centres.get(size, _first_centre(size))[clusters])
                    bound = part["norm"].to_numpy()[:, None] * (np.cos(np.maximum(0, angle - radius - SLACK)) + SLACK)
                    row, at = np.nonzero(bound >= needs - SLACK * np.abs(needs))
                    yield part.iloc[row].assign(cluster=clusters[at], bound=bound[row, at])

    return run


class _Best:
    """The k best (score, then least id, then least uid) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.score = np.full((queries, k), np.iinfo(np.int64).min)
        self.place = np.full((queries, k), -1, dtype=np.int64)

    def take(self, queries: np.ndarray, scores: np.ndarray, usable: np.ndarray, first: int, rank: np.ndarray) -> None:
        k = self.score.shape[1]
        score = np.concatenate([self.score[queries], np.where(usable, scores, np.iinfo(np.int64).min)], axis=1)
        fresh = np.where(usable, np.arange(first, first + scores.shape[1]), -1)
        place = np.concatenate([self.place[queries], fresh], axis=1)
        order = np.lexsort((np.where(place >= 0, rank[place], np.iinfo(np.int64).max), ~score), axis=1)[:, :k]
        self.score[queries] = np.take_along_axis(score, order, axis=1)
        self.place[queries] = np.take_along_axis(place, order, axis=1)


def _walk(members: pd.DataFrame, listed: pd.DataFrame, k: int, same: bool, percent: int) -> pd.DataFrame:
    """The best of one list for each query, a query being a member and, for negatives, one of its positives."""
    listed = listed.sort_values(["bound", "vec_id", "uid"], ascending=[False, True, True]).reset_index(drop=True)
    bound, ids, uids = listed["bound"].to_numpy(), listed["vec_id"].to_numpy(), listed["uid"].to_numpy()
    rank = np.empty(len(listed), dtype=np.int64)
    rank[np.lexsort((uids, ids))] = np.arange(len(listed))
    labels, bodies = listed["label"].to_numpy(), listed["body"].to_numpy()
    body, which = np.unique(members["body"].to_numpy(), return_inverse=True)
    anchors = _matrix(body)
    label, norm = members["label"].to_numpy(), members["norm"].to_numpy()
    if not same:
        most = members["positive_score"].to_numpy()
        whole, rest = np.divmod(most, 100)  # no overflow in percent * most
        least = whole * percent + -(-rest * percent // 100)
    best, active = _Best(len(members), k), np.arange(len(members))
    for first in range(0, len(listed), STEP):
        end = first + STEP
        # certified: the next bound is under the k-th best, or under what may be returned at all
        reach = bound[first] * norm[active]
        reach += SLACK * (1 + np.abs(reach))
        going = reach >= best.score[active, k - 1]
        if not same:
            going &= reach >= least[active] * (1 - SLACK) - 1
        active = active[going]
        if not len(active):
            break
        used, row = np.unique(which[active], return_inverse=True)
        score = _scores(anchors[used], _matrix(bodies[first:end]))[row]
        alike = label[active, None] == labels[first:end]
        if same:
            itself = members["vec_id"].to_numpy()[active, None] == ids[first:end]
            usable = alike & ~(itself & (members["uid"].to_numpy()[active, None] == uids[first:end]))
        else:
            usable = ~alike & (score <= most[active, None]) & (score >= least[active, None])
        usable &= score >= best.score[active, k - 1 :]
        some = usable.any(axis=1)
        best.take(active[some], score[some], usable[some], first, rank)
    query, slot = np.nonzero(best.place >= 0)
    place = best.place[query, slot]
    return pd.DataFrame(
        {"query": members["query"].to_numpy()[query], "found_id": ids[place], "found_uid": uids[place],
         "found_label": labels[place], "score": best.score[query, slot]}
    )


def _search(
    homes: DataFrame, rows: DataFrame, centres: dict[int, np.ndarray], sure: Column, k: int, same: bool, percent: int
) -> DataFrame:
    """query, rank, found_id, found_uid, score: the k best of all rows for each row of homes."""
    needed = _needed(homes, sure)
    kinds = f"{ROW}, cluster int, bound double"
    visits = stage_table(rows.select("vec_id", "label", "uid", "size", "norm", "body").mapInPandas(_visits(centres, needed), kinds), "visits")
    deal = lambda frame, most, name: frame.groupBy("size", "cluster").agg(
        F.ceil(F.sum(F.length("body") + 64) / F.lit(most)).cast("int").alias(name)
    )
    counts = stage_table(
        deal(homes, BLOCK_BYTES, "blocks").join(deal(visits, SHARD_BYTES, "shards"), ["size", "cluster"]), "cluster_sizes"
    )
    extra = [] if same else ["positive_score"]
    left = homes.join(counts, ["size", "cluster"]).select(
        "size", "cluster", F.expr("cast(pmod(xxhash64(uid, vec_id), blocks) as int)").alias("block"),
        F.explode(F.expr("sequence(0, shards - 1)")).alias("shard"), "query", "vec_id", "label", "uid", "norm", "body", *extra,
    )
    right = visits.join(counts, ["size", "cluster"]).select(
        "size", "cluster", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"),
        F.expr("cast(pmod(xxhash64(uid, vec_id), shards) as int)").alias("shard"), "vec_id", "label", "uid", "norm", "body", "bound",
    )
    keys = ["size", "cluster", "block", "shard"]

    def run(members: pd.DataFrame, listed: pd.DataFrame) -> pd.DataFrame:
        return _walk(members, listed, k, same, percent)

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        run, "query string, found_id long, found_uid long, found_label long, score long"
    )
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "found_id", "found_uid", "found_label"))), 1, k)
    # at most k rows for each query and shard
    return stage_table(
        found.groupBy("query").agg(best.alias("best")).select("query", F.posexplode("best").alias("rank", "hit")).select(
            "query", (F.col("rank") + 1).alias("rank"), "hit.found_id", "hit.found_uid", (-F.col("hit.down")).alias("score")
        ),
        "found",
    )


def mine_hard_negatives(
    vectors: DataFrame, anchor: Column, label: Column | None = None, scale: int = 256, k: int = 5, percent: int = 80
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows where `anchor` holds; an anchor's positives are its k best other rows of
    its label; for each, the k best rows of other labels that score between percent hundredths of
    the positive's score and that score. `label` replaces the column label where given.
    """
    kind = vectors.select(
        F.col("vec_id").cast("long"),
        (F.col("label") if label is None else label).cast("long").alias("label"),
        F.col("embedding").cast("array<double>"),
    )
    rows = stage_table(kind.mapInArrow(_integers(scale), ROW).dropDuplicates(["vec_id", "label", "uid", "body"]), "rows")
    anchors = rows.where(anchor)
    centres = fit_clusters(anchors)
    key = F.concat_ws("/", "vec_id", "label", "uid")
    homes = stage_table(
        anchors.mapInPandas(_homes(centres, _sample(rows), k), f"{ROW}, cluster int, angle double, sure double")
        .withColumn("query", key),
        "anchors",
    )
    positives = _search(homes, rows, centres, F.col("sure"), k, True, percent)
    pairs = stage_table(
        homes.withColumnRenamed("query", "anchor").join(
            positives.select(
                F.col("query").alias("anchor"), F.col("found_id").alias("positive_id"),
                F.col("score").alias("positive_score"), F.col("rank").alias("positive_rank"),
            ),
            "anchor",
        ).where("positive_score >= 0").withColumn("query", F.concat_ws("/", "anchor", "positive_rank")),
        "pairs",
    )
    needs = F.col("positive_score") * F.lit(percent / 100)
    negatives = _search(pairs, rows, centres, needs, k, False, percent)
    return pairs.join(negatives, "query").select(
        F.col("vec_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"),
        F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )
