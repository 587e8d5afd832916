"""Near-duplicate vectors: spherical k-means cells, packs of cells compared pair by pair, one kept per group.

Method: cells are fitted on at most `most` vectors, chosen by hash. Every vector has one home, the cell with the nearest centre. With u the direction
from B's centre to A's, asin(x.u) is the angle from x to the plane across u. Two vectors
at the bound lie no further apart than acos(bound), so x in A and y in B can be a pair
only where asin(x.u) + asin(-y.u) <= acos(bound), however the vectors are spread. Within
two cells both sides are sorted by that angle, and only the steps in which the sum can
hold are multiplied, in single precision: first along a part of the axes, with the norm of
the rest as one more component, which gives no less than the cosine; then, where that
reaches the bound, in full. What comes near the bound is decided in double.
No pair is missed. The price: vectors without any direction of their own have partners
to be ruled out in nearly all cells, so the work still grows with the square of their
number; the angles take off most of it.

On Spark: cells in their order are cut into packs of PACK_BYTES at most, a large cell
into several. A body moves once, into its pack, and each pack is one row of a stored
table, a file of its own. Two packs meet by a Cartesian product, which reads that table
again and shuffles nothing, so the disk used grows with the vectors and not with the
pairs. A pair of packs with no cells near enough is not looked into. It gives link counts
and a spanning link for each vector, not all pairs.

Equal vectors are one class from the start. Vectors of different lengths are not linked.

Rows: a null, empty or zero vector, or one with a null or non-finite component, links
with nothing. Rows that share a vec_id and vector count once. A row without vec_id has
no links, a null component, and is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perdura.llm.components import connected_components
from perdura.sources.staging import stage_table

MOST = 20_000
CELL, MOST_CELLS = 1_000, 2_000
BLOCK = 2_000  # rows of a product with all centres, or of a cell with itself
STEP, WIDEST = 128, 16_000  # rows and most columns of a step of two cells
PACK_BYTES, LEAST_PACKS = 12 << 20, 16  # of bodies; fewer packs only for under BLOCK / 4 rows each
HEAD, SHORT, LONG = 1 / 2, 32, 1_024  # share of a length that is multiplied first, and between which lengths
DENSE = 1 / 32  # share of the first products that is more than worth looking at one by one
SEEN = 200_000  # digests a task keeps
EDGES = 1_000_000  # links held before they are spanned
SLACK = 1e-5  # over the rounding of angles
APART = 1e-4  # centres that are nearer have no direction
STEPS = 8

GROUP = "struct<size:int,wide:boolean,cells:binary,centres:binary,nodes:binary,weights:binary,body:binary>"
PACK = f"pack int, sizes array<int>, cells array<int>, lows array<float>, groups array<{GROUP}>"


def _usable(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and components of the usable vectors, by length."""
    vectors = batch.column("embedding")
    values = vectors.values.to_numpy(zero_copy_only=False)  # a null is a NaN
    first = np.asarray(vectors.offsets)
    size = np.diff(first)
    known = np.asarray(vectors.is_valid()) & np.asarray(batch.column("vec_id").is_valid())
    for n in np.unique(size[known & (size > 0)]):
        rows = np.flatnonzero(known & (size == n))
        x = values[first[rows][:, None] + np.arange(n)] + 0.0
        fit = np.isfinite(x).all(axis=1) & x.any(axis=1)
        yield rows[fit], x[fit]


def _bodies(cells: dict[int, np.ndarray] | None = None):
    """Class, length, home and components of each vector. A body is given once a task; in single precision if that is exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keys, sizes, homes, bodies = ([None] * batch.num_rows for _ in range(4))
            for rows, x in _usable(batch):
                home = _homes(x, _centres(cells or {}, x.shape[1]))
                with np.errstate(over="ignore", under="ignore"):
                    single = x.astype(np.float32)
                narrow = (single == x).all(axis=1)
                for at, row in enumerate(rows):
                    key = xxhash.xxh3_128_digest(x[at].tobytes())
                    keys[row], sizes[row], homes[row] = key, x.shape[1], home[at]
                    if key not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(key)
                        bodies[row] = (single if narrow[at] else x)[at].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()),
                 pa.array(homes, pa.int32()), pa.array(bodies, pa.binary())],
                ["vec_id", "class", "size", "cell", "body"],
            )

    return run


def _matrix(bodies: list[bytes], size: int) -> np.ndarray:
    """Components as doubles."""
    return np.stack([np.frombuffer(b, dtype=f"<f{len(b) // size}").astype(np.float64) for b in bodies])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_centres(x: np.ndarray, k: int) -> np.ndarray:
    """k unit centres of unit vectors x, the first k vectors to begin with."""
    centres = x[:k].copy()
    for _ in range(STEPS):
        home = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        size = np.linalg.norm(sums, axis=1)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


def fit_cells(vectors: DataFrame, most: int = MOST, cell: int = CELL) -> dict[int, np.ndarray]:
    """Centres by vector length, fitted on a bounded sample."""
    usable = vectors.where("vec_id is not null and size(embedding) > 0")
    total = usable.count()
    chance = F.xxhash64("vec_id", "embedding")
    likely = usable.where(F.abs(chance / 2.0**63) <= min(1.0, 2 * most / max(1, total)))  # bounds what is sent to be ordered
    rows = likely.orderBy(chance, "vec_id").limit(most).mapInArrow(
        _bodies(), "vec_id long, class binary, size int, cell int, body binary"
    ).where("body is not null").select("size", "body").collect()
    by_size: dict[int, list[bytes]] = {}
    for r in rows:
        by_size.setdefault(r["size"], []).append(r["body"])
    cells = {}
    for size, bodies in by_size.items():
        k = min(MOST_CELLS, max(1, round(total * len(bodies) / len(rows) / cell)), max(1, len(bodies) // 4))
        cells[size] = spherical_centres(_unit(_matrix(bodies, size)), k)
    return cells


def _centres(cells: dict[int, np.ndarray], size: int) -> np.ndarray:
    """Lengths the sample has not seen have one cell."""
    return cells.get(size, np.eye(1, size))


def _homes(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre, from integers whose products are exact: equal vectors have one home in whatever block."""
    if len(centres) == 1:
        return np.zeros(len(x), dtype=np.int64)
    bits = min(20, (52 - x.shape[1].bit_length()) // 2)
    to = np.rint(centres * 2.0**bits).T
    home = np.empty(len(x), dtype=np.int64)
    for start in range(0, len(x), BLOCK):
        part = x[start : start + BLOCK]
        exponent = np.frexp(np.abs(part).max(axis=1, keepdims=True))[1]
        whole = np.rint(np.ldexp(np.ldexp(part, -exponent), bits))
        home[start : start + BLOCK] = (whole @ to).argmax(axis=1)
    return home


def _angles(own: np.ndarray, near: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Angle to the plane between the own centre and another; where that has no direction, the least there is."""
    with np.errstate(divide="ignore", invalid="ignore"):
        sine = (own - near) / apart
    return np.arcsin(np.where(apart < APART, -1, np.clip(sine, -1, 1)))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([np.linalg.norm(b - c, axis=1) for c in a])


def _lows(x: np.ndarray, cell: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Over the vectors of a pack, the least angle to the plane of each cell."""
    lows = np.full(len(centres), np.inf)
    for home in np.unique(cell):
        rows, margin = x[cell == home], np.full(len(centres), np.inf)
        for start in range(0, len(rows), BLOCK):
            near = rows[start : start + BLOCK] @ centres.T
            np.minimum(margin, (near[:, home, None] - near).min(axis=0), out=margin)
        np.minimum(lows, _angles(margin, 0, _apart(centres[home, None], centres)[0]), out=lows)
    return lows


def _pack(cells: dict[int, np.ndarray]):
    """One row with the vectors of a pack, by length and cell."""

    def run(key: tuple, members: pa.Table, owners: pa.Table) -> pa.Table:
        owner = {c: (n, w) for c, n, w in zip(*(owners.column(c).to_pylist() for c in ("class", "node", "weight")))}
        found = {c: r for c, *r in zip(*(members.column(c).to_pylist() for c in ("class", "size", "cell", "body")))}
        by_size: dict[int, list] = {}
        for c, (size, cell, body) in found.items():
            by_size.setdefault(size, []).append((cell, *owner[c], body))
        groups, lows = [], None
        for size in sorted(by_size):
            cell, node, weight, bodies = zip(*sorted(by_size[size]))
            wide = any(len(b) != 4 * size for b in bodies)
            centres = _centres(cells, size)
            homes = np.array(cell, dtype=np.int32)
            if len(by_size) == 1:
                lows = _lows(_unit(_matrix(bodies, size)), homes, centres).tolist()
            groups.append({
                "size": size, "wide": wide, "cells": homes.tobytes(), "centres": centres[np.unique(homes)].tobytes(),
                "nodes": np.array(node, dtype=np.int64).tobytes(), "weights": np.array(weight, dtype=np.int64).tobytes(),
                "body": _matrix(bodies, size).tobytes() if wide else b"".join(bodies),
            })
        inside = np.unique(homes).tolist() if lows else None
        row = {"pack": key[0].as_py(), "sizes": sorted(by_size), "cells": inside, "lows": lows, "groups": groups}
        binary = {k: pa.binary() for k in ("cells", "centres", "nodes", "weights", "body")}
        group = pa.struct([("size", pa.int32()), ("wide", pa.bool_()), *binary.items()])
        return pa.Table.from_pylist([row], pa.schema([
            ("pack", pa.int32()), ("sizes", pa.list_(pa.int32())), ("cells", pa.list_(pa.int32())),
            ("lows", pa.list_(pa.float32())), ("groups", pa.list_(group)),
        ]))

    return run


def fit_axes(cells: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """By length, orthonormal axes along which the centres spread most: HEAD of a length, which is not short or very long."""
    axes = {}
    for size, centres in cells.items():
        if SHORT < size <= LONG:
            axes[size] = np.linalg.eigh(centres.T @ centres)[1][:, : -int(size * HEAD) - 1 : -1].copy()
    return axes


class _Group:
    """The vectors of one length in a pack, sorted by cell."""

    def __init__(self, group: dict, axes: dict[int, np.ndarray]):
        self.raw = np.frombuffer(group["body"], dtype="<f8" if group["wide"] else "<f4").reshape(-1, group["size"])
        self.nodes, self.weights = (np.frombuffer(group[c], dtype=np.int64) for c in ("nodes", "weights"))
        self.centres = np.frombuffer(group["centres"], dtype=np.float64).reshape(-1, group["size"])
        cells = np.frombuffer(group["cells"], dtype=np.int32)
        self.cells, self.first, self.at = np.unique(cells, return_index=True, return_inverse=True)
        self.ends = np.append(self.first[1:], len(cells))
        self.unit = _unit(self.raw.astype(np.float64))
        self.head = self.single = self.unit.astype(np.float32)
        if group["size"] in axes:  # products of heads are no less than those of the vectors
            head = self.unit @ axes[group["size"]]
            rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", head, head)))
            self.head = np.column_stack([head, rest]).astype(np.float32)
        self.own = np.einsum("ij,ij->i", self.unit, self.centres[self.at])

    def angles(self, other: _Group) -> np.ndarray:
        """Angle of each vector to the plane of each cell of the other."""
        return _angles(self.own[:, None], self.unit @ other.centres.T, _apart(self.centres, other.centres)[self.at])

    def scaled(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.raw[rows].astype(np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        return x, np.linalg.norm(x, axis=1)


def _pieces(n: int) -> Iterator[slice]:
    return (slice(start, start + BLOCK) for start in range(0, n, BLOCK))


def _decided(a: _Group, b: _Group, rows: np.ndarray, cols: np.ndarray, score: np.ndarray, above: bool, bound: float):
    """The linked (row, col) of rows and columns whose heads have that product; above: only with the row before the column."""
    error = (a.raw.shape[1] + 16) * 2.0**-23  # more than single precision can be off
    if not score.size or score.max() < bound - error:
        return None
    r, c = np.divmod(np.flatnonzero(score >= bound - error), len(cols))
    if a.head is a.single:
        score = score[r, c]
    elif len(r) > score.size * DENSE:
        score = a.single[rows] @ b.single[cols].T
        r, c = np.divmod(np.flatnonzero(score >= bound - error), len(cols))
        score = score[r, c]
    else:
        score = np.empty(len(r), dtype=np.float32)
        for part in _pieces(len(r)):
            score[part] = np.einsum("ij,ij->i", a.single[rows[r[part]]], b.single[cols[c[part]]])
    r, c = rows[r], cols[c]
    keep = score >= bound - error
    if above:
        keep &= r < c
    r, c, score = r[keep], c[keep], score[keep]
    linked = score >= bound + error
    near = np.flatnonzero(~linked)
    for part in _pieces(len(near)):
        (x, norm_x), (y, norm_y) = a.scaled(r[near[part]]), b.scaled(c[near[part]])
        linked[near[part]] = np.einsum("ij,ij->i", x, y) / (norm_x * norm_y) >= bound
    return (r[linked], c[linked]) if linked.any() else None


def _linked(a: _Group, b: _Group, same: bool, bound: float):
    """All linked (row of a, row of b), each once, piece by piece."""
    reach = np.arccos(np.clip(bound, -1, 1)) + SLACK
    angle_a, angle_b = a.angles(b), b.angles(a)
    low_a, low_b = np.minimum.reduceat(angle_a, a.first, axis=0), np.minimum.reduceat(angle_b, b.first, axis=0)
    for i, j in zip(*np.nonzero(low_a + low_b.T <= reach)):
        if same and i > j:
            continue
        rows, cols = np.arange(a.first[i], a.ends[i]), np.arange(b.first[j], b.ends[j])
        if same and i == j:
            for up in _pieces(len(rows)):
                for to in _pieces(len(cols)):
                    if up.start <= to.start:
                        score = a.head[rows[up]] @ b.head[cols[to]].T
                        yield _decided(a, b, rows[up], cols[to], score, up.start == to.start, bound)
            continue
        angle_r, angle_c = angle_a[rows, j], angle_b[cols, i]
        keep = angle_r <= reach - low_b[j, i]
        rows, angle_r = rows[keep], angle_r[keep]
        keep = angle_c <= reach - low_a[i, j]
        cols, angle_c = cols[keep], angle_c[keep]
        order = angle_r.argsort()
        rows, angle_r = rows[order], angle_r[order]
        order = angle_c.argsort()
        cols, angle_c = cols[order], angle_c[order]
        head_r, head_c = a.head[rows], b.head[cols]
        for start in range(0, len(rows), STEP):
            up, end = slice(start, start + STEP), angle_c.searchsorted(reach - angle_r[start], side="right")
            for after in range(0, end, WIDEST):
                to = slice(after, min(end, after + WIDEST))
                yield _decided(a, b, rows[up], cols[to], head_r[up] @ head_c[to].T, False, bound)


def _least(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least number reachable from each of 0 to n - 1."""
    root = np.arange(n)
    while True:
        before = root.copy()
        least = np.minimum(root[u], root[v])
        for ends in (before[u], before[v], u, v):
            np.minimum.at(root, ends, least)
        root = root[root]
        if (root == before).all():
            return root


def _links(a: _Group, b: _Group, same: bool, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, links, root) of the vectors with a link between the two groups."""
    nodes = a.nodes if same else np.concatenate([a.nodes, b.nodes])
    weights = a.weights if same else np.concatenate([a.weights, b.weights])
    order = nodes.argsort()
    rank = np.empty(len(nodes), dtype=np.int64)
    rank[order] = np.arange(len(nodes))
    links = np.zeros(len(nodes), dtype=np.int64)
    u = v = np.empty(0, dtype=np.int64)
    for found in _linked(a, b, same, bound):
        if found is None:
            continue
        row, col = found[0], found[1] + (0 if same else len(a.nodes))
        np.add.at(links, row, weights[col])
        np.add.at(links, col, weights[row])
        u, v = np.append(u, rank[row]), np.append(v, rank[col])
        if len(u) > EDGES:
            u, v = np.arange(len(nodes)), _least(len(nodes), u, v)
            u, v = u[u != v], v[u != v]
    linked = np.flatnonzero(links)
    return nodes[linked], links[linked], nodes[order][_least(len(nodes), u, v)[rank[linked]]]


def _compare(bound: float, axes: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                same = batch.column("pack")[row].as_py() == batch.column("other")[row].as_py()
                left = {g["size"]: g for g in batch.column("groups")[row].as_py()}
                right = left if same else {g["size"]: g for g in batch.column("others")[row].as_py()}
                for size in left.keys() & right.keys():
                    a = _Group(left[size], axes)
                    found = _links(a, a if same else _Group(right[size], axes), same, bound)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["node", "links", "root"])

    return run


def _packs(owners: DataFrame) -> DataFrame:
    """Where each cell begins among all bytes, how many vectors it has, and the number of packs."""
    cells = owners.groupBy("size", "cell").agg(F.count("*").alias("n"))
    length = F.col("size") * F.col("n") * 4.0
    everything = Window.partitionBy()
    packs = F.greatest(
        F.ceil(F.sum(length).over(everything) / PACK_BYTES),
        F.least(F.lit(LEAST_PACKS), F.ceil(F.sum("n").over(everything) / (BLOCK / 4))),
    )
    return stage_table(
        cells.select(
            "size", "cell", "n", (F.sum(length).over(Window.orderBy("size", "cell")) - length).alias("start"),
            length.alias("length"), F.sum(length).over(everything).alias("whole"), packs.cast("int").alias("packs"),
        ),
        "cell_sizes",
    )


def _dealt(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """The pack of each row: by cell, and within a cell by class."""
    place = F.col("start") + F.col("length") * F.pmod(F.xxhash64("class"), F.col("n")) / F.col("n")
    return rows.join(F.broadcast(cells), ["size", "cell"]).withColumn(
        "pack", F.least(F.floor(place / F.col("whole") * F.col("packs")), F.col("packs") - 1).cast("int")
    )


def near_duplicate_vectors(vectors: DataFrame, bound: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id (least vec_id reachable by links), kept; one row per row of vectors."""
    vectors = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    cells = fit_cells(vectors)
    rows = stage_table(
        vectors.mapInArrow(_bodies(cells), "vec_id long, class binary, size int, cell int, body binary"), "vectors"
    )
    classes = stage_table(
        rows.where("class is not null").groupBy("class", "size", "cell").agg(
            F.min("vec_id").alias("node"), F.countDistinct("vec_id").alias("weight")
        ),
        "vector_classes",
    )
    sizes = _packs(classes)
    members = _dealt(rows.where("body is not null"), sizes).select("pack", "class", "size", "cell", "body")
    owners = _dealt(classes, sizes).select("pack", "class", "node", "weight")
    packed = stage_table(
        members.groupBy("pack").cogroup(owners.groupBy("pack")).applyInArrow(_pack(cells), PACK), "packs", ["pack"]
    ).select("pack", "sizes", "cells", "lows", "groups")
    others = packed.select(
        F.col("pack").alias("other"), F.col("sizes").alias("other_sizes"), F.col("cells").alias("other_cells"),
        F.col("lows").alias("other_lows"), F.col("groups").alias("others"),
    )
    reach = float(np.arccos(np.clip(bound, -1, 1)) + 2 * SLACK)
    near = F.expr(
        "pack <= other and arrays_overlap(sizes, other_sizes) and coalesce("
        "array_min(transform(other_cells, c -> get(lows, c))) + array_min(transform(cells, c -> get(other_lows, c)))"
        f" <= {reach!r}, true)"
    )
    found = stage_table(
        packed.join(others.hint("shuffle_replicate_nl"), near).select("pack", "other", "groups", "others").mapInArrow(
            _compare(bound, fit_axes(cells)), "node long, links long, root long"
        ),
        "links",
    )
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    component = connected_components(found, "node", "root")
    result = stage_table(
        classes.select("class", "node", "weight").join(links, "node", "left").join(component, "node", "left").select(
            "class",
            (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        ),
        "vector_result",
    )
    return rows.select("vec_id", "class").join(result, "class", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("component_id", "vec_id")).alias("kept"),
    )
