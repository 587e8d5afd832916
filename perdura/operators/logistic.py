"""Logistic regressions with an elastic-net penalty: all settings of all folds share each scan."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perdura.sources.staging import stage_table

ROWS = 500  # of a block of rows by vectors
BATCH = 10_000  # rows whose scores are sorted together
CELLS = 512  # of scores that a vector's cells are cut into at once
TOLERANCE = 1e-9


def _rows(batches: Iterator[pa.RecordBatch], p: int, most: int = ROWS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            part = batch.slice(start, most)
            x = np.stack([part.column(f"x{i}").to_numpy() for i in range(p)], axis=1)
            yield np.c_[np.ones(len(x)), x], part.column("label").to_numpy(), part.column("fold").to_numpy()


def _sums(theta: np.ndarray, held: np.ndarray):
    """Loss, gradient and upper Hessian of each vector, summed over the rows outside its fold."""
    up = np.triu_indices(theta.shape[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(theta), 1 + theta.shape[1] + len(up[0])))
        for x, y, fold in _rows(batches, theta.shape[1] - 1):
            used = fold[:, None] != held[None, :]
            z = x @ theta.T
            chance = 0.5 + 0.5 * np.tanh(z / 2)
            total[:, 0] += ((np.logaddexp(0, z) - y[:, None] * z) * used).sum(axis=0)
            total[:, 1 : 1 + x.shape[1]] += ((chance - y[:, None]) * used).T @ x
            total[:, 1 + x.shape[1] :] += (chance * (1 - chance) * used).T @ (x[:, up[0]] * x[:, up[1]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return run


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b) for b in table.column("sums").to_pylist())
    return pa.table([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def _scan(rows: DataFrame, theta: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = theta.shape[1]
    parts = (
        rows.mapInArrow(_sums(theta, held), "sums binary")
        .groupBy(F.pmod(F.xxhash64("sums"), F.lit(16))).applyInArrow(_added, "sums binary").collect()
    )
    total = sum((np.frombuffer(r["sums"]) for r in parts), np.zeros(1)).reshape(len(theta), -1)
    hessian = np.zeros((len(theta), p, p))
    up = np.triu_indices(p)
    hessian[:, up[0], up[1]] = hessian[:, up[1], up[0]] = total[:, 1 + p :]
    return total[:, 0], total[:, 1 : 1 + p], hessian


def _step(theta, gradient, hessian, l1):
    """Minimum of each vector's quadratic model plus its l1 penalty, by coordinates."""
    new, slope = theta.copy(), gradient.copy()
    for _ in range(5_000):
        moved = 0.0
        for j in range(theta.shape[1]):
            curve = np.maximum(hessian[:, j, j], 1e-12)
            goal = new[:, j] - slope[:, j] / curve
            if j:
                goal = np.sign(goal) * np.maximum(0, np.abs(goal) - l1 / curve)
            change = goal - new[:, j]
            new[:, j] = goal
            slope += hessian[:, :, j] * change[:, None]
            moved = max(moved, np.abs(change).max())
        if moved < TOLERANCE / 10:
            break
    return new


def fit(rows: DataFrame, p: int, settings: Sequence[tuple[float, float, int]], held: np.ndarray) -> np.ndarray:
    """Intercept and coefficients by vector, for (C, l1_ratio, max_iter) and the fold each leaves out.

    C times the summed loss, plus l1_ratio * |w| + (1 - l1_ratio) / 2 * w^2, the intercept free;
    proximal Newton steps, halved while they raise the objective, at most max_iter of them.
    """
    c, ratio, most = (np.array(v, dtype=float) for v in zip(*settings))
    theta = np.zeros((len(c), p + 1))
    last, target, value = theta.copy(), theta.copy(), np.full(len(c), np.inf)
    share, taken, active = np.ones(len(c)), np.zeros(len(c), dtype=int), np.arange(len(c))
    while len(active):
        loss, gradient, hessian = _scan(rows, theta[active], held[active])
        w = theta[active, 1:]
        now = c[active] * loss + ratio[active] * np.abs(w).sum(axis=1) + (1 - ratio[active]) / 2 * (w * w).sum(axis=1)
        worse = (now > value[active] + 1e-10 * np.abs(now)) & (share[active] > 1e-6)
        back = active[worse]
        share[back] /= 2
        theta[back] = last[back] + share[back, None] * (target[back] - last[back])
        good = ~worse & (taken[active] < most[active])
        ahead = active[good]
        if len(ahead):
            value[ahead], last[ahead], share[ahead] = now[good], theta[ahead], 1.0
            soft = np.r_[0, np.ones(p)] * (1 - ratio[ahead])[:, None]
            curve = c[ahead, None, None] * hessian[good] + soft[:, :, None] * np.eye(p + 1)
            target[ahead] = _step(theta[ahead], c[ahead, None] * gradient[good] + soft * theta[ahead], curve, ratio[ahead])
            theta[ahead] = target[ahead]
            taken[ahead] += 1
            ahead = ahead[np.abs(target[ahead] - last[ahead]).max(axis=1) > TOLERANCE]
        active = np.sort(np.r_[back, ahead])
    return theta


def _used(fold: np.ndarray, held: int, outside: bool) -> np.ndarray:
    return fold != held if outside else fold == held


@dataclass
class _Cell:
    """Rows of one vector with scores from lo to hi, some of each class; ``parts`` is how many it is cut into next."""

    lo: float
    hi: float
    pairs: int  # positives times negatives
    rows: int
    parts: int = 1


def _cut(score: np.ndarray, cells: Sequence[_Cell]) -> np.ndarray:
    """The part of a cell that each of some rising scores falls in, numbered over all cells, -1 for none."""
    lo, hi = np.array([c.lo for c in cells]), np.array([c.hi for c in cells])
    parts = np.array([c.parts for c in cells])
    at = np.searchsorted(lo, score, side="right") - 1
    inside = (at >= 0) & (score <= hi[at])
    share = np.zeros(len(score))
    cut = inside & (parts[at] > 1)
    share[cut] = (score[cut] - lo[at[cut]]) / (hi[at[cut]] - lo[at[cut]])
    part = np.minimum((share * parts[at]).astype(np.int64), parts[at] - 1)
    return np.where(inside, (np.cumsum(parts) - parts)[at] + part, -1)


def _cell_counts(theta: np.ndarray, held: np.ndarray, outside: bool, cells: dict[int, list[_Cell]]):
    """Rows by class, least and greatest score of each part of the cells; at most a row for each part and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = np.array(sorted(cells))
        for x, y, fold in _rows(batches, theta.shape[1] - 1, BATCH):
            found = []
            for h in np.unique(held[vectors]):
                mine, used = vectors[held[vectors] == h], _used(fold, h, outside)
                label = y[used] == 1
                scores = x[used] @ theta[mine].T
                for v, score in zip(mine, scores.T):
                    order = np.argsort(score)
                    part = _cut(score[order], cells[v])
                    order, part = order[part >= 0], part[part >= 0]
                    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else part
                    last = np.r_[first[1:], len(part)] - 1
                    if len(first):
                        pos = np.add.reduceat(label[order].astype(np.int64), first)
                        found.append((np.full(len(first), v), part[first], score[order[first]], score[order[last]], pos, last - first + 1 - pos))
            if found:
                columns = [np.concatenate(c) for c in zip(*found)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["vector", "part", "lo", "hi", "pos", "neg"])

    return run


def _next_cuts(waiting: list[_Cell], most: float) -> list[_Cell]:
    """The heaviest cells, so many that the rest holds ``most`` pairs at most, each with its number of parts."""
    waiting.sort(key=lambda c: c.pairs)
    left = 0
    while waiting and left + waiting[0].pairs <= most:
        left += waiting.pop(0).pairs
    chosen = waiting[-CELLS // 2 :]
    total = sum(c.pairs for c in chosen)
    for c in chosen:
        c.parts = min(max(2, CELLS * c.pairs // (2 * total)), max(2, c.rows))
    return sorted(chosen, key=lambda c: c.lo)


def rank_statistic(
    rows: DataFrame, theta: np.ndarray, held: np.ndarray, outside: bool = False, resolution: float = 0.0
) -> tuple[np.ndarray, np.ndarray]:
    """(area under the ROC curve, bound of its error) of each vector, over the rows of its fold or outside it.

    Scores are counted by class in cells, which add up over partitions. Pairs of rows in different
    cells are settled. Cells with both classes are cut again, between their own least and greatest
    score, until the pairs left in them are at most ``resolution`` of all; those and equal scores
    count half. What is shuffled and sent depends on the cells, CELLS a vector and pass, not on the
    number of rows. About 1 / resolution cells a vector are open at a time, on the driver too;
    ``resolution=0`` is exact and opens as many as there are rows. NaN where a class is absent.
    """
    n = len(theta)
    wins, total = np.zeros(n), np.zeros((n, 2))
    waiting: dict[int, list[_Cell]] = {v: [] for v in range(n)}
    cells = {v: [_Cell(-np.inf, np.inf, 0, 0)] for v in range(n)}
    started = False
    while cells:
        counted = rows.mapInArrow(
            _cell_counts(theta, held, outside, cells), "vector long, part long, lo double, hi double, pos long, neg long"
        ).groupBy("vector", "part").agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
        ).toArrow()
        vector, part, lo, hi, pos, neg = (counted.column(c).to_numpy() for c in ("vector", "part", "lo", "hi", "pos", "neg"))
        order = np.lexsort((part, vector))
        vector, part, lo, hi, pos, neg = (c[order] for c in (vector, part, lo, hi, pos, neg))
        bounds = np.searchsorted(vector, np.arange(n + 1))
        for v, cut in cells.items():
            mine = slice(bounds[v], bounds[v + 1])
            owner = np.searchsorted(np.cumsum([c.parts for c in cut]), part[mine], side="right")
            p, q = pos[mine].astype(float), neg[mine].astype(float)
            below = np.cumsum(q) - q  # negatives of lower parts of the same cell
            first = np.searchsorted(owner, owner)
            below -= below[first] if len(first) else 0
            wins[v] += (p * below).sum()
            tied = lo[mine] == hi[mine]
            wins[v] += (p * q / 2)[tied].sum()
            for i in np.flatnonzero((p * q > 0) & ~tied):
                at = mine.start + i
                waiting[v].append(_Cell(lo[at], hi[at], int(pos[at]) * int(neg[at]), int(pos[at] + neg[at])))
            if not started:
                total[v] = p.sum(), q.sum()
        started, cells = True, {}
        for v, cut in waiting.items():
            most = resolution * total[v].prod()
            if sum(c.pairs for c in cut) > most:
                cells[v] = _next_cuts(list(cut), most)
                taken = set(map(id, cells[v]))
                waiting[v] = [c for c in cut if id(c) not in taken]
    open_pairs = np.array([float(sum(c.pairs for c in waiting[v])) for v in range(n)])
    with np.errstate(invalid="ignore", divide="ignore"):
        pairs = total.prod(axis=1)
        return (wins + open_pairs / 2) / pairs, open_pairs / 2 / pairs


def _score_sums(theta: np.ndarray, held: np.ndarray, outside: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(theta), 3))
        for x, y, fold in _rows(batches, theta.shape[1] - 1, ROWS):
            used = fold[:, None] != held[None, :] if outside else fold[:, None] == held[None, :]
            z = x @ theta.T
            right = (z > 0) == (y[:, None] == 1)
            loss = np.logaddexp(0, z) - y[:, None] * z
            total += np.stack([used.sum(axis=0), (right & used).sum(axis=0), (loss * used).sum(axis=0)], axis=1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(theta))), *(pa.array(c) for c in total.T)], ["vector", "n", "right", "loss"]
        )

    return run


def score_metrics(
    rows: DataFrame, theta: np.ndarray, held: np.ndarray, outside: bool, resolution: float
) -> dict[str, np.ndarray]:
    """accuracy, log_loss and auc of each vector, over the rows of its fold or outside it."""
    found = rows.mapInArrow(_score_sums(theta, held, outside), "vector long, n double, right double, loss double").groupBy(
        "vector"
    ).agg(F.sum("n").alias("n"), F.sum("right").alias("right"), F.sum("loss").alias("loss")).toArrow()
    table = np.full((len(theta), 3), np.nan)
    if found.num_rows:
        table[found.column("vector").to_numpy()] = np.stack([found.column(c).to_numpy() for c in ("n", "right", "loss")], axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return {
            "accuracy": table[:, 1] / table[:, 0], "log_loss": table[:, 2] / table[:, 0],
            "auc": rank_statistic(rows, theta, held, outside, resolution)[0],
        }


def _staged(df: DataFrame, features: Sequence[str], label: str, fold: Column) -> DataFrame:
    columns = [F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    return stage_table(
        df.select(*columns, F.col(label).cast("double").alias("label"), fold.cast("long").alias("fold")), "logistic"
    )


def grid_auc(
    df: DataFrame, features: Sequence[str], label: str, settings: Sequence[tuple[float, float, int]], fold: Column, folds: int,
    resolution: float = 0.0,
) -> list[float | None]:
    """Mean held-out area under the ROC curve of each (C, l1_ratio, max_iter); each fold's fit counts its own rows.

    Folds in which a class is absent do not count; None where all are.
    """
    rows, held = _staged(df, features, label, fold), np.tile(np.arange(folds), len(settings))
    theta = fit(rows, len(features), [s for s in settings for _ in range(folds)], held)
    auc = rank_statistic(rows, theta, held, resolution=resolution)[0].reshape(len(settings), folds)
    return [float(a[~np.isnan(a)].mean()) if (~np.isnan(a)).any() else None for a in auc]


def grid_report(
    df: DataFrame, features: Sequence[str], label: str, settings: Sequence[tuple[float, float, int]], test: Column,
    resolution: float = 0.0,
) -> DataFrame:
    """A row for each setting, fitted on the rows where ``test`` does not hold.

    C, l1_ratio, max_iter, intercept, coefficients by feature, and accuracy, log_loss and auc
    of the train and the test rows.
    """
    rows, held = _staged(df, features, label, test.cast("int")), np.ones(len(settings), dtype=np.int64)
    theta = fit(rows, len(features), settings, held)
    metrics = {
        f"{side}_{name}": values
        for side, outside in (("train", True), ("test", False))
        for name, values in score_metrics(rows, theta, held, outside, resolution).items()
    }
    columns = ["C", "l1_ratio", "max_iter", "intercept", *features, *metrics]
    lines = [
        (float(c), float(ratio), int(most), *map(float, t), *(float(m[i]) for m in metrics.values()))
        for i, ((c, ratio, most), t) in enumerate(zip(settings, theta))
    ]
    kinds = ", ".join(f"`{c}` {'int' if c == 'max_iter' else 'double'}" for c in columns)
    return df.sparkSession.createDataFrame(lines, kinds)
