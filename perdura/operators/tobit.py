"""Censored (Tobit) regression with elastic-net penalty on distributed rows.

The penalised log-likelihood of a parameter vector theta = (intercept, b, s) is

    loglik(theta) - C * (alpha * ||theta||_1 + (1 - alpha) * ||theta||^2 / 2)

Rows that are not censored enter it only through their cross products, which one
scan collects. After that each iteration scans the censored rows alone, and one
scan returns log-likelihood, gradient and Hessian for many parameter vectors, so
a whole grid, all folds or all bootstrap replicates advance together. The driver
holds a few numbers per vector and takes proximal Newton steps, which keep the
L1 part exact (zeros are exact zeros).

Vectors near a known fit need no scan of their own: one scan expands the censored
rows' log-likelihood about that fit, per sample, and all vectors climb the
expansion. A bound on what the expansion leaves out, from the largest values of
the rows, says which vectors it serves; the others go on with scans.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perdura.functions.numeric import hash_fraction, linear_prediction
from perdura.functions.probability import (
    FIFTH_DERIVATIVE,
    LOG_SQRT_2PI,
    log_ndtr,
    log_ndtr_and_mills,
    log_ndtr_derivatives,
)
from perdura.operators.caching import cached
from perdura.operators.moments import sum_over_rows
from perdura.operators.resampling import stratified_places

CELLS_PER_BLOCK = 32_768  # arrays of this size stay in the processor's cache
SMALLEST_SIGMA = 1e-15
EXPAND_FROM = 100_000  # fewer censored rows are scanned instead: an expansion would serve few vectors
MOST_MOMENTS = 512  # sums a sample's expansion may take
FARTHEST = 1.0  # most a row's argument may move from the centre of an expansion
TINY = 1e-13  # gain, relative to the objective, at which a climb that costs no scan ends
CLOSE = 1e-8  # error of a parameter, relative to 1 + its size, that an expansion may leave
WEIGHTED_CELLS = 131_072  # rows by samples weighed at once

# P(X <= k) of the Poisson(1) law as 64-bit integers; beyond k = 15 it rounds to 1
POISSON_BOUNDS = [
    np.uint64(min(int(2**64 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))), 2**64 - 1))
    for k in range(16)
]
_BOUNDS = np.array(POISSON_BOUNDS, np.uint64)
_UNDECIDED = 255


def _count_table() -> np.ndarray:
    """Draw by the 16 upper bits of its hash, where these decide it."""
    low = np.arange(1 << 16, dtype=np.uint64) << np.uint64(48)
    first = np.searchsorted(_BOUNDS, low, side="right")
    last = np.searchsorted(_BOUNDS, low | np.uint64((1 << 48) - 1), side="right")
    return np.where(first == last, first, _UNDECIDED).astype(np.uint8)


_COUNTS = _count_table()


@dataclass(frozen=True)
class Censoring:
    left: float = -math.inf
    right: float = math.inf

    def censored(self, label: Column) -> Column:
        return (label <= F.lit(float(self.left))) | (label >= F.lit(float(self.right)))


@dataclass(frozen=True)
class Weighting:
    """Row weights of several samples; ``sample[k]`` is the sample of vector k.

    ``weigh`` maps the rows' extra columns and sample numbers to a
    [rows, samples] array.
    """

    weigh: Callable[[np.ndarray, np.ndarray], np.ndarray]
    sample: np.ndarray


@dataclass(frozen=True)
class Sums:
    """Log-likelihood, gradient and Hessian per parameter vector."""

    value: np.ndarray
    gradient: np.ndarray
    hessian: np.ndarray

    def __add__(self, other: Sums) -> Sums:
        return Sums(
            self.value + other.value,
            self.gradient + other.gradient,
            self.hessian + other.hessian,
        )


def block_rows(width: int, cells: int = CELLS_PER_BLOCK) -> int:
    return max(64, min(4096, cells // width))


def _mirror(upper: np.ndarray) -> np.ndarray:
    """[k, n, n] arrays filled above the diagonal, mirrored below it."""
    lower = np.tril_indices(upper.shape[-1], -1)
    upper[:, lower[0], lower[1]] = upper[:, lower[1], lower[0]]
    return upper


def cross_products(
    df: DataFrame | None, features: Sequence[str], label: str, extra: Sequence[str], weights: Weighting | None
) -> np.ndarray:
    """Weighted sum of v v', v = (1, x, y), per sample: [samples, p + 2, p + 2]."""
    p = len(features)
    size = p + 2
    pairs = np.triu_indices(size)
    numbers = np.unique(weights.sample) if weights else np.arange(1)

    def kernel(rows: np.ndarray) -> np.ndarray:
        v = np.column_stack([np.ones(len(rows)), rows[:, : p + 1]])
        products = v[:, pairs[0]] * v[:, pairs[1]]
        if weights is None:
            return products.sum(axis=0)[None, :]
        return weights.weigh(rows[:, p + 1 :], numbers).T @ products

    out = np.zeros((int(numbers.max()) + 1, size, size))
    if df is not None:
        block = block_rows(len(numbers) + len(pairs[0]), WEIGHTED_CELLS)
        sums = sum_over_rows(df, [*features, label, *extra], kernel, block)
        for number, row in zip(numbers, sums):
            out[number][pairs] = row
    return _mirror(out)


def exact_rows(products: np.ndarray, theta: np.ndarray) -> Sums:
    """Sums over uncensored rows from their cross products, one per vector."""
    m = theta.shape[1] - 1
    b, s = theta[:, :m], theta[:, m]
    n = products[:, 0, 0]
    xx, xy, yy = products[:, :m, :m], products[:, :m, m], products[:, m, m]
    xxb = np.einsum("kij,kj->ki", xx, b)
    xz = (xy - xxb) / s[:, None]  # sum of x z, z the scaled residual
    zz = (yy - 2 * (xy * b).sum(axis=1) + (xxb * b).sum(axis=1)) / (s * s)
    value = -0.5 * zz - n * (np.log(np.maximum(s, SMALLEST_SIGMA)) + LOG_SQRT_2PI)
    gradient = np.column_stack([xz / s[:, None], (zz - n) / s])
    hessian = np.zeros((len(theta), m + 1, m + 1))
    scale = (s * s)[:, None]
    hessian[:, :m, :m] = -xx / scale[:, :, None]
    hessian[:, :m, m] = hessian[:, m, :m] = -2 * xz / scale
    hessian[:, m, m] = (n - 3 * zz) / (s * s)
    return Sums(value, gradient, hessian)


def censored_rows(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    theta: np.ndarray,
    limits: Censoring,
    extra: Sequence[str] = (),
    weights: Weighting | None = None,
) -> Sums:
    """Sums over censored rows, by one scan for all vectors of ``theta``."""
    p = len(features)
    m = p + 1
    upper = np.triu_indices(m)
    b, s = theta[:, :m].T.copy(), theta[:, m].copy()
    vectors = len(theta)
    if weights is not None:
        numbers, place = np.unique(weights.sample, return_inverse=True)

    def kernel(rows: np.ndarray) -> np.ndarray:
        x = np.column_stack([np.ones(len(rows)), rows[:, :p]])
        # left rows look down from the label, right rows up from it
        sign = np.where(rows[:, p] <= limits.left, 1.0, -1.0)[:, None]
        a = (rows[:, p, None] - x @ b) / s * sign
        value, mills = log_ndtr_and_mills(a)
        bend = -mills * (a + mills)
        cross = (bend * a + mills) * sign  # s^2 d2 / d(xb) ds
        scale = -mills * a  # s d / ds
        second = a * (bend * a + 2 * mills)  # s^2 d2 / ds2
        pull = -sign * mills  # s d / d(xb)
        if weights is not None:
            w = weights.weigh(rows[:, p + 1 :], numbers)
            if len(numbers) < vectors or (place != np.arange(vectors)).any():
                w = w[:, place]
            for part in (value, pull, scale, bend, cross, second):
                part *= w
        products = x[:, upper[0]] * x[:, upper[1]]
        return np.column_stack(
            [
                value.sum(axis=0),
                (x.T @ pull / s).T,
                scale.sum(axis=0) / s,
                (bend.T @ products) / (s * s)[:, None],
                (x.T @ cross / (s * s)).T,
                second.sum(axis=0) / (s * s),
            ]
        )

    block = block_rows(vectors + len(upper[0]) // 8)
    out = sum_over_rows(df, [*features, label, *extra], kernel, block)
    hessian = np.zeros((vectors, m + 1, m + 1))
    at = 1 + m + 1
    hessian[:, upper[0], upper[1]] = out[:, at : at + len(upper[0])]
    at += len(upper[0])
    hessian[:, :m, m] = out[:, at : at + m]
    hessian[:, m, m] = out[:, at + m]
    return Sums(out[:, 0], out[:, 1 : 1 + m + 1], _mirror(hessian))


class Expansion:
    """Fourth-order expansion of the censored rows' log-likelihood about ``centre``, per sample.

    With phi = (b / s, 1 / s) the argument of a row's normal CDF is u . phi, linear in phi; the
    sums of the products of u's entries, weighted by the derivatives at the centre, are all an
    expansion needs. ``moments`` is [samples, sums], lowest order first; ``reach`` holds the
    largest absolute entries of u over the rows, ``rows`` the weight of each sample.
    """

    ORDER = 4

    def __init__(self, centre: np.ndarray, moments: np.ndarray, rows: np.ndarray, reach: np.ndarray) -> None:
        self.centre, self.rows, self.reach = self.natural(centre[None, :])[0], rows, reach
        self.moments, at = [], 0
        for picks in self.picks(len(reach)):
            self.moments.append(moments[:, at : at + len(picks)])
            at += len(picks)
        self.spread = []
        for order, picks in enumerate(self.picks(len(reach))):
            place = {p: i for i, p in enumerate(picks)}
            whole = np.ndindex(*[len(reach)] * order)
            self.spread.append(np.array([place[tuple(sorted(i))] for i in whole]))

    @classmethod
    def picks(cls, size: int) -> list[list[tuple[int, ...]]]:
        """Products of the entries of u that are summed, by order."""
        return [list(combinations_with_replacement(range(size), k)) for k in range(cls.ORDER + 1)]

    @staticmethod
    def natural(theta: np.ndarray) -> np.ndarray:
        s = theta[:, -1:]
        return np.column_stack([theta[:, :-1] / s, 1 / s])

    def distance(self, theta: np.ndarray) -> np.ndarray:
        """Bound on how far any row's argument is from the centre's."""
        return np.abs(self.natural(theta) - self.centre) @ self.reach

    def sums(self, theta: np.ndarray, sample: np.ndarray) -> Sums:
        """As :func:`censored_rows` would give; a value of minus infinity beyond FARTHEST."""
        d = self.natural(theta) - self.centre
        count, n = d.shape
        t = [m[sample][:, k].reshape(count, *[n] * order) for order, (m, k) in enumerate(zip(self.moments, self.spread))]
        third = np.einsum("kabcd,kd->kabc", t[4], d)
        second = np.einsum("kabc,kc->kab", third, d)
        cube = np.einsum("kabc,kc->kab", t[3], d)
        square, straight = np.einsum("kab,kb->ka", cube, d), np.einsum("kab,kb->ka", t[2], d)
        fourth = np.einsum("kab,kb->ka", second, d)
        value = t[0] + ((t[1] + straight / 2 + square / 6 + fourth / 24) * d).sum(axis=1)
        g = t[1] + straight + square / 2 + fourth / 6
        h = t[2] + cube + second / 2
        value = np.where(self.distance(theta) <= FARTHEST, value, -np.inf)
        return Sums(value, *self._of_theta(theta, g, h))

    def _turn(self, theta: np.ndarray) -> np.ndarray:
        """d phi / d theta."""
        count, n = theta.shape
        s = theta[:, -1]
        j = np.zeros((count, n, n))
        j[:, np.arange(n - 1), np.arange(n - 1)] = 1 / s[:, None]
        j[:, :-1, -1] = -theta[:, :-1] / (s * s)[:, None]
        j[:, -1, -1] = -1 / (s * s)
        return j

    def _of_theta(self, theta: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = theta[:, -1]
        j = self._turn(theta)
        hessian = np.einsum("kai,kab,kbj->kij", j, h, j)
        bend = -g[:, :-1] / (s * s)[:, None]
        hessian[:, :-1, -1] += bend
        hessian[:, -1, :-1] += bend
        hessian[:, -1, -1] += 2 * ((g[:, :-1] * theta[:, :-1]).sum(axis=1) + g[:, -1]) / s**3
        return np.einsum("kai,ka->ki", j, g), hessian

    def error(self, theta: np.ndarray, sample: np.ndarray, hessian: np.ndarray) -> np.ndarray:
        """Bound on the gradient left out, as the largest step it makes in a parameter.

        ``hessian`` is that of all rows and the penalty, of the function to be minimised.
        """
        far = self.distance(theta)
        left_out = FIFTH_DERIVATIVE / 24 * (self.rows[sample] * far**4)[:, None] * self.reach
        pull = np.einsum("kai,ka->ki", np.abs(self._turn(theta)), left_out)
        step = np.einsum("kij,kj->ki", np.abs(np.linalg.pinv(hessian, hermitian=True)), pull)
        worst = (step / (1 + np.abs(theta))).max(axis=1)
        return np.where(far <= FARTHEST, worst, np.inf)


def expand(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    centre: np.ndarray,
    limits: Censoring,
    reach: np.ndarray,
    extra: Sequence[str] = (),
    weights: Weighting | None = None,
) -> Expansion:
    """The expansion of the censored rows about ``centre``, by one scan for all samples."""
    p = len(features)
    size = p + 2
    phi = Expansion.natural(np.asarray(centre, float)[None, :])[0]
    picks = Expansion.picks(size)
    # each product is one of the order below times one more entry
    steps = []
    for lower, upper in zip(picks, picks[1:]):
        place = {q: i for i, q in enumerate(lower)}
        steps.append((np.array([place[q[:-1]] for q in upper]), np.array([q[-1] for q in upper])))
    numbers = np.unique(weights.sample) if weights else np.arange(1)
    length = sum(map(len, picks)) + 1

    def kernel(rows: np.ndarray) -> np.ndarray:
        sign = np.where(rows[:, p] <= limits.left, 1.0, -1.0)[:, None]
        u = np.column_stack([-np.ones(len(rows)), -rows[:, :p], rows[:, p]]) * sign
        terms = np.empty((len(rows), length))
        products, at = np.ones((len(rows), 1)), 0
        for order, bend in enumerate(log_ndtr_derivatives(u @ phi)):
            if order:
                below, entry = steps[order - 1]
                products = products[:, below] * u[:, entry]
            np.multiply(products, bend[:, None], out=terms[:, at : at + products.shape[1]])
            at += products.shape[1]
        terms[:, at] = 1.0
        if weights is None:
            return terms.sum(axis=0)[None, :]
        return weights.weigh(rows[:, p + 1 :], numbers).T @ terms

    block = block_rows(len(numbers) + length, WEIGHTED_CELLS)
    sums = sum_over_rows(df, [*features, label, *extra], kernel, block)
    out = np.zeros((int(numbers.max()) + 1, length))
    out[numbers] = sums
    return Expansion(np.asarray(centre, float), out[:, :-1], out[:, -1], reach)


def penalty(theta: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> np.ndarray:
    return l1 * np.abs(theta).sum(axis=-1) + l2 * (theta**2).sum(axis=-1) / 2


def _convex(hessian: np.ndarray) -> np.ndarray:
    """Flip or lift eigenvalues that would make a step go uphill."""
    values, vectors = np.linalg.eigh(hessian)
    floor = 1e-10 * np.abs(values).max(axis=-1, keepdims=True) + 1e-300
    values = np.maximum(np.abs(values), floor)
    return np.einsum("kij,kj,klj->kil", vectors, values, vectors)


def _newton_target(
    theta: np.ndarray, g: np.ndarray, h: np.ndarray, l1: np.ndarray, l2: np.ndarray, free: np.ndarray
) -> np.ndarray:
    """Minimiser of the penalised quadratic model around ``theta``."""
    x = theta.copy()
    size = theta.shape[1]
    smooth = l1 == 0
    for k in np.flatnonzero(smooth):
        a = h[k][np.ix_(free, free)] + l2[k] * np.eye(len(free))
        x[k, free] -= np.linalg.solve(a, (g[k] + l2[k] * theta[k])[free])
    rest = np.flatnonzero(~smooth)
    if len(rest) == 0:
        return x
    hr, gr, tr = h[rest], g[rest], theta[rest]
    xr, l1r, l2r = tr.copy(), l1[rest], l2[rest]
    slope = gr.copy()  # gradient of the quadratic at xr
    for _ in range(2000):
        moved = 0.0
        for j in range(size):
            if j not in free:
                continue
            hjj = hr[:, j, j]
            pull = hjj * xr[:, j] - slope[:, j]
            new = np.sign(pull) * np.maximum(np.abs(pull) - l1r, 0) / (hjj + l2r)
            step = new - xr[:, j]
            xr[:, j] = new
            slope += hr[:, :, j] * step[:, None]
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-13:
            break
    x[rest] = xr
    return x


def maximise(
    evaluate: Callable[[np.ndarray, np.ndarray], Sums],
    start: np.ndarray,
    c: np.ndarray,
    alpha: np.ndarray,
    fixed_sigma: bool = False,
    max_iter: int = 100,
    tol: float = 1e-9,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best theta, its penalised objective, and scans used, for every vector.

    ``evaluate(theta, ids)`` scans once for the vectors still moving.
    """
    theta = np.array(start, float)
    count, size = theta.shape
    free = np.arange(size - 1 if fixed_sigma else size)
    l1, l2 = c * alpha, c * (1 - alpha)
    best = np.full(count, np.inf)
    scans = np.zeros(count, int)
    step = np.zeros_like(theta)
    length = np.ones(count)
    expected = np.zeros(count)
    active = np.arange(count)
    trial = theta.copy()
    for _ in range(max_iter):
        if len(active) == 0:
            break
        sums = evaluate(trial[active], active)
        scans[active] += 1
        objective = -sums.value + penalty(trial[active], l1[active], l2[active])
        limit = best[active] + 1e-4 * length[active] * expected[active]
        good = np.isfinite(objective) & ((objective <= limit) | np.isinf(best[active]))
        stay = []
        retry = active[~good]
        length[retry] *= 0.5
        trial[retry] = theta[retry] + length[retry, None] * step[retry]
        stay.extend(retry[length[retry] > 1e-12])
        rows = np.flatnonzero(good)
        if len(rows):
            ids = active[rows]
            theta[ids] = trial[ids]
            best[ids] = objective[rows]
            g, h = -sums.gradient[rows], _convex(-sums.hessian[rows])
            target = _newton_target(theta[ids], g, h, l1[ids], l2[ids], free)
            d = target - theta[ids]
            gain = (g * d).sum(axis=1) + (
                penalty(target, l1[ids], l2[ids]) - penalty(theta[ids], l1[ids], l2[ids])
            )
            # the deviation stays positive: at most nine tenths of the way to 0
            down = -d[:, -1] / theta[ids, -1]
            length[ids] = np.where(down > 0.9, 0.9 / np.maximum(down, 1e-300), 1.0)
            step[ids], expected[ids] = d, gain
            trial[ids] = theta[ids] + length[ids, None] * d
            moving = -gain > tol * (1 + np.abs(best[ids]))
            stay.extend(ids[moving])
            # the last step is below the tolerance and is taken unseen
            done = ~moving & (length[ids] == 1.0)
            theta[ids[done]] = target[done]
            best[ids[done]] += gain[done]
        active = np.array(sorted(stay), int)
    return theta, best, scans


@dataclass(frozen=True)
class TobitFit:
    c: float
    alpha: float
    intercept: float
    coef: np.ndarray
    sigma: float
    loglik: float
    objective: float
    scans: int

    @property
    def theta(self) -> np.ndarray:
        return np.concatenate(([self.intercept], self.coef, [self.sigma]))


class TobitRows:
    """The rows of one problem, narrow and cached, with the cross products of the
    uncensored ones.

    Use as a context. Features are taken as they are; scale them first, both for
    the penalty's sake and for the precision of the cross products. Callers whose
    features are costly to derive write them to a table first. ``spread=False``
    leaves the rows in the partitions and order in which they come.
    """

    def __init__(
        self,
        df: DataFrame,
        features: Sequence[str],
        label: str,
        limits: Censoring,
        extra: dict[str, Column] | None = None,
        spread: bool = True,
    ) -> None:
        self.features, self.label, self.limits, self.spread = list(features), label, limits, spread
        self.extra = list(extra or {})
        picked = [F.col(c).cast("double").alias(c) for c in (*self.features, label)]
        picked += [c.cast("double").alias(n) for n, c in (extra or {}).items()]
        self.df = df.select(*picked).na.drop()

    def __enter__(self) -> TobitRows:
        held = self.limits.censored(F.col(self.label))
        self.df = cached(self.df) if self.spread else self.df.persist(StorageLevel.MEMORY_AND_DISK)
        self.exact, self.censored = self.df.filter(~held), self.df.filter(held)
        counts = self.df.agg(
            F.count_if(~held).alias("exact"),
            F.count_if(held).alias("censored"),
            *[F.max(F.when(held, F.abs(c))).alias(f"_most_{i}") for i, c in enumerate((*self.features, self.label))],
        ).first()
        if not counts["exact"] + counts["censored"]:
            raise ValueError("no complete rows")
        self.any_exact, self.any_censored = counts["exact"] > 0, counts["censored"] > 0
        self._many = counts["censored"] >= EXPAND_FROM
        self._reach = np.array([1.0, *[counts[f"_most_{i}"] or 0.0 for i in range(len(self.features) + 1)]])
        self._plain = self._products(self.exact, self.any_exact)
        return self

    def __exit__(self, *_) -> None:
        self.df.unpersist()

    def _products(self, df: DataFrame, rows: bool, weights: Weighting | None = None) -> np.ndarray:
        return cross_products(df if rows else None, self.features, self.label, self.extra, weights)

    def whole_products(self) -> np.ndarray:
        """Cross products of all rows, the censored among them."""
        return (self._plain + self._products(self.censored, self.any_censored))[0]

    def start(self) -> np.ndarray:
        """Least squares with the population deviation of its residuals."""
        whole = self.whole_products()
        xx, xy, yy = whole[:-1, :-1], whole[:-1, -1], whole[-1, -1]
        b = np.linalg.lstsq(xx, xy, rcond=None)[0]
        variance = max(yy - 2 * b @ xy + b @ xx @ b, 0.0) / whole[0, 0]
        return np.concatenate((b, [math.sqrt(variance) or 1.0]))

    def products(self, weights: Weighting | None = None) -> np.ndarray:
        if weights is None:
            return self._plain
        return self._products(self.exact, self.any_exact, weights)

    def sums(
        self, theta: np.ndarray, products: np.ndarray, weights: Weighting | None = None
    ) -> Sums:
        """``products`` comes from :meth:`products` with the same weighting."""
        theta = np.atleast_2d(np.asarray(theta, float))
        sample = weights.sample if weights else np.zeros(len(theta), int)
        known = exact_rows(products[sample], theta)
        if not self.any_censored:
            return known
        return known + censored_rows(
            self.censored, self.features, self.label, theta, self.limits, self.extra, weights
        )

    def expansion(self, centre: np.ndarray, weights: Weighting | None = None) -> Expansion | None:
        """None where there are few rows to expand, or it would take too many sums."""
        if not self._many or math.comb(len(self._reach) + Expansion.ORDER, Expansion.ORDER) > MOST_MOMENTS:
            return None
        return expand(
            self.censored, self.features, self.label, centre, self.limits, self._reach, self.extra, weights
        )

    def values(self, theta: np.ndarray, centre: np.ndarray, weights: Weighting | None = None) -> np.ndarray:
        """Log-likelihood of vectors around ``centre``; a scan serves those that are too far off."""
        products, near = self.products(weights), self.expansion(centre, weights)
        sample = weights.sample if weights else np.zeros(len(theta), int)
        if near is None:
            return self.sums(theta, products, weights).value
        known = exact_rows(products[sample], theta)
        value = known.value + near.sums(theta, sample).value
        left_out = FIFTH_DERIVATIVE / 120 * near.rows[sample] * near.distance(theta) ** 5
        far = np.flatnonzero(~(left_out <= CLOSE * (1 + np.abs(value))) | ~np.isfinite(value))
        if len(far):
            part = Weighting(weights.weigh, sample[far]) if weights else None
            value[far] = self.sums(theta[far], products, part).value
        return value

    def fit(
        self,
        settings: Sequence[tuple[float, float]],
        start: np.ndarray | None = None,
        weights: Weighting | None = None,
        fixed_sigma: bool = False,
        max_iter: int = 100,
        tol: float = 1e-9,
        centre: np.ndarray | None = None,
    ) -> list[TobitFit]:
        """Fit all (C, alpha) settings together; ``centre`` is a parameter vector near the optima, if one is known."""
        start = self.start() if start is None else np.asarray(start, float)
        theta0 = np.broadcast_to(start, (len(settings), len(self.features) + 2)).copy()
        c = np.array([s[0] for s in settings], float)
        alpha = np.array([s[1] for s in settings], float)
        products = self.products(weights)

        def evaluate(theta: np.ndarray, ids: np.ndarray) -> Sums:
            part = Weighting(weights.weigh, weights.sample[ids]) if weights else None
            return self.sums(theta, products, part)

        near = self.expansion(centre, weights) if centre is not None else None
        if near is None:
            theta, objective, scans = maximise(evaluate, theta0, c, alpha, fixed_sigma, max_iter, tol)
        else:
            sample = weights.sample if weights else np.zeros(len(settings), int)

            def climb(theta: np.ndarray, ids: np.ndarray) -> Sums:
                return exact_rows(products[sample[ids]], theta) + near.sums(theta, sample[ids])

            theta, objective, scans = maximise(climb, theta0, c, alpha, fixed_sigma, max_iter, TINY)
            scans[:] = 1
            bent = _convex(-climb(theta, np.arange(len(theta))).hessian)
            bent += (c * (1 - alpha))[:, None, None] * np.eye(theta.shape[1])
            far = np.flatnonzero(~(near.error(theta, sample, bent) <= CLOSE))
            if len(far):
                begin = np.where((near.distance(theta[far]) <= FARTHEST)[:, None], theta[far], theta0[far])
                theta[far], objective[far], more = maximise(
                    lambda t, ids: evaluate(t, far[ids]), begin, c[far], alpha[far], fixed_sigma, max_iter, tol
                )
                scans[far] += more
        cost = penalty(theta, c * alpha, c * (1 - alpha))
        return [
            TobitFit(
                float(c[k]), float(alpha[k]), float(t[0]), t[1:-1].copy(), float(t[-1]),
                float(cost[k] - objective[k]), float(objective[k]), int(scans[k]),
            )
            for k, t in enumerate(theta)
        ]


def _outside(more: np.ndarray, folds: np.ndarray) -> np.ndarray:
    return (more[:, :1] != folds).astype(float)


def _inside(more: np.ndarray, folds: np.ndarray) -> np.ndarray:
    return (more[:, :1] == folds).astype(float)


def held_out_loglik(rows: TobitRows, fits: Sequence[TobitFit], fold: np.ndarray) -> np.ndarray:
    """Log-likelihood of each fit on the fold it was not trained on."""
    held = Weighting(_inside, fold)
    theta = np.array([f.theta for f in fits])
    return rows.sums(theta, rows.products(held), held).value


def tobit_grid(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    limits: Censoring,
    settings: Sequence[tuple[float, float]],
    fold: Column | None = None,
    folds: int = 5,
) -> list[tuple[TobitFit, float | None]]:
    """Every setting fitted on all rows, with its mean held-out log-likelihood.

    Without ``fold`` the second value is None. All settings of all folds share
    each scan.
    """
    extra = {"_fold": fold} if fold is not None else None
    with TobitRows(df, features, label, limits, extra) as rows:
        # one vector is cheap to scan for, so all start at the unpenalised fit
        centre = rows.fit([(0.0, 1.0)])[0].theta
        fits = rows.fit(settings, centre, centre=centre)
        if fold is None:
            return [(f, None) for f in fits]
        held = np.tile(np.arange(folds), len(settings))
        start = np.repeat([f.theta for f in fits], folds, axis=0)
        repeated = [s for s in settings for _ in range(folds)]
        parts = rows.fit(repeated, start, Weighting(_outside, held), centre=centre)
        theta = np.array([f.theta for f in parts])
        scores = rows.values(theta, centre, Weighting(_inside, held)).reshape(len(settings), folds)
        return [(f, float(m)) for f, m in zip(fits, scores.mean(axis=1))]


def kfold_best(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    limits: Censoring,
    fold: Column,
    folds: int = 10,
    setting: tuple[float, float] = (0.0, 1.0),
) -> tuple[list[float], TobitFit]:
    """Held-out log-likelihood of each fold's model, and the best of them."""
    held = np.arange(folds)
    with TobitRows(df, features, label, limits, {"_fold": fold}) as rows:
        fits = rows.fit([setting] * folds, None, Weighting(_outside, held))
        scores = held_out_loglik(rows, fits, held)
        return list(map(float, scores)), fits[int(np.argmax(scores))]


def poisson_counts(row_bits: np.ndarray, replicates: np.ndarray, seed: int) -> np.ndarray:
    """Poisson(1) draws fixed by (row, replicate, seed): [rows, replicates]."""
    with np.errstate(over="ignore"):
        key = replicates.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        h = row_bits.astype(np.uint64)[:, None] * np.uint64(0xD1342543DE82EF95) + key[None, :]
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    counts = _COUNTS[h >> np.uint64(48)]
    left = np.nonzero(counts == _UNDECIDED)
    counts[left] = np.searchsorted(_BOUNDS, h[left], side="right")
    return counts.astype(float)


def bootstrap(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    limits: Censoring,
    keys: Sequence[str],
    replicates: int = 1000,
    setting: tuple[float, float] = (49.8, 1.0),
    seed: int = 77,
    batch: int = 250,
) -> list[TobitFit]:
    """Refits on Poisson(1) row weights; replicates of a batch share each scan.

    The weights come from a hash of the row's key and the replicate, so they do
    not depend on the partitioning. Every replicate starts at the full fit.
    """
    bits = hash_fraction(*[F.col(k) for k in keys], seed=seed, method="xxhash64")
    extra = {"_bits": bits * F.lit(float(1 << 52))}

    def draw(more: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        return poisson_counts(more[:, 0], numbers + first, seed)

    out: list[TobitFit] = []
    with TobitRows(df, features, label, limits, extra) as rows:
        start = rows.fit([setting])[0].theta
        for first in range(0, replicates, batch):
            size = min(batch, replicates - first)
            out += rows.fit([setting] * size, start, Weighting(draw, np.arange(size)), centre=start)
    return out


@dataclass(frozen=True)
class Replicate:
    """A refit, and how it does on the rows as they are."""

    fit: TobitFit
    pseudo_r2: float
    rmse: float
    loglik: float


def fit_quality(rows: TobitRows, fits: Sequence[TobitFit], centre: np.ndarray) -> list[Replicate]:
    """Pseudo R2 and RMSE of each fit, from the cross products of all rows, and their log-likelihood."""
    whole = rows.whole_products()
    n, theta = whole[0, 0], np.array([f.theta for f in fits])
    b = theta[:, :-1]
    xx, xy, yy = whole[:-1, :-1], whole[:-1, -1], whole[-1, -1]
    fitted, both, squares = b @ xx[0], b @ xy, np.einsum("ki,ij,kj->k", b, xx, b)
    mse = np.maximum(yy - 2 * both + squares, 0) / n
    covariance, spread = both / n - fitted / n * xy[0] / n, squares / n - (fitted / n) ** 2
    of_label = yy / n - (xy[0] / n) ** 2
    with np.errstate(invalid="ignore", divide="ignore"):
        pseudo = np.where((spread > 0) & (of_label > 0), covariance**2 / (spread * of_label), np.nan)
    loglik = rows.values(theta, centre)
    return [Replicate(*r) for r in zip(fits, map(float, pseudo), map(float, np.sqrt(mse)), map(float, loglik))]


def stratified_bootstrap(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    limits: Censoring,
    keys: Sequence[str],
    stratum: Column | None = None,
    replicates: int = 1000,
    setting: tuple[float, float] = (49.8, 1.0),
    seed: int = 77,
    batch: int = 250,
) -> list[Replicate]:
    """Refits on resamples with replacement in which each stratum (by default each label) has its number of rows.

    Fixed by seed whatever the partitioning; rows with a missing value take no part.
    """
    narrow = df.select(*dict.fromkeys([*keys, *features, label]), *([] if stratum is None else [stratum.alias("_by")]))
    kept = narrow.na.drop(subset=[*features, label])
    by = F.col("_by" if stratum is not None else label)
    places, draw = stratified_places(kept, by, keys, seed)
    extra = {c: F.col(c) for c in ("_stratum", "_bucket", "_place")}
    fits: list[TobitFit] = []
    with TobitRows(places, features, label, limits, extra, spread=not draw.in_runs()) as rows:
        start = rows.fit([setting])[0].theta
        for first in range(0, replicates, batch):
            size = min(batch, replicates - first)

            def weigh(more: np.ndarray, numbers: np.ndarray, first: int = first, held: dict = {}) -> np.ndarray:  # noqa: B006
                return draw.weigh(more, numbers + first, held)

            fits += rows.fit([setting] * size, start, Weighting(weigh, np.arange(size)), centre=start)
        return fit_quality(rows, fits, start)


def row_loglik(prediction: Column, label: Column, sigma: float, limits: Censoring) -> Column:
    """Log-likelihood of each row, given its linear prediction."""

    @F.pandas_udf(T.DoubleType())
    def loglik(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for xb, y in batches:
            z = ((y - xb) / sigma).to_numpy(float)
            out = -0.5 * z * z - math.log(max(sigma, SMALLEST_SIGMA)) - LOG_SQRT_2PI
            left, right = (y <= limits.left).to_numpy(), (y >= limits.right).to_numpy()
            out[left] = log_ndtr(z[left])
            out[right] = log_ndtr(-z[right])
            yield pd.Series(out)

    return loglik(prediction.cast("double"), label.cast("double"))


def censor_class(label: Column, limits: Censoring) -> Column:
    def bound(value: float) -> Column:
        return F.lit(float(value))

    return (
        F.when(label <= bound(limits.left), "left")
        .when(label >= bound(limits.right), "right")
        .otherwise("middle")
    )


def aic(loglik: float, parameters: int) -> float:
    return 2 * parameters - 2 * loglik


def _param(name: str, doc: str, convert) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=convert)


class TobitRegression(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    features = _param("features", "feature columns", TypeConverters.toListString)
    labelCol = _param("labelCol", "label column", TypeConverters.toString)
    censorLeft = _param("censorLeft", "labels at or below are censored", TypeConverters.toFloat)
    censorRight = _param("censorRight", "labels at or above are censored", TypeConverters.toFloat)
    C = _param("C", "penalty weight", TypeConverters.toFloat)
    alpha = _param("alpha", "share of the L1 part", TypeConverters.toFloat)
    fixedSigma = _param("fixedSigma", "keep the starting deviation", TypeConverters.toBoolean)
    maxIter = _param("maxIter", "most scans", TypeConverters.toInt)

    def __init__(self, **values) -> None:
        super().__init__()
        self._setDefault(
            labelCol="label", censorLeft=-math.inf, censorRight=math.inf, C=0.0, alpha=1.0,
            fixedSigma=False, maxIter=100,
        )
        self._set(**values)

    def _fit(self, df: DataFrame) -> TobitModel:
        get = self.getOrDefault
        limits = Censoring(get("censorLeft"), get("censorRight"))
        with TobitRows(df, get("features"), get("labelCol"), limits) as rows:
            fit = rows.fit(
                [(get("C"), get("alpha"))], fixed_sigma=get("fixedSigma"), max_iter=get("maxIter")
            )[0]
        return TobitModel(
            features=get("features"), labelCol=get("labelCol"), censorLeft=limits.left,
            censorRight=limits.right, coefficients=list(map(float, fit.coef)),
            intercept=fit.intercept, sigma=fit.sigma, loglik=fit.loglik, C=fit.c, alpha=fit.alpha,
        )


class TobitModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    features = _param("features", "feature columns", TypeConverters.toListString)
    labelCol = _param("labelCol", "label column", TypeConverters.toString)
    predictionCol = _param("predictionCol", "output", TypeConverters.toString)
    censorLeft = _param("censorLeft", "left limit", TypeConverters.toFloat)
    censorRight = _param("censorRight", "right limit", TypeConverters.toFloat)
    coefficients = _param("coefficients", "weights", TypeConverters.toListFloat)
    intercept = _param("intercept", "intercept", TypeConverters.toFloat)
    sigma = _param("sigma", "deviation", TypeConverters.toFloat)
    loglik = _param("loglik", "log-likelihood of the fit", TypeConverters.toFloat)
    C = _param("C", "penalty weight", TypeConverters.toFloat)
    alpha = _param("alpha", "share of the L1 part", TypeConverters.toFloat)

    def __init__(self, **values) -> None:
        super().__init__()
        self._setDefault(predictionCol="prediction")
        self._set(**values)

    @property
    def limits(self) -> Censoring:
        return Censoring(self.getOrDefault("censorLeft"), self.getOrDefault("censorRight"))

    def predicted(self) -> Column:
        weights = dict(zip(self.getOrDefault("features"), self.getOrDefault("coefficients")))
        return linear_prediction(weights, self.getOrDefault("intercept"))

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOrDefault("predictionCol"), self.predicted())

    def with_row_loglik(self, df: DataFrame, output: str = "loglik") -> DataFrame:
        label = F.col(self.getOrDefault("labelCol"))
        column = row_loglik(self.predicted(), label, self.getOrDefault("sigma"), self.limits)
        return df.withColumn(output, column)

    def score(self, df: DataFrame, compat: bool = False) -> float:
        """Log-likelihood of the rows. ``compat`` leaves the intercept out and
        subtracts the penalty, as the study's score does."""
        get = self.getOrDefault
        coef = get("coefficients")
        theta = np.array([0.0 if compat else get("intercept"), *coef, get("sigma")])
        with TobitRows(df, get("features"), get("labelCol"), self.limits) as rows:
            value = float(rows.sums(theta, rows.products()).value[0])
        if compat:
            c, a = np.array(get("C")), get("alpha")
            value -= float(penalty(theta[1:], c * a, c * (1 - a)))
        return value
