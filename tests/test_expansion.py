"""Fits on an expansion of the likelihood against fits by scans; draws against their plain form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from perdura.functions.probability import FIFTH_DERIVATIVE, log_ndtr, log_ndtr_derivatives
from perdura.operators import resampling, tobit

LIMITS = tobit.Censoring(-1.0, 2.0)
NAMES = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 2))
    y = np.clip(1 + x @ [0.7, -0.4] + rng.normal(size=6000), -1, 2)
    data = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id long, a double, b double, y double").repartition(3).cache()


def test_derivatives_follow_each_other():
    x = np.concatenate([np.linspace(-60, -24, 7201), np.linspace(-24, 12, 7201)])
    found = log_ndtr_derivatives(x)
    assert np.allclose(found[0], log_ndtr(x))
    for lower, upper in zip(found, found[1:]):
        slope = (lower[2:] - lower[:-2]) / (x[2:] - x[:-2])
        inner = np.abs(x[2:] - x[:-2] - 0.01) < 1e-9
        assert np.allclose(slope[inner], upper[1:-1][inner], atol=2e-5, rtol=2e-5)
    assert np.abs(np.diff(found[4][7202:]) / 0.005).max() < FIFTH_DERIVATIVE


def test_expansion_gives_the_sums_of_a_scan(rows):
    with tobit.TobitRows(rows, NAMES, "y", LIMITS, {"_fold": F.col("id") % 3}) as held:
        held._many = True
        centre = held.fit([(0.0, 1.0)])[0].theta
        sample = np.array([0, 1, 2, 2])
        weights = tobit.Weighting(tobit._outside, sample)
        theta = centre + np.linspace(0, 0.003, 4)[:, None] * np.array([1, -1, 1, 0.5])
        plain = tobit.censored_rows(held.censored, NAMES, "y", theta, LIMITS, held.extra, weights)
        near = held.expansion(centre, weights).sums(theta, sample)
    for found, want in zip((near.value, near.gradient, near.hessian), (plain.value, plain.gradient, plain.hessian)):
        assert np.allclose(found, want, rtol=1e-6, atol=1e-4)


def test_fits_far_and_near_are_those_of_scans(rows, monkeypatch):
    settings = [(0.0, 1.0), (3.0, 0.5), (900.0, 1.0), (1e5, 1.0)]
    fold = F.col("id") % 3
    want = tobit.tobit_grid(rows, NAMES, "y", LIMITS, settings, fold, 3)
    monkeypatch.setattr(tobit, "EXPAND_FROM", 0)
    scanned = []
    plain = tobit.censored_rows
    monkeypatch.setattr(tobit, "censored_rows", lambda df, f, y, theta, *more: scanned.append(len(theta)) or plain(df, f, y, theta, *more))
    for bound in (tobit.CLOSE, 1e-4):
        scanned.clear()
        monkeypatch.setattr(tobit, "CLOSE", bound)
        got = tobit.tobit_grid(rows, NAMES, "y", LIMITS, settings, fold, 3)
        for (g, score), (w, known) in zip(got, want):
            assert np.allclose(g.theta, w.theta, atol=1e-5) and score == pytest.approx(known, abs=1e-2)
    # what stays near the fit of all rows takes no scan; the far settings do
    assert 0 < max(scanned[5:]) < len(settings) * 3


def test_bootstrap_does_not_scan_for_each_step(rows, monkeypatch):
    want = tobit.bootstrap(rows, NAMES, "y", LIMITS, ["id"], 20, (0.0, 1.0))
    monkeypatch.setattr(tobit, "EXPAND_FROM", 0)
    monkeypatch.setattr(tobit, "CLOSE", 1e-2)
    scanned = []
    plain = tobit.censored_rows
    monkeypatch.setattr(tobit, "censored_rows", lambda df, f, y, theta, *more: scanned.append(len(theta)) or plain(df, f, y, theta, *more))
    got = tobit.bootstrap(rows, NAMES, "y", LIMITS, ["id"], 20, (0.0, 1.0))
    assert max(scanned) == 1  # the fit of all rows only
    assert np.allclose([f.theta for f in got], [f.theta for f in want], atol=1e-3)


def test_poisson_draws_are_those_of_all_bounds():
    bits, numbers = np.arange(3000.0) * 7919 * 2**20, np.arange(40)
    with np.errstate(over="ignore"):
        key = numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(77)
        h = bits.astype(np.uint64)[:, None] * np.uint64(0xD1342543DE82EF95) + key[None, :]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    want = sum((h >= bound).astype(int) for bound in tobit.POISSON_BOUNDS)
    assert (tobit.poisson_counts(bits, numbers, 77) == want).all()
    table = tobit._COUNTS != tobit._UNDECIDED
    for bound in tobit.POISSON_BOUNDS:
        assert not table[int(bound) >> 48] or int(bound) & ((1 << 48) - 1) == 0


def test_bucket_draws_do_not_depend_on_the_path():
    rng = np.random.default_rng(3)
    upto = np.zeros((2, 17), np.int64)
    upto[:, 1:] = rng.integers(0, 9, (2, 16)).cumsum(axis=1)
    draw, path = resampling.ExactDraw(upto, 77), {}
    total = 0
    for bucket in range(16):
        assert (draw.drawn(1, bucket, 0, path) == draw.drawn(1, bucket, 0)).all()
        total = total + draw.copies(1, bucket, 0, path).sum(axis=1) if upto[1, bucket + 1] > upto[1, bucket] else total
    assert (total == upto[1, -1]).all()
