"""The rank statistic against all pairs; its traffic against the number of rows; the report per setting."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from perdura.operators import logistic


def brute(score, y):
    if not len(y) or y.all() or not y.any():
        return float("nan")
    up, down = score[y == 1], np.sort(score[y == 0])
    return ((np.searchsorted(down, up, "left") + np.searchsorted(down, up, "right")) / 2).sum() / len(up) / len(down)


def frame(spark, x, y, fold, parts=3):
    pdf = pd.DataFrame(x, columns=[f"x{i}" for i in range(x.shape[1])]).assign(label=y.astype(float), fold=fold.astype(np.int64))
    return spark.createDataFrame(pdf).repartition(parts)


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(8)
    n = 6000
    x = np.c_[rng.normal(size=n), np.round(rng.normal(size=n), 1), rng.lognormal(0, 4, size=n)]
    y = (x[:, 0] + rng.normal(size=n) > 0).astype(int)
    fold = np.arange(n) % 5 % 3
    theta = np.array([[0, 1, 0, 0], [0, 0, 1, 0], [1, 0, 0, 1], [0, 1, 0.5, 0], [2, 0, 0, 0], [0, -1, 0, 1e-3]], dtype=float)
    held = np.array([0, 0, 1, 1, 2, 2])
    return x, y, fold, theta, held, frame(spark, x, y, fold).cache()


@pytest.mark.parametrize("outside", [False, True])
def test_equals_all_pairs(made, outside, monkeypatch):
    x, y, fold, theta, held, rows = made
    monkeypatch.setattr(logistic, "BATCH", 700)
    got, error = logistic.rank_statistic(rows, theta, held, outside, resolution=0)
    for t, h, auc in zip(theta, held, got):
        used = (fold != h) if outside else (fold == h)
        assert auc == pytest.approx(brute(t[0] + x[used] @ t[1:], y[used]), abs=1e-12)
    assert (error == 0).all()


def test_error_stays_under_the_bound_it_gives(made, monkeypatch):
    x, y, fold, theta, held, rows = made
    monkeypatch.setattr(logistic, "CELLS", 16)
    got, error = logistic.rank_statistic(rows, theta, held, resolution=0.02)
    assert 0 < error.max() <= 0.01
    for t, h, auc, e in zip(theta, held, got, error):
        assert abs(auc - brute(t[0] + x[fold == h] @ t[1:], y[fold == h])) <= e + 1e-12


def test_absent_class_and_no_rows(spark):
    x, y = np.arange(6.0)[:, None], np.array([1, 1, 1, 0, 1, 0])
    rows = frame(spark, x, y, np.array([0, 0, 0, 1, 1, 1]))
    got, _ = logistic.rank_statistic(rows, np.array([[0.0, 1.0]] * 3), np.array([0, 1, 2]))
    assert np.isnan(got[[0, 2]]).all() and got[1] == 0.5


def test_traffic_does_not_grow_with_the_rows(spark, monkeypatch):
    sizes = []
    frames = type(spark.range(0))
    plain = frames.toArrow
    monkeypatch.setattr(frames, "toArrow", lambda self: sizes.append((t := plain(self)).num_rows) or t)
    monkeypatch.setattr(logistic, "CELLS", 32)
    rng = np.random.default_rng(3)
    most = []
    for n in (2_000, 40_000):
        x = rng.normal(size=(n, 1))
        y = (x[:, 0] + rng.normal(size=n) > 0).astype(int)
        sizes.clear()
        got, _ = logistic.rank_statistic(frame(spark, x, y, np.zeros(n)), np.array([[0.0, 1.0]]), np.array([0]), resolution=1e-2)
        assert got[0] == pytest.approx(brute(x[:, 0], y), abs=0.005)
        most.append(max(sizes))
    assert max(most) <= 32 + 16  # a cell is cut into two parts at least


def test_report_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 2))
    y = (x @ [1.0, -0.5] + rng.normal(size=900) > 0.3).astype(int)
    test = np.arange(900) % 3 == 0
    rows = frame(spark, x, y, test)
    settings = [(0.05, 0.5, 50), (0.001, 1.0, 50), (1.0, 0.0, 50)]
    got = logistic.grid_report(rows, ["x0", "x1"], "label", settings, F.col("fold") == 1).collect()
    assert [(r["C"], r["l1_ratio"], r["max_iter"]) for r in got] == settings
    for r in got:
        z = r["intercept"] + x @ [r["x0"], r["x1"]]
        for side, used in (("train", ~test), ("test", test)):
            assert r[f"{side}_accuracy"] == pytest.approx(((z > 0) == (y == 1))[used].mean())
            assert r[f"{side}_log_loss"] == pytest.approx((np.logaddexp(0, z) - y * z)[used].mean())
            assert r[f"{side}_auc"] == pytest.approx(brute(z[used], y[used]), abs=1e-4)
    assert got[1]["x1"] == 0.0 and got[2]["test_auc"] > 0.7
