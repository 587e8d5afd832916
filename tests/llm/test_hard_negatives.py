"""Hard negatives against all pairs, on odd rows and in small blocks."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from perdura.llm import hard_negatives
from perdura.llm.hard_negatives import mine_hard_negatives

KIND = "vec_id long, label int, embedding array<double>"


def brute(rows, k=5, percent=80):
    usable = sorted({
        (i, label, tuple(math.floor(256 * x) for x in v)) for i, label, v in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    })
    out = []
    for a in usable:
        if a[0] % 10:
            continue
        scored = [(-sum(x * y for x, y in zip(a[2], b[2])), b[0], b) for b in usable if b != a and len(b[2]) == len(a[2])]
        scored.sort(key=lambda s: s[:2])
        for down, i, _ in [s for s in scored if s[2][1] == a[1]][:k]:
            found = [s for s in scored if s[2][1] != a[1] and percent * -down <= 100 * -s[0] <= 100 * -down][:k]
            out += [(a[0], i, n + 1, s[1], -down, -s[0]) for n, s in enumerate(found)]
    return sorted(out)


def mined(spark, rows, **more):
    frame = spark.createDataFrame(rows, KIND).withColumn("uid", F.lit("mine")).withColumn("cluster", F.lit(-1))
    return sorted(map(tuple, mine_hard_negatives(frame, F.expr("vec_id % 10 = 0"), **more).collect()))


def cloud(rng, n, size=8, centres=4):
    middle = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(centres)]
    return [
        (i, rng.randrange(3), [m + rng.gauss(0, 0.3) for m in rng.choice(middle)]) for i in range(n)
    ]


def test_against_all_pairs_with_odd_rows(spark):
    rng = random.Random(4)
    rows = cloud(rng, 300)
    copy = rows[20][2]
    rows += [(i, rng.randrange(3), copy) for i in range(300, 340)]  # ties
    rows += [rows[0], rows[10], rows[11]]  # repeated rows
    rows += [(400, 1, [0.0] * 8), (410, 1, []), (411, 1, []), (420, 0, [1.0, 2.0]), (421, 0, [1.0, 1.0]), (422, 1, [0.9, 1.0])]
    rows += [(None, 1, copy), (430, None, copy), (440, 1, None), (450, 1, [None] * 8), (460, 1, [math.nan] * 8), (470, 1, [math.inf] * 8)]
    rows += [(480, 1, [-x for x in copy]), (490, 7, [1e5] * 8), (491, 7, [-1e5] * 8), (492, 8, [9e4] * 8)]
    assert mined(spark, rows) == brute(rows)


@pytest.mark.parametrize("size", [4, 64])
def test_small_blocks_lists_and_steps(spark, monkeypatch, size):
    for name, value in (("BLOCK_BYTES", 1500), ("SHARD_BYTES", 6000), ("STEP", 16), ("SAMPLE_BYTES", 4000)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = cloud(random.Random(size), 400, size)
    assert mined(spark, rows) == brute(rows)


def test_two_rows_under_one_id_are_both_candidates(spark):
    rows = [(10, 1, [1.0, 0.0]), (3, 1, [2.0, 0.0]), (3, 2, [1.9, 0.0]), (3, 2, [1.8, 0.0]), (4, 2, [1.0, 5.0])]
    want = [(10, 3, 1, 3, 131072, 256 * 486), (10, 3, 2, 3, 131072, 256 * 460)]
    assert mined(spark, rows) == want


def test_no_rows_no_anchor_no_positive(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1.0]), (2, 2, [1.0])]) == []
    assert mined(spark, [(10, 1, [1.0]), (2, 2, [1.0])]) == []


def test_large_components_stay_exact(spark):
    big = float(1 << 20)
    rows = [(10, 1, [big, 1 / 256, 3.0]), (1, 1, [big, 2.0, 1 / 256]), (2, 2, [big, 1.0, 0.0]), (3, 2, [big, 1.0, 1 / 256]), (4, 2, [1e300, 1.0, 1.0])]
    assert mined(spark, rows) == brute(rows[:4])
