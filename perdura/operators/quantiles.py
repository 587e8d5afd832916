"""Exact order statistics and running totals without one big sorted group.

``percentile`` keeps every distinct value of a group in one buffer, and a window
without partitions sorts everything in one task. Here a rank is located by
counting: rows inside a value bracket fall into equal-width bins, the bin holding
the rank becomes the next bracket, and bins are exact counts combined before the
shuffle. Groups and brackets are tables, so there may be any number of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perdura.functions.dates import missing
from perdura.operators.caching import cached
from perdura.sources.staging import stage_table

MAX_BINS = 1024
COLLECT_ROWS = 50_000  # a bracket of no more rows has a bin for each value
INFINITE = float("inf")
FARTHEST = 1.7e308
ACCURACY = 10_000  # of a sketch: its ranks are off by a share of 1 / ACCURACY at most


def _bin_of(bins: int) -> Column:
    """Bin of ``v`` in its bracket; non-decreasing in ``v``, and not the same for both ends unless curved.

    Curved brackets have bins on a logarithmic scale, for values of many magnitudes.
    """
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    half = F.when(hi - lo == INFINITE, 0.5).otherwise(1.0)  # the width must stay finite

    def curve(x: Column) -> Column:
        return F.signum(x) * F.log1p(F.abs(x))

    curved = F.coalesce(F.try_divide(curve(v) - curve(lo), curve(hi) - curve(lo)), F.lit(0.0))
    straight = (v * half - lo * half) / (hi * half - lo * half)
    place = F.floor(F.when(F.col("curved"), curved).otherwise(straight) * bins).cast("double")
    return F.when(F.col("inside") <= COLLECT_ROWS, v).otherwise(place)


def rank_values(
    df: DataFrame,
    value: str,
    group: str | None,
    ranks_of: Callable[[Column], Sequence[Column]],
) -> DataFrame:
    """(g, n, k, x): per group its size and the exact value x at its k-th asked rank.

    ``ranks_of(n)`` lists 0-based ranks; those outside a group mean its first or last
    row. Null and NaN values do not count, infinite ones do. Values are taken as doubles.
    """
    key = F.col(group).cast("string") if group else F.lit("")
    v = F.col(value).cast("double")
    base = cached(df.filter(~missing(v)).select(key.alias("g"), v.alias("v")))
    try:
        finite = F.when(F.abs("v") < INFINITE, F.col("v"))
        sizes = base.groupBy("g").agg(
            F.count("v").alias("n"), F.min(finite).alias("lo"), F.max(finite).alias("hi"), F.count(finite).alias("inside"),
            F.count_if(F.col("v") == -INFINITE).alias("under"),
        )
        ranks = [F.greatest(F.lit(0), F.least(r, F.col("n") - 1)).cast("long") for r in ranks_of(F.col("n"))]
        rank = F.col("rank") - F.col("under")
        end = F.when(rank < 0, -INFINITE).when(rank >= F.col("inside"), INFINITE)
        state = stage_table(
            sizes.select("*", F.posexplode(F.array(*ranks)).alias("k", "rank")).select(
                "g", "n", "k", rank.alias("rank"), F.coalesce(end, "lo").alias("lo"), F.coalesce(end, "hi").alias("hi"),
                "inside", F.lit(False).alias("curved"),
            ),
            "ranks",
        )
        found = state.where("lo = hi")
        # each second pass at least has straight bins, which part the ends of a bracket
        while not (todo := state.where("lo < hi")).isEmpty():
            brackets = todo.select(F.col("g").alias("of"), "lo", "hi", "inside", "curved").distinct()
            running = Window.partitionBy("of", "lo", "hi").orderBy("bin")
            bins = (
                base.join(brackets, F.col("g").eqNullSafe(F.col("of")) & F.col("v").between(F.col("lo"), F.col("hi")))
                .groupBy("of", "lo", "hi", _bin_of(MAX_BINS).alias("bin"))
                .agg(F.count("*").alias("rows"), F.min("v").alias("low"), F.max("v").alias("high"))
                .withColumn("upto", F.sum("rows").over(running))
                .select("of", F.col("lo").alias("from"), F.col("hi").alias("to"), "rows", "low", "high", "upto")
            )
            holds = (
                F.col("g").eqNullSafe(F.col("of")) & (F.col("lo") == F.col("from")) & (F.col("hi") == F.col("to"))
                & (F.col("rank") >= F.col("upto") - F.col("rows")) & (F.col("rank") < F.col("upto"))
            )
            state = stage_table(
                todo.join(bins, holds).select(
                    "g", "n", "k", (F.col("rank") - F.col("upto") + F.col("rows")).alias("rank"),
                    F.col("low").alias("lo"), F.col("high").alias("hi"), F.col("rows").alias("inside"),
                    ((F.col("rows") * 8 > F.col("inside")) & ~F.col("curved")).alias("curved"),
                ),
                "ranks",
            )
            found = found.unionByName(state.where("lo = hi"))
        return found.select("g", "n", "k", F.col("lo").alias("x"))
    finally:
        base.unpersist()


def quantile_table(df: DataFrame, value: str, probs: Sequence[float], group: str | None = None) -> DataFrame:
    """(g, q): linear-interpolation quantiles per group, as ``percentile`` gives them."""
    spots = [lambda n, p=p: (n - 1) * F.lit(float(p)) for p in probs]
    ranks = rank_values(df, value, group, lambda n: [edge(s(n)) for s in spots for edge in (F.floor, F.ceil)])
    found = ranks.groupBy("g").agg(
        F.first("n").alias("n"), *[F.max(F.when(F.col("k") == i, F.col("x"))).alias(f"x{i}") for i in range(2 * len(probs))]
    )

    def between(i: int) -> Column:
        spot, low, high = spots[i](F.col("n")), F.col(f"x{2 * i}"), F.col(f"x{2 * i + 1}")
        return F.when(low == high, low).otherwise(low + (spot - F.floor(spot)) * (high - low))

    return found.select("g", F.array(*[between(i) for i in range(len(probs))]).alias("q"))


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], group: str | None = None
) -> dict[str | None, list[float]]:
    """``quantile_table`` on the driver, for groups known to be few."""
    return {r["g"]: list(r["q"]) for r in quantile_table(df, value, probs, group).collect()}


@dataclass
class _Rank:
    """A rank looked for in a column: it lies among the ``inside`` rows of [lo, hi], ``below`` rows lie under lo."""

    column: str
    rank: int
    lo: float
    hi: float
    below: int
    inside: int
    trial: tuple[float, float]
    missed: bool = False

    def settle(self, under: int, within: int, low: float | None, high: float | None) -> None:
        """Take what was counted for the trial: it holds the rank, or the rank lies beside it."""
        a, b = self.trial
        self.missed = not under <= self.rank < under + within
        if self.rank < under:
            self.hi, self.inside = math.nextafter(a, -INFINITE), under - self.below
        elif self.rank >= under + within:
            self.inside -= under + within - self.below
            self.lo, self.below = math.nextafter(b, INFINITE), under + within
        else:
            self.lo, self.hi, self.below, self.inside = low, high, under, within

    def narrow(self, a: float | None, b: float | None) -> None:
        """Try [a, b], or the lower half of the values where that is no narrower or the last trial missed."""
        a, b = max(self.lo, self.lo if a is None else a), min(self.hi, self.hi if b is None else b)
        if self.missed or a > b or (a, b) == (self.lo, self.hi):
            a, b = self.lo, max(self.lo, -FARTHEST) / 2 + min(self.hi, FARTHEST) / 2
        self.trial = (a, min(b, math.nextafter(self.hi, -INFINITE)))


def flat_quantiles(
    df: DataFrame, columns: dict[str, Column], probs: Sequence[float], accuracy: int = ACCURACY
) -> dict[str, list[float] | None]:
    """Linear-interpolation quantiles of several columns of the same rows, as ``percentile`` gives them.

    Wide scans only, all columns in each: a sketch brackets every rank, a count puts the bracket in
    its place, and where it holds COLLECT_ROWS rows at most the value at the rank is picked from
    it; a larger one is sketched again. Three scans do up to COLLECT_ROWS * accuracy / 4 rows. The
    sketch only guides: a bracket that misses is seen by its count. None for a column of no values;
    null and NaN do not count, infinite values do.
    """
    names = list(columns)
    values = df.select(*(F.when(~missing(c.cast("double")), c.cast("double")).alias(f"v{i}") for i, c in enumerate(columns.values())))
    slack = 2 / accuracy

    def around(v: Column, spots: Sequence[float]) -> Column:
        ends = [min(1.0, max(0.0, spot + side)) for spot in spots for side in (-slack, slack)]
        return F.percentile_approx(v, ends, accuracy)

    first = values.agg(*(
        c.alias(f"{kind}{i}") for i in range(len(names)) for v in [F.col(f"v{i}")]
        for kind, c in (("n", F.count(v)), ("lo", F.min(v)), ("hi", F.max(v)), ("q", around(v, probs)))
    )).first()
    ranks: dict[tuple[int, int], _Rank] = {}
    for i in range(len(names)):
        n = first[f"n{i}"]
        for j, p in enumerate(probs):
            for edge in (math.floor, math.ceil) if n else ():
                k = edge((n - 1) * p)
                r = ranks.setdefault((i, k), _Rank(f"v{i}", k, first[f"lo{i}"], first[f"hi{i}"], 0, n, (0.0, 0.0)))
                r.narrow(*first[f"q{i}"][2 * j : 2 * j + 2])
    while todo := [r for r in ranks.values() if r.lo < r.hi]:
        if tried := [r for r in todo if r.inside > COLLECT_ROWS]:
            # neighbouring ranks share their bracket
            trials = list(dict.fromkeys((r.column, *r.trial) for r in tried))
            counts = []
            for column, a, b in trials:
                v = F.col(column)
                held = F.when(v.between(a, b), v)
                counts += [F.count_if(v < a), F.count(held), F.min(held), F.max(held)]
            row = values.agg(*(c.alias(str(i)) for i, c in enumerate(counts))).first()
            for r in tried:
                i = 4 * trials.index((r.column, *r.trial))
                r.settle(*row[i : i + 4])
        wanted = [r for r in todo if r.lo < r.hi]
        picks = []
        for r in wanted:
            spot = (r.rank - r.below + 0.5) / r.inside
            inside = F.when(F.col(r.column).between(r.lo, r.hi), F.col(r.column))
            picks.append(_at_share(r.column, r.lo, r.hi, spot) if r.inside <= COLLECT_ROWS else around(inside, [spot]))
        row = values.agg(*(c.alias(str(i)) for i, c in enumerate(picks))).first() if picks else []
        for found, r in zip(row, wanted):
            if r.inside <= COLLECT_ROWS:
                r.lo = r.hi = found
            else:
                r.narrow(*found)

    def value(i: int, p: float) -> float:
        spot = (first[f"n{i}"] - 1) * p
        low, high = ranks[i, math.floor(spot)].lo, ranks[i, math.ceil(spot)].lo
        return low if low == high else low + (spot - math.floor(spot)) * (high - low)

    return {c: [value(i, p) for p in probs] if first[f"n{i}"] else None for i, c in enumerate(names)}


def _at_share(column: str, lo: float, hi: float, share: float) -> Column:
    """The least value of [lo, hi] with at least this share of its rows at or below; an entry per distinct value."""
    between = f"{column} BETWEEN CAST('{lo!r}' AS DOUBLE) AND CAST('{hi!r}' AS DOUBLE)"
    return F.expr(f"percentile_disc({share!r}D) WITHIN GROUP (ORDER BY CASE WHEN {between} THEN {column} END)")


def running_totals(
    df: DataFrame,
    order: str,
    sums: Sequence[str],
    descending: bool = False,
    rows_per_bin: int = 100_000,
) -> DataFrame:
    """Add ``cum_<c>``: totals up to and including each row in ``order``.

    ``order`` must be unique in ``df``. Rows are cut into value bins of about
    ``rows_per_bin``; each bin is summed on its own and shifted by the totals of
    earlier bins. A null comes first and NaN last, the other way round when
    descending, as Spark sorts them; each has a bin of its own.
    """
    def direction(name: str):
        return F.col(name).desc() if descending else F.col(name).asc()

    # several passes follow, so the rows are computed once
    df = stage_table(df, "running-totals")
    bins = max(1, math.ceil(df.count() / rows_per_bin))
    value = F.col(order).cast("double")
    finite = df.select(value.alias("x")).where(value.isNotNull() & ~F.isnan(value))
    cuts = finite.approxQuantile("x", [i / bins for i in range(1, bins)], 1 / (4 * bins)) if bins > 1 else []
    inner_cuts = sorted(set(cuts) - {float("-inf"), float("inf")}) or [0.0]  # any one cut will do
    splits = [float("-inf"), *inner_cuts, float("inf")]
    bucket = Bucketizer(splits=splits, inputCol="_x", outputCol="_bin", handleInvalid="keep")
    binned = bucket.transform(df.withColumn("_x", value)).withColumn(
        "_bin", F.when(F.col("_x").isNull(), -1.0).otherwise(F.col("_bin"))
    )
    # a row for each bin from here to the join
    before = Window.orderBy(direction("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    totals = binned.groupBy("_bin").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    offsets = totals.select(
        "_bin", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums]
    )
    inner = (
        Window.partitionBy("_bin")
        .orderBy(direction(order))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        binned.join(offsets, "_bin")
        .withColumns({f"cum_{c}": F.sum(c).over(inner) + F.col(f"_o_{c}") for c in sums})
        .select(*df.columns, *[f"cum_{c}" for c in sums])
    )
