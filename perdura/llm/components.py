"""Connected components by alternating large-star and small-star rounds.

Each round is two grouped minima and two joins over the edge table; nothing is
gathered per component, so a component of any size is only a key with many rows,
which adaptive execution splits. The rounds end when every component is a star
around its least node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perdura.sources.staging import stage_table


def _flat(edges: DataFrame) -> bool:
    """Whether each upper end u has one lower end v, which is no upper end itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty()


def _star(sides: DataFrame, keep: str) -> DataFrame:
    """Link the other ends of each node u to the least node around it."""
    least = stage_table(
        sides.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("hub"), F.least("u", "m").alias("m")
        ),
        "least",
    )
    linked = sides.join(least, sides["u"] == least["hub"]).where(keep).select(
        F.col("v").alias("u"), F.col("m").alias("v")
    )
    if keep == "v > u":
        return linked
    return linked.unionByName(least.select(F.col("hub").alias("u"), F.col("m").alias("v")))


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every end of an edge; component is its least node.

    Ends are integers. Null ends and loops link nothing; repeated edges count once.
    No edges give no rows.
    """
    ends = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v")
    now = stage_table(
        ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    while not _flat(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stage_table(
            _star(both, "v > u").where("u <> v").distinct(), "large_star"
        )
        now = stage_table(
            _star(
                large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "v <= u"
            ).where("u <> v").distinct(),
            "small_star",
        )
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
