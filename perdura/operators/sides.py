"""Stages of a join's two sides, run before the join.

A wide column (page text, header, comment) that only stateless stages read should not be
shuffled and sorted by the join. ``JoinSides`` keeps an inner join that has not been made;
``push_stages`` runs each leading stage on the side that holds all columns it reads, so
what reaches the join is narrow. Row filters move along: under an inner join on a key a
filter on one side's columns keeps the same rows before as after.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.ml import Transformer
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class JoinSides:
    """An inner equi-join on ``on``; no other column is on both sides."""

    left: DataFrame
    right: DataFrame
    on: str

    def joined(self) -> DataFrame:
        return self.left.join(self.right, self.on)

    def holder(self, columns: Sequence[str]) -> str | None:
        """The side that has all of these columns, the left one if both have."""
        for side in ("left", "right"):
            if set(columns) <= set(getattr(self, side).columns):
                return side
        return None


def push_stages(stages: Sequence[Transformer], sides: JoinSides) -> tuple[JoinSides, list[Transformer]]:
    """The sides after as many leading stages as they can take, and the stages left for the joined rows.

    A stage that works column by column runs on both sides. One that also selects columns
    runs there with the key kept, and once more on the joined rows, for its column order.
    """
    for i, stage in enumerate(stages):
        narrowed = stage.beside_key(sides.on)
        if narrowed is not None:
            sides = replace(sides, left=narrowed.transform(sides.left), right=narrowed.transform(sides.right))
            if stage.selects:
                return sides, list(stages[i:])
            continue
        side = sides.holder(stage.reads())
        if side is None:
            return sides, list(stages[i:])
        sides = replace(sides, **{side: stage.transform(getattr(sides, side))})
    return sides, []


def joined_features(stages: Sequence[Transformer], sides: JoinSides) -> DataFrame:
    """What the stages make of the joined rows, the join as narrow as they allow."""
    sides, rest = push_stages(stages, sides)
    rows = sides.joined()
    for stage in rest:
        rows = stage.transform(rows)
    return rows
