"""Names for helper columns beside those of a table."""

from __future__ import annotations

from collections.abc import Iterable


def unused(names: Iterable[str], wanted: str) -> str:
    """`wanted`, or it with underscores in front, so that no name in use equals it in any case."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted
