"""Nodes of a physical plan before it runs, with the columns they carry."""

from __future__ import annotations


def _listed(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def nodes(df) -> list[tuple[str, list[str]]]:
    """(node name, output columns) of every node of the plan that Spark starts with."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        if plan.nodeName() == "AdaptiveSparkPlan":
            plan = plan.initialPlan()
        found.append((plan.nodeName().split(" ")[0], [a.name() for a in _listed(plan.output())]))
        todo += _listed(plan.children())
    return found


def moved_columns(df) -> set[str]:
    """Columns that an exchange or a sort carries."""
    return {c for name, out in nodes(df) if "Exchange" in name or name == "Sort" for c in out}
