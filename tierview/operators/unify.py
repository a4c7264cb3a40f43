"""The unified table: cold rows strictly before the boundary, hot rows from it onwards.

Both tiers are scan, filter, project, union: no shuffle, whatever the size. Rows with a NULL time are in
neither part, and duplicates are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierview.functions import sqltext
from tierview.functions.boundaries import Boundary, BoundaryError
from tierview.plans.mapping import MappingPlan


def hot_scan(hot: DataFrame, plan: MappingPlan) -> DataFrame:
    """The hot tier with the unified columns, all rows."""
    return hot.selectExpr(*plan.hot_exprs)


def cold_scan(cold: DataFrame, plan: MappingPlan, *more: str) -> DataFrame:
    """The cold tier converted to the unified columns, all rows; ``more`` are expressions to add."""
    staged = reduce(
        lambda df, step: df.withColumns({name: F.expr(expr) for name, expr in step}), plan.cold_steps, cold
    )
    return staged.selectExpr(*plan.cold_exprs, *more)


def hot_part(hot: DataFrame, plan: MappingPlan, boundary: Boundary, *more: str) -> DataFrame:
    """Hot rows at or after the boundary; ``more`` are further predicates on stored columns."""
    return hot_scan(_where(hot, plan.hot_time_filter(">=", boundary), *more), plan)


def cold_part(cold: DataFrame, plan: MappingPlan, boundary: Boundary, *more: str) -> DataFrame:
    """Cold rows strictly before the boundary; ``more`` are further predicates on stored columns."""
    return cold_scan(_where(cold, plan.cold_time_filter("<", boundary), *more), plan)


def _where(df: DataFrame, *predicates: str) -> DataFrame:
    return reduce(lambda kept, p: kept.where(p), predicates, df)


def union_all(cold: DataFrame, hot: DataFrame, plan: MappingPlan) -> DataFrame:
    """Both tiers whole, in unified columns; rows present in both appear twice."""
    return cold_scan(cold, plan).union(hot_scan(hot, plan))


def unify(hot: DataFrame, cold: DataFrame, plan: MappingPlan, boundary: Boundary) -> DataFrame:
    return cold_part(cold, plan, boundary).union(hot_part(hot, plan, boundary))


def read_range(
    hot: DataFrame,
    cold: DataFrame,
    plan: MappingPlan,
    boundary: Boundary,
    start: Boundary | None = None,
    end: Boundary | None = None,
) -> DataFrame:
    """Unified rows with ``start <= time < end``, reading only the tiers the range can touch.

    A plain filter on the unified table gives the same rows, but the optimizer keeps scanning a tier
    whose two time predicates contradict each other; and it cannot prune partitions by time. Limits of
    another kind than the boundary are an error.
    """
    for limit in (start, end):
        if limit is not None and limit.kind != boundary.kind:
            raise BoundaryError(f"limit {limit.text} is {limit.kind}, the boundary is {boundary.kind}")

    def within(time_filter) -> list[str]:
        lower = [time_filter(">=", start)] if start else []
        return lower + ([time_filter("<", end)] if end else [])

    parts = []
    if start is None or start < boundary:
        parts.append(cold_part(cold, plan, boundary, *within(plan.cold_time_filter)))
    if end is None or end > boundary:
        parts.append(hot_part(hot, plan, boundary, *within(plan.hot_time_filter)))
    # start <= boundary <= end leaves at least one tier unless the range itself is empty.
    if not parts:
        parts = [hot_part(hot, plan, boundary, *within(plan.hot_time_filter))]
    return reduce(DataFrame.union, parts)


def unified_sql(plan: MappingPlan, boundary: Boundary, hot_table: str, cold_table: str) -> str:
    """The query text of :func:`unify` over two table names; the boundary is a constant in it.

    The leading comment makes the text say its own boundary (:func:`tierview.sources.views.view_boundary`).
    """
    source = sqltext.table_ref(cold_table)
    where = plan.cold_time_filter("<", boundary)
    for step in plan.cold_steps:
        helpers = ", ".join(f"{expr} AS {sqltext.ident(name)}" for name, expr in step)
        source = f"(SELECT *, {helpers} FROM {source})"
    mark = f"/* boundary {boundary.kind} {boundary.text} */"
    return (
        f"SELECT {mark}\n  {_listed(plan.cold_exprs)}\nFROM {source}\nWHERE {where}\n"
        f"UNION ALL\n"
        f"SELECT\n  {_listed(plan.hot_exprs)}\nFROM {sqltext.table_ref(hot_table)}\n"
        f"WHERE {plan.hot_time_filter('>=', boundary)}"
    )


def _listed(exprs: list[str]) -> str:
    return ",\n  ".join(exprs)
