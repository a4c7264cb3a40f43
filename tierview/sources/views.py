"""The persisted unified view: create, re-point, drop, look at."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierview.functions import sqltext
from tierview.functions.boundaries import Boundary, parse_boundary
from tierview.operators.unify import unified_sql
from tierview.plans.mapping import MappingPlan
from tierview.sources import catalog

CHECK_SCHEMA = "check string, ok boolean, detail string"


class ViewError(RuntimeError):
    """A view is missing, or something else has its name."""


def create_view(
    spark: SparkSession, view: str, plan: MappingPlan, boundary: Boundary, hot_table: str, cold_table: str
) -> None:
    """Create the unified view; an existing view is left as it is."""
    query = unified_sql(plan, boundary, hot_table, cold_table)
    spark.sql(
        f"CREATE VIEW IF NOT EXISTS {sqltext.table_ref(view)} "
        f"TBLPROPERTIES ({sqltext.string(catalog.MANAGED)} 'true') AS {query}"
    )


def alter_view(
    spark: SparkSession, view: str, plan: MappingPlan, boundary: Boundary, hot_table: str, cold_table: str
) -> bool:
    """Replace the view's query in one catalog change, so readers see the old one or the new one.

    Returns False, changing nothing, when the view says the same already.
    """
    query = unified_sql(plan, boundary, hot_table, cold_table)
    if view_text(spark, view) == query:
        return False
    spark.sql(f"ALTER VIEW {sqltext.table_ref(view)} AS {query}")
    return True


def drop_view(spark: SparkSession, view: str) -> None:
    """Drop a view if it is there; a table of that name is an error, not a victim."""
    kind = object_kind(spark, view)
    if kind == catalog.TABLE:
        raise ViewError(f"{view} is a table, not a view")
    if kind == catalog.VIEW:
        spark.sql(f"DROP VIEW IF EXISTS {sqltext.table_ref(view)}")


def object_kind(spark: SparkSession, name: str) -> str | None:
    """TABLE, VIEW or None."""
    if not spark.catalog.tableExists(sqltext.table_ref(name)):
        return None
    return catalog.VIEW if catalog.describe(spark, name).get("type") == "VIEW" else catalog.TABLE


def view_text(spark: SparkSession, view: str) -> str:
    if object_kind(spark, view) != catalog.VIEW:
        raise ViewError(f"view {view} does not exist")
    return catalog.describe(spark, view)["view_text"]


def view_boundary(spark: SparkSession, view: str) -> Boundary:
    """The boundary a unified view is cut at, read from its own text."""
    mark = re.search(r"/\* boundary (\w+) (.+?) \*/", view_text(spark, view))
    if mark is None:
        raise ViewError(f"{view} is not a unified view")
    return parse_boundary(mark.group(2), mark.group(1))


def has_rows(spark: SparkSession, table: str) -> bool:
    return not spark.table(sqltext.table_ref(table)).isEmpty()


def count_at_least(df: DataFrame, rows: int) -> bool:
    return at_least(df, rows).first()[0]


def at_least(df: DataFrame, rows: int) -> DataFrame:
    """One row, ``enough``: whether there are that many rows. A count per task, then their sum."""
    return df.agg((F.count("*") >= rows).alias("enough"))


def check_view(
    spark: SparkSession,
    view: str,
    boundary: Boundary | None = None,
    contains: Iterable[str] = (),
    columns: Iterable[str] = (),
    min_rows: int = 0,
) -> DataFrame:
    """One row per check: the view exists, is cut at ``boundary``, says, has, answers and counts."""
    exists = object_kind(spark, view) == catalog.VIEW
    results = [("exists", exists, view)]
    if exists:
        text = view_text(spark, view)
        if boundary is not None:
            found = view_boundary(spark, view)
            results.append(("boundary", found == boundary, found.text))
        results += [("contains", part in text, part) for part in contains]
        try:
            df = spark.table(sqltext.table_ref(view))
            results += [("column", c in df.columns, c) for c in columns]
            df.take(1)
            results.append(("selectable", True, None))
            if min_rows:
                results.append(("min_rows", count_at_least(df, min_rows), str(min_rows)))
        except Exception as error:  # noqa: BLE001 - any failure to answer is the finding
            results.append(("selectable", False, sqltext.error_text(error)))
    return spark.createDataFrame(results, CHECK_SCHEMA)
