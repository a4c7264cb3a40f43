"""What each tier contributes and hides, what conversions lose, which names differ, how runs went."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierview.functions import sqltext
from tierview.functions.boundaries import Boundary
from tierview.operators.boundary import misplacement
from tierview.operators.unify import cold_scan
from tierview.plans.mapping import ColumnRule, MappingPlan
from tierview.plans.spec import PartitionRule
from tierview.sources import catalog

# Steps a job can fail at.
STEPS = ("precheck", "mapping", "rename", "create_view", "alter_view", "drop_view", "rename_back", "drop_cold")


def tier_audit(
    hot: DataFrame, cold: DataFrame, plan: MappingPlan, boundary: Boundary, moved_to: Boundary | None = None
) -> DataFrame:
    """One row per tier: rows, smallest and largest time, rows without a time, rows shown and hidden.

    ``shown_if_moved`` counts the rows shown with the boundary at ``moved_to`` (or where it is): hot rows
    that drop out there are lost to readers unless the cold tier holds them.
    """
    time = plan.spec.time_column
    now, then = plan.hot_literal(boundary), plan.hot_literal(moved_to or boundary)
    rule = plan.time_rule
    column = sqltext.ident(time)

    def summary(df: DataFrame, tier: str, op: str) -> DataFrame:
        return df.agg(
            F.count("*").alias("n_rows"),
            F.min(sqltext.column(time)).alias("min_time"),
            F.max(sqltext.column(time)).alias("max_time"),
            F.count_if(sqltext.column(time).isNull()).alias("null_times"),
            F.count_if(F.expr(f"{column} {op} {now}")).alias("shown"),
            F.count_if(F.expr(f"NOT ({column} {op} {now})")).alias("hidden"),
            F.count_if(F.expr(f"{column} {op} {then}")).alias("shown_if_moved"),
        ).select(F.lit(tier).alias("tier"), "*")

    # Only the time column is read from either tier.
    cold_times = cold.selectExpr(f"{rule.cold_expr} AS {column}")
    return summary(cold_times, "cold", "<").union(summary(hot.select(column), "hot", ">="))


def conversion_losses(cold: DataFrame, plan: MappingPlan) -> DataFrame:
    """Per served column its rule, ``lost`` and ``changed``.

    Lost are stored values that the conversion to the hot type made NULL; of an array, every element counts.
    Changed are numbers, times and native arrays of them that come out as another value: cast back, they are
    not what was stored (3.7 served as 3). Text and addresses have many spellings of one value and are not
    compared. One pass over the cold tier gives one row of counts.
    """
    stored = [f"{sqltext.ident(c.cold_column)} AS {_stored(n)}" for n, c in enumerate(plan.columns) if c.cold_column]
    row = cold_scan(cold, plan, *stored).agg(
        *[_lost(n, c).alias(f"c{n}") for n, c in enumerate(plan.columns)],
        *[_changed(n, c).alias(f"d{n}") for n, c in enumerate(plan.columns)],
    )
    lines = [
        F.struct(
            F.lit(n).alias("ordinal"),
            F.lit(c.name).alias("column"),
            F.lit(c.rule).alias("rule"),
            F.lit(c.cold_type).cast("string").alias("cold_type"),
            F.lit(c.hot_type.simpleString()).alias("hot_type"),
            F.col(f"c{n}").alias("lost"),
            F.col(f"d{n}").alias("changed"),
        )
        for n, c in enumerate(plan.columns)
    ]
    return row.select(F.explode(F.array(*lines)).alias("r")).select("r.*")


def _stored(ordinal: int) -> str:
    return f"__stored_{ordinal}"


def _lost(ordinal: int, rule: ColumnRule) -> Column:
    if rule.cold_column is None or rule.rule == "plain":
        return F.lit(0).cast("bigint")
    new, old = sqltext.column(rule.name), F.col(_stored(ordinal))
    if not isinstance(rule.hot_type, T.ArrayType):
        return F.count_if(new.isNull() & old.isNotNull())
    gone = _null_elements(new)
    if isinstance(rule.stored, T.ArrayType):
        gone = gone - _null_elements(old)
    return F.coalesce(F.sum(F.when(new.isNotNull(), gone).cast("bigint")), F.lit(0).cast("bigint"))


def _changed(ordinal: int, rule: ColumnRule) -> Column:
    if rule.cold_column is None or rule.rule != "cast" or isinstance(rule.stored, T.StringType):
        return F.lit(0).cast("bigint")
    new, old = sqltext.column(rule.name), F.col(_stored(ordinal))
    back = new.try_cast(rule.stored)
    return F.count_if(new.isNotNull() & old.isNotNull() & ~back.eqNullSafe(old))


def _null_elements(array: Column) -> Column:
    return F.size(array) - F.size(F.array_compact(array))


def partition_violations(df: DataFrame, time_column: str, rule: PartitionRule) -> DataFrame:
    """Rows whose partition is not the one their time belongs to; none if the rule may be relied on."""
    return df.where(misplacement(time_column, rule))


def name_diff(left: DataFrame, right: DataFrame, skip_suffix: str | None = None) -> DataFrame:
    """Names in only one of two lists (column ``name``), ignoring case: ``name, side``.

    Names ending with ``skip_suffix`` are left out of the right list. One aggregation instead of two
    anti joins: each list is read once and reduced before the shuffle.
    """
    if skip_suffix:
        right = right.where(~F.col("name").endswith(skip_suffix))
    both = left.select("name", F.lit(1).alias("side")).union(right.select("name", F.lit(2)))
    return (
        both.where("name IS NOT NULL AND name <> ''")
        .groupBy(F.lower("name").alias("name"))
        .agg(F.bit_or("side").alias("side"))
        .where("side < 3")
        .select("name", F.when(F.col("side") == 1, "left_only").otherwise("right_only").alias("side"))
    )


def run_summary(results: DataFrame) -> DataFrame:
    """Totals per pair and over all pairs (``(all)``, also of no results) of job results, with the failures of each step.

    ``results``: columns ``pair, status, step``; a row with status ``failed`` failed at its step, which is
    ``unknown`` where it is none of :data:`STEPS`.
    """
    failed = F.col("status") == "failed"
    counts = {"total": F.lit(True), "success": ~failed, "failed": failed}
    counts |= {f"failed_{s}": failed & (F.col("step") == s) for s in STEPS}
    counts["failed_unknown"] = failed & ~F.coalesce(F.col("step").isin(*STEPS), F.lit(False))
    # A row that counts nowhere, so that there is a total of no results.
    none = results.sparkSession.range(1).select(*(F.lit(None).cast("string").alias(c) for c in ("pair", "status", "step")))
    told = results.select("pair", "status", "step", F.lit(True).alias("real")).union(none.withColumn("real", F.lit(False)))
    summed = told.rollup("pair").agg(
        F.grouping_id().alias("__all"), *[F.count_if(F.col("real") & count).alias(name) for name, count in counts.items()]
    )
    named = F.when(F.col("__all") == 1, "(all)").otherwise(F.col("pair")).alias("pair")
    return summed.where("__all = 1 OR total > 0").select(named, *counts)


def probe(spark: SparkSession, readers: dict[str, Callable[[], DataFrame]], at_once: int = 16) -> DataFrame:
    """``tbl, status, error``: ask each table for one row; status is ``rows``, ``empty`` or ``error``.

    Each table is a job of its own, so that one that cannot be read does not spoil the others; and asked by
    ``take``, which starts with a single task where a limit inside a larger query would start them all. So
    small jobs leave a cluster idle: ``at_once`` of them are under way together.
    """

    def asked(item: tuple[str, Callable[[], DataFrame]]) -> tuple:
        name, read = item
        try:
            return name, "rows" if read().take(1) else "empty", None
        except Exception as error:  # noqa: BLE001 - any failure to answer is the finding
            return name, "error", sqltext.error_text(error)

    with ThreadPoolExecutor(at_once) as pool:
        results = list(pool.map(asked, sorted(readers.items())))
    return spark.createDataFrame(results, "tbl string, status string, error string")


def probe_tables(spark: SparkSession, db: str, skip_suffix: str | None = None) -> DataFrame:
    """:func:`probe` of the tables and views of a schema, without those ending with ``skip_suffix``."""
    names = [n for n in catalog.table_kinds(spark, db) if not (skip_suffix and n.endswith(skip_suffix))]
    return probe(spark, {n: partial(spark.table, sqltext.table_ref(db, n)) for n in names})


def probe_totals(probed: DataFrame) -> DataFrame:
    return probed.groupBy("status").agg(F.count("*").alias("tables"))
