"""What has to be done to which table, as DataFrames over catalog listings.

Each plan is one aggregation by base name over the three kinds of facts (cold table, hot object, hot
object with the suffix): a single shuffle with partial aggregation, and no join.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierview.sources.catalog import TABLE, VIEW

# Actions of an init plan.
RENAME_AND_CREATE, CREATE, SKIP, CONFLICT = "rename_and_create", "create", "skip", "conflict"


def table_states(cold: DataFrame, hot: DataFrame, suffix: str, ignore: Iterable[str] = ()) -> DataFrame:
    """``base_table, suffixed_table, base_kind, suffixed_kind`` of the cold tables not ignored.

    ``cold``: column ``table``; ``hot``: ``table, kind``. A kind is NULL where there is no such object.
    """
    if not suffix.strip():
        raise ValueError("an empty suffix cannot tell hot tables from views")
    code = F.when(F.col("kind") == VIEW, 2).otherwise(1)
    nothing = F.lit(0)

    def fact(name, is_cold: bool, base, suffixed):
        return F.struct(
            name.alias("base_table"), F.lit(is_cold).alias("is_cold"), base.alias("base"), suffixed.alias("suffixed")
        )

    # A hot name is one thing as a base name and, where it ends so, another as a suffixed name.
    stripped = F.expr(f"substr(table, 1, length(table) - {len(suffix)})")
    roles = F.array(
        fact(F.col("table"), False, code, nothing),
        F.when(F.col("table").endswith(suffix), fact(stripped, False, nothing, code)),
    )
    facts = (
        cold.select(fact(F.col("table"), True, nothing, nothing).alias("f"))
        .union(hot.select(F.explode(roles).alias("f")).where("f IS NOT NULL"))
        .select("f.*")
    )
    ignored = list(ignore)
    if ignored:
        facts = facts.where(~F.col("base_table").isin(ignored))
    return (
        facts.groupBy("base_table")
        .agg(F.max("is_cold").alias("is_cold"), F.max("base").alias("base"), F.max("suffixed").alias("suffixed"))
        .where("is_cold")
        .select(
            "base_table",
            F.concat("base_table", F.lit(suffix)).alias("suffixed_table"),
            F.when(F.col("base") == 2, VIEW).when(F.col("base") == 1, TABLE).alias("base_kind"),
            F.when(F.col("suffixed") == 2, VIEW).when(F.col("suffixed") == 1, TABLE).alias("suffixed_kind"),
        )
    )


def plan_init(states: DataFrame) -> DataFrame:
    """``base_table, suffixed_table, action, reason``; tables without a hot side are not listed."""
    base, suffixed = F.col("base_kind"), F.col("suffixed_kind")
    action = (
        F.when(base == VIEW, SKIP)
        .when(base.isNotNull() & suffixed.isNotNull(), CONFLICT)
        .when(base.isNotNull(), RENAME_AND_CREATE)
        .when(suffixed.isNotNull(), CREATE)
    )
    reason = (
        F.when(F.col("action") == SKIP, "the view exists")
        .when(F.col("action") == CONFLICT, "both the table and its renamed form exist")
        .when(F.col("action") == RENAME_AND_CREATE, "the table still has its base name")
        .otherwise("the table is renamed, its view is missing")
    )
    return (
        states.withColumn("action", action)
        .where("action IS NOT NULL")
        .select("base_table", "suffixed_table", "action", reason.alias("reason"))
    )


def plan_rollback(states: DataFrame) -> DataFrame:
    """``base_table, suffixed_table, drop_view, rename, blocked, reason`` of the tables to restore.

    Listed are the tables whose renamed form exists: a view alone is somebody else's, a table under its
    base name is already restored, and derived cold columns are never stored.
    """
    base_is_view = F.coalesce(F.col("base_kind") == VIEW, F.lit(False))
    rename = F.col("suffixed_kind") == TABLE
    blocked = rename & F.coalesce(F.col("base_kind") != VIEW, F.lit(False))
    reason = (
        F.when(blocked, "the base name is taken by a table")
        .when(base_is_view & rename, "drop the view, rename back")
        .when(base_is_view, "drop the view; the suffixed name is not a table")
        .when(rename, "rename back")
        .otherwise("nothing to do")
    )
    return states.where("suffixed_kind IS NOT NULL").select(
        "base_table",
        "suffixed_table",
        base_is_view.alias("drop_view"),
        rename.alias("rename"),
        blocked.alias("blocked"),
        reason.alias("reason"),
    )
