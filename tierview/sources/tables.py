"""Changing hot tables: rename and rename back, partial rows, removing rows at one time."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierview.functions import sqltext
from tierview.functions.boundaries import Boundary
from tierview.sources import catalog


class TableError(RuntimeError):
    """A table operation would lose or hide rows, or did."""


def rename(spark: SparkSession, db: str, old: str, new: str, then: Callable[[], None] | None = None) -> None:
    """Rename a table and make sure it still has its rows.

    ``then`` is what must follow at once, so that no data is read while the old name means nothing.

    A renamed managed table has moved, and the catalog may go on listing its partitions at the old
    place, where they read as empty. So its partitions are recovered, and any table's are compared. An
    external table stays where it is and nothing is listed anew.
    """
    source, target = sqltext.table_ref(db, old), sqltext.table_ref(db, new)
    if spark.catalog.tableExists(target):
        raise TableError(f"cannot rename {db}.{old}: {db}.{new} exists")
    about = catalog.describe(spark, f"{db}.{old}")
    partitioned = bool(about.get("partition_columns"))
    before = _partition_names(spark, f"{db}.{old}") if partitioned else set()
    filled = not spark.table(source).isEmpty()
    # The new name is one within the table's catalog and must not name the catalog again.
    within = sqltext.table_ref(db.partition(".")[2] or db, new)
    spark.sql(f"ALTER TABLE {source} RENAME TO {within}")
    if partitioned:
        if about.get("type") != "EXTERNAL":
            spark.sql(f"ALTER TABLE {target} RECOVER PARTITIONS")
    if then is not None:
        then()
    if partitioned:
        lost = before - _partition_names(spark, f"{db}.{new}")
        if lost:
            raise TableError(f"{db}.{new}: partitions lost by the rename: {sorted(lost)}")
    spark.catalog.refreshTable(target)
    if filled and spark.table(target).isEmpty():
        raise TableError(f"{db}.{new} reads no rows after the rename")


def rename_back(spark: SparkSession, db: str, name: str, suffix: str) -> str:
    """Rename ``t<suffix>`` to ``t``; a name without the suffix is left alone. Returns the final name."""
    base = name.removesuffix(suffix)
    if base != name:
        rename(spark, db, name, base)
    return base


def _partition_names(spark: SparkSession, table: str) -> set[str]:
    return {r.partition for r in catalog.partitions(spark, table).collect()}


def truncate(spark: SparkSession, table: str) -> None:
    spark.sql(f"TRUNCATE TABLE {sqltext.table_ref(table)}")


def _filler(field: T.StructField, required: bool) -> Column:
    default = (field.metadata or {}).get("CURRENT_DEFAULT", "").strip()
    if default:
        value = F.expr(default)
    elif required and isinstance(field.dataType, T.ArrayType):
        value = F.array()
    elif required and isinstance(field.dataType, T.VariantType):
        value = F.parse_json(F.lit(catalog.placeholder("json")))
    elif required:
        value = F.lit(catalog.placeholder(field.dataType.simpleString()))
    else:
        value = F.lit(None)
    return value.cast(field.dataType)


def complete_rows(
    rows: DataFrame, target: T.StructType, time_column: str, mode: str = "all", required: set[str] | None = None
) -> DataFrame:
    """Fill rows that give only some of the target's columns.

    Missing columns get their default, else NULL, else (when NULL is not allowed) the placeholder of
    their type. ``mode="required_only"`` returns only the given columns and those that an insert must
    name: the time column and columns without a default that may not be NULL. ``required`` names the
    latter where the schema does not say it.
    """
    if mode not in ("all", "required_only"):
        raise ValueError(f"mode {mode!r} is neither 'all' nor 'required_only'")
    if time_column not in rows.columns:
        raise ValueError(f"rows must give the time column {time_column}")
    unknown = [c for c in rows.columns if c not in target.names]
    if unknown:
        raise ValueError(f"the target has no columns {unknown}")
    if required is None:
        required = {f.name for f in target.fields if not f.nullable}
    picked = []
    for f in target.fields:
        if f.name in rows.columns:
            picked.append(sqltext.column(f.name).cast(f.dataType).alias(f.name))
        elif mode == "all" or (f.name in required and "CURRENT_DEFAULT" not in (f.metadata or {})):
            picked.append(_filler(f, f.name in required).alias(f.name))
    return rows.select(*picked)


def append_rows(
    spark: SparkSession,
    table: str,
    rows: DataFrame,
    time_column: str,
    mode: str = "all",
    required: set[str] | None = None,
) -> None:
    """Append partial rows to a table; columns left out are filled by the table itself."""
    full = complete_rows(rows, spark.table(sqltext.table_ref(table)).schema, time_column, mode, required)
    names = ", ".join(sqltext.ident(c) for c in full.columns)
    spark.sql(f"INSERT INTO {sqltext.table_ref(table)} ({names}) SELECT {names} FROM {{rows}}", rows=full)


def without_time(df: DataFrame, column: str, value: Boundary) -> DataFrame:
    """All rows but those at one time; rows without a time stay."""
    literal = F.expr(value.sql(df.schema[column].dataType))
    return df.where(~sqltext.column(column).eqNullSafe(literal))


def copy_without_time(spark: SparkSession, table: str, column: str, value: Boundary, into: str) -> None:
    """Write the rows of :func:`without_time` to a new table of the same format and partitioning.

    File tables have no row delete, and a table cannot be overwritten while it is being read. The new table has
    the properties of the old one. Where the table is partitioned, :func:`remove_time` writes less.
    """
    about = catalog.describe(spark, table)
    writer = without_time(spark.table(sqltext.table_ref(table)), column, value).write.format(about["provider"])
    by = about.get("partition_columns")
    (writer.partitionBy(*by) if by else writer).saveAsTable(sqltext.table_ref(into))
    carried = {k: v for k, v in catalog.properties(spark, table).items() if not k.startswith(("spark.", "transient_"))}
    if carried:
        listed = ", ".join(f"{sqltext.string(k)} = {sqltext.string(v)}" for k, v in sorted(carried.items()))
        spark.sql(f"ALTER TABLE {sqltext.table_ref(into)} SET TBLPROPERTIES ({listed})")


def remove_time(spark: SparkSession, table: str, column: str, value: Boundary, scratch: str) -> int:
    """Remove the rows at one time from a partitioned table in place; returns how many partitions were written.

    Only partitions that hold such a row are written anew: what they keep goes to the table ``scratch`` first
    (which must not exist, and is dropped at the end), since a table cannot be overwritten while it is being
    read. A partition that keeps nothing is dropped. If the run breaks off, ``scratch`` holds what is missing.
    """
    source, target = spark.table(sqltext.table_ref(table)), sqltext.table_ref(scratch)
    by = catalog.describe(spark, table).get("partition_columns")
    if not by:
        raise TableError(f"{table} is not partitioned, use copy_without_time")
    keys = [sqltext.column(c) for c in by]
    literal = F.expr(value.sql(source.schema[column].dataType))
    # One row for each partition that is concerned.
    hit = source.where(sqltext.column(column).eqNullSafe(literal)).select(*keys).distinct().collect()
    if not hit:
        return 0

    def held(row) -> Column:
        return reduce(Column.__and__, [key.eqNullSafe(F.lit(row[c])) for key, c in zip(keys, by)])

    kept = without_time(source.where(reduce(Column.__or__, map(held, hit))), column, value)
    kept.write.format("parquet").partitionBy(*by).saveAsTable(target)
    full = {tuple(row) for row in spark.table(target).select(*keys).distinct().collect()}
    names = ", ".join(map(sqltext.ident, source.columns))
    overwrite = spark.table(target).select(*source.columns)
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        parts = ", ".join(map(sqltext.ident, by))
        spark.sql(f"INSERT OVERWRITE {sqltext.table_ref(table)} PARTITION ({parts}) SELECT {names} FROM {{rows}}", rows=overwrite)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
    for row in hit:
        if tuple(row) not in full:
            where = ", ".join(f"{sqltext.ident(c)} = {sqltext.string(str(row[c])) if row[c] is not None else 'NULL'}" for c in by)
            spark.sql(f"ALTER TABLE {sqltext.table_ref(table)} DROP IF EXISTS PARTITION ({where})")
    spark.catalog.refreshTable(sqltext.table_ref(table))
    spark.sql(f"DROP TABLE {target}")
    return len(hit)


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*names)
