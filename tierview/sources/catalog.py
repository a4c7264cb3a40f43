"""Reading the catalog: tables and their kinds, columns, partitions, views; registering cold sources."""

from __future__ import annotations

import json
import logging
import re
from collections.abc import Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierview.functions import sqltext
from tierview.functions.boundaries import PLACEHOLDERS
from tierview.plans.spec import ColdSource

log = logging.getLogger(__name__)

TABLE, VIEW = "TABLE", "VIEW"

#: Questions to the catalog that are under way together.
AT_ONCE = 16


class CatalogError(RuntimeError):
    """The catalog cannot say what must be known."""

# The property that marks a view as one of ours, and where a cold table came from.
MANAGED = "tierview.managed"
COLD = "tierview.cold"

LISTING_SCHEMA = "table string, kind string"
SURVEY_SCHEMA = (
    "tbl string, kind string, provider string, partition_columns array<string>, properties map<string,string>, "
    "columns array<struct<name:string,type:string,nullable:boolean,default:string>>, view_text string, error string"
)
COLUMN_SCHEMA = "tbl string, ordinal int, column string, type string, nullable boolean, default string"

# A single JDBC read is one task unless it is told how to split the table.
_JDBC_SPLIT = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")


def list_tables(spark: SparkSession, db: str) -> DataFrame:
    """``table, kind`` of a schema, from two listings and without looking at each table."""
    shown = spark.sql(f"SHOW TABLES IN {sqltext.table_ref(db)}").where("NOT isTemporary")
    names = shown.select(F.col("tableName").alias("table"))
    try:
        found = _views(spark, db)
    except AnalysisException:
        if "." not in db or db.startswith("spark_catalog."):
            raise
        # A catalog that has no views need not know the statement.
        return names.select("table", F.lit(TABLE).alias("kind"))
    return with_kinds(names, found.select(F.col("viewName").alias("table")))


def with_kinds(names: DataFrame, views: DataFrame) -> DataFrame:
    """``table, kind`` of a listing that holds tables and views alike, given the views among them.

    Both have a column ``table``. One aggregation: names listed only as views are left out.
    """
    marked = names.select("table", F.lit(1).alias("seen")).union(views.select("table", F.lit(2)))
    return (
        marked.groupBy("table")
        .agg(F.bit_or("seen").alias("seen"))
        .where("seen <> 2")
        .select("table", F.when(F.col("seen") == 3, VIEW).otherwise(TABLE).alias("kind"))
    )


def table_kinds(spark: SparkSession, db: str) -> dict[str, str]:
    return {r.table: r.kind for r in list_tables(spark, db).collect()}


def _views(spark: SparkSession, db: str) -> DataFrame:
    return spark.sql(f"SHOW VIEWS IN {sqltext.table_ref(db)}").where("NOT isTemporary")


def managed_views(spark: SparkSession, db: str) -> list[str]:
    """Views created by this library, by name; other people's views are not among them.

    A view that cannot be described is an error: it may be one of ours.
    """
    found = survey(spark, db, sorted(r.viewName for r in _views(spark, db).collect()))
    broken = [about for about in found if about.error]
    if broken:
        raise CatalogError("; ".join(f"{about.table}: {about.error}" for about in broken))
    return [about.table for about in found if MANAGED in about.properties]


def properties(spark: SparkSession, table: str) -> dict[str, str]:
    return {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {sqltext.table_ref(table)}").collect()}


def describe(spark: SparkSession, table: str) -> dict:
    """What the catalog knows of a table or view."""
    row = spark.sql(f"DESCRIBE TABLE EXTENDED {sqltext.table_ref(table)} AS JSON").first()
    return json.loads(row[0])


@dataclass(frozen=True)
class About:
    """What the catalog says of one table or view in one answer; only ``error`` where it cannot."""

    table: str
    kind: str | None = None
    provider: str | None = None
    partition_columns: tuple[str, ...] = ()
    properties: Mapping[str, str] = field(default_factory=dict)
    # Name, type, nullable, default, in order.
    columns: tuple[tuple[str, str, bool, str | None], ...] = ()
    view_text: str | None = None
    error: str | None = None


def survey(spark: SparkSession, db: str, names: Iterable[str] | None = None, at_once: int = AT_ONCE) -> list[About]:
    """Ask the catalog once for each table and view of a schema (or those named), ``at_once`` of them together.

    In the order of their names. One that cannot be described has its error, and does not keep the others from being
    told. Kinds, columns, properties and view texts are all in the one answer, so nothing is asked twice.
    """

    def asked(name: str) -> About:
        try:
            told = describe(spark, f"{db}.{name}")
            return About(
                name,
                VIEW if told.get("type") == "VIEW" else TABLE,
                told.get("provider"),
                tuple(told.get("partition_columns") or ()),
                dict(told.get("table_properties") or {}),
                tuple((c["name"], type_text(c["type"]), c.get("nullable", True), c.get("default")) for c in told["columns"]),
                told.get("view_text"),
            )
        except Exception as error:  # noqa: BLE001 - a failure to answer is what is known of the table
            return About(name, error=sqltext.error_text(error))

    if names is None:
        names = [r.tableName for r in spark.sql(f"SHOW TABLES IN {sqltext.table_ref(db)}").where("NOT isTemporary").collect()]
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(asked, sorted(names)))


def survey_frame(spark: SparkSession, found: Iterable[About]) -> DataFrame:
    """A survey as a table: ``tbl, kind, provider, partition_columns, properties, columns, view_text, error``."""
    rows = [
        (a.table, a.kind, a.provider, list(a.partition_columns), dict(a.properties), list(a.columns), a.view_text, a.error) for a in found
    ]
    return spark.createDataFrame(rows, SURVEY_SCHEMA)


def type_text(told: Mapping) -> str:
    """The name of a type as a schema has it, from the catalog's description of it."""
    name = told["name"]
    if name == "array":
        return f"array<{type_text(told['element_type'])}>"
    if name == "map":
        return f"map<{type_text(told['key_type'])},{type_text(told['value_type'])}>"
    if name == "struct":
        return f"struct<{','.join(f'{f['name']}:{type_text(f['type'])}' for f in told['fields'])}>"
    if name == "decimal":
        return f"decimal({told['precision']},{told['scale']})"
    if name == "interval" and told.get("start_unit"):
        units = dict.fromkeys((told["start_unit"], told.get("end_unit") or told["start_unit"]))
        return f"interval {' to '.join(units)}"
    return {"timestamp_ltz": "timestamp", "integer": "int", "varchar": "string", "char": "string"}.get(name, name)


def column_rows(df: DataFrame, table: str) -> list[tuple]:
    return [
        (table, n, f.name, f.dataType.simpleString(), f.nullable, (f.metadata or {}).get("CURRENT_DEFAULT"))
        for n, f in enumerate(df.schema.fields)
    ]


def columns(spark: SparkSession, db: str) -> DataFrame:
    """Column catalog of every table and view of a schema, in ordinal order, from one :func:`survey`.

    One that cannot be described has no columns here; the survey has its error.
    """
    rows = []
    for about in survey(spark, db):
        if about.error:
            log.warning("%s.%s cannot be described: %s", db, about.table, about.error)
        rows += [(about.table, n, *told) for n, told in enumerate(about.columns)]
    return spark.createDataFrame(rows, COLUMN_SCHEMA).orderBy("tbl", "ordinal")


def measured_columns(df: DataFrame, table: str) -> DataFrame:
    """Column catalog of one table with ``nulls`` counted: file tables do not record NOT NULL.

    One pass, one row of counts, turned into one row per column.
    """
    counts = df.agg(*[F.count_if(sqltext.column(c).isNull()).alias(f"c{n}") for n, c in enumerate(df.columns)])
    rows = [
        F.struct(
            F.lit(t).alias("tbl"),
            F.lit(n).alias("ordinal"),
            F.lit(name).alias("column"),
            F.lit(kind).alias("type"),
            F.lit(default).cast("string").alias("default"),
            F.col(f"c{n}").alias("nulls"),
        )
        for t, n, name, kind, _, default in column_rows(df, table)
    ]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def has_column(spark: SparkSession, table: str, column: str) -> bool:
    return column in spark.table(sqltext.table_ref(table)).columns


def _partitions(spark: SparkSession, table: str) -> DataFrame:
    return spark.sql(f"SHOW PARTITIONS {sqltext.table_ref(table)}").where("trim(partition) <> ''")


def partitions(spark: SparkSession, table: str) -> DataFrame:
    """Partition names of a table, ascending, blanks left out; an unpartitioned table is an error."""
    return _partitions(spark, table).orderBy("partition")


def partition_values(spark: SparkSession, table: str, column: str) -> list:
    """Values of one partition column in its own type, ascending; the partition of NULL is left out."""
    kind = spark.table(sqltext.table_ref(table)).schema[column].dataType
    escaped = F.regexp_extract("partition", f"(?:^|/){re.escape(column)}=([^/]*)", 1)
    named = _partitions(spark, table).select(escaped.alias("v")).where("v <> '' AND v <> '__HIVE_DEFAULT_PARTITION__'")
    # Names are percent-encoded, but a plus sign in them means itself.
    value = F.url_decode(F.replace("v", F.lit("+"), F.lit("%2B"))).cast(kind)
    # A listing the catalog has already handed to the driver: sorting it here costs no job.
    return sorted({r.value for r in named.select(value.alias("value")).collect()})


def frame_partitions(df: DataFrame, column: str) -> DataFrame:
    """Column ``partition``: the values of a frame's partition column in its own type, ascending, without NULL."""
    return df.select(sqltext.column(column).alias("partition")).where("partition IS NOT NULL").distinct().orderBy("partition")


def partition_scan(df: DataFrame, column: str, value) -> DataFrame:
    """Rows of one partition; on a partitioned table only its files are read."""
    return df.where(sqltext.column(column) == F.lit(value))


def register_cold(spark: SparkSession, table: str, source: ColdSource) -> None:
    """Make a cold source addressable by name. Metadata only.

    A table that is there already is left as it is, unless it was registered here from elsewhere: serving
    its old place without a word would hide the new rows, so that is an error.
    """
    if source.format.lower() == "jdbc":
        missing = [o for o in _JDBC_SPLIT if o not in source.options]
        if missing:
            raise ValueError(f"{table}: a JDBC source is read by one task unless {missing} are given")
    options = dict(source.options)
    if source.path is not None:
        options["path"] = source.path
    origin = json.dumps([source.format.lower(), dict(sorted(options.items()))])
    if spark.catalog.tableExists(sqltext.table_ref(table)):
        known = properties(spark, table).get(COLD)
        if known not in (None, origin):
            raise ValueError(f"{table} is registered as {known}, not as {origin}; unregister it first")
    listed = ", ".join(f"{sqltext.string(k)} {sqltext.string(v)}" for k, v in sorted(options.items()))
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {sqltext.table_ref(table)} USING {source.format} "
        + (f"OPTIONS ({listed}) " if listed else "")
        + f"TBLPROPERTIES ({sqltext.string(COLD)} {sqltext.string(origin)})"
    )
    if source.path is not None and describe(spark, table).get("partition_columns"):
        spark.sql(f"ALTER TABLE {sqltext.table_ref(table)} RECOVER PARTITIONS")


def unregister_cold(spark: SparkSession, table: str) -> None:
    """Forget a cold source registered here. Its files stay; a table not registered here is an error."""
    if not spark.catalog.tableExists(sqltext.table_ref(table)):
        return
    if COLD not in properties(spark, table):
        raise ValueError(f"{table} was not registered as a cold source")
    spark.sql(f"DROP TABLE IF EXISTS {sqltext.table_ref(table)}")


def placeholder(type_name: str) -> str:
    """What a required column of this type is filled with; unknown types get zero."""
    return PLACEHOLDERS.get(type_name.split("(")[0], "0")
