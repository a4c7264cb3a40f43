"""Where hot begins: the smallest time of the hot tier."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierview.functions import sqltext
from tierview.functions.boundaries import Boundary, parse_boundary, sentinel
from tierview.plans.spec import PartitionRule, TableSpec
from tierview.sources import catalog

# So many tables' minima are found in one job unless a caller says otherwise. No result depends on it.
TABLES_PER_JOB = 64


class PartitionError(RuntimeError):
    """Rows are in other partitions than the declared rule says."""


def boundary_frame(hot: DataFrame, spec: TableSpec, name: str = "boundary") -> DataFrame:
    """One row: the smallest time, or the sentinel when there is none.

    In the declared kind: a narrow integer column, which need not hold the sentinel, gives a BIGINT. A
    partial minimum per task, so a few bytes per task are shuffled; only the time column is read.
    """
    kind = hot.schema[spec.time_column].dataType
    kind = T.LongType() if spec.time_type == "bigint" else kind
    late = F.expr(sentinel(spec.time_type).sql(kind)).cast(kind)
    return hot.agg(F.coalesce(_lowest(spec).cast(kind), late).alias(name))


def global_boundary(hot: DataFrame, spec: TableSpec) -> Boundary:
    return parsed(hot.agg(_lowest(spec).cast("string")).first()[0], spec)


def _lowest(spec: TableSpec) -> Column:
    return F.min(sqltext.column(spec.time_column))


def parsed(low: str | None, spec: TableSpec) -> Boundary:
    """The boundary of a smallest time, told as text: as a value, a zoned one would arrive in the driver's own zone."""
    return sentinel(spec.time_type) if low is None else parse_boundary(low, spec.time_type)


def partition_lows(hot: DataFrame, spec: TableSpec) -> DataFrame:
    """``partition, low, broken``: of each partition the smallest time, and whether a row of it belongs elsewhere.

    A rule never falls as time rises, so a partition to which its smallest and its largest time belong is right. The rule
    is computed for these two, and not for each row.
    """
    rule, time = spec.hot_partition, sqltext.column(spec.time_column)
    sums = hot.groupBy(sqltext.column(rule.column).alias("__p")).agg(F.min(time).alias("__low"), F.max(time).alias("__high"))
    right = F.lit(True)
    for edge in ("__low", "__high"):
        sums = sums.withColumn(spec.time_column, F.col(edge)).withColumn(f"{edge}_in", F.expr(rule.of(sqltext.ident(spec.time_column))))
        right = right & F.col(f"{edge}_in").eqNullSafe(F.col("__p"))
    broken = F.col("__low").isNotNull() & ~right
    return sums.select(F.col("__p").alias("partition"), F.col("__low").alias("low"), broken.alias("broken"))


def lowest_partition_frame(hot: DataFrame, spec: TableSpec, name: str = "boundary") -> DataFrame:
    """Like :func:`boundary_frame`, as the smallest time of the first partition that has one, in one job.

    For a frame whose partitions no catalog lists. Two columns are read, and a row for each partition and task moved.
    Partitions that break the rule are an error. Where a catalog lists the partitions, :func:`many_boundaries` reads the first
    ones only.
    """
    kind = hot.schema[spec.time_column].dataType
    kind = T.LongType() if spec.time_type == "bigint" else kind
    late = F.expr(sentinel(spec.time_type).sql(kind)).cast(kind)
    first = F.min_by("low", F.when(F.col("low").isNotNull(), F.col("partition")))
    told = partition_lows(hot, spec).agg(first.cast(kind).alias("low"), F.count_if("broken").alias("wrong"))
    broken = F.raise_error(F.format_string("%d partitions hold rows that the partition rule puts elsewhere", F.col("wrong"))).cast(kind)
    return told.select(F.when(F.col("wrong") > 0, broken).otherwise(F.coalesce("low", late)).alias(name))


def pruned_boundary(hot: DataFrame, spec: TableSpec, values: list) -> Boundary:
    """The smallest time of a frame whose partitions follow time, given their values in ascending order.

    Reads the first partition, then two more, then four, until a time is found.
    """
    return _searched({"": _reads(hot, spec, values)}, {"": spec}, TABLES_PER_JOB)[""]


def partition_boundary(spark: SparkSession, table: str, spec: TableSpec) -> Boundary:
    """Like :func:`global_boundary` for a catalog table whose partitions follow time.

    Reads the first partitions only: one, then two more, then four, until a time is found. Equals the
    global minimum because a :class:`PartitionRule` promises that partitions rise with time.
    """
    if spec.hot_partition is None:
        raise ValueError(f"{table}: no partition rule is declared, use global_boundary")
    return table_boundary(spark, table, spec)


def table_boundary(spark: SparkSession, table: str, spec: TableSpec) -> Boundary:
    return many_boundaries(spark, {table: spec})[table]


def boundaries_frame(tables: dict[str, tuple[DataFrame, TableSpec]]) -> DataFrame:
    """``tbl, boundary`` (as text; NULL when a table has no time) of many hot tables in one query."""
    return _lows(tables).select("tbl", "boundary")


def _lows(tables: dict[str, tuple[DataFrame, TableSpec]]) -> DataFrame:
    def low(name: str, hot: DataFrame, spec: TableSpec) -> DataFrame:
        misplaced = F.lit(0).cast("bigint")
        if spec.hot_partition is not None:
            misplaced = F.count_if(misplacement(spec.time_column, spec.hot_partition))
        found = hot.agg(_lowest(spec).cast("string").alias("boundary"), misplaced.alias("misplaced"))
        return found.select(F.lit(name).alias("tbl"), "boundary", "misplaced")

    return reduce(DataFrame.union, [low(name, hot, spec) for name, (hot, spec) in tables.items()])


def misplacement(time_column: str, rule: PartitionRule) -> Column:
    """True for a row whose partition is not the one its time belongs to."""
    expected = F.expr(rule.of(sqltext.ident(time_column)))
    timed = sqltext.column(time_column).isNotNull()
    return timed & ~sqltext.column(rule.column).eqNullSafe(expected)


def rule_proofs(tables: dict[str, tuple[DataFrame, str, PartitionRule]]) -> DataFrame:
    """``tbl, timed, misplaced``: rows with a time, and those in another partition than the rule says.

    ``tables``: frame, time column and rule by name. One aggregate over the two columns each; a rule with
    no misplaced row may be relied on, a row without a time breaks none.
    """

    def proof(name: str, df: DataFrame, time: str, rule: PartitionRule) -> DataFrame:
        wrong = F.count_if(misplacement(time, rule)).alias("misplaced")
        return df.agg(F.count(sqltext.column(time)).alias("timed"), wrong).select(F.lit(name).alias("tbl"), "*")

    return reduce(DataFrame.union, [proof(name, *given) for name, given in tables.items()])


def misplaced_rows(
    tables: dict[str, tuple[DataFrame, str, PartitionRule]], per_job: int = TABLES_PER_JOB
) -> dict[str, int]:
    """How many rows break each table's rule, ``per_job`` tables to a job."""
    found = {}
    for names in _chunks(sorted(tables), per_job):
        found |= {r.tbl: r.misplaced for r in rule_proofs({n: tables[n] for n in names}).collect()}
    return found


def many_boundaries(
    spark: SparkSession, tables: dict[str, TableSpec], per_job: int = TABLES_PER_JOB
) -> dict[str, Boundary]:
    """Boundaries of many catalog tables, ``per_job`` to a job (more make a longer query plan).

    A table with a partition rule is read a few partitions at a time, in as many rounds as it takes to
    find a time; any other table is read once. Rows met on the way that break their table's rule are an
    error; :func:`misplaced_rows` looks at all of them.
    """
    reads = {}
    for name, spec in tables.items():
        rule = spec.hot_partition
        values = catalog.partition_values(spark, name, rule.column) if rule else []
        reads[name] = _reads(spark.table(name), spec, values)
    return _searched(reads, tables, per_job)


def _searched(reads: dict[str, list[DataFrame]], specs: dict[str, TableSpec], per_job: int) -> dict[str, Boundary]:
    found = {name: sentinel(spec.time_type) for name, spec in specs.items()}
    left = {name: list(frames) for name, frames in reads.items()}
    while left:
        ready = {name: (frames.pop(0), specs[name]) for name, frames in left.items()}
        for names in _chunks(sorted(ready), per_job):
            for row in _lows({name: ready[name] for name in names}).collect():
                if row.misplaced:
                    raise PartitionError(f"{row.tbl}: {row.misplaced} rows read are not where the partition rule says")
                if row.boundary is not None:
                    found[row.tbl] = parsed(row.boundary, specs[row.tbl])
                    del left[row.tbl]
        # Rows of the NULL partition have, by the rule, no time: a table read to its end has none.
        left = {name: frames for name, frames in left.items() if frames}
    return found


def _reads(hot: DataFrame, spec: TableSpec, values: list) -> list[DataFrame]:
    """What to look at for the smallest time, in turn: ever more partitions, or the whole table."""
    if not values or spec.hot_partition is None:
        return [hot]
    column = sqltext.column(spec.hot_partition.column)
    slices = [values[2**n - 1 : 2 ** (n + 1) - 1] for n in range(len(values).bit_length())]
    return [hot.where(column.between(s[0], s[-1])) for s in slices]


def _chunks(items: list, size: int) -> list[list]:
    return [items[n : n + size] for n in range(0, len(items), size)]
