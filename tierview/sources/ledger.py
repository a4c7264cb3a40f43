"""What jobs have seen of each file of each table, kept in a table, so that a pass reads only files that are new.

A file is known by its path, size and time of change, and by what was measured of it: the time column and the partition
rule. Entries are only ever added; those of files that are gone or changed match nothing any more. Losing the ledger,
or part of it, costs a reading of the files concerned.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierview.functions import sqltext
from tierview.operators.boundary import TABLES_PER_JOB
from tierview.plans.spec import PartitionRule
from tierview.sources import files

#: Files of the ledger itself from which on it is written anew. No result depends on it.
COMPACTED_FROM = 200

KEYS = ["tbl", "declared", "file", "size", "modified"]
SCHEMA = f"tbl string, declared string, {files.ENTRY}"
_NAMES = [column.split()[0] for column in SCHEMA.split(", ")]


class LedgerError(RuntimeError):
    """A table's files changed while they were read."""


@dataclass(frozen=True)
class Watched:
    """A frame read from files, its time column and its partition rule."""

    df: DataFrame
    time_column: str
    rule: PartitionRule | None = None

    @property
    def kind(self) -> T.DataType:
        return self.df.schema[self.time_column].dataType

    @property
    def declared(self) -> str:
        rule = [self.rule.column, self.rule.expr] if self.rule else None
        return json.dumps([self.time_column, self.kind.simpleString(), rule])


@dataclass(frozen=True)
class Seen:
    """All files of a table together; ``low`` is the smallest time as text. ``new_files`` were read in this pass."""

    files: int
    new_files: int
    n_rows: int
    timed: int
    misplaced: int
    low: str | None


def create(spark: SparkSession, ledger: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {sqltext.table_ref(ledger)} ({SCHEMA}) USING parquet PARTITIONED BY (tbl)")


def entries(spark: SparkSession, ledger: str, tables: Iterable[str]) -> DataFrame:
    """The entries of these tables, each file once."""
    spark.catalog.refreshTable(sqltext.table_ref(ledger))
    known = spark.table(sqltext.table_ref(ledger)).where(F.col("tbl").isin(list(tables)))
    return known.dropDuplicates(KEYS)


def add(spark: SparkSession, ledger: str, found: DataFrame) -> None:
    ref = sqltext.table_ref(ledger)
    found.select(*spark.table(ref).columns).hint("rebalance", "tbl").write.insertInto(ref)


def compact(spark: SparkSession, ledger: str) -> None:
    """Write the ledger anew in few files, each entry once. What a broken run loses is read again from the tables."""
    ref, scratch = sqltext.table_ref(ledger), sqltext.table_ref(f"{ledger}_compacted")
    spark.sql(f"DROP TABLE IF EXISTS {scratch}")
    whole = spark.table(ref)
    whole.dropDuplicates(KEYS).hint("rebalance", "tbl").write.format("parquet").partitionBy("tbl").saveAsTable(scratch)
    names = ", ".join(map(sqltext.ident, whole.columns))
    spark.sql(f"INSERT OVERWRITE {ref} SELECT {names} FROM {scratch}")
    spark.sql(f"DROP TABLE {scratch}")
    spark.catalog.refreshTable(ref)


def listings(watched: dict[str, Watched]) -> DataFrame:
    """``KEYS`` of every file of all tables as it is now."""
    each = (
        files.listing(w.df).select(F.lit(name).alias("tbl"), F.lit(w.declared).alias("declared"), "file", "size", "modified")
        for name, w in sorted(watched.items())
    )
    return reduce(DataFrame.union, each)


def unseen(now: DataFrame, known: DataFrame) -> DataFrame:
    """Files of a listing that have no entry."""
    return now.join(known.select(*KEYS), KEYS, "left_anti")


def from_footers(watched: Watched, new: DataFrame, count: int) -> DataFrame:
    """Entries of new files as far as their footers say all that is to be known, without reading data."""
    told = files.footers(new, count, watched.time_column, watched.kind)
    told = files.placed(told, watched.df, watched.time_column, watched.rule).where("misplaced IS NOT NULL")
    return new.join(told, "file").select(*KEYS, *(c for c in told.columns if c != "file"))


def from_scan(watched: Watched, new: DataFrame, names: list[str] | None) -> DataFrame:
    """Entries of new files by reading their times; ``names`` are theirs, None reads all files of the table.

    A file that no row was read from is empty. One that is no longer as it was listed gets no entry.
    """
    df = watched.df if names is None else files.only(watched.df, names)
    read = files.scanned(df, watched.time_column, watched.rule)
    sums = ("n_rows", "timed", "misplaced")
    read = read.withColumnsRenamed({"size": "__size", "modified": "__modified"})
    same = F.col("__size").isNull() | ((F.col("__size") == F.col("size")) & (F.col("__modified") == F.col("modified")))
    told = new.join(read, "file", "left").where(same)
    rest = (c for c in read.columns if c not in ("file", "__size", "__modified", *sums))
    return told.select(*KEYS, *rest, *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in sums))


def summed(now: DataFrame, known: DataFrame) -> DataFrame:
    """Per table of a listing: files, files without an entry, rows, and the smallest time in each form."""
    joined = now.join(known, KEYS, "left")
    return joined.groupBy("tbl").agg(
        F.count("*").alias("files"),
        F.count_if(F.col("n_rows").isNull()).alias("unknown"),
        *(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("n_rows", "timed", "misplaced")),
        F.min("low").cast("string").alias("number"),
        F.timestamp_micros(F.min("low")).cast("string").alias("zoned"),
        F.min("low_at").cast("string").alias("moment"),
        F.min("low_at").cast("date").cast("string").alias("day"),
    )


def _text(row, kind: T.DataType) -> str | None:
    if isinstance(kind, T.DateType):
        return row.day
    if isinstance(kind, T.TimestampNTZType):
        return row.moment
    return row.zoned if isinstance(kind, T.TimestampType) else row.number


def observe(spark: SparkSession, ledger: str, watched: dict[str, Watched]) -> dict[str, Seen]:
    """Look at the files that the ledger does not know yet, remember them, and sum up all files of each table.

    Files of an unchanged table are listed and not opened. Of new Parquet files the footers are read, and data only
    where these do not tell the times or do not prove the rule; of other new files the time column is read, and with a
    rule its partition column. What was found is kept before the next step, so a broken pass goes on where it was.

    The driver holds the names of new files, up to ``files.LISTED`` of a table; with more, the table is read whole. So
    many tables share a job as elsewhere (``TABLES_PER_JOB``).
    """
    create(spark, ledger)
    names, out = sorted(watched), {}
    for n in range(0, len(names), TABLES_PER_JOB):
        out |= _observed(spark, ledger, {name: watched[name] for name in names[n : n + TABLES_PER_JOB]})
    if len(spark.table(sqltext.table_ref(ledger)).inputFiles()) > COMPACTED_FROM:
        compact(spark, ledger)
    return out


def _observed(spark: SparkSession, ledger: str, watched: dict[str, Watched]) -> dict[str, Seen]:
    now = listings(watched)

    def new_counts() -> dict[str, int]:
        left = unseen(now, entries(spark, ledger, watched))
        return {r.tbl: r["count"] for r in left.groupBy("tbl").count().collect()}

    first = counts = new_counts()
    for step in ("footers", "scan"):
        if not counts:
            break
        left = unseen(now, entries(spark, ledger, watched))
        found = []
        for name, count in sorted(counts.items()):
            mine = left.where(F.col("tbl") == name)
            if step == "footers":
                found.append(from_footers(watched[name], mine, count))
            else:
                names = [r.file for r in mine.select("file").collect()] if count <= files.LISTED else None
                found.append(from_scan(watched[name], mine, names))
        add(spark, ledger, reduce(DataFrame.union, (f.select(_NAMES) for f in found)))
        counts = new_counts()

    out = {name: Seen(0, 0, 0, 0, 0, None) for name in watched}  # a table without files
    for row in summed(now, entries(spark, ledger, watched)).collect():
        if row.unknown:
            raise LedgerError(f"{row.tbl}: {row.unknown} files changed while they were read")
        low = _text(row, watched[row.tbl].kind)
        out[row.tbl] = Seen(row.files, first.get(row.tbl, 0), row.n_rows, row.timed, row.misplaced, low)
    return out


def may_hold(watched: Watched, known: DataFrame, *predicates: tuple[str, str]) -> DataFrame:
    """``file`` of the files that may hold a row of the range: by their entries, or because they have none.

    ``known``: entries of the table. A predicate on the time column comes with the edge that it is put to: a bound from
    below with ``high``, the largest time of a file, one from above with ``low``, the smallest.
    """
    now = listings({"": watched}).drop("tbl")
    told = now.join(known.drop("tbl"), [k for k in KEYS if k != "tbl"], "left")
    column = watched.time_column
    edges = told.select("file", F.col("n_rows").isNull().alias("__unknown"), *(files.value(e, watched.kind).alias(f"__{e}") for e in ("low", "high")))
    kept = F.lit(True)
    for n, (edge, predicate) in enumerate(predicates):
        edges = edges.withColumn(column, F.col(f"__{edge}")).withColumn(f"__k{n}", F.expr(predicate))
        kept = kept & F.coalesce(F.col(f"__k{n}"), F.lit(False))
    return edges.where(F.col("__unknown") | kept).select("file")


def retold(known: DataFrame, watched: Watched) -> DataFrame:
    """Entries of the same time column under any rule, as if none had been declared: times do not depend on it."""
    time = F.get_json_object("declared", "$[0]") == watched.time_column
    kind = F.get_json_object("declared", "$[1]") == watched.kind.simpleString()
    keys = [k for k in KEYS if k != "declared"]
    return known.where(time & kind).dropDuplicates(keys).withColumn("declared", F.lit(watched.declared))


def narrowed(watched: Watched, known: DataFrame, *predicates: tuple[str, str]) -> DataFrame:
    """The frame without the files that hold no row of the range; see :func:`may_hold`.

    The rows of the range are all in it, and the caller filters them as without an index.
    """
    wanted = [r.file for r in may_hold(watched, known, *predicates).limit(files.LISTED + 1).collect()]
    return watched.df if len(wanted) > files.LISTED else files.only(watched.df, wanted)
