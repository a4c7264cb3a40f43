"""Files of tables: which there are, what times each holds, and reading only some of them.

What is known of a file is an entry (``ENTRY``): its rows, those with a time, the smallest and the largest time, and the
rows that are not in the partition a rule says. Times are kept as numbers (integers, microseconds of zoned timestamps)
or as moments (dates and zoneless timestamps), so that entries of all tables have one form.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierview.functions import sqltext
from tierview.operators.boundary import misplacement
from tierview.plans.spec import PartitionRule
from tierview.sources import catalog

#: Names of files that one filter lists. A read that would need more takes all files, with the same rows.
LISTED = 10_000

#: Files whose footers one task reads.
FOOTERS_PER_TASK = 200

# Formats whose tables are files, each with a path, a size and a time of change.
FORMATS = ("parquet", "orc", "csv", "json", "avro")

FILE = "file string, size bigint, modified timestamp"
ENTRY = (
    f"{FILE}, n_rows bigint, timed bigint, low bigint, high bigint, low_at timestamp_ntz, high_at timestamp_ntz, misplaced bigint"
)
_FOOTER = "file string, n_rows bigint, timed bigint, low bigint, high bigint, low_at timestamp_ntz, high_at timestamp_ntz"
_MOMENTS = (T.DateType, T.TimestampNTZType)
_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.TimestampType)


def table_of_files(spark: SparkSession, table: str, time_column: str) -> DataFrame | None:
    """The table as its files are now, or None if it is no table of files or keeps times in another type."""
    if not spark.catalog.tableExists(sqltext.table_ref(table)):
        return None
    about = catalog.describe(spark, table)
    if about.get("type") == "VIEW" or str(about.get("provider")).lower() not in FORMATS:
        return None
    spark.catalog.refreshTable(sqltext.table_ref(table))
    df = spark.table(sqltext.table_ref(table))
    kept = "_metadata" not in df.columns and time_column in df.columns and supported(df.schema[time_column].dataType)
    return df if kept else None


def supported(kind: T.DataType) -> bool:
    return isinstance(kind, _MOMENTS + _NUMBERS)


def listing(df: DataFrame) -> DataFrame:
    """``file, size, modified`` of every file of a frame, listed by Spark; no file is opened."""
    spark = df.sparkSession
    tops: list[str] = []
    for folder in sorted({unquote(name).rpartition("/")[0] + "/" for name in df.inputFiles()}):
        if not tops or not folder.startswith(tops[-1]):
            tops.append(folder)
    if not tops:
        return spark.createDataFrame([], FILE)
    plain = [re.sub(r"([\\*?\[\]{}])", r"\\\1", top) for top in tops]
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(plain)
    return found.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").alias("modified"),
    )


def only(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows of these files; no other file is opened."""
    return df.where(F.col("_metadata.file_path").isin(names)) if names else df.where(F.lit(False))


def _kept(time: Column, kind: T.DataType) -> tuple[Column, Column]:
    """A time as a number or as a moment; the other one is NULL."""
    if isinstance(kind, _MOMENTS):
        return F.lit(None).cast("bigint"), time.cast("timestamp_ntz")
    return (F.unix_micros(time) if isinstance(kind, T.TimestampType) else time.cast("bigint")), F.lit(None).cast("timestamp_ntz")


def value(edge: str, kind: T.DataType) -> Column:
    """The smallest (``low``) or largest (``high``) time of an entry, in the column's own type."""
    if isinstance(kind, _MOMENTS):
        return F.col(f"{edge}_at").cast(kind)
    return F.timestamp_micros(F.col(edge)) if isinstance(kind, T.TimestampType) else F.col(edge).cast(kind)


def scanned(df: DataFrame, time_column: str, rule: PartitionRule | None) -> DataFrame:
    """Entries by reading the time column, and with a rule its partition column. A row of partial sums per file and task.

    Files without rows have no entry here.
    """
    time, kind = sqltext.column(time_column), df.schema[time_column].dataType
    wrong = F.count_if(misplacement(time_column, rule)) if rule else F.lit(0).cast("bigint")
    about = F.col("_metadata")
    keys = {"file": "file_path", "size": "file_size", "modified": "file_modification_time"}
    sums = df.groupBy(*(about[field].alias(name) for name, field in keys.items())).agg(
        F.count("*").alias("n_rows"), F.count(time).alias("timed"), F.min(time).alias("__low"), F.max(time).alias("__high"), wrong.alias("misplaced")
    )
    (low, low_at), (high, high_at) = _kept(F.col("__low"), kind), _kept(F.col("__high"), kind)
    return sums.select(
        *keys, "n_rows", "timed", low.alias("low"), high.alias("high"), low_at.alias("low_at"), high_at.alias("high_at"), "misplaced"
    )


def footers(files: DataFrame, count: int, time_column: str, kind: T.DataType) -> DataFrame:
    """Entries without ``misplaced`` from the footers of Parquet files (``files``: column ``file``); no data page is read.

    A file has none here if its footer does not say all of it (timestamps of 96 bits, a column that came later, dates of
    the old calendar, no statistics) or if its store is one that only Spark can open: such files are to be scanned.
    """

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            told = [(name, _footer(name, time_column, kind)) for name in batch.column("file").to_pylist()]
            told = [(name, *found) for name, found in told if found is not None]
            columns = list(zip(*told)) if told else [()] * 5
            moments = isinstance(kind, _MOMENTS)
            none = [None] * len(told)
            numbers, places = pa.int64(), pa.timestamp("us")
            low, high = columns[3], columns[4]
            yield pa.record_batch(
                [
                    pa.array(columns[0], pa.string()),
                    pa.array(columns[1], numbers),
                    pa.array(columns[2], numbers),
                    pa.array(none if moments else low, numbers),
                    pa.array(none if moments else high, numbers),
                    pa.array(low if moments else none, numbers).cast(places),
                    pa.array(high if moments else none, numbers).cast(places),
                ],
                names=["file", "n_rows", "timed", "low", "high", "low_at", "high_at"],
            )

    tasks = max(1, -(-count // FOOTERS_PER_TASK))
    return files.select("file").repartition(tasks).mapInArrow(read, _FOOTER)


def _footer(name: str, column: str, kind: T.DataType) -> tuple[int, int, int | None, int | None] | None:
    """Rows, rows with a time, smallest and largest time of a file, as numbers or microseconds; None if not all is told."""
    import pyarrow as pa
    from pyarrow import fs
    from pyarrow import parquet as pq

    try:
        system, path = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", name))
        meta = pq.read_metadata(system.open_input_file(path))
        schema = meta.schema.to_arrow_schema()
    except (pa.ArrowException, OSError, ValueError):
        return None  # the scan tells whether the file is broken or its store not known here
    places = [n for n in range(meta.num_columns) if meta.schema.column(n).path == column]
    if len(places) != 1 or schema.names.count(column) != 1 or b"org.apache.spark.legacyDateTime" in (meta.metadata or {}):
        return None
    scale = _micros(schema.field(column).type, kind)
    if scale is None or meta.schema.column(places[0]).physical_type == "INT96":
        return None
    timed, low, high = 0, None, None
    for group in range(meta.num_row_groups):
        chunk = meta.row_group(group).column(places[0])
        told = chunk.statistics if chunk.is_stats_set else None
        if told is None or not told.has_null_count:
            return None
        rows = meta.row_group(group).num_rows - told.null_count
        if rows and not told.has_min_max:
            return None
        if rows:
            timed += rows
            low = told.min_raw if low is None else min(low, told.min_raw)
            high = told.max_raw if high is None else max(high, told.max_raw)
    return meta.num_rows, timed, None if low is None else low * scale, None if high is None else high * scale


def _micros(stored, kind: T.DataType) -> int | None:
    """What a stored number is to be multiplied by, None if Spark may read it as something else."""
    import pyarrow as pa

    if isinstance(kind, T.DateType):
        return 86_400_000_000 if pa.types.is_date32(stored) else None
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        zoned = isinstance(kind, T.TimestampType)
        if not pa.types.is_timestamp(stored) or (stored.tz is not None) != zoned:
            return None
        return {"ms": 1000, "us": 1}.get(stored.unit)
    return 1 if pa.types.is_signed_integer(stored) else None


def placed(entries: DataFrame, df: DataFrame, time_column: str, rule: PartitionRule | None) -> DataFrame:
    """Entries of footers with ``misplaced``, where it follows from them: 0, else NULL.

    A rule never falls as time rises, so where the smallest and the largest time of a file belong to its partition, all
    its times do. The partition is read from the file's path; a path that does not say it proves nothing.
    """
    if rule is None:
        return entries.withColumn("misplaced", F.lit(0).cast("bigint"))
    kind, own = df.schema[time_column].dataType, df.schema[rule.column].dataType
    prefix = f"{rule.column}="
    # The path of a table with several partition columns has them in folders above one another.
    parts = F.transform(F.split("file", "/"), lambda p: F.url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))))
    named = F.element_at(F.filter(parts, lambda p: F.startswith(p, F.lit(prefix))), -1)
    folder = F.url_decode(F.replace(F.substr(named, F.lit(len(prefix) + 1)), F.lit("+"), F.lit("%2B")))
    partition = F.when(folder != "__HIVE_DEFAULT_PARTITION__", folder).try_cast(own)
    edges = entries.select(F.struct(*entries.columns).alias("__e"), partition.alias("__p"), value("low", kind).alias("__l"), value("high", kind).alias("__h"))
    expected = []
    for n, edge in enumerate(("__l", "__h")):
        edges = edges.withColumn(time_column, F.col(edge)).withColumn(f"__x{n}", F.expr(rule.of(sqltext.ident(time_column))))
        expected.append(F.col(f"__x{n}").eqNullSafe(F.col("__p")) & F.col("__p").isNotNull())
    right = (F.col("__e.timed") == 0) | (expected[0] & expected[1])
    return edges.select("__e.*", F.when(right, F.lit(0).cast("bigint")).alias("misplaced"))
