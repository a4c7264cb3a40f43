"""What a caller declares: pairs of schemas, and per table the time column and the cold encodings."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierview.functions.boundaries import check_kind
from tierview.functions.codec import DEFAULT_DELIMITER

# The time column of a table nothing is declared for.
DEFAULT_TIME_COLUMN = "recordTimestamp"
DEFAULT_TIME_TYPE = "bigint"


@dataclass(frozen=True)
class PartitionRule:
    """Partition column holding ``expr`` of the time column (``{t}``), never falling as time rises.

    Example: ``PartitionRule("ym", "date_format({t}, 'yyyyMM')")``. Declaring it lets a time boundary
    prune partitions and lets the smallest time be read from the first partitions only;
    :func:`tierview.operators.audit.partition_violations` checks the data against it.
    """

    column: str
    expr: str

    def of(self, time_sql: str) -> str:
        return self.expr.replace("{t}", time_sql)


@dataclass(frozen=True)
class ColdSource:
    """Where a cold table's rows are, for tables not yet in any catalog."""

    format: str
    path: str | None = None
    options: Mapping[str, str] = field(default_factory=dict)


def _plain_type(declared: str) -> str:
    """Lower case, angle brackets, and without wrappers that say nothing about the values."""
    text = "".join(declared.lower().split()).replace("(", "<").replace(")", ">")
    bare = re.sub("(?:nullable|lowcardinality)<([^<>]*)>", r"\1", text)
    return bare if bare == text else _plain_type(bare)


@dataclass(frozen=True)
class TableSpec:
    """Declarations for one table; empty strings mean "the default"."""

    time_column: str = DEFAULT_TIME_COLUMN
    time_type: str = DEFAULT_TIME_TYPE
    # Types the cold columns stand for where the stored type does not say it: ``ipv4``, ``ipv6``,
    # ``array<ipv4>``, ``array<ipv6>``, ``array<T>``; ``Array(Nullable(IPv6))`` and the like will do.
    cold_types: Mapping[str, str] = field(default_factory=dict)
    delimiter: str = DEFAULT_DELIMITER
    # One delimiter for each level of nested cold columns kept as text (:mod:`tierview.functions.nested`); without them
    # nested columns are refused.
    nested_delimiters: tuple[str, ...] = ()
    # Whether a cold value that does not convert fails the query (in ANSI mode, Spark's default).
    strict: bool = False
    hot_partition: PartitionRule | None = None
    cold_partition: PartitionRule | None = None

    def __post_init__(self):
        object.__setattr__(self, "time_column", self.time_column.strip() or DEFAULT_TIME_COLUMN)
        plain = {name: _plain_type(declared) for name, declared in self.cold_types.items()}
        object.__setattr__(self, "cold_types", plain)
        object.__setattr__(self, "time_type", check_kind(self.time_type.strip() or DEFAULT_TIME_TYPE))


@dataclass(frozen=True)
class TierPair:
    """A hot schema and the cold schema (``db`` or ``catalog.db``) with the same tables."""

    name: str
    hot_db: str
    cold_db: str
    suffix: str
    # Cold tables that are not in a catalog yet, by table name.
    cold_sources: Mapping[str, ColdSource] = field(default_factory=dict)

    def __post_init__(self):
        if not self.suffix.strip():
            raise ValueError(f"pair {self.name!r} needs a suffix for the renamed hot tables")


@dataclass(frozen=True)
class TierConfig:
    pairs: tuple[TierPair, ...]
    tables: Mapping[str, TableSpec] = field(default_factory=dict)
    ignore: frozenset[str] = frozenset()
    # Table in which jobs remember what they have seen of each file (``db.name``); without one they read all files.
    ledger: str | None = None
    # Table in which jobs write down what they are going to do to several views (``db.name``), so that they change all
    # of them or none.
    journal: str | None = None

    def pair(self, name: str) -> TierPair:
        for pair in self.pairs:
            if pair.name == name:
                return pair
        raise KeyError(f"no pair named {name!r}; known: {[p.name for p in self.pairs]}")

    def spec(self, table: str) -> TableSpec:
        """Declaration of a table: by its own name, else without a pair's suffix, else the defaults."""
        if table in self.tables:
            return self.tables[table]
        for pair in self.pairs:
            base = table.removesuffix(pair.suffix)
            if base != table and base in self.tables:
                return self.tables[base]
        return TableSpec()

    def of(self, pair: TierPair, table: str) -> TableSpec:
        """Declaration of a unified table: by its hot name, else by its own, else the defaults."""
        return self.spec(table + pair.suffix)


def time_specs(names: DataFrame, declared: DataFrame, suffixes: list[str]) -> DataFrame:
    """Time column of every table name, looked up like :meth:`TierConfig.spec` but as one join.

    ``names``: column ``table``. ``declared``: ``table, time_column, time_type``, blanks allowed.
    """
    candidates = [F.col("table")] + [
        F.when(F.col("table").endswith(s), F.expr(f"substr(table, 1, length(table) - {len(s)})")) for s in suffixes
    ]
    wanted = (
        names.select("table")
        .distinct()
        .select("table", F.posexplode(F.array(*candidates)).alias("rank", "candidate"))
        .where(F.col("candidate").isNotNull())
    )
    found = declared.select(
        F.col("table").alias("candidate"),
        F.struct(
            F.nullif(F.trim("time_column"), F.lit("")).alias("time_column"),
            F.lower(F.nullif(F.trim("time_type"), F.lit(""))).alias("time_type"),
        ).alias("declared"),
    )
    # A candidate without a declaration has a NULL rank and is passed over by min_by.
    best = F.min_by("declared", F.when(F.col("declared").isNotNull(), F.col("rank")))
    return (
        wanted.join(found, "candidate", "left")
        .groupBy("table")
        .agg(best.alias("best"))
        .select(
            "table",
            F.coalesce("best.time_column", F.lit(DEFAULT_TIME_COLUMN)).alias("time_column"),
            F.coalesce("best.time_type", F.lit(DEFAULT_TIME_TYPE)).alias("time_type"),
        )
    )


def declared_frame(spark: SparkSession, config: TierConfig) -> DataFrame:
    """The declared time columns of a config as input for :func:`time_specs`."""
    rows = [(name, spec.time_column, spec.time_type) for name, spec in sorted(config.tables.items())]
    return spark.createDataFrame(rows, "table string, time_column string, time_type string")
