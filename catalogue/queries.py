"""Registered queries: ``(spark, sf_dir) -> DataFrame``. Boundaries are read first, as a job of their own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogue import fixtures as fx
from tierview.functions import addresses, boundaries, codec, nested, networks
from tierview.functions.boundaries import parse_boundary, sentinel
from tierview.operators import agreement, audit, boundary, unify
from tierview.plans import lifecycle
from tierview.plans.mapping import reconcile
from tierview.plans.spec import PartitionRule, TableSpec, time_specs
from tierview.sources import aliases, catalog, ledger, tables, views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[f"q_{function.__name__}"] = function
    return function


def _unified(tiers: fx.Tiers, at: str | None = None) -> DataFrame:
    kind = tiers.spec.time_type
    cut = boundary.global_boundary(tiers.hot, tiers.spec) if at is None else parse_boundary(at, kind)
    return unify.unify(tiers.hot, tiers.cold, tiers.plan, cut)


# The unified table -------------------------------------------------------------------------------


@query
def unified_orders(spark, sf_dir):
    return _unified(fx.orders(spark, sf_dir))


@query
def unified_events(spark, sf_dir):
    return _unified(fx.events(spark, sf_dir))


@query
def unified_lineitem(spark, sf_dir):
    return _unified(fx.lineitem(spark, sf_dir))


@query
def unified_drifted(spark, sf_dir):
    return _unified(fx.events_drifted(spark, sf_dir))


@query
def unified_count(spark, sf_dir):
    return _unified(fx.orders(spark, sf_dir)).agg(F.count("*").alias("n"))


@query
def union_all(spark, sf_dir):
    tiers = fx.orders(spark, sf_dir)
    return unify.union_all(tiers.cold, tiers.hot, tiers.plan)


@query
def hot_scan(spark, sf_dir):
    tiers = fx.orders(spark, sf_dir)
    return unify.hot_scan(tiers.hot, tiers.plan)


@query
def cold_scan(spark, sf_dir):
    tiers = fx.orders(spark, sf_dir)
    return unify.cold_scan(tiers.cold, tiers.plan)


@query
def cold_below_boundary(spark, sf_dir):
    tiers = fx.events_without_some_times(spark, sf_dir)
    return unify.cold_part(tiers.cold, tiers.plan, boundary.global_boundary(tiers.hot, tiers.spec))


@query
def hot_from_boundary(spark, sf_dir):
    tiers = fx.events_without_some_times(spark, sf_dir)
    return unify.hot_part(tiers.hot, tiers.plan, boundary.global_boundary(tiers.hot, tiers.spec))


@query
def update_forward(spark, sf_dir):
    return _unified(fx.orders(spark, sf_dir), "2000-01-01 00:00:00")


@query
def update_sentinel(spark, sf_dir):
    return _unified(fx.orders(spark, sf_dir), sentinel("datetime").text)


@query
def read_range_hot_only(spark, sf_dir):
    return _range(spark, sf_dir, "2000-03-01 00:00:00", "2000-09-01 00:00:00")


@query
def read_range_cold_only(spark, sf_dir):
    return _range(spark, sf_dir, "1996-03-01 00:00:00", "1997-03-01 00:00:00")


@query
def read_range_both(spark, sf_dir):
    return _range(spark, sf_dir, "1998-11-01 00:00:00", "1999-03-01 00:00:00")


@query
def read_range_from(spark, sf_dir):
    return _range(spark, sf_dir, "1998-11-01 00:00:00", None)


@query
def read_range_until(spark, sf_dir):
    return _range(spark, sf_dir, None, "1999-03-01 00:00:00")


@query
def read_range_events(spark, sf_dir):
    return _limited(fx.events(spark, sf_dir), "1705600000", "1706000000")


@query
def read_range_lineitem(spark, sf_dir):
    return _limited(fx.lineitem(spark, sf_dir), "1999-11-01", "2000-02-01")


def _range(spark, sf_dir, start: str | None, end: str | None) -> DataFrame:
    return _limited(fx.orders(spark, sf_dir), start, end)


def _limited(tiers: fx.Tiers, start: str | None, end: str | None) -> DataFrame:
    cut = boundary.global_boundary(tiers.hot, tiers.spec)
    limits = [t if t is None else parse_boundary(t, tiers.spec.time_type) for t in (start, end)]
    return unify.read_range(tiers.hot, tiers.cold, tiers.plan, cut, *limits)


# The text of the view ----------------------------------------------------------------------------


def _viewed(spark, tiers: fx.Tiers, name: str) -> DataFrame:
    """The unified table by the query text that a view would hold, over temporary views of both tiers."""
    cut = boundary.global_boundary(tiers.hot, tiers.spec)
    tiers.hot.createOrReplaceTempView(f"{name}_hot")
    tiers.cold.createOrReplaceTempView(f"{name}_cold")
    return spark.sql(unify.unified_sql(tiers.plan, cut, f"{name}_hot", f"{name}_cold"))


@query
def view_orders(spark, sf_dir):
    return _viewed(spark, fx.orders(spark, sf_dir), "view_orders")


@query
def view_lineitem(spark, sf_dir):
    tiers = fx.lineitem(spark, sf_dir)
    tiers = replace(tiers, hot=fx.lineitem_by_month(spark, sf_dir), spec=replace(tiers.spec, hot_partition=fx.MONTH))
    return _viewed(spark, tiers, "view_lineitem")


@query
def view_drifted(spark, sf_dir):
    tiers = fx.events_addressed(spark, sf_dir)
    return _viewed(spark, tiers, "view_drifted").withColumn("ip6_int", F.col("ip6_int").cast("string"))


@query
def unified_event_ids(spark, sf_dir):
    return _unified(fx.events_by_id(spark, sf_dir))


# Boundaries and partitions -----------------------------------------------------------------------


@query
def boundary_ts(spark, sf_dir):
    tiers = fx.orders(spark, sf_dir)
    return boundary.boundary_frame(tiers.hot, tiers.spec)


@query
def boundary_date(spark, sf_dir):
    tiers = fx.lineitem(spark, sf_dir)
    return boundary.boundary_frame(tiers.hot, tiers.spec)


@query
def boundary_epoch(spark, sf_dir):
    tiers = fx.events(spark, sf_dir)
    return boundary.boundary_frame(tiers.hot, tiers.spec)


@query
def boundary_empty_hot(spark, sf_dir):
    tiers = fx.orders(spark, sf_dir)
    return boundary.boundary_frame(tiers.hot.where("o_totalprice < 0"), tiers.spec)


@query
def boundary_all_null_hot(spark, sf_dir):
    tiers = fx.orders(spark, sf_dir)
    untimed = F.when(F.col("o_totalprice") < 0, F.col("o_orderdate"))
    return boundary.boundary_frame(tiers.hot.withColumn("o_orderdate", untimed), tiers.spec)


@query
def boundary_partition(spark, sf_dir):
    hot = fx.lineitem_by_month(spark, sf_dir)
    return boundary.lowest_partition_frame(hot, TableSpec("d", "date", hot_partition=fx.MONTH))


@query
def boundary_partition_numeric(spark, sf_dir):
    # Months counted from the end of 1999: 9 comes before 10, as it does not by name.
    rule = PartitionRule("m", "year({t}) * 12 + month({t}) - 24000")
    hot = fx.lineitem(spark, sf_dir).hot.withColumn("m", F.expr(rule.of("d")))
    return boundary.lowest_partition_frame(hot, TableSpec("d", "date", hot_partition=rule))


@query
def boundary_partition_pruned(spark, sf_dir):
    """The same from a partitioned copy, of which the first month is read and no other."""
    path, spec = fx.scratch(spark), TableSpec("d", "date", hot_partition=fx.MONTH)
    whole = fx.lineitem_by_month(spark, sf_dir)
    whole.repartition(fx.MONTH.column).write.partitionBy(fx.MONTH.column).parquet(path)
    hot = spark.read.schema(whole.schema).parquet(path)
    values = [r.partition for r in catalog.frame_partitions(hot, fx.MONTH.column).collect()]
    low = boundary.pruned_boundary(hot, spec, values)
    return spark.range(1).select(F.expr(low.sql(hot.schema["d"].dataType)).alias("boundary"))


@query
def rule_proof(spark, sf_dir):
    """Of each tier the rows that a partition rule would lose: none of the hot ones, some of the cold ones."""
    hot = fx.lineitem_by_month(spark, sf_dir)
    cold = fx.lineitem(spark, sf_dir).cold.withColumn("d", F.to_date("d"))
    moved = cold.withColumn(fx.MONTH.column, F.expr(fx.MONTH.of("date_add(d, l_linenumber)")))
    return boundary.rule_proofs({"hot": (hot, "d", fx.MONTH), "cold": (moved, "d", fx.MONTH)})


@query
def partitions_sorted(spark, sf_dir):
    return catalog.frame_partitions(fx.lineitem_by_month(spark, sf_dir), fx.MONTH.column)


@query
def partition_scan(spark, sf_dir):
    hot = fx.lineitem_by_month(spark, sf_dir)
    first = hot.agg(F.min(fx.MONTH.column)).first()[0]
    return catalog.partition_scan(hot, fx.MONTH.column, first)


@query
def partition_violations(spark, sf_dir):
    # Partitioned by another date than the one the rule speaks of, so that some rows are misplaced.
    rows = fx.lineitem_by_month(spark, sf_dir)
    moved = rows.withColumn("d", F.expr("date_add(d, l_linenumber)"))
    return audit.partition_violations(moved, "d", fx.MONTH)


@query
def refresh_boundaries(spark, sf_dir):
    tiers = {f.__name__: f(spark, sf_dir) for f in (fx.orders, fx.events, fx.lineitem)}
    return boundary.boundaries_frame({name: (t.hot, t.spec) for name, t in tiers.items()})


@query
def refresh_incremental(spark, sf_dir):
    """Three passes over the hot line items, which come in two lots: what each pass read and what it then knew."""
    whole, path = fx.lineitem_by_month(spark, sf_dir), fx.scratch(spark)
    entries, told = [], []
    for n, lot in enumerate(("l_orderkey % 3 <> 0 AND d >= DATE '2000-03-01'", "l_orderkey % 3 = 0 OR d < DATE '2000-03-01'", None)):
        if lot:
            whole.where(lot).repartition(fx.MONTH.column).write.mode("append").partitionBy(fx.MONTH.column).parquet(f"{path}/hot")
        # The partition column is text: read as numbers, it would not be what the rule says.
        df = spark.read.schema(whole.schema).parquet(f"{path}/hot")
        watched = ledger.Watched(df, "d", fx.MONTH)
        now = ledger.listings({"hot": watched})
        known = reduce(DataFrame.union, entries) if entries else None
        new = ledger.unseen(now, known) if entries else now
        proved = ledger.from_footers(watched, new, new.count())
        proved.write.parquet(f"{path}/footers{n}")
        entries.append(spark.read.parquet(f"{path}/footers{n}"))
        rest = ledger.unseen(new, entries[-1])
        names = [r.file for r in rest.select("file").collect()]
        ledger.from_scan(watched, rest, names).select(*proved.columns).write.parquet(f"{path}/scanned{n}")
        entries.append(spark.read.parquet(f"{path}/scanned{n}"))
        read = entries[-2].union(entries[-1]).agg(F.coalesce(F.sum("n_rows"), F.lit(0)).cast("bigint").alias("new_rows"))
        state = ledger.summed(now, reduce(DataFrame.union, entries)).select("n_rows", "timed", "misplaced", F.col("day").alias("boundary"))
        told += [df.withColumn("pass", F.lit(n)) for df in (read, state)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), told)
    return both.groupBy("pass").agg(*(F.max(c).alias(c) for c in ("new_rows", "n_rows", "timed", "misplaced", "boundary")))


@query
def range_by_index(spark, sf_dir):
    """Two weeks of the orders, from the files whose times can hold them; a lot that no entry tells of is read."""
    df, path = fx.table(spark, sf_dir, "orders"), fx.scratch(spark)
    by_time = df.repartitionByRange(16, "o_orderdate")
    by_time.where("o_orderkey % 5 <> 0").write.parquet(f"{path}/orders")
    watched = ledger.Watched(spark.read.parquet(f"{path}/orders"), "o_orderdate")
    now = ledger.listings({"orders": watched})
    ledger.from_footers(watched, now, 16).write.parquet(f"{path}/entries")
    known = spark.read.parquet(f"{path}/entries")
    by_time.where("o_orderkey % 5 = 0").write.mode("append").parquet(f"{path}/orders")
    later = ledger.Watched(spark.read.parquet(f"{path}/orders"), "o_orderdate")
    start, end = ("o_orderdate >= TIMESTAMP_NTZ '1998-03-05 00:00:00'", "o_orderdate < TIMESTAMP_NTZ '1998-03-19 00:00:00'")
    return ledger.narrowed(later, known, ("high", start), ("low", end)).where(start).where(end)


# Reconciled schemas ------------------------------------------------------------------------------


def _drifted_cold(spark, sf_dir, *columns: str) -> DataFrame:
    tiers = fx.events_drifted(spark, sf_dir)
    return unify.cold_scan(tiers.cold, tiers.plan).select("event_id", *columns)


@query
def hot_only_default(spark, sf_dir):
    return _drifted_cold(spark, sf_dir, "status")


@query
def hot_only_null(spark, sf_dir):
    return _drifted_cold(spark, sf_dir, "tags")


@query
def cold_only_dropped(spark, sf_dir):
    tiers = fx.events_drifted(spark, sf_dir)
    return unify.cold_scan(tiers.cold, tiers.plan)


@query
def type_align(spark, sf_dir):
    return _drifted_cold(spark, sf_dir, "value")


@query
def ip_mapping(spark, sf_dir):
    return _drifted_cold(spark, sf_dir, "src_ip_int")


@query
def mapping_report(spark, sf_dir):
    tiers = fx.events_damaged(spark, sf_dir)
    return audit.conversion_losses(tiers.cold, tiers.plan).drop("changed")


@query
def conversion_losses(spark, sf_dir):
    tiers = fx.orders_narrowed(spark, sf_dir)
    return audit.conversion_losses(tiers.cold, tiers.plan)


@query
def cold_alias_columns(spark, sf_dir):
    tiers = fx.events_drifted(spark, sf_dir)
    cold = tiers.cold.withColumn("labels", F.array("event_type", "legacy"))
    spec = TableSpec(cold_types={"src_ip": "ipv4"}, delimiter=fx.DELIMITER)
    return aliases.with_aliases(cold, spec).select("event_id", "src_ip_int", "labels_str")


@query
def drop_alias_columns(spark, sf_dir):
    tiers = fx.events_drifted(spark, sf_dir)
    return aliases.without_aliases(aliases.with_aliases(tiers.cold, tiers.spec), tiers.cold.schema, tiers.spec)


def _digits(name: str, kind: str) -> Column:
    # 38-digit numbers are compared as text, which nothing on the way can round.
    return F.col(name).cast(kind).alias(name)


# Values ------------------------------------------------------------------------------------------


@query
def ipv4_int(spark, sf_dir):
    return fx.addresses(spark, sf_dir).select("event_id", addresses.ipv4_to_int("ip4").alias("ip"))


@query
def ipv6_int(spark, sf_dir):
    numbered = addresses.with_ipv6_int(fx.addresses(spark, sf_dir), "ip6", "ip")
    return numbered.select("event_id", _digits("ip", "string"))


@query
def ipv6_bytes(spark, sf_dir):
    wide = addresses.with_ipv6_bytes(fx.addresses(spark, sf_dir), "ip6", "ip")
    return wide.select("event_id", F.hex("ip").alias("ip_hex"))


@query
def ipv6_ranges(spark, sf_dir):
    """Where every address is, of all 128 bits: networks, a range, its own network of 42 bits, and its halves."""
    rows = addresses.with_ipv6_bytes(fx.addresses(spark, sf_dir), "ip6", "ip")
    key = F.col("ip")
    high, low = networks.halves(key)
    return rows.select(
        "event_id",
        *(networks.in_network(key, net).alias(name) for name, net in fx.NETWORKS.items()),
        networks.in_range(key, "2001:db8::10", "fe80::1f4").alias("between"),
        F.hex(networks.network_of(key, 42)).alias("net42"),
        high.cast("string").alias("high"),
        low.cast("string").alias("low"),
    )


def _nested_lines(spark, sf_dir) -> tuple[DataFrame, T.DataType]:
    """Every document as lines of words, which may hold both delimiters, and its type."""
    lines = F.transform(F.split("text", "\n", -1), lambda line: F.split(line, " ", -1))
    return fx.table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines")), T.ArrayType(T.ArrayType(T.StringType()))


@query
def encode_nested(spark, sf_dir):
    df, kind = _nested_lines(spark, sf_dir)
    return df.select("doc_id", nested.encode("lines", kind, fx.NESTED).alias("stored"))


@query
def decode_nested(spark, sf_dir):
    df, kind = _nested_lines(spark, sf_dir)
    stored = df.select("doc_id", nested.encode("lines", kind, fx.NESTED).alias("stored"))
    back = stored.select("doc_id", nested.decode("stored", kind, fx.NESTED).alias("lines"))
    return back.select("doc_id", F.transform("lines", lambda line: F.array_join(line, " ")).alias("lines"))


@query
def decode_nested_records(spark, sf_dir):
    """Maps of structs from the text of a cold tier, served through the mapping."""
    cold = fx.events(spark, sf_dir).cold
    text = F.concat("event_type", F.lit(":"), "user_id", F.lit(","), F.col("value").cast("string"))
    cold = cold.select("event_id", "recordTimestamp", F.when(F.col("event_type") != "error", text).otherwise("\\z0").alias("told"))
    record = "map<string,struct<user:bigint,amount:double>>"
    hot = spark.createDataFrame([], f"event_id bigint, recordTimestamp bigint, told {record}")
    plan = reconcile(hot.schema, cold.schema, TableSpec(nested_delimiters=(";", ":", ",")))
    served = unify.cold_scan(cold, plan)
    entry = F.get(F.map_entries("told"), F.lit(0))
    return served.select(
        "event_id", F.size("told").alias("n"), entry["key"].alias("kind"), entry["value"]["user"].alias("user"), entry["value"]["amount"].alias("amount")
    )


@query
def decode_strings(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select(
        "doc_id", F.replace("text", F.lit(" "), F.lit(fx.DELIMITER)).alias("words")
    )
    return docs.select("doc_id", codec.decode_array("words", T.StringType(), fx.DELIMITER).alias("words"))


@query
def decode_typed(spark, sf_dir):
    stored = fx.encoded(fx.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")
    return stored.select("vec_id", codec.decode_array("embedding", T.FloatType(), fx.DELIMITER).alias("embedding"))


@query
def encode_roundtrip(spark, sf_dir):
    text = fx.table(spark, sf_dir, "embeddings").select(
        "vec_id", codec.encode_array("embedding", fx.DELIMITER).alias("embedding")
    )
    return text.select("vec_id", codec.decode_array("embedding", T.FloatType(), fx.DELIMITER).alias("embedding"))


@query
def encode_refusals(spark, sf_dir):
    words = fx.table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("words"))
    return words.select(
        "doc_id",
        codec.is_encodable("words", ",").alias("ok"),
        codec.encode_array("words", ",", strict=False).alias("stored"),
    )


@query
def decode_int128(spark, sf_dir):
    wide = F.concat(F.col("event_id").cast("string"), F.lit("0" * 30))
    beyond = F.concat(F.lit("9" * 34), F.col("event_id") + 100000)
    stored = fx.table(spark, sf_dir, "events").select(
        "event_id", F.concat_ws(fx.DELIMITER, wide, "event_type", beyond, "user_id").alias("ids")
    )
    decoded = stored.select("event_id", codec.decode_array("ids", codec.INT128, fx.DELIMITER).alias("ids"))
    return decoded.select("event_id", _digits("ids", "array<string>"))


@query
def decode_empty(spark, sf_dir):
    kind = F.col("event_type")
    stored = fx.table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind == "error", "")
        .when(kind == "view", fx.DELIMITER)
        .when(kind == "click", F.concat("props", F.lit(fx.DELIMITER)))
        .when(kind == "signup", F.col("props"))
        .alias("parts"),
    )
    return stored.select("event_id", codec.decode_array("parts", T.StringType(), fx.DELIMITER).alias("parts"))


@query
def epoch(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").select(
        "event_id",
        boundaries.utc_epoch_seconds(F.col("ts")).alias("epoch"),
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"),
    )


@query
def validate_targets(spark, sf_dir):
    order, status, priority = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    dear = F.col("o_totalprice") > 200000
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = (
        F.when((priority == "1-URGENT") & dear, F.concat(day, F.lit(" 07:08:09.25")))
        .when(priority == "1-URGENT", F.concat(day, F.lit(" 07:08:09")))
        .when((priority == "2-HIGH") & dear, F.concat(F.lit("'"), day, F.lit(" 7:08:09,0000001'")))
        .when(priority == "2-HIGH", F.concat(F.lit("'"), day, F.lit("'")))
        .when((priority == "3-MEDIUM") & dear, F.date_format("o_orderdate", "yyyy/MM/dd"))
        .when(priority == "3-MEDIUM", F.concat(F.substring(day, 1, 4), F.lit("-02-30")))
        .when((priority == "4-NOT SPECIFIED") & dear, F.concat(order + 1, F.lit("0" * 19)))
        .when(priority == "4-NOT SPECIFIED", F.concat(F.lit("-"), order))
        .otherwise(F.concat(day, F.lit(" 25:00:00")))
    )
    targets = fx.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(status == "F", "datetime").when(status == "O", "date").otherwise("BIGINT").alias("time_type"),
        text.alias("boundary"),
    )
    return boundaries.validate_targets(targets)


# Rows --------------------------------------------------------------------------------------------


_TARGET = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType(), False),
        T.StructField("o_custkey", T.LongType(), False),
        T.StructField("o_orderstatus", T.StringType(), False, {"CURRENT_DEFAULT": "'O'"}),
        T.StructField("o_totalprice", T.DoubleType(), True),
        T.StructField("o_orderdate", T.TimestampNTZType(), True),
        T.StructField("o_orderpriority", T.StringType(), False),
        T.StructField("o_billed", T.DateType(), False),
        T.StructField("o_open", T.BooleanType(), False),
    ]
)


@query
def complete_rows(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey")
    return tables.complete_rows(rows, _TARGET, "o_orderdate")


@query
def complete_rows_required(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey")
    return tables.complete_rows(rows, _TARGET, "o_orderdate", mode="required_only")


@query
def drop_columns(spark, sf_dir):
    return tables.drop_columns(fx.table(spark, sf_dir, "orders"), ["o_totalprice", "o_orderpriority"])


@query
def enough_rows(spark, sf_dir):
    whole = _unified(fx.orders(spark, sf_dir))
    return views.at_least(whole, 100).union(views.at_least(whole, 10**12))


@query
def delete_at_time(spark, sf_dir):
    tiers = fx.orders(spark, sf_dir)
    cut = boundary.global_boundary(tiers.hot, tiers.spec)
    return tables.without_time(fx.table(spark, sf_dir, "orders"), "o_orderdate", cut)


# Audits and plans --------------------------------------------------------------------------------


@query
def tier_audit(spark, sf_dir):
    tiers = fx.orders(spark, sf_dir)
    cut = boundary.global_boundary(tiers.hot, tiers.spec)
    moved = parse_boundary("2000-01-01 00:00:00", "datetime")
    return audit.tier_audit(tiers.hot, tiers.cold, tiers.plan, cut, moved)


def _apart(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    tiers = fx.orders_apart(spark, sf_dir)
    limits = [parse_boundary(t, "datetime") for t in ("1999-01-01 00:00:00", "1999-06-01 00:00:00")]
    return agreement.overlap(tiers.hot, tiers.cold, tiers.plan, *limits)


@query
def tier_agreement(spark, sf_dir):
    return agreement.agreement(*_apart(spark, sf_dir), "o_orderdate", 7 * 86_400)


@query
def tier_differences(spark, sf_dir):
    return agreement.differences(*_apart(spark, sf_dir), "o_orderdate", 7 * 86_400)


@query
def tier_agreement_events(spark, sf_dir):
    """Tiers that agree: the cold values are text, and come out as what the hot ones are."""
    tiers = fx.events_drifted(spark, sf_dir)
    limits = [parse_boundary(t, "bigint") for t in (1705708800, 1706140800)]
    names = ["event_id", "recordTimestamp", "user_id", "event_type", "value", "props", "src_ip_int"]
    hot, cold = (df.select(*names) for df in agreement.overlap(tiers.hot, tiers.cold, tiers.plan, *limits))
    return agreement.agreement(hot, cold, "recordTimestamp", agreement.WIDTHS["bigint"])


@query
def column_catalog(spark, sf_dir):
    tiers = fx.events_without_some_times(spark, sf_dir)
    drifted = fx.events_drifted(spark, sf_dir)
    listed = catalog.measured_columns(tiers.hot, "events").union(catalog.measured_columns(drifted.hot, "drifted"))
    return listed.union(catalog.measured_columns(fx.table(spark, sf_dir, "orders"), "orders"))


@query
def table_diff(spark, sf_dir):
    left = fx.table(spark, sf_dir, "customer").select(F.upper("c_name").alias("name"))
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    marked = F.when(F.col("o_orderstatus") == "P", F.concat(name, F.lit("_hot"))).otherwise(
        F.when(F.col("o_totalprice") > 300000, F.concat(F.lit("Big"), name)).otherwise(name)
    )
    right = fx.orders(spark, sf_dir).hot.select(marked.alias("name"))
    return audit.name_diff(left, right, skip_suffix="_hot")


@query
def table_kinds(spark, sf_dir):
    orders = fx.orders(spark, sf_dir)
    name = F.concat(F.lit("customer_"), "o_custkey").alias("table")
    views = fx.table(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_totalprice > 150000").select(name)
    return catalog.with_kinds(orders.hot.select(name), views)


@query
def init_plan(spark, sf_dir):
    return lifecycle.plan_init(lifecycle.table_states(*fx.customer_objects(spark, sf_dir), "_hot", ["customer_7"]))


@query
def rollback_plan(spark, sf_dir):
    return lifecycle.plan_rollback(lifecycle.table_states(*fx.customer_objects(spark, sf_dir), "_hot", ["customer_7"]))


@query
def time_spec(spark, sf_dir):
    customers = fx.table(spark, sf_dir, "customer")
    segment = F.col("c_mktsegment")
    names = customers.select(
        F.when(segment == "BUILDING", F.concat("c_name", F.lit("_hot")))
        .when(segment == "FURNITURE", F.concat("c_name", F.lit("_local")))
        .otherwise(F.col("c_name"))
        .alias("table")
    )
    # Declared under the hot name what has a debt, and beside it under its own name, which then does not count.
    debt = F.when(F.col("c_acctbal") < -500, F.array(F.lit("_hot"), F.lit(""))).otherwise(F.array(F.lit("")))
    declared = customers.where("c_acctbal > 0 OR c_acctbal < -500").withColumn("suffix", F.explode(debt)).select(
        F.concat("c_name", "suffix").alias("table"),
        F.when(F.col("suffix") == "_hot", "hotTime")
        .when(segment == "MACHINERY", " ")
        .otherwise(F.lit("insertTime"))
        .alias("time_column"),
        F.when(segment == "HOUSEHOLD", "").otherwise(F.lit("DATETIME")).alias("time_type"),
    )
    return time_specs(names, declared, ["_hot", "_local"])


@query
def run_summary(spark, sf_dir):
    late = F.col("o_orderstatus") == "P"
    results = fx.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("pair"),
        F.when(late, "failed").otherwise("restored").alias("status"),
        F.when(
            late,
            F.when(F.col("o_totalprice") > 200000, "drop_view")
            .when(F.col("o_totalprice") > 100000, "precheck")
            .when(F.col("o_totalprice") > 50000, "elsewhere"),
        ).alias("step"),
    )
    return audit.run_summary(results)


@query
def probe_tables(spark, sf_dir):
    names = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark"
    frames = {n: fx.table(spark, sf_dir, n) for n in [*names.split(), "labels", "conversations"]}
    frames["no_orders"] = frames["orders"].where("o_totalprice < 0")
    readers = {name: lambda df=df: df for name, df in frames.items()}
    readers["missing"] = lambda: spark.table("no_such_table")
    # Of the error its class only: the text is Spark's own.
    return audit.probe(spark, readers).withColumn("error", F.regexp_extract("error", r"^\[([A-Z_]+)\]", 1))
