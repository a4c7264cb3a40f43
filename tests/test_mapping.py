from __future__ import annotations

import pytest
from pyspark.sql import types as T
from pyspark.sql.types import StructType

from tierview import MappingError, PartitionRule, TableSpec, mapping_report, parse_boundary, reconcile
from tierview.operators.audit import conversion_losses
from tierview.operators.unify import cold_scan, unified_sql, unify
from tierview.plans.mapping import mapping_counts
from tierview.plans.spec import TierConfig, TierPair, declared_frame, time_specs


def schema(ddl: str, **defaults) -> StructType:
    made = StructType.fromDDL(ddl)
    for field in made.fields:
        if field.name in defaults:
            field.metadata = {"CURRENT_DEFAULT": defaults[field.name]}
    return made


TIME = "recordTimestamp bigint"


def rules(plan):
    return {c.name: c.rule for c in plan.columns}


def test_order_is_cold_order_then_hot_only_in_hot_order():
    hot = schema(f"z int, id int, {TIME}, b string, a string")
    plan = reconcile(hot, schema(f"{TIME}, gone int, id int"), TableSpec())
    assert plan.names == ["recordTimestamp", "id", "z", "b", "a"]
    assert plan.skipped == (("gone", "int"),)
    assert mapping_counts(plan) == {"processed": 2, "skipped": 1, "hot_only": 3, "final": 5}


def test_hot_only_columns():
    hot = schema(f"id int, {TIME}, extra_col int, tags array<string>, status int", status="1")
    plan = reconcile(hot, schema(f"id int, {TIME}"), TableSpec())
    exprs = dict(zip(plan.names, plan.cold_exprs))
    assert exprs["extra_col"] == "cast(NULL AS int) AS `extra_col`"
    assert exprs["tags"] == "cast(NULL AS array<string>) AS `tags`"
    assert exprs["status"] == "cast(1 AS int) AS `status`"
    assert rules(plan)["status"] == "default"


def test_rule_precedence():
    hot = schema(f"{TIME}, a_int array<decimal(38,0)>, b array<string>, c array<int>, d_int bigint, e_int decimal(38,0), f int, g string")
    cold = schema(f"{TIME}, a string, b string, c string, d string, e string, f bigint, g string")
    spec = TableSpec(cold_types={"a": "Array(Nullable(IPv6))", "b": "array<string>", "c": "array<int>", "d": "LowCardinality(Nullable(IPv4))", "e": "IPv6"})
    plan = reconcile(hot, cold, spec)
    assert rules(plan) == {
        "recordTimestamp": "plain", "a_int": "decode_ipv6", "b": "decode_text", "c": "decode_typed",
        "d_int": "ipv4", "e_int": "ipv6", "f": "cast", "g": "plain",
    }


def test_addresses_need_the_numbered_hot_column():
    hot = schema(f"{TIME}, ip string")
    plan = reconcile(hot, schema(f"{TIME}, ip string"), TableSpec(cold_types={"ip": "ipv4"}))
    assert rules(plan)["ip"] == "null"
    assert plan.skipped == (("ip", "ipv4"),)


def test_matching_is_case_sensitive_but_clashes_are_refused():
    with pytest.raises(MappingError, match="differ only in case"):
        reconcile(schema(f"{TIME}, a int, A int"), schema(TIME), TableSpec())
    plan = reconcile(schema(f"{TIME}, a int"), schema(f"{TIME}, A int"), TableSpec())
    assert rules(plan)["a"] == "null"


@pytest.mark.parametrize(
    "hot,cold,spec,message",
    [
        (f"{TIME}, m map<string,int>", TIME, TableSpec(), "not supported"),
        (f"{TIME}, s struct<x:int>", TIME, TableSpec(), "not supported"),
        (f"{TIME}, n array<array<int>>", TIME, TableSpec(), "not supported"),
        ("id int", "id int", TableSpec(), "not in the hot tier"),
        (f"id int, {TIME}", "id int", TableSpec(), "not in the cold tier"),
        ("t string", "t string", TableSpec("t", "datetime"), "declared as datetime"),
        (f"{TIME}, ip_int bigint", f"{TIME}, ip string, ip_int bigint", TableSpec(cold_types={"ip": "ipv4"}), "several"),
        (TIME, TIME, TableSpec(cold_types={"nope": "ipv4"}), "cold tier lacks"),
        (f"{TIME}, a int", f"{TIME}, a string", TableSpec(cold_types={"a": "array<int>"}), "is not"),
        (f"{TIME}, a array<int>", f"{TIME}, a bigint", TableSpec(), "neither an array nor text"),
    ],
)
def test_refused(hot, cold, spec, message):
    with pytest.raises(MappingError, match=message):
        reconcile(schema(hot), schema(cold), spec)


def test_no_columns():
    with pytest.raises(MappingError, match="no columns"):
        reconcile(StructType(), schema(TIME), TableSpec())


def test_report(spark):
    hot = schema(f"{TIME}, x int, y string", x="3")
    plan = reconcile(hot, schema(f"{TIME}, old string"), TableSpec())
    rows = [(r.column, r.side, r.rule) for r in mapping_report(spark, plan).collect()]
    assert rows == [("recordTimestamp", "both", "plain"), ("x", "hot", "default"), ("y", "hot", "null"), ("old", "cold", "dropped")]


def test_every_cold_form_of_an_address(spark):
    cold = spark.sql(
        "SELECT 1L AS recordTimestamp, '2001:db8::1' AS a, unhex('20010db8000000000000000000000001') AS b, "
        "array('::1', 'x') AS c, array('10.0.0.1') AS d, '5|6' AS e, cast(7 AS decimal(38,0)) AS f"
    )
    hot = schema(
        f"{TIME}, a_int decimal(38,0), b_int decimal(38,0), c_int array<decimal(38,0)>, d_int array<bigint>, "
        "e_int array<bigint>, f_int decimal(38,0)"
    )
    kinds = {"a": "ipv6", "b": "ipv6", "c": "array<ipv6>", "d": "array<ipv4>", "e": "array<ipv4>", "f": "ipv6"}
    plan = reconcile(hot, cold.schema, TableSpec(cold_types=kinds, delimiter="|"))
    row = cold_scan(cold, plan).first()
    number = 0x20010DB8 * 2**96 + 1
    assert [int(row.a_int), int(row.b_int), int(row.f_int)] == [number, number, 7]
    assert [[None if v is None else int(v) for v in x] for x in (row.c_int, row.d_int, row.e_int)] == [
        [1, None], [167772161], [5, 6],
    ]


def test_json_text_fills_a_variant(spark):
    cold = spark.sql("SELECT 1L AS recordTimestamp, '{\"a\": 5}' AS j UNION ALL SELECT 2L, 'no json'")
    hot = spark.sql("SELECT 9L AS recordTimestamp, parse_json('[1]') AS j")
    plan = reconcile(hot.schema, cold.schema, TableSpec())
    df = unify(hot, cold, plan, parse_boundary(5, "bigint"))
    assert [r[0] for r in df.selectExpr("to_json(j)", "recordTimestamp").orderBy("recordTimestamp").collect()] == ['{"a":5}', None, "[1]"]
    assert {r.column: r.lost for r in conversion_losses(cold, plan).collect()} == {"recordTimestamp": 0, "j": 1}


def test_losses_do_not_count_what_was_null_before(spark):
    cold = spark.sql(
        "SELECT 1L AS recordTimestamp, array('1', NULL, 'x') AS a, array('::1', NULL, 'fe80::1') AS b, '1|y|z' AS c, "
        "cast(NULL AS string) AS d, 'n' AS e, 'q' AS f"
    )
    hot = schema(f"{TIME}, a array<int>, b_int array<decimal(38,0)>, c array<int>, d int, e int, f string, g int")
    plan = reconcile(hot, cold.schema, TableSpec(cold_types={"b": "array<ipv6>"}, delimiter="|"))
    lost = {r.column: r.lost for r in conversion_losses(cold, plan).collect()}
    assert lost == {"recordTimestamp": 0, "a": 1, "b_int": 1, "c": 2, "d": 0, "e": 1, "f": 0, "g": 0}


def test_strict_conversion_fails_the_query(spark):
    cold = spark.sql("SELECT 1L AS recordTimestamp, 'x' AS n")
    plan = reconcile(schema(f"{TIME}, n int"), cold.schema, TableSpec(strict=True))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        cold_scan(cold, plan).collect()
    lenient = reconcile(schema(f"{TIME}, n int"), cold.schema, TableSpec())
    assert cold_scan(cold, lenient).first().n is None


def test_view_text_and_frame_say_the_same(spark):
    spark.sql("SELECT id AS recordTimestamp, id * 2 AS v, concat('::', hex(id)) AS ip FROM range(100)").createOrReplaceTempView("c")
    spark.sql("SELECT id + 50 AS recordTimestamp, cast(id AS int) AS v, cast(id AS decimal(38,0)) AS ip_int, 'h' AS h FROM range(100)").createOrReplaceTempView("h")
    spec = TableSpec(cold_types={"ip": "ipv6"})
    hot, cold = spark.table("h"), spark.table("c")
    plan = reconcile(hot.schema, cold.schema, spec)
    boundary = parse_boundary(60, "bigint")
    by_text = spark.sql(unified_sql(plan, boundary, "h", "c"))
    by_frame = unify(hot, cold, plan, boundary)
    assert by_text.schema == by_frame.schema
    assert sorted(by_text.collect()) == sorted(by_frame.collect())
    assert by_text.count() == 60 + 90


def test_time_filter_reaches_the_stored_column():
    hot = schema("d date, ym string")
    plan = reconcile(hot, schema("d timestamp_ntz"), TableSpec("d", "date", hot_partition=PartitionRule("ym", "date_format({t}, 'yyyyMM')")))
    b = parse_boundary("2000-01-01", "date")
    assert plan.cold_time_filter("<", b) == "`d` < TIMESTAMP_NTZ '2000-01-01 00:00:00'"
    assert plan.hot_time_filter(">=", b) == "`d` >= DATE '2000-01-01' AND `ym` >= date_format(DATE '2000-01-01', 'yyyyMM')"
    assert plan.hot_time_filter("<", b) == "`d` < DATE '2000-01-01' AND `ym` <= date_format(DATE '1999-12-31', 'yyyyMM')"
    assert isinstance(plan.time_rule.hot_type, T.DateType)


STORED = {
    "date": "date_add(DATE '2024-01-01', cast(id AS int))",
    "timestamp_ntz": "TIMESTAMP_NTZ '2024-01-01 12:00:00' + make_dt_interval(cast(id AS int), 0, 0, 0.000001)",
    "bigint": "id",
    "int": "cast(id AS int)",
    "decimal(10,1)": "cast(id - 0.5 AS decimal(10,1))",
    "string": "cast(id AS string)",
}


@pytest.mark.parametrize(
    "stored,hot,kind,at,rule",
    [
        ("date", "date", "date", "2024-01-05", "date_add({t}, 0)"),
        ("timestamp_ntz", "date", "date", "2024-01-05", "cast({t} AS date)"),
        ("date", "timestamp_ntz", "datetime", "2024-01-05 10:00:00", "date_add({t}, 0)"),
        ("timestamp_ntz", "timestamp_ntz", "datetime", "2024-01-05 00:00:00", "cast({t} AS date)"),
        ("bigint", "bigint", "bigint", "5", "{t} div 5"),
        ("bigint", "bigint", "bigint", "-9223372036854775808", "{t} div 5"),
        ("int", "bigint", "bigint", "5", "{t} div 5"),
        ("decimal(10,1)", "bigint", "bigint", "5", "ceil({t})"),
        ("string", "bigint", "bigint", "5", "cast({t} AS bigint) div 5"),
    ],
)
def test_partition_predicates_lose_no_rows(spark, stored, hot, kind, at, rule):
    partition = PartitionRule("p", rule)
    rows = spark.sql(f"SELECT t, {partition.of('t')} AS p FROM (SELECT {STORED[stored]} AS t FROM range(12))")
    spec = TableSpec("t", kind, cold_partition=partition, hot_partition=partition)
    plan = reconcile(schema(f"t {hot}, p string"), rows.schema, spec)
    b = parse_boundary(at, kind)
    for op in ("<", ">="):
        expected = rows.where(f"try_cast(t AS {hot}) {op} {b.sql()}")
        assert rows.where(plan.cold_time_filter(op, b)).collect() == expected.collect()
        if stored == hot:
            assert rows.where(plan.hot_time_filter(op, b)).collect() == expected.collect()


@pytest.mark.parametrize("at", ["2024-01-05 00:00:00", "2024-01-05 00:00:01", "9999-12-31 23:59:59"])
def test_days_against_a_moment(spark, at):
    cold = spark.sql("SELECT date_add(DATE '2024-01-01', cast(id AS int)) AS t FROM range(10)")
    plan = reconcile(schema("t timestamp_ntz"), cold.schema, TableSpec("t", "datetime"))
    b = parse_boundary(at, "datetime")
    for op in ("<", ">="):
        by_plan = cold.where(plan.cold_time_filter(op, b)).collect()
        assert by_plan == cold.where(f"cast(t AS timestamp_ntz) {op} {b.sql()}").collect()


@pytest.mark.parametrize("at", ["2024-01-05", "9999-12-31"])
def test_moments_against_a_day(spark, at):
    cold = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-04 23:59:59.999999' + make_dt_interval(0, 0, 0, id / 1000000) AS t FROM range(3)")
    plan = reconcile(schema("t date"), cold.schema, TableSpec("t", "date"))
    b = parse_boundary(at, "date")
    for op in ("<", ">="):
        by_plan = cold.where(plan.cold_time_filter(op, b)).collect()
        assert by_plan == cold.where(f"cast(t AS date) {op} {b.sql()}").collect()


def config():
    pairs = (TierPair("p", "h", "c", "_hot"), TierPair("q", "h2", "c2", "_local"))
    return TierConfig(pairs, {"a": TableSpec("insertTime", "datetime"), "b_hot": TableSpec("x", "date"), "b": TableSpec("", "")})


def test_time_columns_are_looked_up_alike(spark):
    names = ["a", "a_hot", "a_local", "b", "b_hot", "b_local", "c", "c_hot", "_hot"]
    found = time_specs(
        spark.createDataFrame([(n,) for n in names], "table string"), declared_frame(spark, config()), ["_hot", "_local"]
    )
    by_join = {r.table: (r.time_column, r.time_type) for r in found.collect()}
    assert by_join == {n: (config().spec(n).time_column, config().spec(n).time_type) for n in names}
    assert by_join["a_local"] == ("insertTime", "datetime")
    assert by_join["b"] == ("recordTimestamp", "bigint")


def test_declarations_are_checked():
    with pytest.raises(KeyError):
        config().pair("nope")
    with pytest.raises(ValueError):
        TierPair("p", "h", "c", " ")
    with pytest.raises(ValueError):
        TableSpec("t", "timestamp")
