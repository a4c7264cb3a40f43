"""Lifecycle of tables on a real catalog: init, update, refresh, rollback, from every state."""

from __future__ import annotations

import itertools
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tierview import BoundaryError, ColdSource, PartitionRule, TableSpec, TierConfig, TierPair, parse_boundary, sentinel
from tierview.functions import sqltext
from tierview.jobs import lifecycle
from tierview.jobs import (
    JobError,
    init_plan,
    refresh_all,
    rollback_plan,
    run_init,
    run_rollback,
    unified,
    unified_range,
    update,
    update_many,
)
from tierview.operators import audit
from tierview.sources import catalog, tables, views

SUFFIX = "_local_catalog"
_ids = itertools.count()


class Site:
    """Hot and cold schemas of one test."""

    def __init__(self, spark):
        n = next(_ids)
        self.spark, self.hot, self.cold = spark, f"hot{n}", f"cold{n}"
        spark.sql(f"CREATE DATABASE {self.hot}")
        spark.sql(f"CREATE DATABASE {self.cold}")
        self.specs, self.ignore, self.sources = {}, frozenset(), {}

    @property
    def config(self):
        return TierConfig((TierPair("cold", self.hot, self.cold, SUFFIX, self.sources),), self.specs, self.ignore)

    def save(self, df, name, tier="hot", by=()):
        df.write.partitionBy(*by).saveAsTable(f"{getattr(self, tier)}.{name}")

    def kinds(self):
        return catalog.table_kinds(self.spark, self.hot)

    def rows(self, name):
        return self.spark.table(f"{self.hot}.{name}")

    def boundary(self, name):
        return views.view_boundary(self.spark, f"{self.hot}.{name}").text

    def sql(self, text):
        return self.spark.sql(text.format(hot=self.hot, cold=self.cold, s=SUFFIX))

    def init(self):
        return statuses(run_init(self.spark, self.config))

    def rollback(self, **options):
        return statuses(run_rollback(self.spark, self.config, **options))


def statuses(df):
    return {r.tbl: r.status for r in df.collect()}


@pytest.fixture
def site(spark, sf_dir):
    """Three tables of 300 days, hot from day 200 and cold until day 250; one partitioned by month."""
    site = Site(spark)
    days = spark.range(300).select(
        F.col("id"),
        F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(cast(id as int))").alias("at"),
        (F.col("id") * 86400).alias("recordTimestamp"),
    )
    hot, cold = days.where("id >= 200"), days.where("id < 250")
    site.save(hot.select("id", F.col("at").alias("insertTime")), "platform_log")
    site.save(cold.select("id", F.col("at").alias("insertTime")), "platform_log", "cold")
    site.save(hot.select("id", "recordTimestamp"), "dns_log")
    site.save(cold.select("id", "recordTimestamp"), "dns_log", "cold")
    daily = hot.select("id", F.to_date("at").alias("d")).withColumn("ym", F.date_format("d", "yyyyMM"))
    site.save(daily, "daily", by=["ym"])
    site.save(cold.select("id", F.col("at").alias("d")), "daily", "cold")
    site.specs = {
        "platform_log": TableSpec("insertTime", "datetime"),
        "daily": TableSpec("d", "date", hot_partition=PartitionRule("ym", "date_format({t}, 'yyyyMM')")),
    }
    return site


ALL = ["daily", "dns_log", "platform_log"]
HOT_ONLY = {t: "TABLE" for t in ALL}
UNIFIED = {**{t: "VIEW" for t in ALL}, **{t + SUFFIX: "TABLE" for t in ALL}}


def test_init_serves_every_row_once(site):
    assert site.init() == {t: "created" for t in ALL}
    assert site.kinds() == UNIFIED
    for name in ALL:
        assert sorted(r.id for r in site.rows(name).collect()) == list(range(300)), name
    assert site.boundary("platform_log") == "2024-07-19 00:00:00"
    assert site.boundary("dns_log") == str(200 * 86400)
    assert site.boundary("daily") == "2024-07-19"


def test_rows_inserted_before_the_boundary_show_after_an_update(site):
    site.sql("TRUNCATE TABLE {hot}.dns_log")
    site.init()
    assert site.boundary("dns_log") == sentinel("bigint").text
    assert site.rows("dns_log").count() == 250
    rows = site.spark.createDataFrame([(86400 * 240,)], "recordTimestamp long")
    tables.append_rows(site.spark, f"{site.hot}.dns_log{SUFFIX}", rows, "recordTimestamp")
    assert site.rows("dns_log").count() == 250
    update(site.spark, site.config, "cold", "dns_log", 86400 * 240)
    assert site.rows("dns_log").count() == 241
    assert site.rows("dns_log").where("id IS NULL").count() == 1


def test_update_to_the_smallest_time(site):
    site.init()
    update(site.spark, site.config, "cold", "platform_log", "2024-08-01 00:00:00")
    assert site.rows("platform_log").count() == 300
    update(site.spark, site.config, "cold", "platform_log", "'2024-07-19 00:00:00'")
    assert site.boundary("platform_log") == "2024-07-19 00:00:00"
    again = update(site.spark, site.config, "cold", "platform_log", "2024-07-19 00:00:00")
    assert statuses(again) == {"platform_log": "unchanged"}


def test_update_past_the_cold_tier_hides_rows_and_the_audit_says_so(site):
    site.init()
    update(site.spark, site.config, "cold", "dns_log", 270 * 86400)
    assert site.rows("dns_log").count() == 280
    hot, cold = site.rows("dns_log" + SUFFIX), site.spark.table(f"{site.cold}.dns_log")
    from tierview import reconcile

    plan = reconcile(hot.schema, cold.schema, TableSpec())
    at = views.view_boundary(site.spark, f"{site.hot}.dns_log")
    rows = {r.tier: r for r in audit.tier_audit(hot, cold, plan, at).collect()}
    assert (rows["hot"].shown, rows["hot"].hidden, rows["cold"].shown, rows["cold"].hidden) == (30, 70, 250, 0)


def test_empty_hot_uses_the_sentinel(site):
    for name in ALL:
        site.sql(f"TRUNCATE TABLE {{hot}}.{name}")
    site.init()
    assert {n: site.boundary(n) for n in ALL} == {
        "daily": "9999-12-31", "dns_log": "9999999999999", "platform_log": "9999-12-31 23:59:59",
    }
    check = views.check_view(site.spark, f"{site.hot}.daily", sentinel("date"), ["9999-12-31"], ["d", "ym"], 250)
    assert all(r.ok for r in check.collect())
    assert not views.count_at_least(site.rows("daily"), 251)


def test_rollback_restores_names_rows_and_kinds(site):
    before = {n: sorted(site.rows(n).collect()) for n in ALL}
    site.init()
    assert site.rollback() == {t: "restored" for t in ALL}
    assert site.kinds() == HOT_ONLY
    assert {n: sorted(site.rows(n).collect()) for n in ALL} == before
    assert site.rollback() == {}


def test_init_twice(site):
    site.init()
    texts = {n: views.view_text(site.spark, f"{site.hot}.{n}") for n in ALL}
    assert site.init() == {t: "skipped" for t in ALL}
    assert {n: views.view_text(site.spark, f"{site.hot}.{n}") for n in ALL} == texts


def test_hot_only_columns(site):
    site.sql("DROP TABLE {hot}.dns_log")
    site.sql(
        "CREATE TABLE {hot}.dns_log (id INT, recordTimestamp BIGINT, extra_col INT, tags ARRAY<STRING>, "
        "status INT DEFAULT 1) USING parquet"
    )
    site.sql("INSERT INTO {hot}.dns_log VALUES (1, 21600000, 5, array('x'), 7)")
    site.init()
    df = site.rows("dns_log")
    assert df.columns == ["id", "recordTimestamp", "extra_col", "tags", "status"]
    assert df.where("extra_col IS NULL AND tags IS NULL AND status = 1").count() == 250
    assert df.where("extra_col = 5 AND tags = array('x') AND status = 7").count() == 1


def test_name_conflict_changes_nothing(site):
    site.init()
    site.sql("DROP VIEW {hot}.dns_log")
    site.sql("CREATE TABLE {hot}.dns_log (id INT) USING parquet")
    before = site.kinds()
    with pytest.raises(JobError, match="base name is taken") as failure:
        run_rollback(site.spark, site.config)
    failed = [r for r in failure.value.frame(site.spark).collect() if r.status == "failed"]
    assert [(r.tbl, r.step) for r in failed] == [("dns_log", "precheck")]
    assert {k: v for k, v in site.kinds().items() if "dns" in k} == {k: v for k, v in before.items() if "dns" in k}
    assert site.rollback(on_error="continue") == {"dns_log": "failed", "platform_log": "restored"}
    results = run_rollback(site.spark, site.config, on_error="continue")
    total = audit.run_summary(results).where("pair = '(all)'").first()
    assert (total.total, total.success, total.failed, total.failed_precheck) == (1, 0, 1, 1)
    with pytest.raises(JobError, match="renamed form"):
        run_init(site.spark, site.config)


def test_update_refuses_bad_requests_before_changing_anything(site):
    site.init()
    go = lambda *targets: update_many(site.spark, site.config, "cold", targets)
    with pytest.raises(KeyError):
        update(site.spark, site.config, "nope", "dns_log", 1)
    for bad in ["20250101", "2025/11/12 00:00:00", "", None]:
        with pytest.raises(ValueError):
            go(("dns_log", 21000000), ("platform_log", bad))
    with pytest.raises(BoundaryError):
        go(("platform_log", "2024-08-01 00:00:00"), ("dns_log", "2025-11-12 00:00:00"))
    with pytest.raises(views.ViewError):
        go(("dns_log", 21000000), ("missing", 5))
    with pytest.raises(ValueError):
        go()
    with pytest.raises(ValueError):
        go((" ", 5))
    assert site.boundary("dns_log") == str(200 * 86400)
    assert site.boundary("platform_log") == "2024-07-19 00:00:00"
    go(("dns_log", "21000000"), ("platform_log", "2024-08-01 00:00:00"), ("daily", "2024-08-02"))
    assert [site.boundary(n) for n in ALL] == ["2024-08-02", "21000000", "2024-08-01 00:00:00"]


@pytest.mark.parametrize("missing", [["dns_log"], ALL])
def test_init_repairs_missing_views(site, missing):
    site.init()
    for name in missing:
        site.sql(f"DROP VIEW {{hot}}.{name}")
    assert site.init() == {t: "created" if t in missing else "skipped" for t in ALL}
    assert site.kinds() == UNIFIED
    assert site.rows("daily").count() == 300


@pytest.mark.parametrize("restored", [["daily"], ALL])
def test_init_after_tables_were_renamed_back_by_hand(site, restored):
    site.init()
    for name in restored:
        site.sql(f"DROP VIEW {{hot}}.{name}")
        tables.rename_back(site.spark, site.hot, name + SUFFIX, SUFFIX)
    assert site.init() == {t: "created" if t in restored else "skipped" for t in ALL}
    assert [site.rows(n).count() for n in ALL] == [300] * 3


@pytest.mark.parametrize("gone", [["daily"], ALL])
def test_rollback_without_views(site, gone):
    site.init()
    for name in gone:
        site.sql(f"DROP VIEW {{hot}}.{name}")
    assert site.rollback() == {t: "restored" for t in ALL}
    assert site.kinds() == HOT_ONLY
    assert site.rows("daily").count() == 100


@pytest.mark.parametrize("restored", [["daily"], ALL])
def test_rollback_after_tables_were_renamed_back_by_hand(site, restored):
    site.init()
    for name in restored:
        site.sql(f"DROP VIEW {{hot}}.{name}")
        tables.rename_back(site.spark, site.hot, name + SUFFIX, SUFFIX)
    assert site.rollback() == {t: "restored" for t in ALL if t not in restored}
    assert site.kinds() == HOT_ONLY


def test_states_and_their_plans(site):
    """Base and suffixed object, both, either or none; ignored; without a cold table."""
    for name in ["t_none", "none_t", "view_t", "t_t", "view_none", "none_none", "ignored"]:
        site.sql(f"CREATE TABLE {{cold}}.{name} (recordTimestamp BIGINT) USING parquet")
    for name in ["t_none", "none_t{s}", "view_t{s}", "t_t", "t_t{s}", "ignored", "uncold"]:
        site.sql(f"CREATE TABLE {{hot}}.{name} (recordTimestamp BIGINT) USING parquet")
    for name in ["view_t", "view_none"]:
        site.sql(f"CREATE VIEW {{hot}}.{name} AS SELECT 1 AS x")
    for name in ALL:
        site.sql(f"DROP TABLE {{cold}}.{name}")
    site.ignore = frozenset(["ignored"])
    pair = site.config.pairs[0]
    assert {r.base_table: r.action for r in init_plan(site.spark, site.config, pair).collect()} == {
        "t_none": "rename_and_create", "none_t": "create", "view_t": "skip", "t_t": "conflict", "view_none": "skip",
    }
    plan = {r.base_table: (r.drop_view, r.rename, r.blocked) for r in rollback_plan(site.spark, site.config, pair).collect()}
    assert plan == {
        "none_t": (False, True, False), "view_t": (True, True, False), "t_t": (False, True, True),
    }


def test_a_schema_that_cannot_be_served_leaves_all_tables_alone(site):
    site.sql("ALTER TABLE {cold}.platform_log RENAME TO {cold}.old_log")
    site.sql("CREATE TABLE {cold}.platform_log (id BIGINT) USING parquet")
    with pytest.raises(JobError, match="not in the cold tier") as failure:
        run_init(site.spark, site.config)
    assert failure.value.results[-1][3] == "mapping"
    assert site.kinds() == HOT_ONLY


def test_refresh_follows_the_data_and_leaves_foreign_views_alone(site):
    site.init()
    site.sql("CREATE VIEW {hot}.foreign_view AS SELECT 1 AS x")
    assert statuses(refresh_all(site.spark, site.config)) == {t: "unchanged" for t in ALL}
    site.sql("INSERT INTO {hot}.dns_log{s} VALUES (-1, 180 * 86400)")
    site.sql("TRUNCATE TABLE {hot}.platform_log{s}")
    site.sql("ALTER TABLE {hot}.daily{s} DROP PARTITION (ym = '202407')")
    assert statuses(refresh_all(site.spark, site.config)) == {t: "updated" for t in ALL}
    assert [site.boundary(n) for n in ALL] == ["2024-08-01", str(180 * 86400), "9999-12-31 23:59:59"]
    assert site.rows("daily").count() == 300
    site.ignore = frozenset(ALL)
    assert statuses(refresh_all(site.spark, site.config)) == {}


def test_update_picks_up_new_columns(site):
    site.init()
    site.sql("ALTER TABLE {hot}.dns_log{s} ADD COLUMNS (note STRING)")
    assert not catalog.has_column(site.spark, f"{site.hot}.dns_log", "note")
    assert statuses(refresh_all(site.spark, site.config))["dns_log"] == "updated"
    assert catalog.has_column(site.spark, f"{site.hot}.dns_log", "note")


def test_range_reads(site):
    site.init()
    limits = [("2024-08-01", "2024-08-05"), ("2024-02-01", "2024-02-03"), ("2024-07-18", "2024-07-21"), (None, None)]
    hot_or_cold = []
    for low, high in limits:
        df = unified_range(site.spark, site.config, "cold", "daily", low, high)
        by_view = site.rows("daily")
        by_view = by_view.where(f"d >= DATE '{low}' AND d < DATE '{high}'") if low else by_view
        assert sorted(df.collect()) == sorted(by_view.collect())
        scans = df._jdf.queryExecution().optimizedPlan().toString()
        hot_or_cold.append((f"{site.hot}.daily{SUFFIX}" in scans, f"{site.cold}.daily" in scans))
    assert hot_or_cold == [(True, False), (False, True), (True, True), (True, True)]
    assert unified_range(site.spark, site.config, "cold", "daily", "2024-08-05", "2024-08-01").count() == 0
    assert sorted(unified(site.spark, site.config, "cold", "daily").collect()) == sorted(site.rows("daily").collect())


def test_time_predicates_prune_partitions(site):
    site.init()
    df = unified_range(site.spark, site.config, "cold", "daily", "2024-09-01", "2024-09-05")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ym" in plan.split("PartitionFilters: ")[1].split("]")[0]
    assert df.count() == 4


def test_partition_boundary_reads_first_partitions_only(site):
    from tierview.operators import boundary

    site.init()
    name, spec = f"{site.hot}.daily{SUFFIX}", site.specs["daily"]
    assert boundary.partition_boundary(site.spark, name, spec) == boundary.global_boundary(site.spark.table(name), spec)
    assert catalog.partition_values(site.spark, name, "ym")[0] == "202407"
    assert [r.partition for r in catalog.partitions(site.spark, name).collect()] == [
        f"ym=2024{m:02d}" for m in range(7, 11)
    ]
    assert audit.partition_violations(site.spark.table(name), "d", spec.hot_partition).count() == 0
    with pytest.raises(ValueError):
        boundary.partition_boundary(site.spark, name, TableSpec("d", "date"))
    with pytest.raises(Exception, match="not partitioned|PARTITION"):
        catalog.partitions(site.spark, f"{site.hot}.dns_log{SUFFIX}").collect()


def test_partition_boundary_skips_partitions_without_times_and_sorts_by_value(site):
    from tierview.operators import boundary

    rows = [(None, 2), (None, 9), (50, 10), (55, 11), (None, None)]
    df = site.spark.createDataFrame(rows, "recordTimestamp long, p int")
    site.save(df, "numbered", by=["p"])
    spec = TableSpec(hot_partition=PartitionRule("p", "cast({t} div 5 AS int)"))
    name = f"{site.hot}.numbered"
    assert catalog.partition_values(site.spark, name, "p") == [2, 9, 10, 11]
    assert boundary.partition_boundary(site.spark, name, spec).value == 50
    site.save(df.where("recordTimestamp IS NULL"), "untimed", by=["p"])
    assert boundary.partition_boundary(site.spark, f"{site.hot}.untimed", spec) == sentinel("bigint")


def test_misplaced_rows_stop_a_refresh(site):
    site.init()
    site.sql("INSERT INTO {hot}.daily{s} VALUES (-1, DATE '2024-01-01', '202408'), (-2, DATE '2024-09-01', '202407')")
    with pytest.raises(JobError, match="1 rows read are not where"):
        refresh_all(site.spark, site.config)
    assert site.boundary("daily") == "2024-07-19"
    rule = site.specs["daily"].hot_partition
    assert sorted(r.id for r in audit.partition_violations(site.rows("daily" + SUFFIX), "d", rule).collect()) == [-2, -1]


def test_awkward_partition_values(site):
    values = ["a b", "c/d", "e=f", "g%h", "i+j", "é"]
    site.save(site.spark.createDataFrame([(v, 1) for v in values], "p string, x int").select("x", "p"), "odd", by=["p"])
    assert catalog.partition_values(site.spark, f"{site.hot}.odd", "p") == values


def test_rename_keeps_partitioned_rows_and_refuses_a_taken_name(site):
    tables.rename(site.spark, site.hot, "daily", "daily2")
    assert site.rows("daily2").count() == 100
    with pytest.raises(tables.TableError, match="exists"):
        tables.rename(site.spark, site.hot, "daily2", "dns_log")
    assert tables.rename_back(site.spark, site.hot, "dns_log", SUFFIX) == "dns_log"


def test_external_tables_stay_where_they_are(site, tmp_path):
    path = str(tmp_path / "elsewhere")
    site.rows("daily").write.partitionBy("ym").parquet(path)
    site.sql("DROP TABLE {hot}.daily")
    site.sql(f"CREATE TABLE {{hot}}.daily (id BIGINT, d DATE, ym STRING) USING parquet PARTITIONED BY (ym) LOCATION '{path}'")
    site.sql("ALTER TABLE {hot}.daily RECOVER PARTITIONS")
    site.init()
    assert catalog.describe(site.spark, f"{site.hot}.daily{SUFFIX}")["location"].endswith(path)
    assert site.rows("daily").count() == 300
    site.rollback()
    assert site.rows("daily").count() == 100
    assert catalog.describe(site.spark, f"{site.hot}.daily")["location"].endswith(path)


def test_cold_sources_are_registered_and_forgotten(site, tmp_path):
    path = str(tmp_path / "cold files")
    site.spark.table(f"{site.cold}.dns_log").write.json(path)
    site.sql("DROP TABLE {cold}.dns_log")
    site.sources = {"dns_log": ColdSource("json", path)}
    site.init()
    assert site.rows("dns_log").count() == 300
    site.rollback()
    assert "dns_log" not in catalog.table_kinds(site.spark, site.cold)
    assert site.spark.read.json(path).count() == 250
    with pytest.raises(ValueError, match="not registered"):
        catalog.unregister_cold(site.spark, f"{site.cold}.daily")
    with pytest.raises(ValueError, match="one task"):
        catalog.register_cold(site.spark, f"{site.cold}.j", ColdSource("jdbc", options={"url": "x", "dbtable": "y"}))


def test_cold_sources_of_a_failed_pair_are_kept(site, tmp_path):
    path = str(tmp_path / "files")
    site.spark.table(f"{site.cold}.dns_log").write.parquet(path)
    site.sql("DROP TABLE {cold}.dns_log")
    site.sources = {"dns_log": ColdSource("parquet", path)}
    site.init()
    site.sql("DROP VIEW {hot}.daily")
    site.sql("CREATE TABLE {hot}.daily (id INT) USING parquet")
    assert site.rollback(on_error="continue")["daily"] == "failed"
    assert "dns_log" in catalog.table_kinds(site.spark, site.cold)


def test_two_pairs_and_a_catalog_qualified_cold_schema(spark, site):
    other = Site(spark)
    days = spark.range(10).select("id", F.col("id").alias("recordTimestamp"))
    other.save(days.where("id >= 5"), "dns_log")
    other.save(days.where("id < 7"), "dns_log", "cold")
    pairs = (
        TierPair("first", site.hot, f"spark_catalog.{site.cold}", SUFFIX),
        TierPair("second", other.hot, other.cold, "_h"),
    )
    config = TierConfig(pairs, site.specs)
    done = [(r.pair, r.tbl) for r in run_init(spark, config).collect()]
    assert done == [("first", t) for t in ALL] + [("second", "dns_log")]
    assert site.rows("platform_log").count() == 300
    assert other.rows("dns_log").count() == 10
    update(spark, config, "second", "dns_log", 6)
    assert other.boundary("dns_log") == "6" and site.boundary("dns_log") == str(200 * 86400)
    assert {r.detail for r in refresh_all(spark, config).collect() if r.pair == "second"} == {"5"}
    site.sql("DROP VIEW {hot}.dns_log")
    site.sql("CREATE TABLE {hot}.dns_log (id INT) USING parquet")
    results = run_rollback(spark, config, on_error="continue")
    summary = {r.pair: (r.total, r.success, r.failed) for r in audit.run_summary(results).collect()}
    assert summary == {"first": (3, 2, 1), "second": (1, 1, 0), "(all)": (4, 3, 1)}
    assert other.kinds() == {"dns_log": "TABLE"}


def test_awkward_column_names_and_a_catalog_qualified_hot_schema(spark, site):
    site.sql("CREATE TABLE {hot}.odd (`event time` BIGINT, `a.b` INT, `x``y` STRING, `select` INT DEFAULT 2) USING parquet")
    site.sql("CREATE TABLE {cold}.odd (`event time` INT, `a.b` STRING, `x``y` STRING) USING parquet")
    site.sql("INSERT INTO {hot}.odd VALUES (10, 1, 'h', 3), (12, 1, 'h', 3)")
    site.sql("INSERT INTO {cold}.odd VALUES (9, '7', 'c'), (10, '8', 'c')")
    pair = TierPair("q", f"spark_catalog.{site.hot}", site.cold, SUFFIX)
    config = TierConfig((pair,), {"odd": TableSpec("event time")}, frozenset(ALL))
    assert statuses(run_init(spark, config)) == {"odd": "created"}
    assert statuses(run_init(spark, config)) == {"odd": "skipped"}
    assert sorted(tuple(r) for r in site.rows("odd").collect()) == [(9, 7, "c", 2), (10, 1, "h", 3), (12, 1, "h", 3)]
    assert unified(spark, config, "q", "odd").count() == 3
    assert unified_range(spark, config, "q", "odd", 10, 12).count() == 1
    hot, cold = site.rows("odd" + SUFFIX), spark.table(f"{site.cold}.odd")
    from tierview import reconcile

    plan = reconcile(hot.schema, cold.schema, config.spec("odd"))
    at = parse_boundary(10, "bigint")
    assert {r.tier: (r.shown, r.hidden) for r in audit.tier_audit(hot, cold, plan, at).collect()} == {"cold": (1, 1), "hot": (2, 0)}
    assert {r.column: r.lost for r in audit.conversion_losses(cold, plan).collect()} == dict.fromkeys(hot.columns, 0)
    assert {r.column: r.nulls for r in catalog.measured_columns(hot, "odd").collect()} == dict.fromkeys(hot.columns, 0)
    assert tables.without_time(hot, "event time", at).count() == 1
    assert statuses(refresh_all(spark, config)) == {"odd": "unchanged"}
    assert statuses(run_rollback(spark, config)) == {"odd": "restored"}


def test_zoned_timestamps_are_cut_in_the_session_zone(spark, site):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Shanghai")
    try:
        days = spark.range(10).selectExpr("id", "timestamp_seconds(id * 86400) AS at")
        site.save(days.where("id >= 5"), "zoned")
        site.save(days.where("id < 8"), "zoned", "cold")
        site.specs = {**site.specs, "zoned": TableSpec("at", "datetime")}
        site.init()
        assert site.boundary("zoned") == "1970-01-06 08:00:00"
        assert sorted(r.id for r in site.rows("zoned").collect()) == list(range(10))
        assert statuses(refresh_all(spark, site.config))["zoned"] == "unchanged"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert site.rows("zoned").count() == 10


def test_a_cold_source_that_is_not_ours_is_not_dropped(site):
    site.init()
    site.sources = {"dns_log": ColdSource("parquet", "/nowhere")}
    with pytest.raises(JobError, match="drop_cold"):
        run_rollback(site.spark, site.config)
    assert site.kinds() == HOT_ONLY
    assert "dns_log" in catalog.table_kinds(site.spark, site.cold)


def test_drop_view_spares_tables(site):
    with pytest.raises(views.ViewError, match="is a table"):
        views.drop_view(site.spark, f"{site.hot}.dns_log")
    views.drop_view(site.spark, f"{site.hot}.nothing")
    with pytest.raises(views.ViewError, match="does not exist"):
        views.view_text(site.spark, f"{site.hot}.nothing")


def test_checks_report_what_is_wrong(site):
    site.init()
    tables.rename(site.spark, site.hot, "daily" + SUFFIX, "elsewhere")
    found = {r.check: r.ok for r in views.check_view(site.spark, f"{site.hot}.daily", columns=["d"]).collect()}
    assert found == {"exists": True, "selectable": False}
    rows = views.check_view(site.spark, f"{site.hot}.dns_log", parse_boundary(5, "bigint"), ["zzz"], ["no"], 301).collect()
    assert [(r.check, r.ok) for r in rows] == [
        ("exists", True), ("boundary", False), ("contains", False), ("column", False), ("selectable", True), ("min_rows", False),
    ]
    assert [r.ok for r in views.check_view(site.spark, f"{site.hot}.nothing").collect()] == [False]
    probed = {r.tbl: r.status for r in audit.probe_tables(site.spark, site.hot, SUFFIX).collect()}
    assert probed == {"daily": "error", "dns_log": "rows", "elsewhere": "rows", "platform_log": "rows"}
    totals = audit.probe_totals(audit.probe_tables(site.spark, site.hot, SUFFIX)).collect()
    assert {r.status: r.tables for r in totals} == {"error": 1, "rows": 3}


def test_column_catalog(site):
    site.sql("CREATE TABLE {hot}.made (a INT DEFAULT 4, b ARRAY<STRING>) USING parquet")
    rows = catalog.columns(site.spark, site.hot).where("tbl = 'made'").collect()
    assert [(r.ordinal, r.column, r.type, r.default) for r in rows] == [(0, "a", "int", "4"), (1, "b", "array<string>", None)]
    assert catalog.list_tables(site.spark, site.hot).count() == 4


def test_partial_rows_are_completed_by_the_table(site):
    site.sql("CREATE TABLE {hot}.made (t BIGINT, a INT DEFAULT 4, b STRING, c STRING) USING parquet")
    rows = site.spark.createDataFrame([(1,)], "t long")
    for mode in ("all", "required_only"):
        tables.append_rows(site.spark, f"{site.hot}.made", rows, "t", mode, required={"t", "c"})
    assert [tuple(r) for r in site.rows("made").collect()] == [(1, 4, None, "")] * 2
    with pytest.raises(ValueError, match="time column"):
        tables.complete_rows(rows, site.rows("made").schema, "b")
    with pytest.raises(ValueError, match="no columns"):
        tables.complete_rows(rows.withColumn("zz", F.lit(1)), site.rows("made").schema, "t")


def test_every_type_has_a_placeholder(spark):
    ddl = (
        "t bigint, a tinyint, b smallint, c int, d bigint, e decimal(38,0), f float, g double, h decimal(9,2), i boolean, "
        "j string, k date, l timestamp, m timestamp_ntz, n array<int>, o variant"
    )
    target = spark.createDataFrame([], ddl).schema
    rows = tables.complete_rows(spark.range(1).toDF("t"), target, "t", required=set(target.names))
    assert [t for _, t in rows.dtypes] == [f.dataType.simpleString() for f in target.fields]
    row = rows.withColumn("o", F.to_json("o")).withColumn("l", F.col("l").cast("string")).first()
    assert row[1:9] == (0,) * 8 and row[9:11] == (False, "") and row.n == [] and row.o == "{}"
    assert [str(row[c]) for c in "klm"] == ["1970-01-01", "1970-01-01 00:00:00", "1970-01-01 00:00:00"]


def test_rows_at_one_time_are_left_out_of_the_copy(site):
    at = parse_boundary("2024-07-19", "date")
    tables.copy_without_time(site.spark, f"{site.hot}.daily", "d", at, f"{site.hot}.daily_copy")
    assert site.rows("daily_copy").count() == 99
    assert catalog.partition_values(site.spark, f"{site.hot}.daily_copy", "ym")[0] == "202407"
    tables.truncate(site.spark, f"{site.hot}.daily_copy")
    assert not views.has_rows(site.spark, f"{site.hot}.daily_copy")


def test_names_are_quoted():
    assert sqltext.table_ref("a.b", "c") == "`a`.`b`.`c`"
    assert sqltext.ident("x`y") == "`x``y`"
    assert sqltext.string("a'b\\") == "'a\\'b\\\\'"


# Rules are proved, names resolved, failures recorded ------------------------------------------------


def misplace(site, tier):
    """A row in a later partition than its day belongs to, where no search for the boundary looks."""
    if tier == "hot":
        site.sql("INSERT INTO {hot}.daily VALUES (-1, DATE '2024-08-05', '202410')")
        return
    rule = PartitionRule("cym", "date_format({t}, 'yyyyMM')")
    site.specs["daily"] = replace(site.specs["daily"], cold_partition=rule)
    cold = site.spark.table(f"{site.cold}.daily").selectExpr("*", f"{rule.of('d')} AS cym")
    moved = cold.selectExpr(*[c for c in cold.columns if c != "cym"], "CASE WHEN id = (SELECT min(id) FROM {c}) THEN '209901' ELSE cym END AS cym".replace("{c}", f"{site.cold}.daily"))
    rows = site.spark.createDataFrame(moved.collect(), moved.schema)
    site.spark.sql(f"DROP TABLE {site.cold}.daily")
    site.save(rows, "daily", tier="cold", by=["cym"])


@pytest.mark.parametrize("tier", ["hot", "cold"])
def test_a_misplaced_row_stops_every_job(site, tier):
    misplace(site, tier)
    with pytest.raises(JobError, match="partition rule") as stopped:
        run_init(site.spark, site.config)
    assert [r[:4] for r in stopped.value.results if r[2] == "failed"] == [("cold", "daily", "failed", "precheck")]
    assert site.kinds()["daily"] == "TABLE"
    # Without the rules nothing is pruned, so nothing can be lost; declared afterwards they are not believed.
    told = site.specs["daily"]
    site.specs["daily"] = replace(told, hot_partition=None, cold_partition=None)
    run_init(site.spark, site.config)
    rows = site.rows("daily").count()
    site.specs["daily"] = told
    assert unified_range(site.spark, site.config, "cold", "daily", "1000-01-01").count() == rows
    for job in (lambda: refresh_all(site.spark, site.config), lambda: update(site.spark, site.config, "cold", "daily", "2024-08-01")):
        with pytest.raises(Exception, match="partition rule"):
            job()
    assert site.rows("daily").count() == rows


def test_declared_under_the_hot_name(site):
    told = site.specs.pop("daily")
    site.specs["daily" + SUFFIX] = told
    site.init()
    assert site.boundary("daily") == "2024-07-19"
    refresh_all(site.spark, site.config)
    update(site.spark, site.config, "cold", "daily", "2024-08-01")
    assert site.boundary("daily") == "2024-08-01"
    assert unified_range(site.spark, site.config, "cold", "daily", "2024-08-01", "2024-08-03").count() == 2
    # Of both names the hot one counts.
    site.specs["daily"] = TableSpec("no_such_column", "bigint")
    refresh_all(site.spark, site.config)
    pair = site.config.pairs[0]
    assert site.config.of(pair, "daily") == site.config.spec("daily" + SUFFIX) == told


def test_ranges_take_boundaries_and_refuse_other_kinds(site):
    site.init()
    day = lambda text: parse_boundary(text, "date")
    whole = unified_range(site.spark, site.config, "cold", "daily", "2024-08-01", "2024-08-05").count()
    assert unified_range(site.spark, site.config, "cold", "daily", day("2024-08-01"), day("2024-08-05")).count() == whole
    with pytest.raises(BoundaryError, match="is datetime, the boundary is date"):
        unified_range(site.spark, site.config, "cold", "daily", parse_boundary("2024-08-01 00:00:00", "datetime"))
    with pytest.raises(BoundaryError):
        assert day("2024-08-01") < parse_boundary("3", "bigint")


def test_failures_are_in_the_results(site):
    site.init()
    site.spark.sql(f"DROP TABLE {site.cold}.daily")
    with pytest.raises(JobError) as stopped:
        refresh_all(site.spark, site.config)
    assert [r[:4] for r in stopped.value.results][-1] == ("cold", "daily", "failed", "mapping")


def test_rollback_goes_on_past_a_bad_pair(site):
    site.init()
    bad = TierPair("bad", site.hot, "no_such_schema", SUFFIX)
    config = replace(site.config, pairs=(bad, *site.config.pairs))
    rows = run_rollback(site.spark, config, on_error="continue").collect()
    assert [tuple(r)[:4] for r in rows if r.status == "failed"] == [("bad", "(all)", "failed", "precheck")]
    assert site.kinds()["daily"] == "TABLE" and "daily" + SUFFIX not in site.kinds()
    with pytest.raises(JobError):
        run_rollback(site.spark, config)


def test_init_reads_boundaries_in_batches_and_not_while_names_are_gone(site, monkeypatch):
    for n in range(10):
        df = site.spark.range(5).selectExpr("id AS recordTimestamp", "id AS v")
        site.save(df, f"t{n}")
        site.save(df, f"t{n}", tier="cold")
    calls, gone = [], []
    many = lifecycle.many_boundaries
    monkeypatch.setattr(lifecycle, "many_boundaries", lambda spark, tables: calls.append(sorted(tables)) or many(spark, tables))
    rename = tables.rename

    def watched(spark, db, old, new, then=None):
        def both():
            tracker = spark.sparkContext.statusTracker()
            before = set(tracker.getJobIdsForGroup(None))
            then()
            gone.append(len(set(tracker.getJobIdsForGroup(None)) - before))

        rename(spark, db, old, new, then=both)

    monkeypatch.setattr(tables, "rename", watched)
    site.init()
    assert len(calls) == 1 and f"{site.hot}.t0" in calls[0]
    assert len(gone) >= 10 and not any(gone)
    assert all(site.rows(f"t{n}").count() == 5 for n in range(10))


def test_errors_without_text_and_empty_runs(site):
    def silent():
        raise ValueError

    told = audit.probe(site.spark, {"a": silent, "b": lambda: site.spark.range(1)}).collect()
    assert [tuple(r) for r in told] == [("a", "error", "ValueError"), ("b", "rows", None)]
    empty = site.spark.createDataFrame([], "pair string, status string, step string")
    row = audit.run_summary(empty).collect()
    assert [(r.pair, r.total, r.failed, r.failed_unknown) for r in row] == [("(all)", 0, 0, 0)]


def test_counting_rows_needs_no_single_task_for_them(site):
    df = site.spark.range(100_000, numPartitions=8)
    assert views.count_at_least(df, 100_000) and not views.count_at_least(df, 100_001) and views.count_at_least(df, 0)


def test_cold_sources_that_moved_are_refused(site, tmp_path):
    for n in (3, 5):
        site.spark.range(n).write.parquet(str(tmp_path / str(n)))
    name = f"{site.cold}.moved"
    catalog.register_cold(site.spark, name, ColdSource("parquet", str(tmp_path / "3")))
    catalog.register_cold(site.spark, name, ColdSource("parquet", str(tmp_path / "3")))
    with pytest.raises(ValueError, match="unregister it first"):
        catalog.register_cold(site.spark, name, ColdSource("parquet", str(tmp_path / "5")))
    catalog.unregister_cold(site.spark, name)
    catalog.register_cold(site.spark, name, ColdSource("parquet", str(tmp_path / "5")))
    assert site.spark.table(name).count() == 5


def test_rows_at_one_time_are_removed_in_place(site):
    rows = [(1, 10, "a"), (2, 20, "a"), (3, 10, "b"), (4, 30, "c"), (None, 5, "c")]
    df = site.spark.createDataFrame([(t, v, p) for v, t, p in rows], "recordTimestamp long, v long, p string")
    site.save(df, "parted", by=["p"])
    name = f"{site.hot}.parted"
    site.spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('kept' = 'yes')")
    files = lambda p: {r[0] for r in site.rows("parted").where(f"p = '{p}'").select(F.input_file_name()).collect()}
    untouched = files("c")
    cut = parse_boundary("10", "bigint")
    assert tables.remove_time(site.spark, name, "recordTimestamp", cut, f"{site.hot}.scratch") == 2
    assert sorted((r.recordTimestamp, r.v, r.p) for r in site.rows("parted").collect()) == [(5, None, "c"), (20, 2, "a"), (30, 4, "c")]
    assert files("c") == untouched and catalog.properties(site.spark, name)["kept"] == "yes"
    assert "scratch" not in site.kinds()
    tables.copy_without_time(site.spark, name, "recordTimestamp", parse_boundary("20", "bigint"), f"{site.hot}.copied")
    assert site.rows("copied").count() == 2 and catalog.properties(site.spark, f"{site.hot}.copied")["kept"] == "yes"


@pytest.mark.parametrize("kind", ["tinyint", "smallint", "int"])
def test_sentinel_of_narrow_times(site, kind):
    from tierview.operators import boundary

    empty = site.spark.range(0).selectExpr(f"CAST(id AS {kind}) AS recordTimestamp")
    assert boundary.boundary_frame(empty, TableSpec()).first()[0] == 9999999999999
    assert boundary.global_boundary(empty, TableSpec()) == sentinel("bigint")
    full = site.spark.range(5, 9).selectExpr(f"CAST(id AS {kind}) AS recordTimestamp")
    assert boundary.boundary_frame(full, TableSpec()).first()[0] == 5
