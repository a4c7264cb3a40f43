"""The ledger of files: what passes read, what they refuse, and which files a range read opens."""

from __future__ import annotations

import itertools
import os
from dataclasses import replace
from urllib.parse import unquote, urlparse

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierview import PartitionRule, TableSpec, TierConfig, TierPair
from tierview.jobs import JobError, refresh_all, run_init, tier_agreement, unified_range, update
from tierview.operators.boundary import misplacement
from tierview.sources import files, ledger, views

MONTH = PartitionRule("ym", "date_format({t}, 'yyyyMM')")
_ids = itertools.count()


class Site:
    """A table of 200 days in both tiers, hot from day 100, by month and with a ledger; and one without a rule."""

    def __init__(self, spark):
        n = next(_ids)
        self.spark, self.hot, self.cold = spark, f"lhot{n}", f"lcold{n}"
        for db in (self.hot, self.cold):
            spark.sql(f"CREATE DATABASE {db}")
        days = self.days(0, 200)
        self.append(days.where("id >= 100"), "daily", self.hot, ["ym"])
        self.append(days.where("id < 150"), "daily", self.cold, ["ym"])
        self.append(days.where("id >= 100").drop("ym"), "flat", self.hot, files=5)
        self.append(days.where("id < 150").drop("ym"), "flat", self.cold, files=5)
        rule = {"hot_partition": MONTH, "cold_partition": MONTH}
        specs = {"daily": TableSpec("d", "date", **rule), "flat": TableSpec("d", "date")}
        self.config = TierConfig((TierPair("p", self.hot, self.cold, "_hot"),), specs, ledger=f"{self.hot}_ops.seen")
        spark.sql(f"CREATE DATABASE {self.hot}_ops")

    def days(self, start, end):
        at = F.expr("date_add(DATE '2024-01-01', cast(id as int))")
        return self.spark.range(start, end).withColumn("d", at).withColumn("ym", F.date_format("d", "yyyyMM"))

    def append(self, df, name, db, by=(), files=1):
        df.repartitionByRange(files, "id").write.mode("append").partitionBy(*by).saveAsTable(f"{db}.{name}")

    def seen(self):
        watched = {}
        for db, name in ((self.hot, "daily_hot"), (self.cold, "daily")):
            df = files.table_of_files(self.spark, f"{db}.{name}", "d")
            watched[f"{db}.{name}"] = ledger.Watched(df, "d", MONTH)
        return ledger.observe(self.spark, self.config.ledger, watched)

    def boundary(self, name):
        return views.view_boundary(self.spark, f"{self.hot}.{name}").text


@pytest.fixture
def site(spark):
    site = Site(spark)
    run_init(spark, site.config)
    refresh_all(spark, site.config)  # the rename has moved the hot files
    return site


def statuses(df):
    return {r.tbl: r.status for r in df.collect()}


def on_disk(df):
    return [unquote(urlparse(name).path) for name in df.inputFiles()]


class Unreadable:
    """Files that hold rubbish meanwhile, with their size and time of change kept."""

    def __init__(self, *frames):
        self.paths = [path for df in frames for path in on_disk(df)]

    def __enter__(self):
        self.kept = []
        for path in self.paths:
            about = os.stat(path)
            self.kept.append((path, open(path, "rb").read(), about))
            with open(path, "r+b") as file:
                file.write(b"?" * about.st_size)
            os.utime(path, ns=(about.st_atime_ns, about.st_mtime_ns))

    def __exit__(self, *_):
        for path, data, about in self.kept:
            with open(path, "r+b") as file:
                file.write(data)
            os.utime(path, ns=(about.st_atime_ns, about.st_mtime_ns))


def tables(site, *names):
    return [site.spark.table(n.format(hot=site.hot, cold=site.cold)) for n in names]


ALL = ("{hot}.daily_hot", "{cold}.daily", "{hot}.flat_hot")


def test_unchanged_tables_are_not_read(site):
    with Unreadable(*tables(site, *ALL)):
        assert statuses(refresh_all(site.spark, site.config)) == {"daily": "unchanged", "flat": "unchanged"}
        assert statuses(update(site.spark, site.config, "p", "daily", "2024-05-01")) == {"daily": "updated"}
        with pytest.raises(JobError):
            refresh_all(site.spark, replace(site.config, ledger=None))


def test_only_new_files_are_read(site):
    old = tables(site, *ALL)
    with Unreadable(*old):
        site.append(site.days(90, 95), "daily_hot", site.hot, ["ym"])
        site.append(site.days(95, 98).drop("ym"), "flat_hot", site.hot)
        assert statuses(refresh_all(site.spark, site.config)) == {"daily": "updated", "flat": "updated"}
    assert (site.boundary("daily"), site.boundary("flat")) == ("2024-03-31", "2024-04-05")


@pytest.mark.parametrize("tier", ["hot", "cold"])
def test_a_misplaced_row_in_a_new_file_is_refused(site, tier):
    wrong = site.days(120, 122).withColumn("ym", F.when(F.col("id") == 121, "202401").otherwise(F.col("ym")))
    name, db = ("daily_hot", site.hot) if tier == "hot" else ("daily", site.cold)
    site.append(wrong, name, db, ["ym"])
    for _ in range(2):  # also when the file is known
        with pytest.raises(JobError, match="partition rule"):
            refresh_all(site.spark, site.config)
        with pytest.raises(Exception, match="partition rule"):
            update(site.spark, site.config, "p", "daily", "2024-05-01")
    assert site.boundary("daily") == "2024-04-10"
    site.spark.sql(f"ALTER TABLE {db}.{name} DROP PARTITION (ym = '202401')") if tier == "hot" else None
    if tier == "hot":
        assert statuses(refresh_all(site.spark, site.config)) == {"daily": "unchanged", "flat": "unchanged"}


def test_files_that_go_or_change_count_no_more(site):
    site.spark.sql(f"ALTER TABLE {site.hot}.daily_hot DROP PARTITION (ym = '202404')")
    refresh_all(site.spark, site.config)
    assert site.boundary("daily") == "2024-05-01"
    site.days(130, 140).drop("ym").write.mode("overwrite").insertInto(f"{site.hot}.flat_hot")
    refresh_all(site.spark, site.config)
    assert site.boundary("flat") == "2024-05-10"
    site.spark.sql(f"TRUNCATE TABLE {site.hot}.flat_hot")
    refresh_all(site.spark, site.config)
    assert site.boundary("flat") == "9999-12-31"


def test_a_lost_or_partial_ledger_is_filled_again(site):
    whole = site.seen()
    assert all(s.new_files == 0 and s.misplaced == 0 for s in whole.values())
    site.spark.sql(f"TRUNCATE TABLE {site.config.ledger}")
    again = site.seen()
    assert {n: s.new_files for n, s in again.items()} == {n: s.files for n, s in whole.items()}
    assert {n: replace(s, new_files=0) for n, s in again.items()} == whole
    # Entries that are there twice count once, and compaction keeps what they say.
    twice = site.spark.table(site.config.ledger)
    ledger.add(site.spark, site.config.ledger, site.spark.createDataFrame(twice.collect(), twice.schema))
    assert site.seen() == whole
    ledger.compact(site.spark, site.config.ledger)
    assert site.seen() == whole
    assert site.spark.table(site.config.ledger).count() == sum(s.files for s in whole.values())


def test_another_declaration_is_measured_anew(site):
    days = PartitionRule("ym", "date_format(date_add({t}, 1), 'yyyyMM')")
    df = files.table_of_files(site.spark, f"{site.hot}.daily_hot", "d")
    seen = ledger.observe(site.spark, site.config.ledger, {f"{site.hot}.daily_hot": ledger.Watched(df, "d", days)})
    (found,) = seen.values()
    assert found.new_files == found.files and found.misplaced == df.where(misplacement("d", days)).count() > 0


def test_many_new_files_are_read_in_one_scan(site, monkeypatch):
    monkeypatch.setattr(files, "LISTED", 1)
    monkeypatch.setattr(files, "_footer", lambda *_: None)
    site.spark.sql(f"TRUNCATE TABLE {site.config.ledger}")
    assert statuses(refresh_all(site.spark, site.config)) == {"daily": "unchanged", "flat": "unchanged"}


KINDS = {
    "day": "date_add(DATE '2024-02-27', cast(id as int))",
    "early": "date_add(DATE '1970-01-05', -cast(id as int))",
    "moment": "timestamp_ntz '2024-02-27 23:59:59.999998' + make_dt_interval(0, 0, 0, id / 1000000)",
    "zoned": "timestamp '2024-02-27 23:59:59.999998' + make_dt_interval(cast(id as int))",
    "number": "id - 7",
    "small": "cast(id - 7 as smallint)",
}


@pytest.mark.parametrize("name", KINDS)
@pytest.mark.parametrize("zoned_as", ["INT96", "TIMESTAMP_MICROS"])
def test_footers_and_scans_say_the_same(spark, tmp_path, name, zoned_as):
    spark.conf.set("spark.sql.parquet.outputTimestampType", zoned_as)
    try:
        rows = spark.range(0, 40, 1, 4).select(F.when(F.col("id") % 5 != 0, F.expr(KINDS[name])).alias("t"), "id")
        rows.union(rows.where("id < 0")).write.parquet(str(tmp_path / "t"))
    finally:
        spark.conf.unset("spark.sql.parquet.outputTimestampType")
    df = spark.read.parquet(str(tmp_path / "t"))
    want = sorted(map(tuple, files.scanned(df, "t", None).select("file", "n_rows", "timed", "low", "high", "low_at", "high_at").collect()))
    kind = df.schema["t"].dataType
    got = sorted(map(tuple, files.footers(files.listing(df), 4, "t", kind).where("n_rows > 0").collect()))
    assert got == ([] if name == "zoned" and zoned_as == "INT96" else want)
    low, high = files.scanned(df, "t", None).agg(F.min(files.value("low", kind)), F.max(files.value("high", kind))).first()
    assert (low, high) == df.agg(F.min("t"), F.max("t")).first()


def test_footers_that_do_not_tell(spark, tmp_path):
    plain = spark.range(10).selectExpr("cast(id as string) AS text", "id AS n", "timestamp_ntz '2024-01-01 00:00:00' AS t")
    plain.write.option("parquet.column.statistics.enabled", "false").parquet(str(tmp_path / "bare"))
    plain.write.json(str(tmp_path / "json"))
    for folder, column, kind in (("bare", "gone", T.LongType()), ("bare", "text", T.LongType()), ("bare", "t", T.TimestampType()), ("json", "n", T.LongType())):
        path = str(tmp_path / folder)
        df = spark.read.parquet(path) if folder == "bare" else spark.read.json(path)
        assert files.footers(files.listing(df), 1, column, kind).count() == 0
    assert files.listing(plain).count() == 0 and not files.supported(T.StringType())


def test_partitions_in_paths_prove_the_rule(spark):
    """Odd characters in partition values and two partition columns; a wrong file is left to the scan."""
    spark.sql("CREATE DATABASE IF NOT EXISTS odd")
    rule = PartitionRule("day of", "concat('a b+c/d=', date_format({t}, 'yyyy:MM'), '%')")
    days = spark.range(90).withColumn("d", F.expr("date_add(DATE '2024-01-01', cast(id as int))")).withColumn("k", F.col("id") % 2)
    good = days.withColumn("day of", F.expr(rule.of("d")))
    wrong = days.where("id = 3").withColumn("day of", F.lit("other"))
    good.unionByName(wrong).coalesce(1).write.partitionBy("k", "day of").saveAsTable("odd.places")
    watched = ledger.Watched(files.table_of_files(spark, "odd.places", "d"), "d", rule)
    now = ledger.listings({"odd.places": watched})
    told = ledger.from_footers(watched, now, now.count())
    assert told.count() == now.count() - 1 and told.agg(F.sum("misplaced")).first()[0] == 0
    (seen,) = ledger.observe(spark, "odd.seen", {"odd.places": watched}).values()
    assert (seen.n_rows, seen.misplaced, seen.low) == (91, 1, "2024-01-01")


def test_what_is_no_table_of_files(spark, site):
    assert files.table_of_files(spark, f"{site.hot}.daily", "d") is None  # a view
    assert files.table_of_files(spark, f"{site.hot}.nothing", "d") is None
    spark.sql(f"CREATE TABLE {site.hot}.texts (d string, x double) USING parquet")
    assert files.table_of_files(spark, f"{site.hot}.texts", "d") is None
    assert files.table_of_files(spark, f"{site.hot}.texts", "y") is None


def read(df):
    """The rows of a frame that was not read before, and how many files were opened for them."""
    rows = sorted(map(tuple, df.collect()))
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    counts = [leaves.apply(n).metrics().get("numFiles") for n in range(leaves.size())]
    return rows, sum(count.get().value() for count in counts if count.isDefined())


@pytest.mark.parametrize(
    ("start", "end", "most"),
    [("2024-06-01", "2024-06-03", 1), ("2024-01-10", "2024-01-12", 1), ("2024-04-08", "2024-04-12", 3), (None, "2024-01-05", 1), ("2024-07-10", None, 1), ("2030-01-01", None, 0)],
)
def test_a_range_read_opens_only_files_that_can_hold_it(site, start, end, most):
    for db, name in ((site.hot, "flat_hot"), (site.cold, "flat")):
        df = files.table_of_files(site.spark, f"{db}.{name}", "d")
        ledger.observe(site.spark, site.config.ledger, {f"{db}.{name}": ledger.Watched(df, "d")})
    plain, all_files = read(unified_range(site.spark, replace(site.config, ledger=None), "p", "flat", start, end))
    ours, some = read(unified_range(site.spark, site.config, "p", "flat", start, end))
    assert ours == plain
    assert some <= most and all_files >= 5


def test_a_file_without_an_entry_is_read(site):
    site.append(site.days(160, 162).drop("ym"), "flat_hot", site.hot)
    got = unified_range(site.spark, site.config, "p", "flat", "2024-06-09", "2024-06-12")
    assert sorted(r.id for r in got.collect()) == [160, 160, 161, 161, 162]


def test_a_range_over_many_files_is_not_listed(site, monkeypatch):
    monkeypatch.setattr(files, "LISTED", 1)
    got = unified_range(site.spark, site.config, "p", "flat", "2024-04-01", "2024-07-01")
    assert got.count() == 91


def test_tiers_are_compared_where_they_overlap(site):
    spark = site.spark
    same, apart = tier_agreement(spark, site.config, "p", "daily")
    assert same.count() == 50 and same.where("NOT agrees").isEmpty() and apart.isEmpty()
    site.append(site.days(120, 122), "daily_hot", site.hot, ["ym"])
    site.append(site.days(140, 141).withColumn("id", F.lit(-1).cast("bigint")), "daily", site.cold, ["ym"])
    same, apart = tier_agreement(spark, site.config, "p", "daily", "2024-04-11", None, 7)
    assert same.where("NOT agrees").count() == 2
    assert sorted((r.id, r.n_hot, r.n_cold) for r in apart.collect()) == [(-1, 0, 1), (120, 2, 1), (121, 2, 1)]
    same, apart = tier_agreement(spark, site.config, "p", "daily", None, "2024-04-20")
    assert same.count() == 10 and apart.isEmpty()
    spark.sql(f"TRUNCATE TABLE {site.cold}.flat")
    same, apart = tier_agreement(spark, site.config, "p", "flat")
    assert same.isEmpty() and apart.isEmpty()


def test_batches_and_compaction_change_nothing(site, monkeypatch):
    whole = site.seen()
    monkeypatch.setattr(ledger, "TABLES_PER_JOB", 1)
    monkeypatch.setattr(ledger, "COMPACTED_FROM", 0)
    site.append(site.days(90, 92), "daily_hot", site.hot, ["ym"])
    seen = site.seen()
    name = f"{site.hot}.daily_hot"
    assert seen[name].low == "2024-03-31" and seen[name].new_files == 2 and seen[name].n_rows == whole[name].n_rows + 2
    assert {n: s for n, s in seen.items() if n != name} == {n: s for n, s in whole.items() if n != name}
    assert statuses(refresh_all(site.spark, site.config)) == {"daily": "updated", "flat": "unchanged"}
