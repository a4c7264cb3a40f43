"""One question to the catalog for each table, several together, and what becomes of tables that it cannot describe."""

from __future__ import annotations

import itertools
import threading
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tierview.sources import catalog

_ids = itertools.count()

KINDS = (
    "a tinyint, b smallint, c int, d bigint, e float, f double, g decimal(20,3), h string, i varchar(5), j char(3), k binary, l boolean, "
    "m date, n timestamp, o timestamp_ntz, p array<struct<`x y`:int,y:map<string,array<date>>>>, q interval day to second, r variant"
)


@pytest.fixture
def db(spark):
    name = f"survey{next(_ids)}"
    spark.sql(f"CREATE DATABASE {name}")
    return name


def counted(monkeypatch, broken=()):
    asked, plain, under_way, most = Counter(), catalog.describe, [0], [0]
    lock = threading.Lock()

    def describe(spark, table):
        with lock:
            asked[table] += 1
            under_way[0] += 1
            most[0] = max(most[0], under_way[0])
        try:
            time.sleep(0.01)
            if table.rpartition(".")[2] in broken:
                raise RuntimeError("no such store")
            return plain(spark, table)
        finally:
            with lock:
                under_way[0] -= 1

    monkeypatch.setattr(catalog, "describe", describe)
    return asked, most


def test_each_table_is_asked_once_and_several_together(spark, db, monkeypatch):
    names = [f"t{n:03}" for n in range(150)]
    for n in names:
        spark.sql(f"CREATE TABLE {db}.{n} (a int, b string) USING parquet")
    asked, most = counted(monkeypatch, broken={"t007"})
    found = catalog.survey(spark, db)
    assert [a.table for a in found] == names and asked == {f"{db}.{n}": 1 for n in names}
    assert 1 < most[0] <= catalog.AT_ONCE
    assert [(a.table, a.error, a.columns) for a in found if a.error] == [("t007", "no such store", ())]
    frame = catalog.survey_frame(spark, found)
    assert frame.where("error IS NOT NULL").count() == 1 and frame.where(F.size("columns") == 2).count() == 149
    asked.clear()
    assert catalog.columns(spark, db).count() == 298 and set(asked.values()) == {1}


def test_types_defaults_partitions_and_properties(spark, db):
    spark.sql(f"CREATE TABLE {db}.t ({KINDS}, z string DEFAULT 'x') USING parquet PARTITIONED BY (m) TBLPROPERTIES ('k' = 'v')")
    spark.sql(f"CREATE VIEW {db}.v AS SELECT c, p FROM {db}.t")
    table, view = catalog.survey(spark, db)
    want = catalog.column_rows(spark.table(f"{db}.t"), "t")
    assert [("t", n, *told) for n, told in enumerate(table.columns)] == want
    assert (table.kind, table.provider, table.partition_columns, table.properties["k"]) == ("TABLE", "parquet", ("m",), "v")
    assert view.kind == "VIEW" and view.view_text == f"SELECT c, p FROM {db}.t" and len(view.columns) == 2
    assert [tuple(r) for r in catalog.columns(spark, db).collect()] == want + catalog.column_rows(spark.table(f"{db}.v"), "v")


def test_views_of_ours(spark, db, monkeypatch):
    for n in range(20):
        ours = f"TBLPROPERTIES ('{catalog.MANAGED}' = 'true')" if n % 2 else ""
        spark.sql(f"CREATE VIEW {db}.v{n:02} {ours} AS SELECT 1 AS x")
    asked, _ = counted(monkeypatch)
    assert catalog.managed_views(spark, db) == [f"v{n:02}" for n in range(1, 20, 2)]
    assert set(asked.values()) == {1}
    monkeypatch.undo()
    counted(monkeypatch, broken={"v03"})
    with pytest.raises(catalog.CatalogError, match="v03"):
        catalog.managed_views(spark, db)
