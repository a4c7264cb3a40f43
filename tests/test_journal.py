"""Several views as one change: runs that fail or break off at every step."""

from __future__ import annotations

import itertools

import pytest

from tierview import TableSpec, TierConfig, TierPair
from tierview.jobs import JobError, journal, refresh_all, run_init, update_many
from tierview.sources import views

_ids = itertools.count()
TABLES = ["a", "b", "c"]


class Broken(BaseException):
    """The process ends here: nothing after it runs."""


@pytest.fixture
def site(spark):
    n = next(_ids)
    hot, cold, ops = f"jhot{n}", f"jcold{n}", f"jops{n}"
    for db in (hot, cold, ops):
        spark.sql(f"CREATE DATABASE {db}")
    for name in TABLES:
        spark.range(50, 100).selectExpr("id AS t", "id AS x").write.saveAsTable(f"{hot}.{name}")
        spark.range(0, 70).selectExpr("id AS t", "id AS x").write.saveAsTable(f"{cold}.{name}")
    specs = {name: TableSpec("t", "bigint") for name in TABLES}
    config = TierConfig((TierPair("p", hot, cold, "_hot"),), specs, journal=f"{ops}.journal")
    run_init(spark, config)
    return spark, config, hot


def cuts(site):
    return [views.view_boundary(site[0], f"{site[2]}.{name}").value for name in TABLES]


def to(*values):
    return list(zip(TABLES, values))


def states(site):
    told = site[0].table(site[1].journal).where("state <> 'planned'").orderBy("at")
    return [r.state for r in told.collect()]


def failing(monkeypatch, at, error):
    """The ``at``-th view cannot be changed."""
    calls, plain = itertools.count(), views.alter_view

    def alter(*args):
        if next(calls) == at:
            raise error
        return plain(*args)

    monkeypatch.setattr(views, "alter_view", alter)


def test_all_views_change_and_the_journal_says_so(site):
    spark, config, _ = site
    update_many(spark, config, "p", to(55, 56, 57))
    assert cuts(site) == [55, 56, 57] and states(site) == ["done"]
    update_many(spark, config, "p", to(55, 56, 57))  # nothing to change, nothing to write down
    assert states(site) == ["done"] and journal.open_runs(spark, config.journal) == {}


@pytest.mark.parametrize("at", range(3))
@pytest.mark.parametrize("job", ["update", "refresh"])
def test_a_failure_puts_back_what_came_before(site, monkeypatch, at, job):
    spark, config, hot = site
    update_many(spark, config, "p", to(60, 61, 62))
    failing(monkeypatch, at, RuntimeError("no"))
    with pytest.raises(JobError, match="put back") as caught:
        update_many(spark, config, "p", to(55, 56, 57)) if job == "update" else refresh_all(spark, config)
    assert cuts(site) == [60, 61, 62] and states(site) == ["done", "undone"]
    assert [r[2] for r in caught.value.results] == ["restored"] * at + ["failed"]
    monkeypatch.undo()
    refresh_all(spark, config)
    assert cuts(site) == [50, 50, 50]


@pytest.mark.parametrize("at", range(3))
def test_a_run_that_breaks_off_is_undone_by_the_next(site, monkeypatch, at):
    spark, config, _ = site
    failing(monkeypatch, at, Broken())
    with pytest.raises(Broken):
        update_many(spark, config, "p", to(55, 56, 57))
    monkeypatch.undo()
    assert cuts(site) == [55, 56, 57][:at] + [50] * (3 - at)
    with pytest.raises(ValueError):  # the next run ends it, whatever becomes of itself
        update_many(spark, config, "p", [("a", None)])
    assert cuts(site) == [50, 50, 50] and states(site) == ["undone"]


def test_a_run_that_breaks_off_after_all_views_is_done(site, monkeypatch):
    spark, config, _ = site
    monkeypatch.setattr(journal, "end", lambda *_: (_ for _ in ()).throw(Broken()))
    with pytest.raises(Broken):
        update_many(spark, config, "p", to(55, 56, 57))
    monkeypatch.undo()
    assert journal.recover(spark, config.journal) and cuts(site) == [55, 56, 57] and states(site) == ["done"]
    assert journal.recover(spark, config.journal) == {}


def test_a_run_that_breaks_off_while_it_puts_back(site, monkeypatch):
    spark, config, _ = site
    failing(monkeypatch, 2, RuntimeError("no"))
    plain, calls = journal.set_text, itertools.count()
    monkeypatch.setattr(journal, "set_text", lambda *args: plain(*args) if next(calls) < 1 else (_ for _ in ()).throw(Broken()))
    with pytest.raises(Broken):
        update_many(spark, config, "p", to(55, 56, 57))
    monkeypatch.undo()
    assert cuts(site) == [55, 50, 50]
    refresh_all(spark, config)
    assert cuts(site) == [50, 50, 50] and states(site)[0] == "undone"


def test_what_someone_else_changed_is_left(site, monkeypatch):
    spark, config, hot = site
    failing(monkeypatch, 2, Broken())
    with pytest.raises(Broken):
        update_many(spark, config, "p", to(55, 56, 57))
    monkeypatch.undo()
    spark.sql(f"ALTER VIEW {hot}.b AS SELECT 1 AS t, 2 AS x")
    with pytest.raises(journal.JournalError, match="b"):
        journal.recover(spark, config.journal)
    assert views.view_boundary(spark, f"{hot}.a").value == 50
    assert journal.recover(spark, config.journal) == {}


def test_a_view_that_is_gone(site, monkeypatch):
    spark, config, hot = site
    failing(monkeypatch, 1, Broken())
    with pytest.raises(Broken):
        update_many(spark, config, "p", to(55, 56, 57))
    monkeypatch.undo()
    spark.sql(f"DROP VIEW {hot}.c")
    with pytest.raises(journal.JournalError, match="c"):
        journal.recover(spark, config.journal)
    assert views.view_boundary(spark, f"{hot}.a").value == 50
