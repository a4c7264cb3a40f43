"""Jobs over many tables: bring them into the unified state, move their boundaries, take them back.

Data work (finding boundaries) runs as Spark jobs; the rest are catalog changes, one table after the
other. No transaction spans them. Instead every step may be repeated, and each run derives what is left
to do from the state of the catalog.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierview.functions import sqltext
from tierview.functions.boundaries import Boundary, parse_boundary
from tierview.jobs import journal
from tierview.jobs.results import JobError, Results, StepError, step
from tierview.operators import agreement
from tierview.operators.boundary import PartitionError, many_boundaries, misplaced_rows, parsed
from tierview.operators.unify import cold_scan, read_range, unified_sql, unify
from tierview.plans import lifecycle as plans
from tierview.plans.mapping import MappingPlan, reconcile
from tierview.plans.spec import PartitionRule, TableSpec, TierConfig, TierPair
from tierview.sources import catalog, files, ledger, tables, views

# Stands for a table's name in the result of a step that concerns the whole pair.
ALL_TABLES = "(all)"


def _states(spark: SparkSession, config: TierConfig, pair: TierPair) -> DataFrame:
    cold = catalog.list_tables(spark, pair.cold_db).select("table")
    return plans.table_states(cold, catalog.list_tables(spark, pair.hot_db), pair.suffix, config.ignore)


def init_plan(spark: SparkSession, config: TierConfig, pair: TierPair) -> DataFrame:
    return plans.plan_init(_states(spark, config, pair))


def rollback_plan(spark: SparkSession, config: TierConfig, pair: TierPair) -> DataFrame:
    return plans.plan_rollback(_states(spark, config, pair))


def _mapping(spark: SparkSession, pair: TierPair, table: str, hot_table: str, spec: TableSpec) -> MappingPlan:
    hot = spark.table(sqltext.table_ref(pair.hot_db, hot_table)).schema
    cold = spark.table(sqltext.table_ref(pair.cold_db, table)).schema
    return reconcile(hot, cold, spec)


def _names(pair: TierPair, table: str) -> tuple[str, str, str]:
    return f"{pair.hot_db}.{table}", f"{pair.hot_db}.{table}{pair.suffix}", f"{pair.cold_db}.{table}"


def run_init(spark: SparkSession, config: TierConfig) -> DataFrame:
    """Bring every table of every pair into the unified state; the first error stops the run.

    Within a pair, name conflicts, schemas that cannot be served and rows that break a partition rule are found
    before any table changes, and so are the boundaries, in batches. What is left then is a rename and a view.
    """
    results = Results()
    for pair in config.pairs:
        work: list[tuple] = []
        with _recorded(results, pair, None, f"init of {pair.name}"), step("precheck"):
            for name, source in sorted(pair.cold_sources.items()):
                catalog.register_cold(spark, f"{pair.cold_db}.{name}", source)
            todo = init_plan(spark, config, pair).orderBy("base_table").collect()
        for row in todo:
            table, spec = row.base_table, config.of(pair, row.base_table)
            with _recorded(results, pair, table, f"init of {pair.name}.{table}"):
                if row.action == plans.CONFLICT:
                    raise StepError("precheck", tables.TableError(row.reason))
                if row.action != plans.SKIP:
                    current = table if row.action == plans.RENAME_AND_CREATE else row.suffixed_table
                    with step("mapping"):
                        work.append((table, current, _mapping(spark, pair, table, current, spec)))
        lows = _boundaries(spark, config, pair, work, results, "init")
        mapped = {table: plan for table, _, plan in work}
        for row in todo:
            table = row.base_table
            if row.action == plans.SKIP:
                results.done(pair.name, table, "skipped", row.reason)
                continue
            view, hot, cold = _names(pair, table)

            def create(view=view, plan=mapped[table], low=lows[table], hot=hot, cold=cold) -> None:
                with step("create_view"):
                    views.create_view(spark, view, plan, low, hot, cold)

            with _recorded(results, pair, table, f"init of {pair.name}.{table}"):
                if row.action == plans.RENAME_AND_CREATE:
                    with step("rename"):
                        tables.rename(spark, pair.hot_db, table, row.suffixed_table, then=create)
                else:
                    create()
            results.done(pair.name, table, "created", lows[table].text)
    return results.frame(spark)


@contextmanager
def _recorded(results: Results, pair: TierPair, table: str | None, what: str) -> Iterator[None]:
    """Put a failure into the results, then stop the job. Without a table it is one of the whole pair."""
    try:
        yield
    except Exception as error:
        results.failed(pair.name, table or ALL_TABLES, error)
        raise results.stop(f"{what} failed: {sqltext.error_text(error)}") from error


def _ruled(spark: SparkSession, pair: TierPair, work: list[tuple[str, str, MappingPlan]]) -> dict[str, tuple]:
    """The tiers of these tables that have a partition rule: frame, column and the rule to prove, by name."""
    rules = {}
    for table, current, plan in work:
        spec = plan.spec
        if spec.hot_partition is not None:
            hot = spark.table(sqltext.table_ref(pair.hot_db, current))
            rules[f"{pair.hot_db}.{current}"] = (hot, spec.time_column, spec.hot_partition)
        if spec.cold_partition is not None:
            cold = spark.table(sqltext.table_ref(pair.cold_db, table))
            rules[f"{pair.cold_db}.{table}"] = (cold, plan.time_rule.cold_column, spec.cold_partition)
    return rules


def _seen(
    spark: SparkSession, config: TierConfig, tables: dict[str, tuple[str, PartitionRule | None]]
) -> dict[str, ledger.Seen]:
    """What the ledger says of those tables that are made of files, given time column and rule; new files are read."""
    if config.ledger is None:
        return {}
    frames = {name: files.table_of_files(spark, name, time) for name, (time, _) in tables.items()}
    watched = {n: ledger.Watched(df, *tables[n]) for n, df in frames.items() if df is not None}
    return ledger.observe(spark, config.ledger, watched)


def _prove(
    spark: SparkSession, pair: TierPair, work: list[tuple[str, str, MappingPlan]], seen: dict[str, ledger.Seen]
) -> None:
    """Every rule of these tables on every row, since a row that breaks one would vanish from the view.

    Of tables that ``seen`` tells of nothing is read. Of any other two columns of a tier are, and nothing where no rule
    is declared.
    """
    rules = _ruled(spark, pair, work)
    found = {name: seen[name].misplaced for name in rules if name in seen}
    rest = {name: given for name, given in rules.items() if name not in seen}
    found |= misplaced_rows(rest) if rest else {}
    broken = {name: n for name, n in sorted(found.items()) if n}
    if broken:
        raise PartitionError(f"rows are not where the partition rule says: {broken}")


def _boundaries(
    spark: SparkSession,
    config: TierConfig,
    pair: TierPair,
    work: list[tuple[str, str, MappingPlan]],
    results: Results,
    job: str,
) -> dict[str, Boundary]:
    """The smallest hot time of each table, given its current name and mapping; its rules are proved."""

    def found(some: list[tuple[str, str, MappingPlan]]) -> dict[str, Boundary]:
        specs = {f"{pair.hot_db}.{current}": plan.spec for _, current, plan in some}
        wanted = {name: (spec.time_column, spec.hot_partition) for name, spec in specs.items()}
        wanted |= {name: (time, rule) for name, (_, time, rule) in _ruled(spark, pair, some).items()}
        seen = _seen(spark, config, wanted)
        lows = {n: parsed(seen[n].low, spec) for n, spec in specs.items() if n in seen}
        lows |= many_boundaries(spark, {n: spec for n, spec in specs.items() if n not in seen})
        _prove(spark, pair, some, seen)
        return {table: lows[f"{pair.hot_db}.{current}"] for table, current, _ in some}

    try:
        return found(work) if work else {}
    except Exception as error:  # noqa: BLE001 - which table it was is found below
        for one in work:
            with _recorded(results, pair, one[0], f"{job} of {pair.name}.{one[0]}"), step("precheck"):
                found([one])
        results.failed(pair.name, ALL_TABLES, error)
        raise results.stop(f"{job} of {pair.name} failed: {sqltext.error_text(error)}") from error


def _checked(spark: SparkSession, config: TierConfig, pair: TierPair, table: str) -> MappingPlan:
    """Mapping of a view that exists and whose new text would be accepted."""
    view, hot, cold = _names(pair, table)
    if views.object_kind(spark, view) != catalog.VIEW:
        raise views.ViewError(f"view {view} does not exist")
    return _mapping(spark, pair, table, f"{table}{pair.suffix}", config.of(pair, table))


def update(
    spark: SparkSession, config: TierConfig, pair_name: str, table: str, boundary: str | int | Boundary
) -> DataFrame:
    """Cut one view at the given boundary and rebuild its columns.

    No data is read, but for the two columns of each tier with a partition rule, which is proved first; with a ledger,
    of its new files only.
    """
    return update_many(spark, config, pair_name, [(table, boundary)])


def update_many(
    spark: SparkSession, config: TierConfig, pair_name: str, targets: Sequence[tuple[str, str | int | Boundary]]
) -> DataFrame:
    """:func:`update` for several views, in order. All targets are checked before any view changes.

    With a journal a failure puts the views before it back, and a run that broke off is ended first.
    """
    pair = config.pair(pair_name)
    if not targets:
        raise ValueError("no tables to update")
    _recovered(spark, config)
    work = []
    for table, value in targets:
        if not table.strip():
            raise ValueError("a target has no table name")
        if value is None or not str(value).strip():
            raise ValueError(f"{table}: a boundary is needed")
        kind = config.of(pair, table).time_type
        wanted = value if isinstance(value, Boundary) and value.kind == kind else None
        boundary = wanted or parse_boundary(value.text if isinstance(value, Boundary) else value, kind)
        work.append((table, boundary, _checked(spark, config, pair, table)))
    proved = [(table, f"{table}{pair.suffix}", plan) for table, _, plan in work]
    ruled = _ruled(spark, pair, proved)
    _prove(spark, pair, proved, _seen(spark, config, {name: (time, rule) for name, (_, time, rule) in ruled.items()}))
    for table, boundary, plan in work:
        _, hot, cold = _names(pair, table)
        # Analysis only: types the catalog would refuse are found here.
        spark.sql(unified_sql(plan, boundary, hot, cold))
    results = Results()
    _alter_all(spark, config, [(pair, table, boundary, plan) for table, boundary, plan in work], results)
    return results.frame(spark)


def _alter_all(
    spark: SparkSession, config: TierConfig, work: list[tuple[TierPair, str, Boundary, MappingPlan]], results: Results
) -> None:
    """Re-point all views. With a journal all of them or, if one cannot be, none: what was changed is put back."""
    if config.journal is None:
        for one in work:
            _alter(spark, *one, results)
        return
    changes = []
    for pair, table, boundary, plan in work:
        view, hot, cold = _names(pair, table)
        changes.append(journal.Change(view, views.view_text(spark, view), unified_sql(plan, boundary, hot, cold)))
    changing = [c for c in changes if c.old != c.new]
    run = journal.plan(spark, config.journal, changing) if changing else None
    done = Results()
    try:
        for one in work:
            _alter(spark, *one, done)
    except JobError as error:
        results.rows += [(*r[:2], "restored", None, r[4]) if r[2] == "updated" else r for r in done.rows]
        journal.undo(spark, changing)
        journal.end(spark, config.journal, run, journal.UNDONE)
        raise results.stop(f"{error}; the views before it were put back") from error
    results.rows += done.rows
    if run:
        journal.end(spark, config.journal, run, journal.DONE)


def _alter(
    spark: SparkSession, pair: TierPair, table: str, boundary: Boundary, plan: MappingPlan, results: Results
) -> None:
    view, hot, cold = _names(pair, table)
    try:
        with step("alter_view"):
            changed = views.alter_view(spark, view, plan, boundary, hot, cold)
    except StepError as error:
        results.failed(pair.name, table, error)
        raise results.stop(f"update of {pair.name}.{table} failed: {error}") from error
    results.done(pair.name, table, "updated" if changed else "unchanged", boundary.text)


def refresh_all(spark: SparkSession, config: TierConfig) -> DataFrame:
    """Cut every unified view of every pair at the smallest time its hot table has now.

    One pass; whatever schedules it must not let two passes overlap. Views that this library did not
    create and ignored tables are left alone. With a ledger, tables whose files are the ones of the last pass
    are not read. With a journal the views of all pairs change as one: a failure puts those before it back.
    """
    results = Results()
    _recovered(spark, config)
    work_of_all = []
    for pair in config.pairs:
        with _recorded(results, pair, None, f"refresh of {pair.name}"), step("precheck"):
            found = [v for v in catalog.managed_views(spark, pair.hot_db) if v not in config.ignore]
        work = []
        for table in found:
            with _recorded(results, pair, table, f"refresh of {pair.name}.{table}"), step("mapping"):
                work.append((table, f"{table}{pair.suffix}", _checked(spark, config, pair, table)))
        lows = _boundaries(spark, config, pair, work, results, "refresh")
        some = [(pair, table, lows[table], plan) for table, _, plan in work]
        if config.journal is None:
            _alter_all(spark, config, some, results)
        else:
            work_of_all += some
    _alter_all(spark, config, work_of_all, results)
    return results.frame(spark)


def _recovered(spark: SparkSession, config: TierConfig) -> None:
    """End a run over several views that broke off, before anything else is looked at."""
    if config.journal is not None:
        journal.recover(spark, config.journal)


def run_rollback(spark: SparkSession, config: TierConfig, on_error: str = "stop") -> DataFrame:
    """Drop the views and rename the hot tables back, from whatever state they are in.

    ``on_error="continue"`` goes on with the next table; the failures are in the result. Cold sources
    registered by :func:`run_init` are forgotten at the very end, those of pairs with failures are kept.
    """
    if on_error not in ("stop", "continue"):
        raise ValueError(f"on_error {on_error!r} is neither 'stop' nor 'continue'")
    results = Results()
    for pair in config.pairs:
        try:
            with step("precheck"):
                todo = rollback_plan(spark, config, pair).orderBy("base_table").collect()
        except StepError as error:
            results.failed(pair.name, ALL_TABLES, error)
            if on_error == "stop":
                raise results.stop(f"rollback of {pair.name} failed: {error}") from error
            continue
        for row in todo:
            table = row.base_table
            try:
                if row.blocked:
                    raise StepError("precheck", tables.TableError(f"{pair.hot_db}.{table}: {row.reason}"))
                # The view first: renaming the table under it would break it, and it holds the name.
                if row.drop_view:
                    with step("drop_view"):
                        views.drop_view(spark, f"{pair.hot_db}.{table}")
                if row.rename:
                    with step("rename_back"):
                        tables.rename_back(spark, pair.hot_db, row.suffixed_table, pair.suffix)
            except StepError as error:
                results.failed(pair.name, table, error)
                if on_error == "stop":
                    raise results.stop(f"rollback of {pair.name}.{table} failed: {error}") from error
                continue
            results.done(pair.name, table, "restored", row.reason)
    for pair in config.pairs:
        if results.failures(pair.name):
            continue
        for name in sorted(pair.cold_sources):
            try:
                with step("drop_cold"):
                    catalog.unregister_cold(spark, f"{pair.cold_db}.{name}")
            except StepError as error:
                results.failed(pair.name, name, error)
                if on_error == "stop":
                    raise results.stop(f"rollback of {pair.name}.{name} failed: {error}") from error
    return results.frame(spark)


def unified(spark: SparkSession, config: TierConfig, pair_name: str, table: str) -> DataFrame:
    """The unified table as a DataFrame, cut where its view is and with the view's columns."""
    pair = config.pair(pair_name)
    view, hot, cold = _names(pair, table)
    plan = _checked(spark, config, pair, table)
    boundary = views.view_boundary(spark, view)
    whole = unify(spark.table(sqltext.table_ref(hot)), spark.table(sqltext.table_ref(cold)), plan, boundary)
    return whole.select(*map(sqltext.column, spark.table(sqltext.table_ref(view)).columns))


def unified_range(
    spark: SparkSession, config: TierConfig, pair_name: str, table: str, start=None, end=None
) -> DataFrame:
    """Rows of the unified table with ``start <= time < end``, reading only the tiers concerned.

    Limits are boundaries or what :func:`parse_boundary` reads. Partitions are pruned by the rules that the
    view's text has, which were proved when it was written; a rule declared since is not relied on. With a ledger,
    files are left out whose entries say that they hold no row of the range; a file without an entry is read.
    """
    pair = config.pair(pair_name)
    view, hot, cold = _names(pair, table)
    plan = _checked(spark, config, pair, table)
    boundary, text = views.view_boundary(spark, view), views.view_text(spark, view)
    trusted = replace(
        plan.spec,
        hot_partition=plan.spec.hot_partition if plan.hot_time_filter(">=", boundary) in text else None,
        cold_partition=plan.spec.cold_partition if plan.cold_time_filter("<", boundary) in text else None,
    )
    limits = [v if v is None or isinstance(v, Boundary) else parse_boundary(v, plan.spec.time_type) for v in (start, end)]
    plain = replace(plan, spec=replace(plan.spec, hot_partition=None, cold_partition=None))
    frames = (
        _narrowed(spark, config, hot, plain.spec.time_column, plain.hot_time_filter, limits[0] or boundary, limits[1]),
        _narrowed(spark, config, cold, plain.time_rule.cold_column, plain.cold_time_filter, limits[0], limits[1] or boundary),
    )
    return read_range(*frames, replace(plan, spec=trusted), boundary, *limits)


def _narrowed(spark, config, table: str, column: str, time_filter, start: Boundary | None, end: Boundary | None) -> DataFrame:
    """A tier without the files that the ledger says hold nothing of the range."""
    df = files.table_of_files(spark, table, column) if config.ledger else None
    if df is None or not spark.catalog.tableExists(sqltext.table_ref(config.ledger)):
        return spark.table(sqltext.table_ref(table))
    bounds = [("high", time_filter(">=", start))] if start else []
    bounds += [("low", time_filter("<", end))] if end else []
    known = ledger.entries(spark, config.ledger, [table]).where("n_rows IS NOT NULL")
    # What was measured for another rule tells the times as well.
    watched = ledger.Watched(df, column)
    return ledger.narrowed(watched, ledger.retold(known, watched), *bounds)


def tier_agreement(
    spark: SparkSession, config: TierConfig, pair_name: str, table: str, start=None, end=None, width: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Whether both tiers of a unified table hold the same rows with ``start <= time < end``: by bucket, and the rows
    that one has more often (:mod:`tierview.operators.agreement`).

    Without limits it is where the tiers overlap: from the smallest hot time to the largest cold one. ``width`` is the
    length of a bucket, in days of a date and seconds or units of other times; a day unless given.
    """
    pair = config.pair(pair_name)
    _, hot, cold = _names(pair, table)
    plan = _checked(spark, config, pair, table)
    kind, time = plan.spec.time_type, plan.spec.time_column
    limits = [v if v is None or isinstance(v, Boundary) else parse_boundary(v, kind) for v in (start, end)]
    frames = [spark.table(sqltext.table_ref(t)) for t in (hot, cold)]
    if limits[0] is None:
        limits[0] = many_boundaries(spark, {hot: plan.spec})[hot]
    ours, theirs = agreement.overlap(*frames, plan, *limits)
    if limits[1] is None:
        # Beyond the last cold time hot has rows of its own.
        last = cold_scan(frames[1], plan).agg(F.max(sqltext.column(time)).cast("string")).first()[0]
        column = sqltext.column(time)
        ours = ours.where(F.lit(False) if last is None else column <= F.expr(plan.hot_literal(parse_boundary(last, kind))))
    width = width or agreement.WIDTHS[kind]
    return agreement.agreement(ours, theirs, time, width), agreement.differences(ours, theirs, time, width)
