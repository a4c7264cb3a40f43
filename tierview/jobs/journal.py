"""Changing several views as one: what was planned is written down first, and a run that fails puts back what it did.

The journal is a table to which rows are only added: of each run one for each view with its old and its new text, in one
write, and one more when the run has ended (``done`` or ``undone``). A run without such an end broke off; whoever comes
next ends it from the texts that the views have by then.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tierview.functions import sqltext
from tierview.sources import catalog, views

PLANNED, DONE, UNDONE = "planned", "done", "undone"
SCHEMA = "run string, seq int, view string, old_text string, new_text string, state string, at timestamp"


class JournalError(RuntimeError):
    """A broken run cannot be ended: someone else has changed its views since."""


@dataclass(frozen=True)
class Change:
    """A view, its text before the run and the text that the run gives it."""

    view: str
    old: str
    new: str


def create(spark: SparkSession, journal: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {sqltext.table_ref(journal)} ({SCHEMA}) USING parquet")


def _add(spark: SparkSession, journal: str, rows: list[tuple]) -> None:
    plain = spark.createDataFrame(rows, "run string, seq int, view string, old_text string, new_text string, state string")
    plain.coalesce(1).withColumn("at", F.current_timestamp()).write.insertInto(sqltext.table_ref(journal))


def plan(spark: SparkSession, journal: str, changes: Sequence[Change]) -> str:
    """Write down what a run is going to do, before it does any of it; returns the run's name."""
    run = uuid.uuid4().hex
    _add(spark, journal, [(run, n, c.view, c.old, c.new, PLANNED) for n, c in enumerate(changes)])
    return run


def end(spark: SparkSession, journal: str, run: str, state: str) -> None:
    _add(spark, journal, [(run, -1, None, None, None, state)])


def open_runs(spark: SparkSession, journal: str) -> dict[str, list[Change]]:
    """The runs that have not ended, the oldest first, with their changes in order."""
    spark.catalog.refreshTable(sqltext.table_ref(journal))
    told = spark.table(sqltext.table_ref(journal))
    ended = told.where(F.col("state") != PLANNED).select("run")
    # Runs that broke off: there is one at most, unless runs overlap.
    left = told.where(F.col("state") == PLANNED).join(ended, "run", "left_anti").orderBy("at", "run", "seq")
    out: dict[str, list[Change]] = {}
    for row in left.collect():
        out.setdefault(row.run, []).append(Change(row.view, row.old_text, row.new_text))
    return out


def set_text(spark: SparkSession, view: str, text: str) -> None:
    spark.sql(f"ALTER VIEW {sqltext.table_ref(view)} AS {text}")


def undo(spark: SparkSession, changes: Sequence[Change]) -> list[str]:
    """Give views that have the run's text their old one again, the last first; returns the views that were put back.

    A view that has neither text, or is gone, was changed by someone else since: it is left as it is, and an error at the
    end, after all others were put back.
    """
    back, strange = [], []
    for change in reversed(changes):
        text = views.view_text(spark, change.view) if views.object_kind(spark, change.view) == catalog.VIEW else None
        if text == change.new and change.new != change.old:
            set_text(spark, change.view, change.old)
            back.append(change.view)
        elif text != change.old:
            strange.append(change.view)
    if strange:
        raise JournalError(f"changed by someone else since, and left as they are: {sorted(strange)}")
    return back


def recover(spark: SparkSession, journal: str) -> dict[str, str]:
    """End the runs that broke off: one whose views all have their new text is done, any other is undone.

    Returns what became of each. A run whose views someone else has changed is undone as far as it can be, and the error
    says which views these are; it counts as ended, so that the error comes once.
    """
    create(spark, journal)
    out = {}
    for run, changes in open_runs(spark, journal).items():
        now = [views.view_text(spark, c.view) if views.object_kind(spark, c.view) == catalog.VIEW else None for c in changes]
        out[run] = DONE if now == [c.new for c in changes] else UNDONE
        try:
            if out[run] == UNDONE:
                undo(spark, changes)
        finally:
            end(spark, journal, run, out[run])
    return out
