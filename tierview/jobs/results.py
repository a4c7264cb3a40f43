"""Results of the jobs: one row per table, with the step a failure happened at."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)

RESULT_SCHEMA = "pair string, tbl string, status string, step string, detail string"


class JobError(RuntimeError):
    """A job stopped; ``results`` holds the rows up to and including the failure."""

    def __init__(self, message: str, results: list[tuple]):
        super().__init__(message)
        self.results = results

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.results, RESULT_SCHEMA)


class StepError(RuntimeError):
    """A step of one table failed."""

    def __init__(self, step: str, cause: Exception):
        super().__init__(f"{step}: {cause}")
        self.step = step


@contextmanager
def step(name: str) -> Iterator[None]:
    """Name the step that an error comes from."""
    try:
        yield
    except StepError:  # of a step within this one
        raise
    except Exception as error:
        raise StepError(name, error) from error


@dataclass
class Results:
    rows: list[tuple] = field(default_factory=list)

    def done(self, pair: str, table: str, status: str, detail: str | None = None) -> None:
        log.info("%s.%s: %s", pair, table, status)
        self.rows.append((pair, table, status, None, detail))

    def failed(self, pair: str, table: str, error: Exception) -> None:
        log.error("%s.%s: %s", pair, table, error)
        name = error.step if isinstance(error, StepError) else "unknown"
        self.rows.append((pair, table, "failed", name, str(error)))

    def failures(self, pair: str | None = None) -> list[tuple]:
        return [r for r in self.rows if r[2] == "failed" and pair in (None, r[0])]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, RESULT_SCHEMA)

    def stop(self, message: str) -> JobError:
        return JobError(message, list(self.rows))
