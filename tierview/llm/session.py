"""What the operators of this package need of a session: bounded Arrow batches and a shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents that a Python worker holds at once. Spark limits Arrow batches by rows only, so long texts need few rows.
BATCH_ROWS = 1000

#: With it, the shuffle files of a query go when it ends. A frame that is run again makes them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batch size to ``rows``, as one worker decodes a whole batch of texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which the driver and all executors see.

    Where the session has none, one on this machine is made if all of Spark runs on it, and else it is an error: on a
    cluster executors would not see each other's files there.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp())
        base = context.getCheckpointDir()
    return base.rstrip("/")


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is made and run inside go when it ends; else they stay until the driver's garbage is collected."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that lost executors cost no recomputation. Its shuffle files go at once."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    with _shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint()  # a frame has the setting of when it was made


def written(df: DataFrame) -> DataFrame:
    """As ``checkpointed``, in Parquet: smaller, and read as far as needed. The folder is new each time."""
    session = df.sparkSession
    path = f"{shared_folder(session)}/table-{uuid.uuid4().hex}"
    with _shuffles_dropped(session):
        df.write.parquet(path)
    return session.read.schema(df.schema).parquet(path)


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")
