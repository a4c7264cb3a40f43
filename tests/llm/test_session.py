"""What is written out leaves no shuffle files behind, whatever the driver's garbage collector does."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[2]

#: In a session of its own, so that no other query's files are there and the folder is known.
RUN = """
import sys, time
from pathlib import Path
from pyspark.sql import SparkSession, functions as F
from tierview.llm import minhash, session

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

folder = Path(sys.argv[1])
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3")
spark = spark.config("spark.checkpoint.dir", str(folder / "shared")).config("spark.driver.host", "127.0.0.1").getOrCreate()

def left():
    return sum(1 for f in (folder / "local").rglob("shuffle_*"))

def summed():
    return spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("n"))

if sys.argv[2] == "near_duplicates":
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.format_string("one two three four %d six seven", F.col("id") % 20).alias("text"))
    out = minhash.near_duplicates(docs, "doc_id", "text")
    assert spark.conf.get(CLEANUP, None) is None
else:
    frame = summed()
    before = sorted(map(tuple, frame.collect()))
    there = left()
    assert there
    spark.conf.set(CLEANUP, "false")
    out = getattr(session, sys.argv[2])(summed())
    assert spark.conf.get(CLEANUP) == "false"
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, frame.collect())) == before
    for _ in range(50):
        if left() <= there:
            break
        time.sleep(0.2)
    sys.exit(left() > there and "files were left")
for _ in range(50):
    if not left():
        break
    time.sleep(0.2)
sys.exit(left() and f"{left()} files were left")
"""


@pytest.mark.parametrize("what", ["checkpointed", "written", "near_duplicates"])
def test_no_shuffle_files_are_left(tmp_path, what):
    (tmp_path / "local").mkdir()
    env = os.environ | {"PYTHONPATH": str(REPO), "SPARK_LOCAL_DIRS": str(tmp_path / "local"), "SPARK_LOCAL_IP": "127.0.0.1"}
    done = subprocess.run([sys.executable, "-c", RUN, str(tmp_path), what], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
