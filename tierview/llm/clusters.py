"""Centroids of vectors, found by rounds of exact assignment with Orchard's search.

Each centroid has a list of the others by their distance to it. A vector starts at some centroid and goes down that
list; as soon as one is nearer, it goes on from the beginning of that one's list. Centroids that it has met are marked
and not measured again. It stops where the list is strictly beyond twice its current distance: by the triangle
inequality whatever comes after is farther away, and none of it is equally near.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierview.llm import vectors
from tierview.llm.session import bounded_batches


class Orchard:
    """Centroids (a row each) with the lists of their neighbours."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        (wide,) = vectors.exact(centroids.shape[1], centroids)
        self.between = np.stack([vectors.squared(wide, one) for one in wide])
        ranked = self.between.copy()
        np.fill_diagonal(ranked, -1)
        self.lists = np.argsort(ranked, axis=1, kind="stable")[:, 1:]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row of ``x``, the nearest centroid (of equally near ones the first) and its squared distance."""
        x, centroids = vectors.exact(x.shape[1], x, self.centroids)
        n, count = len(x), len(centroids)
        current, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
        best = vectors.squared(x, centroids[0])
        met = np.zeros((n, count), bool)
        met[:, 0] = True
        live = np.arange(n if count > 1 else 0)
        while live.size:
            mine = current[live]
            other = self.lists[mine, place[live]]
            near = (self.between[mine, other] <= 4 * best[live]).astype(bool)
            live, other = live[near], other[near]
            place[live] += 1
            new = ~met[live, other]
            row, other = live[new], other[new]
            met[row, other] = True
            d = vectors.squared(x[row], centroids[other])
            closer = ((d < best[row]) | ((d == best[row]) & (other < current[row]))).astype(bool)
            row = row[closer]
            current[row], best[row], place[row] = other[closer], d[closer], 0
            live = live[place[live] < count - 1]
        return current, best


@dataclass(frozen=True)
class Centroids:
    """``table``: the centroids, a row each, as floors of ``scale`` times a vector's components."""

    table: np.ndarray
    scale: int

    def digests(self) -> list[str]:
        """Of each centroid, the SHA-256 of its components as decimal integers, joined by commas."""
        return [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in self.table.tolist()]


def fit(df: DataFrame, key: str, vector: str, dims: int, count: int = 16, rounds: int = 3, scale: int = 64, seed: int = 1) -> Centroids | None:
    """Centroids of all vectors of ``df``; None if no row has a vector that counts.

    A row without a vector of ``dims`` components, or with null or non-finite ones, does not count. Centroids start as
    the vectors whose key has the smallest SHA-256 as ``seed:key`` (a null key is empty there; of rows that share a key
    the smaller vector comes first); a table of fewer rows has so many centroids. A round assigns every row and moves
    each centroid to the floor of its vectors' mean; an empty one stays. Repeated rows count as often as they are
    there. Components are bounded by ``vectors.LIMIT``.

    Each round reads the vectors once. A task sends one row for each centroid and component that it met, so nothing
    grows with a hot centroid; the driver holds the centroids.
    """
    if count < 1:
        raise ValueError("count must be at least 1")
    bounded_batches(df.sparkSession)
    rows = vectors.rows_of(df, key, vector)
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = vectors.kept(rows, dims, scale).select(rank.alias("rank"), "x").orderBy("rank", "x").limit(count)
    start = [row.x for row in first.select("x").collect()]
    if not start:
        return None
    table = np.array(start, np.int64)
    for _ in range(rounds):
        search = Orchard(table)
        table = table.copy()
        for (_, centroid), mean in vectors.means(rows, dims, scale, lambda x, s=search: s.nearest(x)[0][:, None]).items():
            table[centroid] = mean
    return Centroids(table, scale)


def assign(df: DataFrame, key: str, vector: str, centroids: Centroids) -> DataFrame:
    """Returns per row that counts ``key`` (under its name), ``cluster`` and ``distance``, squared, in the centroids'
    integers; one that does not fit a long is told as the largest long. Rows that do not count are left out, see
    :func:`fit`; an empty table gives no rows."""
    bounded_batches(df.sparkSession)
    rows = vectors.rows_of(df, key, vector)
    dims = centroids.table.shape[1]

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(centroids.table)
        for batch in batches:
            at, x = vectors.integers(batch.column("v"), dims, centroids.scale)
            for lo in range(0, len(x), vectors.CHUNK_ROWS):
                cluster, d = search.nearest(x[lo : lo + vectors.CHUNK_ROWS])
                own = batch.column("id").take(pa.array(at[lo : lo + vectors.CHUNK_ROWS]))
                yield pa.record_batch([own, pa.array(cluster, pa.int32()), pa.array(vectors.told(d))], names=["id", "cluster", "distance"])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(assigned, f"id {kind}, cluster int, distance bigint")
    return out.withColumnRenamed("id", key)
