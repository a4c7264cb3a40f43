"""Vectors as exact integers, and exact sums of them over all tasks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierview.llm.session import column

#: Integers end here, on both sides; a component beyond counts as this.
LIMIT = 1 << 62

#: Vectors that are worked on at once.
CHUNK_ROWS = 2048

#: What a distance that does not fit a long is told as.
MOST = (1 << 63) - 1

_HALF = 31


def integers(lists: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows count, and their components as floor(scale * x).

    A row counts if it has ``dims`` components, none of them null, NaN or infinite.
    """
    lengths = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == dims)
    if not len(rows):
        return rows, np.zeros((0, dims), np.int64)
    flat = pc.list_flatten(lists.take(pa.array(rows))).cast(pa.float64())
    table = flat.to_numpy(zero_copy_only=False).reshape(len(rows), dims)
    good = np.isfinite(table).all(axis=1)
    with np.errstate(over="ignore"):
        scaled = np.floor(table[good] * float(scale))
    return rows[good], np.clip(scaled, -LIMIT, LIMIT).astype(np.int64)


def exact(terms: int, *tables: np.ndarray) -> list[np.ndarray]:
    """The tables as they are if four times a squared distance of ``terms`` terms fits a long, else of Python's integers."""
    most = max((max(abs(int(t.max())), abs(int(t.min()))) for t in tables if t.size), default=0)
    return list(tables) if 16 * terms * most * most < 1 << 62 else [t.astype(object) for t in tables]


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    gap = x - y
    return (gap * gap).sum(axis=-1)


def root(d: np.ndarray) -> np.ndarray:
    """Integers that are not below the square root of ``d``."""
    if d.dtype == object:
        return np.array([math.isqrt(v) + 1 for v in d.tolist()], object)
    return np.sqrt(d.astype(np.float64)).astype(np.int64) + 1


def told(d: np.ndarray) -> np.ndarray:
    return np.minimum(d, MOST).astype(np.int64)


def rows_of(df: DataFrame, key: str, vector: str, **more: str) -> DataFrame:
    """``id``, ``v`` and the columns of ``more`` under those names, whatever else ``df`` has."""
    return df.select(column(key).alias("id"), column(vector).alias("v"), *(column(c).alias(n) for n, c in more.items()))


def kept(rows: DataFrame, dims: int, scale: int) -> DataFrame:
    """``rows`` (id, v) that count: id and ``x``, the integers."""

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = integers(batch.column("v"), dims, scale)
            ends = pa.array(np.arange(len(at) + 1) * dims, pa.int32())
            yield pa.record_batch([batch.column("id").take(pa.array(at)), pa.ListArray.from_arrays(ends, pa.array(x.reshape(-1)))], names=["id", "x"])

    return rows.mapInArrow(turned, f"id {rows.schema['id'].dataType.simpleString()}, x array<bigint>")


def means(rows: DataFrame, dims: int, scale: int, groups: Callable[[np.ndarray], np.ndarray], parts: int = 1) -> dict[tuple[int, int], list[int]]:
    """Of each part and group with members, the componentwise floor(sum / count) of its members.

    ``groups`` gives the group of each part of each vector (a column for each part). A task sums what it reads; those
    sums, in two halves that no number of rows makes overflow, are summed by Spark, and one row for each component of
    each mean comes to the driver.
    """
    width = dims // parts

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[tuple[int, int], list] = {}
        for batch in batches:
            _, x = integers(batch.column("v"), dims, scale)
            for lo in range(0, len(x), CHUNK_ROWS):
                some = x[lo : lo + CHUNK_ROWS]
                of = groups(some)
                for part in range(parts):
                    mine = some[:, part * width : (part + 1) * width]
                    order = np.argsort(of[:, part], kind="stable")
                    seen, starts, counts = np.unique(of[order, part], return_index=True, return_counts=True)
                    high = np.add.reduceat(mine[order] >> _HALF, starts)
                    low = np.add.reduceat(mine[order] & ((1 << _HALF) - 1), starts)
                    for g, n, h, l in zip(seen.tolist(), counts.tolist(), high, low):  # noqa: E741
                        had = own.setdefault((part, g), [0, np.zeros(width, np.int64), np.zeros(width, np.int64)])
                        had[0] += n
                        had[1] += h
                        had[2] += l
        if own:
            part, group = np.array(list(own)).T
            yield pa.record_batch(
                [
                    pa.array(np.repeat(part, width), pa.int32()),
                    pa.array(np.repeat(group, width), pa.int32()),
                    pa.array(np.tile(np.arange(width), len(own)), pa.int32()),
                    pa.array(np.repeat([had[0] for had in own.values()], width), pa.int64()),
                    pa.array(np.concatenate([had[1] for had in own.values()])),
                    pa.array(np.concatenate([had[2] for had in own.values()])),
                ],
                names=["p", "g", "i", "n", "high", "low"],
            )

    partial = rows.select("v").mapInArrow(summed, "p int, g int, i int, n bigint, high bigint, low bigint")
    wide = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("n", "high", "low")]
    out: dict[tuple[int, int], list[int]] = {}
    for row in partial.groupBy("p", "g", "i").agg(*wide).collect():
        total = (int(row.high) << _HALF) + int(row.low)
        out.setdefault((row.p, row.g), [0] * width)[row.i] = total // int(row.n)
    return out


def total(name: str) -> Column:
    """The sum of a column of longs, as a long; one that does not fit is told as the largest."""
    most = F.lit(str(MOST)).cast("decimal(38,0)")
    return F.least(F.sum(F.col(name).cast("decimal(20,0)")).cast("decimal(38,0)"), most).cast("bigint")
