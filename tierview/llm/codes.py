"""Vectors compressed to codes: each part of a vector is the number of the nearest entry of that part's codebook.

The nearest entry is found by slices. In each dimension the entries' coordinates are sorted, and before each of them
stands a mask of the entries that come earlier. Entries within a radius of a point are a range of each dimension, so
two lookups and one difference of masks give them as bits, and the masks of all dimensions, ANDed, leave the entries in
the box around the point. The initial radius is the distance to one entry that is near in the widest dimension: no
entry that is as near or nearer lies outside that box, so the least distance among the candidates is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tierview.llm import vectors
from tierview.llm.session import bounded_batches
from tierview.llm.words import U64


class Slices:
    """The entries of one codebook (a row each), sorted by each coordinate, with the masks of what comes before."""

    def __init__(self, entries: np.ndarray):
        count, width = entries.shape
        self.entries = entries
        self.order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, self.order, axis=0).T.copy()
        bits = np.zeros((count, -(-count // 64)), U64)
        bits[np.arange(count), np.arange(count) // 64] = U64(1) << (np.arange(count) % 64).astype(U64)
        self.before = np.zeros((width, count + 1, bits.shape[1]), U64)
        for j in range(width):
            self.before[j, 1:] = np.bitwise_or.accumulate(bits[self.order[:, j]], axis=0)
        self.widest = int(np.argmax(self.sorted[:, -1].astype(float) - self.sorted[:, 0].astype(float)))

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries that are within ``radius`` of ``x`` in every dimension."""
        within = None
        for j, (line, before) in enumerate(zip(self.sorted, self.before)):
            lo = np.searchsorted(line, x[:, j] - radius, side="left")
            hi = np.searchsorted(line, x[:, j] + radius, side="right")
            own = before[hi] ^ before[lo]
            within = own if within is None else within & own
        return within

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row of ``x``, the nearest entry (of equally near ones the first) and its squared distance."""
        x, entries = vectors.exact(x.shape[1], x, self.entries)
        place = np.searchsorted(self.sorted[self.widest], x[:, self.widest].astype(np.int64))
        guess = self.order[np.minimum(place, len(entries) - 1), self.widest]
        masks = self.candidates(x, vectors.root(vectors.squared(x, entries[guess])))
        bits = np.unpackbits(masks.astype("<u8").view(np.uint8), axis=1, bitorder="little")
        row, entry = np.nonzero(bits)
        d = vectors.squared(x[row], entries[entry])
        starts = np.searchsorted(row, np.arange(len(x)))
        least = np.minimum.reduceat(d, starts)
        best = np.flatnonzero(d == least[row])
        best = best[np.searchsorted(row[best], np.arange(len(x)))]
        return entry[best], least


@dataclass(frozen=True)
class Codebooks:
    """``entries``: of each part, of each entry, its components, which are floors of ``scale`` times a vector's."""

    entries: np.ndarray
    dims: int
    scale: int

    def digest(self) -> str:
        """SHA-256 of all components as decimal integers by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()

    def _slices(self) -> list[Slices]:
        return [Slices(part) for part in self.entries]

    def decoded(self, code: str) -> np.ndarray:
        """The vector that a code stands for."""
        return np.concatenate([part[e] for part, e in zip(self.entries, bytes.fromhex(code))]) / self.scale


def _coded(slices: list[Slices], x: np.ndarray) -> tuple[np.ndarray, list]:
    width = x.shape[1] // len(slices)
    told = [s.nearest(x[:, p * width : (p + 1) * width]) for p, s in enumerate(slices)]
    return np.stack([entry for entry, _ in told], axis=1), [d for _, d in told]


def fit(
    df: DataFrame, key: str, vector: str, dims: int, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096
) -> Codebooks | None:
    """Codebooks of all vectors of ``df``; None if no row has a vector that counts.

    A row without a vector of ``dims`` components, or with null or non-finite ones, does not count. Entries start as
    the parts of the vectors with the smallest keys (rows without a key come last, of rows that share one the smaller
    vector comes first); a table of fewer rows has so many entries. A round assigns every part of every row and moves
    each entry to the floor of its parts' mean; an entry without parts stays. Repeated rows count as often as they are
    there. Components are bounded by ``vectors.LIMIT``.

    Each round reads the vectors once. A task sends one row for each entry and component that it met, so nothing grows
    with a hot entry; the driver holds the codebooks.
    """
    if dims % parts or not 0 < entries <= 256:
        raise ValueError("dims must be a multiple of parts, and entries from 1 to 256")
    bounded_batches(df.sparkSession)
    rows = vectors.rows_of(df, key, vector)
    first = vectors.kept(rows, dims, scale).selectExpr("id IS NULL AS last", "id", "x").orderBy("last", "id", "x").limit(entries)
    start = [row.x for row in first.select("x").collect()]
    if not start:
        return None
    books = np.array(start, np.int64).reshape(len(start), parts, dims // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        slices = [Slices(part) for part in books]
        books = books.copy()
        for (part, entry), mean in vectors.means(rows, dims, scale, lambda x, s=slices: _coded(s, x)[0], parts).items():
            books[part, entry] = mean
    return Codebooks(books, dims, scale)


def encode(df: DataFrame, key: str, vector: str, books: Codebooks, keep: str | None = None) -> DataFrame:
    """Returns per row that counts ``key`` (under its name), ``keep`` if given, ``code`` and ``error``.

    ``code`` has two hex digits for each part, ``error`` is the squared distance in the codebooks' integers (one that
    does not fit a long is told as the largest long). Rows that do not count are left out, see :func:`fit`; an empty
    table gives no rows.
    """
    bounded_batches(df.sparkSession)
    rows = vectors.rows_of(df, key, vector, **({"kept": keep} if keep else {}))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = books._slices()
        for batch in batches:
            at, x = vectors.integers(batch.column("v"), books.dims, books.scale)
            for lo in range(0, len(x), vectors.CHUNK_ROWS):
                own = pa.array(at[lo : lo + vectors.CHUNK_ROWS])
                entry, distances = _coded(slices, x[lo : lo + vectors.CHUNK_ROWS])
                digits = [row.tobytes().hex() for row in entry.astype(np.uint8)]
                error = vectors.told(sum(d.astype(object) for d in distances)) if any(d.dtype == object for d in distances) else sum(distances)
                told = [pa.array(digits, pa.string()), pa.array(error, pa.int64())]
                yield pa.record_batch([batch.column(c).take(own) for c in names] + told, names=[*names, "code", "error"])

    names = [c for c in rows.columns if c != "v"]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    out = rows.mapInArrow(coded, kinds + ", code string, error bigint").withColumnRenamed("id", key)
    return out.withColumnRenamed("kept", keep) if keep else out
