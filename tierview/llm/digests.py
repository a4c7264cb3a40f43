"""Document fingerprints from improbable features.

A feature is a window of bytes. Its rarity is that of its entropy among all windows of the corpus; of each run of
neighbouring windows the rarest gets a point, and windows with enough points are selected. They go into Bloom
filters, a new one whenever the last is full, and two fingerprints are compared by the bits that their filters share
beyond what chance explains.
"""

from __future__ import annotations

from base64 import b64decode, b64encode
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierview.llm import words
from tierview.llm.session import bounded_batches, column

#: Bytes of a window, neighbouring windows of which the rarest gets a point, and points that a feature needs.
WINDOW, SPAN, POINTS = 32, 32, 8

#: Steps of entropy; windows below ``WEAK`` steps (runs of few different bytes) are never selected.
STEPS, WEAK = 1000, 100

#: Bits of a filter, features that it takes, bits that a feature sets.
BITS, FULL, HASHES = 2048, 160, 5

_SCALE = 1 << 16
_SUM = np.array([0] + [round(_SCALE * n * np.log2(n)) for n in range(1, WINDOW + 1)], np.int64)
_GAIN = np.concatenate(([0], np.diff(_SUM)))
_NEVER = 1 << 20
_MIX = np.random.Generator(np.random.PCG64(31)).integers(1, 2**63, WINDOW, dtype=np.uint64) | np.uint64(1)


def _laid_out(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after another, a byte between them and room at both ends; where each begins."""
    sizes = np.diff(offsets)
    begins = WINDOW + offsets[:-1] + np.arange(len(sizes))
    buffer = np.zeros(len(data) + len(sizes) + 2 * WINDOW + SPAN, np.uint8)
    buffer[np.repeat(begins - offsets[:-1], sizes) + np.arange(len(data))] = data
    return buffer, begins


def _entropies(buffer: np.ndarray) -> np.ndarray:
    """Of each window, in steps, by sliding: a byte leaves and one comes, and their counts say what that changes."""
    back = np.zeros(len(buffer), np.uint8)
    ahead = np.zeros(len(buffer), np.uint8)
    for lag in range(1, WINDOW):
        same = (buffer[lag:] == buffer[:-lag]).view(np.uint8)
        back[lag:] += same
        ahead[:-lag] += same
    change = _GAIN[back[WINDOW:] + 1] - _GAIN[ahead[:-WINDOW] + 1]
    total = np.concatenate(([_SUM[WINDOW]], _SUM[WINDOW] + np.cumsum(change)))  # the first window is all zeros
    return (_SUM[WINDOW] - total) * STEPS // _SUM[WINDOW]


def _valid(count: int, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Does the window that begins here lie in one text?"""
    edge = np.zeros(count + 1, np.int8)
    long = sizes >= WINDOW
    edge[begins[long]] += 1
    edge[begins[long] + sizes[long] - WINDOW + 1] -= 1
    return np.cumsum(edge[:-1]).astype(bool)


def entropy_counts(df: DataFrame, text: str) -> np.ndarray:
    """How many windows of all texts have an entropy of each step. Counted in tasks, summed up by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(STEPS + 1, np.int64)
        for batch in batches:
            data, offsets = words.raw(batch.column("t"))
            for lo, hi in words.chunks(offsets, 1 << 20):
                own = offsets[lo : hi + 1]
                buffer, begins = _laid_out(data[own[0] : own[-1]], own - own[0])
                entropy = _entropies(buffer)
                total += np.bincount(entropy[_valid(len(entropy), begins, np.diff(own))], minlength=STEPS + 1)
        yield pa.record_batch([pa.array(np.arange(STEPS + 1)), pa.array(total)], names=["step", "n"])

    bounded_batches(df.sparkSession)
    rows = df.select(F.coalesce(column(text), F.lit("")).alias("t"))
    sums = rows.mapInArrow(count, "step bigint, n bigint").groupBy("step").agg(F.sum("n"))
    out = np.zeros(STEPS + 1, np.int64)
    for step, n in sums.collect():  # a row for each step
        out[step] = n
    return out


def rarity(counts: np.ndarray) -> np.ndarray:
    """The rank of each step of entropy: 0 for the rarest, of equally rare ones the lower step first."""
    rank = np.empty(STEPS + 1, np.int64)
    rank[np.lexsort((np.arange(STEPS + 1), counts))] = np.arange(STEPS + 1)
    rank[:WEAK] = _NEVER
    return rank


def fingerprinted(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> list[str]:
    """The fingerprint of each text, in base 64; empty for an empty text.

    A text without a selected window (a short or a monotonous one) has one feature, the whole text.
    """
    sizes = np.diff(offsets)
    buffer, begins = _laid_out(data, offsets)
    entropy = _entropies(buffer)
    rank = np.where(_valid(len(entropy), begins, sizes), ranks[entropy], _NEVER)
    key = (rank << 32) | np.arange(len(rank))
    step = 1
    while step < SPAN:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    winners = key[key < _NEVER << 32] & 0xFFFFFFFF
    at = np.flatnonzero(np.bincount(winners, minlength=1) >= POINTS)
    features = (buffer[at[:, None] + np.arange(WINDOW)].astype(np.uint64) + words.U64(1)) @ _MIX
    owner = np.searchsorted(begins, at, side="right") - 1
    lone = np.setdiff1d(np.flatnonzero(sizes), owner)
    whole = np.array([hash_of(data[offsets[i] : offsets[i + 1]]) for i in lone], np.uint64)
    features, owner = np.concatenate((features, whole)), np.concatenate((owner, lone))
    # A feature that a text has twice counts once, at its first place.
    _, first = np.unique(np.stack((owner.astype(np.uint64), features), axis=1), axis=0, return_index=True)
    first = first[np.lexsort((first, owner[first]))]
    features, owner = words.mixed(features[first]), owner[first]
    counts = np.bincount(owner, minlength=len(sizes))
    filters = -(-counts // FULL)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    chain = np.repeat(np.cumsum(filters) - filters, counts) + place // FULL
    bits = np.zeros((int(filters.sum()), BITS), bool)
    for n in range(HASHES):
        bits[chain, ((features >> words.U64(11 * n)) & words.U64(BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1)
    return [b64encode(packed[end - n : end].tobytes()).decode() for n, end in zip(filters, np.cumsum(filters))]


def hash_of(data: np.ndarray) -> int:
    from hashlib import blake2b

    return int.from_bytes(blake2b(data.tobytes(), digest_size=8).digest(), "little")


def likeness(one: str, two: str) -> float:
    """0 to 1. Each filter of the shorter fingerprint is held against its best match in the other, weighted by its bits.

    Fingerprints of equally many filters are compared both ways. Two empty ones are alike, an empty one is like no other.
    """
    if not one or not two:
        return float(one == two)
    a, b = (np.frombuffer(b64decode(x), np.uint64).reshape(-1, BITS // 64) for x in (one, two))
    bits_a, bits_b = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (a, b))
    shared = np.stack([np.bitwise_count(row & b).sum(axis=1, dtype=np.int64) for row in a])
    chance = np.outer(bits_a, bits_b) / BITS
    least = np.minimum.outer(bits_a, bits_b)
    score = np.clip((shared - chance) / np.maximum(least - chance, 1e-9), 0, 1)
    ways = [np.average(score.max(axis=1), weights=bits_a)] * (len(a) <= len(b))
    ways += [np.average(score.max(axis=0), weights=bits_b)] * (len(b) <= len(a))
    return float(np.mean(ways))


def fingerprints(df: DataFrame, columns: Sequence[str], ranks: np.ndarray, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` as it is, and the fingerprint of each of the text ``columns``, under its name. Null is an empty text."""

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for name in columns:
                data, offsets = words.raw(batch.column(name))
                prints: list[str] = []
                for lo, hi in words.chunks(offsets, 1 << 20):
                    own = offsets[lo : hi + 1]
                    prints += fingerprinted(data[own[0] : own[-1]], own - own[0], ranks)
                made.append(pa.array(prints, pa.string()))
            yield pa.record_batch([*(batch.column(c) for c in keep), *made], names=[*keep, *columns])

    bounded_batches(df.sparkSession)
    texts = [F.coalesce(column(name), F.lit("")).alias(name) for name in columns]
    rows = df.select(*map(column, keep), *texts)
    return rows.mapInArrow(fingerprint, rows.schema)


def compared(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` with a column of likeness for each pair of fingerprint columns. Null counts as empty."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [
                pa.array([likeness(x or "", y or "") for x, y in zip(batch.column(a).to_pylist(), batch.column(b).to_pylist())], pa.float64())
                for a, b in pairs.values()
            ]
            yield pa.record_batch([*batch.columns, *made], names=[*batch.schema.names, *pairs])

    likes = [T.StructField(name, T.DoubleType()) for name in pairs]
    return df.mapInArrow(compare, T.StructType(df.schema.fields + likes))


def followed(df: DataFrame, key: str, text: str) -> DataFrame:
    """Each row's ``k``, ``t`` and ``next``: the text after it in the order of a numeric key, descending, null last.

    Equal keys are ordered by the hash of their texts. After the last row comes the first. Null texts are empty. The
    keys are cut into ranges at their quantiles, a task goes through its range in order, and each range is given the
    first text of the next one, found among the keys alone, so that no order of all rows is needed in one place.
    """
    rows = df.select(column(key).alias("k"), F.coalesce(column(text), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*(F.lit(n / parts) for n in range(1, parts)))
    cuts = rows.agg(F.percentile_approx("k", shares, F.lit(100 * parts))).first()[0] if parts > 1 else None
    cuts = sorted(set(cuts or []))
    place = F.when(F.col("k").isNull(), 0).otherwise(_below(cuts)) if cuts else F.lit(0)
    ranged = rows.withColumn("part", place)

    heads = ranged.groupBy("part").agg(F.max(F.struct("k", F.bitwise_not("h").alias("h"))).alias("head"))
    order = Window.orderBy("part")
    after = heads.select("part", F.coalesce(F.lag("head").over(order), F.last("head").over(order.rowsBetween(0, Window.unboundedFollowing))).alias("head"))
    after = after.select(F.col("part").alias("of"), F.col("head.k").alias("hk"), F.bitwise_not("head.h").alias("hh"))
    # One row for each range: its size is proven, whatever the texts.
    same = ranged["k"].eqNullSafe(F.col("hk")) & (ranged["h"] == F.col("hh"))
    seams = ranged.join(F.broadcast(after), same).groupBy("of").agg(F.first("t").alias("t"))
    both = ranged.select("part", "k", "t", "h", F.lit(False).alias("seam")).unionByName(
        seams.select(F.col("of").alias("part"), F.lit(None).cast(rows.schema["k"].dataType).alias("k"), "t", F.lit(0).cast("long").alias("h"), F.lit(True).alias("seam"))
    )
    dealt = both.repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", "seam", F.desc_nulls_last("k"), "h")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            keys, texts, seams = (batch.column(c).to_pylist() for c in ("k", "t", "seam"))
            out = []
            for row in zip(keys, texts, seams):
                if held is not None and not held[2]:
                    out.append((held[0], held[1], row[1]))
                held = row
            columns = list(zip(*out)) if out else [(), (), ()]
            kinds = (batch.schema.field("k").type, pa.string(), pa.string())
            yield pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=["k", "t", "next"])

    bounded_batches(df.sparkSession)
    kind = rows.schema["k"].dataType.simpleString()
    return dealt.mapInArrow(follow, f"k {kind}, t string, next string")


def _below(cuts: list) -> Column:
    """How many cuts lie below the key."""
    listed = F.array(*map(F.lit, cuts))
    return F.size(F.filter(listed, lambda cut: F.col("k") > cut))
