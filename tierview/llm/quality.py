"""A quality classifier by Bradley-Terry ranking.

A preference pair is a good and a bad text; the chance that the good one is preferred is the logistic function of the
difference of their scores, and scores are linear in features of the text. So the weights are learned by logistic loss
on feature differences, over every pair that the learned rows make. Scores have no zero of their own: the quantile of
the learned scores at the share of bad texts becomes the threshold, and is put at 0.7 on the scale from 0 to 1.

The pairs are not listed. What a row adds to the loss depends on the other class by sums of a smooth function of the
difference of two scores, and between a few nodes of a cell of scores such a function is a polynomial. So each row is
shared out to the nodes of its cell, tasks sum rows and features by node, and pairs of nodes stand for pairs of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierview.llm import words
from tierview.llm.session import bounded_batches, column, written

#: Where the threshold lies on the scale from 0 to 1, and the weight of the squared weights in the loss.
THRESHOLD, PENALTY = 0.7, 1e-3

#: Chebyshev nodes of a cell, which is one wide. The logistic function's poles are pi away, so the error is below 1e-11.
NODES = 12

#: Newton's method ends at a step below the first, and is an error after so many steps.
LEAST_STEP, MOST_STEPS = 1e-7, 100

#: Buckets that a range of scores is cut into to find a rank in it.
BUCKETS = 1024

#: Of the features and labels of some rows, sums under keys.
Part = Callable[[np.ndarray, np.ndarray], dict[int, np.ndarray]]
#: Those sums over all rows, each flat.
Sums = Callable[[Part], dict[int, np.ndarray]]
#: Of weights: the loss, its slope, and its curvature, which is made if called for.
Loss = Callable[[np.ndarray], tuple[float, np.ndarray, Callable[[], np.ndarray]]]

_ANGLES = np.pi * (np.arange(NODES) + 0.5) / NODES
_PLACES = (1 + np.cos(_ANGLES)) / 2
_FACTORS = np.where(np.arange(NODES) % 2, -1, 1) * np.sin(_ANGLES)

_KINDS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".,", "'\"-;:?()", "!", "#", "$", "%", "&", "*", "|", "<>", "{}[]=_/\\~^`+@")
_OTHER, _BEYOND = len(_KINDS), len(_KINDS) + 1


def _kind_table() -> np.ndarray:
    table = np.full(256, _OTHER, np.int64)
    table[128:] = _BEYOND
    for kind, characters in enumerate(_KINDS):
        table[[ord(c) for c in characters]] = kind
    return table


def _shares_distinct(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each text: distinct over all, and the most frequent's share; ones for texts without any."""
    out = np.ones((len(bounds) - 1, 2))
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        if b > a:
            own = np.sort(hashes[a:b])
            cuts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True])))
            out[i] = (len(cuts) - 1) / (b - a), np.diff(cuts).max() / (b - a)
    return out


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row for each text: what its bytes, words, five-word runs and lines are like. Zeros for an empty text."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    owner = np.repeat(np.arange(n), sizes)
    kinds = np.bincount(owner * (_BEYOND + 1) + _kind_table()[data], minlength=n * (_BEYOND + 1)).reshape(n, -1)
    shares = kinds / np.maximum(sizes, 1)[:, None]

    hashes, bounds, starts = words.hashed(data, offsets, words.white_space_words())
    counts = np.diff(bounds)
    lengths = (sizes - kinds[:, 3] - kinds[:, 4]) / np.maximum(counts, 1)
    word = _shares_distinct(hashes, bounds)
    run = _shares_distinct(*words.shingled(hashes, bounds, 5))
    same = np.append(hashes[1:] == hashes[:-1], False)[: len(hashes)]
    same[bounds[1:][bounds[1:] > 0] - 1] = False  # what follows a last word is another text's
    echoed = np.add.reduceat(np.append(same, False), np.minimum(bounds[:-1], len(same))) if n else np.zeros(0)
    line_hashes, line_bounds, _ = words.hashed(data, offsets, words.lines())
    line = _shares_distinct(line_hashes, line_bounds)
    per_line = counts / np.maximum(np.diff(line_bounds), 1)

    logs = np.log1p(np.stack((sizes, counts, lengths, per_line), axis=1))
    marks = np.log1p(1000 * shares[:, 5:])
    table = np.concatenate(
        (shares, marks, logs, word, run, line, (np.where(counts > 0, echoed, 0) / np.maximum(counts, 1))[:, None]), axis=1
    )
    table[sizes == 0] = 0
    return table


@dataclass(frozen=True)
class Ranking:
    """``sigmoid(weights . (features - mean) / spread - cut + logit(THRESHOLD))`` is the score."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float

    def scaled(self, table: np.ndarray) -> np.ndarray:
        return np.clip((table - self.mean) / self.spread, -6, 6)

    def raw(self, table: np.ndarray) -> np.ndarray:
        return _raw(self.scaled(table), self.weights)

    def scores(self, table: np.ndarray) -> np.ndarray:
        at = self.raw(table) - self.cut + np.log(THRESHOLD / (1 - THRESHOLD))
        return np.where(at >= 0, 1, np.exp(np.minimum(at, 0))) / (1 + np.exp(-np.abs(at)))


def _raw(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Not a matrix product, whose last bits depend on a row's neighbours: equal rows have equal scores."""
    return (x * weights).sum(axis=1)


def _wrong(gap: np.ndarray) -> np.ndarray:
    """The chance of the wrong preference."""
    return 1 / (1 + np.exp(np.clip(gap, -500, 500)))


def _unweighted(sums: Sums, width: int) -> tuple[Ranking, int, int]:
    """Mean and spread of all rows, no weights yet; how many are good and bad."""

    def counted(table: np.ndarray, good: np.ndarray) -> dict[int, np.ndarray]:
        return {k: np.append(len(own), own.sum(axis=0)) for k, own in enumerate((table[~good], table[good]))}

    none = np.zeros(1 + width)
    totals = sums(counted)
    below, above = (int(round(totals.get(k, none)[0])) for k in (0, 1))
    rows = max(above + below, 1)
    mean = (totals.get(0, none) + totals.get(1, none))[1:] / rows
    squares = sums(lambda table, _: {0: ((table - mean) ** 2).sum(axis=0)}).get(0, np.zeros(width))
    spread = np.maximum(np.sqrt(squares / rows), 1e-6) if above + below else np.ones(width)
    return Ranking(mean, spread, np.zeros(width), 0.0), above, below


def _shared_out(x: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each row's score, and its share for each node: the value there of a polynomial is the sum of theirs."""
    at = _raw(x, weights)
    cell = np.floor(at)
    gap = (at - cell)[:, None] - _PLACES
    hit = gap == 0
    share = np.where(hit.any(axis=1)[:, None], hit, _FACTORS / np.where(hit, 1, gap))
    return cell.astype(np.int64), share / share.sum(axis=1, keepdims=True)


def _all_pairs(sums: Sums, ranking: Ranking, above: int, below: int) -> Loss:
    """The mean loss of all ``above`` x ``below`` pairs. A key is twice the cell, and one more for good rows."""
    width = len(ranking.weights)
    pairs = above * below

    def at(weights: np.ndarray) -> tuple[float, np.ndarray, Callable[[], np.ndarray]]:
        def by_node(table: np.ndarray, good: np.ndarray) -> dict[int, np.ndarray]:
            x = ranking.scaled(table)
            cell, share = _shared_out(x, weights)
            key, full = 2 * cell + good, np.concatenate((np.ones((len(x), 1)), x), axis=1)
            return {int(k): share[key == k].T @ full[key == k] for k in np.unique(key)}

        nodes = {k: v.reshape(NODES, 1 + width) for k, v in sums(by_node).items()}
        bad = sorted(k for k in nodes if k % 2 == 0)
        places = np.concatenate([k // 2 + _PLACES for k in bad])
        n, x = np.concatenate([nodes[k][:, 0] for k in bad]), np.concatenate([nodes[k][:, 1:] for k in bad])
        loss, slope, cross = 0.0, np.zeros(width), np.zeros((width, width))
        chance, weight = np.zeros(len(n)), np.zeros(len(n))  # for each node of bad rows, summed over good rows
        bend: dict[int, np.ndarray] = {}
        for k in nodes:
            if k % 2:
                own, features = nodes[k][:, 0], nodes[k][:, 1:]
                gap = (k // 2 + _PLACES)[:, None] - places
                p = _wrong(gap)
                w = p * (1 - p)
                loss += own @ np.logaddexp(0, -gap) @ n / pairs
                slope -= (p @ n) @ features / pairs
                cross += features.T @ (w @ x) / pairs
                chance += own @ p
                weight += own @ w
                bend[k] = w @ n / pairs
        slope += chance @ x / pairs
        bend.update(zip(bad, (weight / pairs).reshape(-1, NODES)))

        def curve() -> np.ndarray:
            def bent(table: np.ndarray, good: np.ndarray) -> dict[int, np.ndarray]:
                x = ranking.scaled(table)
                cell, share = _shared_out(x, weights)
                own = np.array([bend[k] for k in (2 * cell + good).tolist()]).reshape(-1, NODES)
                return {0: (x * (share * own).sum(axis=1)[:, None]).T @ x}

            square = sums(bent)[0].reshape(width, width)
            return square - cross - cross.T + PENALTY * np.eye(width)

        return loss + PENALTY / 2 * float(weights @ weights), slope + PENALTY * weights, curve

    return at


def _drawn_pairs(x: np.ndarray, good: np.ndarray, pairs: int) -> Loss:
    rng = np.random.default_rng(7)
    difference = x[rng.choice(np.flatnonzero(good), pairs)] - x[rng.choice(np.flatnonzero(~good), pairs)]

    def at(weights: np.ndarray) -> tuple[float, np.ndarray, Callable[[], np.ndarray]]:
        gap = difference @ weights
        p = _wrong(gap)

        def curve() -> np.ndarray:
            return (difference * (p * (1 - p))[:, None]).T @ difference / pairs + PENALTY * np.eye(len(weights))

        loss = np.logaddexp(0, -gap).mean() + PENALTY / 2 * float(weights @ weights)
        return loss, PENALTY * weights - (difference * p[:, None]).mean(axis=0), curve

    return at


def _least(at: Loss, width: int) -> np.ndarray:
    """The weights of the least loss, by Newton's method on the convex loss. A step that makes it grow is halved."""
    weights = np.zeros(width)
    loss, slope, curve = at(weights)
    for _ in range(MOST_STEPS):
        step = np.linalg.solve(curve(), slope)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        now = at(weights - step)
        while now[0] > loss + 1e-10:
            step /= 2
            now = at(weights - step)
        weights = weights - step
        if np.abs(step).max() < LEAST_STEP:
            return weights
        loss, slope, curve = now
    raise ArithmeticError(f"no least loss after {MOST_STEPS} steps")


def learned(table: np.ndarray, good: np.ndarray, pairs: int | None = None) -> Ranking:
    """The ranking of labelled features. Without good or bad rows there is nothing to prefer: every score is 0.7.

    Of all pairs, as in ``learn``. Only with ``pairs``, which no query gives, so many drawn ones stand for them.
    """
    width = table.shape[1]
    sums: Sums = lambda part: {k: v.reshape(-1) for k, v in part(table, good).items()}
    ranking, above, below = _unweighted(sums, width)
    if not above or not below:
        return ranking
    loss = _all_pairs(sums, ranking, above, below) if pairs is None else _drawn_pairs(ranking.scaled(table), good, pairs)
    ranking = replace(ranking, weights=_least(loss, width))
    raw = np.sort(ranking.raw(table))
    # Half-way between the neighbours at the quantile: the share of bad rows lies below.
    return replace(ranking, cut=float((raw[below - 1] + raw[below]) / 2))


def held_out(key: Column) -> Column:
    """Rows that are not learned from: a quarter, by the checksum of the id as text."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _featured(df: DataFrame) -> DataFrame:
    """``df``: id and t. Features as doubles, packed, in place of t."""

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = words.raw(batch.column("t"))
            for lo, hi in words.chunks(offsets):
                made = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                packed = pa.array([row.tobytes() for row in made], pa.binary())
                yield pa.record_batch([batch.column("id")[lo:hi], packed], names=["id", "x"])

    return df.select("id", "t").mapInArrow(table, f"id {df.schema['id'].dataType.simpleString()}, x binary")


def _unpacked(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return words.raw(batch.column("x"))[0].view(np.float64).reshape(-1, width)


def _summed(rows: DataFrame, width: int) -> Sums:
    """Sums over ``rows`` (x and good). A task sums what it reads, and Spark brings a key's sums together."""

    def total(partial: pa.Table) -> pa.Table:
        table = np.sort(np.stack([np.frombuffer(v) for v in partial.column("v").to_pylist()]), axis=0)  # whatever order they came in
        return pa.table({"k": partial.column("k").slice(0, 1), "v": pa.array([table.sum(axis=0).tobytes()], pa.binary())})

    def sums(part: Part) -> dict[int, np.ndarray]:
        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own: dict[int, np.ndarray] = {}
            for batch in batches:
                if batch.num_rows:
                    good = batch.column("good").to_numpy(zero_copy_only=False) == 1
                    for k, v in part(_unpacked(batch, width), good).items():
                        own[k] = own.get(k, 0) + v.reshape(-1)
            for k, v in own.items():
                yield pa.record_batch([pa.array([k], pa.int64()), pa.array([v.astype(np.float64).tobytes()], pa.binary())], names=["k", "v"])

        partial = rows.mapInArrow(summed, "k bigint, v binary")
        return {r.k: np.frombuffer(r.v) for r in partial.groupBy("k").applyInArrow(total, "k bigint, v binary").collect()}

    return sums


def _halfway(raw: DataFrame, rank: int) -> float:
    """Between the ``rank``-th smallest ``s``, counted from 1, and the next. The range that it lies in is cut until it is one value."""
    s = F.col("s")
    lo, hi = raw.agg(F.min(s), F.max(s)).first()
    before = 0
    while lo < hi:
        bucket = F.least(F.floor((s - F.lit(lo)) / F.lit(hi - lo) * BUCKETS), F.lit(BUCKETS - 1))
        counts = raw.where(s.between(lo, hi)).groupBy(bucket.alias("b")).agg(F.count(s).alias("n"), F.min(s).alias("lo"), F.max(s).alias("hi"))
        for r in counts.orderBy("b").collect():
            if before + r.n >= rank:
                lo, hi = r.lo, r.hi
                break
            before += r.n
    up_to, after = raw.agg(F.count_if(s <= lo), F.min(F.when(s > lo, s))).first()
    return lo if up_to > rank else (lo + after) / 2


def learn(df: DataFrame, key: str, text: str, labels: DataFrame, label: str) -> Ranking:
    """The ranking learned from all ``labels`` (``key`` and ``label``, 1 good, 0 bad) of rows that are not held out.

    Null ids and labels are left out; a repeated row counts as often as it is there. The features of what is learned
    from are written out, since each step of the learning reads them twice; sums for each cell of scores come to the
    driver.
    """
    bounded_batches(df.sparkSession)
    known = labels.select(column(key).alias("id"), column(label).cast("int").alias("good"))
    known = known.where("id IS NOT NULL AND good IN (0, 1)").where(~held_out(F.col("id")))
    texts = df.select(column(key).alias("id"), F.coalesce(column(text), F.lit("")).alias("t")).where(~held_out(F.col("id")))
    # Features are smaller than texts, so they are made before rows are moved to their labels.
    rows = written(_featured(texts).join(known, "id").select("x", "good"))
    width = features(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]
    sums = _summed(rows, width)
    ranking, above, below = _unweighted(sums, width)
    if not above or not below:
        return ranking
    ranking = replace(ranking, weights=_least(_all_pairs(sums, ranking, above, below), width))

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(ranking.raw(_unpacked(batch, width)), pa.float64())], names=["s"])

    return replace(ranking, cut=_halfway(written(rows.mapInArrow(raw, "s double")), below))


def scored(df: DataFrame, key: str, text: str, ranking: Ranking) -> DataFrame:
    """Returns per row ``key`` (under its name) and ``score``, from 0 to 1.

    Texts are read whole. A null text is an empty one, whose score is that of all features zero. An empty table gives
    no rows; other columns are not read.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = words.raw(batch.column("t"))
            for lo, hi in words.chunks(offsets):
                made = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                yield pa.record_batch([batch.column("id")[lo:hi], pa.array(ranking.scores(made))], names=["id", "score"])

    bounded_batches(df.sparkSession)
    rows = df.select(column(key).alias("id"), F.coalesce(column(text), F.lit("")).alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(score, f"id {kind}, score double").withColumnRenamed("id", key)


def filtered(df: DataFrame, text: str, ranking: Ranking, least: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` whose text scores ``least`` or more, with all their columns. A null text is an empty one."""

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = words.raw(batch.column(text).fill_null(""))
            keep = [np.zeros(0, bool)]
            for lo, hi in words.chunks(offsets):
                made = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                keep.append(ranking.scores(made) >= least)
            yield batch.filter(pa.array(np.concatenate(keep)))

    bounded_batches(df.sparkSession)
    return df.mapInArrow(good, df.schema)
