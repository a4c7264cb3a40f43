"""Benchmark decontamination by spaced seeds.

A mask looks at some of the words of a window and ignores the others, so a window with a changed word still has the
same hash under a mask that ignores that place. The hashes of all windows of the test items are joined with those of
the documents; a hit says that an item may lie in a document, and there the words of both are compared one by one.

1. Each distinct text of items becomes a row for each distinct hash. A bitmap of these hashes, of bounded size, goes to
   all tasks, so that of the documents' windows only those are moved that may have a partner.
2. Hashes are joined; what comes out are pairs of a text and an item's text.
3. Each text that is in a pair is moved once, to its pairs, which bring the item's words. All diagonals on which some
   window is equal are found without listing every pair of equal windows, and the longest overlap on them is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierview.llm import words
from tierview.llm.session import bounded_batches, column, written

#: Looked-at places of a window. Any window of 12 words with one changed word, and most with two, keeps one whole; of
#: what an overlap of 6, 7 or from 9 words on may have changed, each keeps one.
MASKS = ("1111", "11011", "1010011", "110001001")

#: What items of few words need besides, which must be there whole, with both ends and ``SHARE`` of their words.
SHORT_MASKS = {1: ("1",), 2: ("11",), 3: ("111",), 4: ("1101", "1011"), 5: ("111",), 8: ("111",)}

#: Words that an overlap must span (an item of fewer words must be there whole), and the share of them that is equal.
LEAST_WORDS, SHARE = 12, 0.75

#: Bytes of test items that a task hashes at once.
BLOCK_BYTES = 1 << 20

#: Bits of the bitmap for each hash of the items, and the most that it has: 64 MB. With more hashes it lets more windows
#: pass that have no partner, and the join drops them.
BITS_PER_HASH, MOST_BITS = 64, 1 << 29

#: Rows of an address and a few numbers up to which a table is sent to all tasks; a longer one is joined by a shuffle.
SENT_ROWS = 500_000

#: Pairs of one text that one task compares; a text with more goes to several.
PAIRS_PER_TASK = 10_000

#: Pairs of equal windows that are listed at once; beyond it their diagonals are found by a convolution.
LISTED_HITS = 1 << 20

_ALL_MASKS = (*MASKS, *dict.fromkeys(mask for masks in SHORT_MASKS.values() for mask in masks))


def masks_of(n: int) -> list[int]:
    """The masks (numbers in ``_ALL_MASKS``) by which an item of ``n`` words is looked for."""
    wanted = (*MASKS, *SHORT_MASKS.get(n, ()))
    return [number for number, mask in enumerate(_ALL_MASKS) if mask in wanted and len(mask) <= n]


def masked(hashes: np.ndarray, mask: int) -> np.ndarray:
    """Hash of the looked-at words of each window, of whatever texts."""
    shape = _ALL_MASKS[mask]
    n = len(hashes) - len(shape) + 1
    total = np.full(max(n, 0), words.PLACE[40 + mask])
    for place, look in enumerate(shape):
        if look == "1":
            total += hashes[place : place + max(n, 0)] * words.PLACE[place]
    return words.mixed(total)


def address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _best(equal: np.ndarray, least: int) -> tuple[int, int, int] | None:
    """The longest run of ``least`` words or more that begins and ends with equal ones and has ``SHARE`` of them equal.

    Returns its first word, its length and its equal words; of runs of one length the first.
    """
    total = np.concatenate(([0], np.cumsum(equal)))
    places = np.flatnonzero(equal)
    if not len(places):
        return None
    # A run from i to j has the share if worth[j + 1] >= worth[i]. The last such j of each i is where the greatest worth
    # from there on, which never rises, is still enough.
    worth = total - SHARE * np.arange(len(total))
    rest = np.maximum.accumulate(worth[places + 1][::-1])
    last = len(places) - 1 - np.searchsorted(rest, worth[places] - 1e-9)
    sizes = places[last] - places + 1
    first = int(np.argmax(sizes))
    if sizes[first] < least:
        return None
    i, size = int(places[first]), int(sizes[first])
    return i, size, int(total[i + size] - total[i])


class Text:
    """The words of one text, and its windows' hashes in order."""

    def __init__(self, body: bytes):
        data = np.frombuffer(body, np.uint8)
        self.words, _, _ = words.hashed(data, np.array([0, len(data)]), words.plain_words())
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _sorted(self, mask: int) -> tuple[np.ndarray, np.ndarray]:
        if mask not in self.windows:
            own = masked(self.words, mask)
            order = np.argsort(own, kind="stable")
            self.windows[mask] = own[order], order
        return self.windows[mask]

    def lays(self, item: np.ndarray) -> np.ndarray:
        """Where the item's first word may be, as places in the text, ascending: wherever some window of both is equal."""
        found = []
        for mask in masks_of(len(item)):
            own, order = self._sorted(mask)
            hashes, of = np.unique(masked(item, mask), return_inverse=True)
            lo, hi = np.searchsorted(own, hashes, side="left"), np.searchsorted(own, hashes, side="right")
            met = np.flatnonzero(hi > lo)
            if not len(met):
                continue
            at = np.argsort(of, kind="stable")
            edges = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(hashes)))))
            mine, theirs = hi[met] - lo[met], edges[met + 1] - edges[met]
            for group in _groups(mine * theirs):
                if len(group) == 1 and mine[group[0]] * theirs[group[0]] > LISTED_HITS:
                    k = met[group[0]]
                    found.append(_diagonals(order[lo[k] : hi[k]], at[edges[k] : edges[k + 1]], len(item)))
                    continue
                # All pairs of equal windows of these hashes.
                many = mine[group] * theirs[group]
                rank = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                k, width = np.repeat(met[group], many), np.repeat(theirs[group], many)
                found.append(np.unique(order[lo[k] + rank // width] - at[edges[k] + rank % width]))
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def overlap(self, item: np.ndarray) -> tuple[int, int, int] | None:
        """First word in the text, words and equal words of the longest overlap; of equally long ones the one that lies
        first."""
        least = min(LEAST_WORDS, len(item))
        lays = self.lays(item)
        lo, hi = np.maximum(lays, 0), np.minimum(lays + len(item), len(self.words))
        best, lies = None, 0
        # Long diagonals first: one that is no longer than the overlap found cannot hold a longer one.
        for n in np.lexsort((lays, lo - hi)).tolist():
            size, lay = int(hi[n] - lo[n]), int(lays[n])
            if size < max(least, best[1] if best else 0):
                break
            if best and size == best[1] and lay > lies:
                continue
            found = _best(self.words[lo[n] : hi[n]] == item[lo[n] - lay : hi[n] - lay], least)
            if found and (not best or found[1] > best[1] or (found[1] == best[1] and lay < lies)):
                best, lies = (int(lo[n]) + found[0], *found[1:]), lay
        return best


def _groups(costs: np.ndarray) -> Iterator[np.ndarray]:
    """Neighbours of ``LISTED_HITS`` together at most; one that costs more goes alone."""
    at, ends = 0, np.cumsum(costs)
    while at < len(costs):
        before = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + LISTED_HITS, side="right")))
        yield np.arange(at, end)
        at = end


def _diagonals(mine: np.ndarray, theirs: np.ndarray, size: int) -> np.ndarray:
    """All differences of two sets of places (``theirs`` below ``size``) by convolution, a stretch of text at a time."""
    out, mine = [], np.sort(mine)
    width = 1 << max(18, int(size).bit_length())
    turned = np.zeros(2 * width)
    turned[size - 1 - theirs] = 1
    turned = np.fft.rfft(turned)
    for lo in range(int(mine[0]), int(mine[-1]) + 1, width):
        own = np.zeros(2 * width)
        own[mine[np.searchsorted(mine, lo) : np.searchsorted(mine, lo + width)] - lo] = 1
        hits = np.fft.irfft(np.fft.rfft(own) * turned, 2 * width)
        out.append(np.flatnonzero(hits > 0.5) + lo - (size - 1))
    return np.unique(np.concatenate(out))


def _item_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each item's text the distinct hashes of its windows, and their masks."""
    table = words.plain_words()
    for batch in batches:
        data, offsets = words.raw(batch.column("t"))
        for lo, hi in words.chunks(offsets, BLOCK_BYTES):
            own, bounds, _ = words.hashed(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], table)
            counts = np.diff(bounds)
            owner = np.repeat(np.arange(hi - lo), counts)
            wanted = np.zeros((len(_ALL_MASKS), hi - lo), bool)
            for n in np.unique(counts).tolist():
                wanted[np.ix_(masks_of(n), counts == n)] = True
            for mask, shape in enumerate(_ALL_MASKS):
                h = masked(own, mask)
                of = owner[: len(h)]
                whole = (of == owner[len(shape) - 1 :][: len(h)]) & wanted[mask][of]
                told = [pa.array(h[whole].view(np.int64)), batch.column("address").take(pa.array(lo + of[whole]))]
                yield pa.record_batch([*told, pa.array(np.full(int(whole.sum()), mask), pa.int32())], names=["hash", "item", "mask"])


def _bitmap(hashes: DataFrame, count: int) -> np.ndarray:
    """The bitmap of the items' hashes, packed. It is made in tasks, a stretch of it each, and has ``MOST_BITS`` at most."""
    bits = min(MOST_BITS, 1 << max(23, int(BITS_PER_HASH * max(count, 1) - 1).bit_length()))
    stretch = 1 << 23

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            place = batch.column("place").to_numpy()
            for part in np.unique(place // stretch).tolist():
                own = place[place // stretch == part] % stretch
                made.setdefault(part, np.zeros(stretch // 8, np.uint8))
                np.bitwise_or.at(made[part], own >> 3, np.uint8(1) << (own & 7).astype(np.uint8))
        for part, told in made.items():
            yield pa.record_batch([pa.array([part], pa.int64()), pa.array([told.tobytes()])], names=["part", "bits"])

    places = hashes.select(F.col("hash").bitwiseAND(F.lit(bits - 1)).alias("place"))
    dealt = places.repartition(bits // stretch, F.floor(F.col("place") / stretch))
    out = np.zeros(bits // 8, np.uint8)
    for row in dealt.mapInArrow(set_bits, "part bigint, bits binary").collect():
        out[row.part * stretch // 8 : (row.part + 1) * stretch // 8] |= np.frombuffer(row.bits, np.uint8)
    return out


def _text_hashes(sent, masks: list[int]):
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each text the distinct hashes of windows that the bitmap has."""
        table, bitmap = words.plain_words(), sent.value
        low = words.U64(8 * len(bitmap) - 1)
        for batch in batches:
            data, offsets = words.raw(batch.column("t"))
            for lo, hi in words.chunks(offsets):
                own, bounds, _ = words.hashed(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], table)
                owner = np.repeat(np.arange(hi - lo), np.diff(bounds))
                for mask in masks:
                    h = masked(own, mask)
                    place = (h & low).astype(np.int64)
                    near = np.flatnonzero(bitmap[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                    near = near[owner[near] == owner[near + len(_ALL_MASKS[mask]) - 1]]
                    if not len(near):
                        continue
                    told = np.unique(np.stack((owner[near], h[near].view(np.int64))), axis=1)
                    text = batch.column("address").take(pa.array(lo + told[0]))
                    yield pa.record_batch([pa.array(told[1]), text], names=["hash", "text"])

    return hashes


_OVERLAP = "text string, item string, first_word bigint, n_words bigint, n_equal bigint"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by text and part: first a text's body (no item), then the words of its items."""
    held, own = None, None
    for batch in batches:
        told = []
        texts, parts, items = (batch.column(c).to_pylist() for c in ("text", "part", "item"))
        for n, (text, part, item) in enumerate(zip(texts, parts, items)):
            body = batch.column("body")[n].as_buffer()
            if item is None:
                held, own = (text, part), Text(body)
                continue
            if held != (text, part):
                raise ValueError(f"the text {text} is not there with its pairs")
            found = own.overlap(np.frombuffer(body, words.U64))
            if found:
                told.append((text, item, *found))
        columns = list(zip(*told)) if told else [()] * 5
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["text", "item", "first_word", "n_words", "n_equal"])


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = words.plain_words()
    for batch in batches:
        data, offsets = words.raw(batch.column("t"))
        for lo, hi in words.chunks(offsets, BLOCK_BYTES):
            own, bounds, _ = words.hashed(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], table)
            bodies = [own[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.record_batch([batch.column("address")[lo:hi], pa.array(bodies, pa.binary())], names=["item", "body"])


def _addressed(df: DataFrame, text: str) -> DataFrame:
    body = F.coalesce(column(text), F.lit(""))
    return df.select(address(body).alias("address"), body.alias("t"))


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SENT_ROWS else df


def _found(df: DataFrame, text: str, items: DataFrame, item_text: str) -> DataFrame:
    """``text, item`` (addresses), ``first_word, n_words, n_equal`` of all texts and items' texts that overlap."""
    session = df.sparkSession
    bounded_batches(session)
    parts = int(session.conf.get("spark.sql.shuffle.partitions"))
    tests = _addressed(items, item_text).dropDuplicates(["address"])
    hashes = written(tests.mapInArrow(_item_hashes, "hash bigint, item string, mask int").dropDuplicates(["hash", "item"]))
    count, masks = hashes.count(), sorted(r.mask for r in hashes.select("mask").distinct().collect())
    sent = session.sparkContext.broadcast(_bitmap(hashes, count))

    docs = _addressed(df, text)
    hits = docs.mapInArrow(_text_hashes(sent, masks), "hash bigint, text string")
    known = _sent(hashes.select("hash", "item"), count)
    pairs = written(hits.join(known, "hash").select("text", "item").distinct())
    sent.destroy()

    of = pairs.groupBy("text").agg(F.ceil(F.count("*") / PAIRS_PER_TASK).cast("int").alias("parts"))
    of = written(of)
    few = _sent(of, of.count())
    bodies = docs.join(few, F.col("address") == F.col("text")).select("text", "parts", "t").dropDuplicates(["text"])
    none = F.lit(None).cast("string").alias("item")
    bodies = bodies.select("text", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), none, F.col("t").cast("binary").alias("body"))
    theirs = tests.mapInArrow(_item_words, "item string, body binary")
    dealt = pairs.join(few, "text").withColumn("part", F.pmod(F.xxhash64("item"), F.col("parts")).cast("int"))
    dealt = dealt.join(theirs, "item").select("text", "part", "item", "body")
    rows = bodies.union(dealt).repartition(parts, "text", "part").sortWithinPartitions("text", "part", F.col("item").asc_nulls_first())
    return written(rows.mapInArrow(_compared, _OVERLAP))


def overlaps(df: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """Returns a row for each document and item that overlap: ``key`` and ``item_key`` (under their names),
    ``first_word`` (in the document, from 0), ``n_words`` and ``n_equal`` of the longest overlap.

    Words are runs of letters and digits, A-Z as a-z. An overlap spans at least ``LEAST_WORDS`` words (an item of
    fewer must be there whole, from end to end), begins and ends with equal words, and ``SHARE`` of its words are
    equal, at the same distances. Items without words, null and empty texts overlap with nothing. Repeated rows of either
    table give repeated results, rows without an id are reported as such. Empty tables give no rows; other columns are
    not read.

    Moved are windows that may have a partner, an address for each, and the texts that have one, once each, however many
    copies there are. A window that many texts and items share is one row for each of them, in a join that Spark splits.
    """
    found = _found(df, text, items, item_text)
    kinds = items.select(column(item_key).alias("item_id"), address(column(item_text)).alias("item"))
    keyed = found.join(kinds, "item").select("text", "item_id", "first_word", "n_words", "n_equal")
    rows = df.select(column(key).alias("id"), address(column(text)).alias("text"))
    out = rows.join(_sent(keyed, found.count()), "text")
    return out.select(F.col("id").alias(key), F.col("item_id").alias(item_key), "first_word", "n_words", "n_equal")


def clean(df: DataFrame, text: str, items: DataFrame, item_text: str) -> DataFrame:
    """The rows of ``df`` whose text overlaps with no item, with all their columns. A null text is an empty one."""
    away = written(_found(df, text, items, item_text).select(F.col("text").alias("__text")).distinct())
    kept = df.select(F.struct("*").alias("__row"), address(column(text)).alias("__address"))
    kept = kept.join(_sent(away, away.count()), F.col("__address") == F.col("__text"), "left_anti")
    return kept.select(*(F.col("__row")[c].alias(c) for c in df.columns))
