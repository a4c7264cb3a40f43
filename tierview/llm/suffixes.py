"""Removal of repeated byte strings by a hash-compared suffix sort.

A byte goes if a string of 50 bytes over it also starts in a document with a smaller id. Strings of 50 bytes are far
too many to be sorted or moved, so each is owned by an anchor: of the 27 places in it at which 24 bytes begin, the one
with the smallest hash. Equal strings have equal anchors at equal distances, and neighbouring strings mostly share one,
so there is an anchor for every 14 bytes.

1. Anchors whose whole span (all the strings that they own) is equal are one class. All but those in the class's first
   document are repeats. Within a chunk of texts the bytes of each are compared with those of the class's first; across
   chunks spans are equal if a second hash of 64 bits, of another kind, agrees as well.
2. What is left are the first members of classes that share an anchor's 24 bytes with another class: the ends of
   repeats, and chance. Their spans are cut from the texts, and all strings of 50 bytes in them, which are suffixes
   cut off at 50, are sorted: two suffixes are compared by binary search for their common extension on prefix
   polynomial hashes, in a mergesort. Neighbours of equal hashes are compared byte by byte. Of equal ones, all but
   those of the first document are repeats.
3. The repeats of a document are joined into runs and cut from its text.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierview.llm import words
from tierview.llm.session import bounded_batches, column, written
from tierview.llm.words import U64

LENGTH, GRAM = 50, 24
_PLACES = LENGTH - GRAM + 1

#: Spans with the same anchor from which on their strings are dealt out one by one, so that no task gets them all, and
#: spans that are sorted at once. No result depends on either.
HEAVY, SORTED = 4096, 4096

_RNG = np.random.Generator(np.random.PCG64(50))
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_STEP = int(_RNG.integers(1, 2**63, dtype=np.uint64)) | 1
_POSITION = U64((1 << 24) - 1)


def prefixes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix polynomial hashes of ``data``, and the factors that bring a difference of two to the first place."""
    up, down = words._powers(1 << max(16, int(len(data)).bit_length()))
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_VALUE[data] * up[: len(data)], out=total[1:])
    return total, down


def _grams(data: np.ndarray) -> np.ndarray:
    """Hashes of all strings of ``GRAM`` bytes, from those of half and of what is left over."""
    power, width, step = _VALUE[data], 1, _STEP
    total, have, shift = None, 0, 1
    while True:
        if GRAM & width:
            part = power[have:] * U64(shift) if total is not None else power
            n = len(part) if total is None else min(len(total), len(part))
            total = part[:n] if total is None else total[:n] + part[:n]
            have, shift = have + width, shift * step % 2**64
        if 2 * width > GRAM:
            return words.mixed(total)
        power = power[:-width] + power[width:] * U64(step)
        width, step = 2 * width, step * step % 2**64


def _spelled(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[np.ndarray]:
    """The bytes of spans, eight at a time; the last eight again where a span is shorter than the longest."""
    eights = np.ndarray(max(len(data) - 7, 0), "<u8", np.ascontiguousarray(data), 0, (1,))
    for at in range(0, LENGTH + _PLACES - 1, 8):
        yield eights[np.minimum(first + at, last + LENGTH - 8)]


def _second(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of spans that shares no step with the polynomial one: each eight bytes are mixed into what was before."""
    total = (last - first).astype(U64)
    for part in _spelled(data, first, last):
        total = words.mixed((total ^ part) * U64(_STEP) + words.PLACE[4])
    return total


def _classes(data: np.ndarray, first: np.ndarray, last: np.ndarray, doc: np.ndarray, *hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of spans by class and document, and whether each in it begins a class. Classes have equal bytes."""
    order = np.lexsort((doc, *hashes))
    head = np.ones(len(order), bool)
    head[1:] = np.any([h[order][1:] != h[order][:-1] for h in hashes], axis=0)
    other = np.flatnonzero(~head)
    mine, its = order[other], order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))[other]]
    equal = last[mine] - first[mine] == last[its] - first[its]
    for a, b in zip(_spelled(data, first[mine], last[mine]), _spelled(data, first[its], last[its])):
        equal &= a == b
    if not equal.all():  # a collision: by their bytes instead
        number: dict[bytes, int] = {}
        spans = (data[a : b + LENGTH].tobytes() for a, b in zip(first.tolist(), last.tolist()))
        told = np.array([number.setdefault(span, len(number)) for span in spans])
        order = np.lexsort((doc, told))
        head[1:] = told[order][1:] != told[order][:-1]
    return order, head


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """All anchors of the texts: text, place of the anchor, first and last string that it owns, its hash, two of its span.

    Places count from the beginning of ``data``, which must be shorter than 2**24 unless it is one text.
    """
    n = len(data) - LENGTH + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none, none.astype(U64), none.astype(U64), none.astype(U64)
    grams = _grams(data)
    count = len(grams)
    bits = max(24, int(count).bit_length())
    key = (grams >> U64(bits) << U64(bits)) | np.arange(count, dtype=U64)
    width = 1
    while 2 * width <= _PLACES:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    rest = _PLACES - width
    key = np.minimum(key[: len(key) - rest], key[rest:])
    place = (key & U64((1 << bits) - 1)).astype(np.int64)

    sizes = np.diff(offsets)
    runs = np.maximum(sizes - LENGTH + 1, 0)
    begins = np.cumsum(runs) - runs
    start = np.repeat(offsets[:-1] - begins, runs) + np.arange(runs.sum())
    text = np.repeat(np.arange(len(sizes)), runs)
    at = place[start]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])))) if len(at) else none
    last = np.append(new[1:], len(at)) - 1 if len(at) else none
    text, at, first, last = text[new], at[new], start[new], start[last]
    total, down = prefixes(data)
    span = (total[last + LENGTH] - total[first]) * down[first]
    span += (at - first).astype(U64) * words.PLACE[1] + (last - first).astype(U64) * words.PLACE[2]
    return text, at, first, last, grams[at], words.mixed(span), _second(data, first, last)


def sort_suffixes(data: np.ndarray, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the strings of ``LENGTH`` bytes that begin ``at``, within groups, stable. ``group`` must be sorted.

    Returns the order and, of each string in it, whether it equals the one before it in its group. A mergesort of all
    groups at once: a string's place in its merged block is its place in its own half and its rank in the other, which
    binary search finds by comparing suffixes.
    """
    total, down = prefixes(data)
    # Of each string: what its prefix hashes are taken from, that of all of it, and its first eight bytes.
    base, factor = total[at], down[at]
    whole = (total[at + LENGTH] - base) * factor
    front = np.ndarray(max(len(data) - 7, 0), ">u8", np.ascontiguousarray(data), 0, (1,))[at].astype(U64)

    def extension(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Common bytes of two strings that are not equal but in their first eight bytes: binary search for the longest
        prefixes of equal hash."""
        a, b, ta, tb, fa, fb = at[x], at[y], base[x], base[y], factor[x], factor[y]
        lo, hi = np.full(len(x), 8), np.full(len(x), LENGTH - 1)
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = (total[a + mid] - ta) * fa == (total[b + mid] - tb) * fb
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def less(x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        ours, theirs = front[x], front[y]
        out = np.where(whole[x] == whole[y], or_equal, False)
        differ = ours != theirs
        out[differ] = (ours < theirs)[differ]
        deep = np.flatnonzero(~differ & (whole[x] != whole[y]))
        if deep.size:
            x, y = x[deep], y[deep]
            common = extension(x, y)
            out[deep] = data[at[x] + common] < data[at[y] + common]
        return out

    n = len(at)
    order = np.arange(n)
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if n else order
    sizes = np.diff(np.append(starts, n))
    begin, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    local = np.arange(n) - begin
    width = 1
    while n and width < sizes.max():
        # The other half of the block, cut off at the group's end.
        half = local // width
        left = half % 2 == 0
        other = begin + np.minimum(np.where(left, half + 1, half - 1) * width, size)
        end = np.minimum(other + width, begin + size)
        live = np.flatnonzero(end > other)
        mine, lo, hi = order[live], other[live].copy(), end[live].copy()
        ties = ~left[live]  # equal strings keep their order: those of the left half come first
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            before = less(order[mid], mine[open_], ties[open_])
            lo[open_] = np.where(before, mid + 1, lo[open_])
            hi[open_] = np.where(before, hi[open_], mid)
        block = begin[live] + (half[live] // 2) * 2 * width
        target = block + local[live] % width + (lo - other[live])
        moved = order.copy()
        moved[target] = order[live]
        order = moved
        width *= 2

    same = np.zeros(n, bool)
    if n > 1:
        a, b = at[order[:-1]], at[order[1:]]
        near = np.flatnonzero((group[1:] == group[:-1]) & (whole[order[1:]] == whole[order[:-1]]))
        true = (data[a[near, None] + np.arange(LENGTH)] == data[b[near, None] + np.arange(LENGTH)]).all(axis=1)
        if not true.all():  # a collision: by their bytes instead
            rows = [bytes(data[i : i + LENGTH]) for i in at.tolist()]
            order = np.array(sorted(range(n), key=lambda i: (group[i], rows[i])))
            same[1:] = [group[x] == group[y] and rows[x] == rows[y] for x, y in zip(order[:-1], order[1:])]
            return order, same
        same[near + 1] = True
    return order, same


# What moves. An anchor is (k1, h, k2, id, c): k1 has 40 bits of its hash, its tag, and 24 of its span's first hash; h is
# its span's second hash; k2 has 32 bits of its place in the text, and 6 each of the distances to the first and last string
# that it owns. Anchors of equal k1 and h are a class. A run of repeats has neither, and its ends in k2. c tells apart
# texts that share an id; it is 0 where ids are unique.
_ANCHORED = "k1 bigint, h bigint, k2 bigint, id bigint, c bigint"
_TOLD = "id bigint, c bigint, tag bigint, x bigint"


def _owned(k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last string that an anchor owns, as places in its text."""
    place = (k2 >> 12) & 0xFFFFFFFF
    return place - ((k2 >> 6) & 63), place + (k2 & 63) - _PLACES


def _run(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (first << 32) | (last + LENGTH)


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors, one for each class of a chunk of texts; for the others that have a smaller id there, the run."""
    for batch in batches:
        data, offsets = words.raw(batch.column("t"))
        ids, c = batch.column("id").to_numpy(), batch.column("c").to_numpy()
        for lo, hi in words.chunks(offsets):
            own = offsets[lo : hi + 1] - offsets[lo]
            part = data[offsets[lo] : offsets[hi]]
            text, at, first, last, tag, kind, second = anchors(part, own)
            doc, base = ids[lo + text], own[text]
            order, head = _classes(part, first, last, doc, kind, second)
            least = np.empty(len(order), np.int64)
            least[order] = doc[order][np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
            mine, again = np.flatnonzero(doc == least), np.flatnonzero(doc > least)
            k1 = ((tag[mine] >> U64(24) << U64(24)) | (kind[mine] >> U64(40))).view(np.int64)
            k2 = ((at - base)[mine] << 12) | ((at - first)[mine] << 6) | (last - at)[mine] + _PLACES
            # Neighbouring anchors own neighbouring strings, so whole copies become one run.
            a, b, of = (first - base)[again], (last - base)[again], text[again]
            new = np.ones(len(again), bool)
            new[1:] = (of[1:] != of[:-1]) | (a[1:] != b[:-1] + 1)
            heads = np.flatnonzero(new)
            ends = np.append(heads[1:], len(again))[: len(heads)] - 1
            runs = _run(a[heads], b[ends])
            of = lo + np.concatenate((text[mine], of[heads]))
            known = np.arange(len(of)) >= len(mine)
            yield pa.record_batch(
                [
                    pa.array(np.concatenate((k1, runs)), mask=known),
                    pa.array(np.concatenate((second[mine].view(np.int64), runs)), mask=known),
                    pa.array(np.concatenate((k2, runs))),
                    pa.array(ids[of]),
                    pa.array(c[of]),
                ],
                names=["k1", "h", "k2", "id", "c"],
            )


def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors come sorted by tag, class and id; runs pass. Of a class, those after the first document are runs. The
    others stay open if their tag has several classes. Between batches only the tag's one class so far is held."""
    lead: tuple | None = None  # tag, class and first id of the last row
    held = np.zeros((0, 3), np.int64)  # k2, id, c of the last tag's first documents, while it has one class
    opened = False  # has the last tag several?
    for batch in batches:
        told = batch.filter(batch.column("k1").is_null())
        if told.num_rows:
            yield _rows(*(told.column(n).to_numpy() for n in ("id", "c")), None, told.column("k2").to_numpy())
        batch = batch.filter(batch.column("k1").is_valid())
        if not batch.num_rows:
            continue
        k1, h, k2, doc, c = (batch.column(n).to_numpy() for n in ("k1", "h", "k2", "id", "c"))
        tag, kind = k1 >> 24, np.stack((k1, h))
        new = np.ones(len(tag), bool)
        new[1:] = (kind[:, 1:] != kind[:, :-1]).any(axis=0)
        least = doc[np.maximum.accumulate(np.where(new, np.arange(len(tag)), 0))]
        goes_on = lead is not None and lead[0] == tag[0]
        if goes_on and lead[1] == (k1[0], h[0]):
            new[0] = False
            least[: (np.flatnonzero(new)[0] if new.any() else len(new))] = lead[2]
        again = doc > least
        yield _rows(doc[again], c[again], None, _run(*_owned(k2[again])))

        # Classes of each tag in this batch; the first tag may have had some before, the last may get more.
        group = np.cumsum(np.concatenate(([0], tag[1:] != tag[:-1])))
        several = np.bincount(group, weights=new) + 0
        several[0] += goes_on * (1 + opened)
        several = several > 1
        if goes_on and several[0] and len(held):
            yield _rows(held[:, 1], held[:, 2], np.full(len(held), lead[0]), held[:, 0])
        if not goes_on or several[0] or group[-1] > 0:
            held = held[:0]
        out = np.flatnonzero(~again & several[group])
        yield _rows(doc[out], c[out], tag[out], k2[out])
        opened = bool(several[-1])
        if not opened:
            stay = np.flatnonzero(~again & (group == group[-1]))
            held = np.concatenate((held, np.stack((k2[stay], doc[stay], c[stay].astype(np.int64)), axis=1)))
        lead = (tag[-1], (k1[-1], h[-1]), least[-1])


def _rows(doc: np.ndarray, c: np.ndarray, tag: np.ndarray | None, x: np.ndarray) -> pa.RecordBatch:
    tags = pa.nulls(len(doc), pa.int64()) if tag is None else pa.array(tag)
    return pa.record_batch([pa.array(doc), pa.array(c), tags, pa.array(x)], names=["id", "c", "tag", "x"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of a document's open spans; under a heavy tag each string alone, with a tag of its own content."""
    for batch in batches:
        data, offsets = words.raw(batch.column("t"))
        ids, c, spans = batch.column("id").to_pylist(), batch.column("c").to_pylist(), batch.column("spans")
        for row in range(batch.num_rows):
            own = data[offsets[row] : offsets[row + 1]].tobytes()
            told = spans[row].values
            tag, k2, heavy = (told.field(n).to_numpy(zero_copy_only=False) for n in ("tag", "x", "heavy"))
            first, last = _owned(k2)
            tags, places, bodies = [], [], []
            for g, a, b, h in zip(tag.tolist(), first.tolist(), last.tolist(), heavy.tolist()):
                if not h:
                    tags.append(g)
                    places.append(a)
                    bodies.append(own[a : b + LENGTH])
                    continue
                for i in range(a, b + 1):
                    body = own[i : i + LENGTH]
                    tags.append(int.from_bytes(blake2b(body, digest_size=5).digest(), "little") - (1 << 40))
                    places.append(i)
                    bodies.append(body)
            n = len(tags)
            yield pa.record_batch(
                [pa.array(tags, pa.int64()), pa.array([ids[row]] * n, pa.int64()), pa.array([c[row]] * n, pa.int64()), pa.array(places, pa.int64()), pa.array(bodies, pa.binary())],
                names=["tag", "id", "c", "lo", "body"],
            )


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans come sorted by tag and id. Sorts their suffixes ``SORTED`` spans at a time; of a tag that goes on, only
    the first of each string is carried over, as a span of its own."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        while held.num_rows >= SORTED:
            part, held = held.slice(0, SORTED).combine_chunks(), held.slice(SORTED)
            runs, firsts = _resolved(part)
            yield runs
            goes_on = held.num_rows == 0 or held.column("tag")[0].as_py() == part.column("tag")[-1].as_py()
            if goes_on:
                held = pa.concat_tables([firsts, held])
                if firsts.num_rows >= SORTED // 2 and held.num_rows >= SORTED:  # many strings of one tag: all of what is here
                    runs, firsts = _resolved(held.combine_chunks())
                    yield runs
                    held = firsts
                    break
    if held is not None and held.num_rows:
        yield _resolved(held.combine_chunks())[0]


def _resolved(part: pa.Table) -> tuple[pa.RecordBatch, pa.Table]:
    """The runs of repeats in these spans, and the first of each string of the last tag."""
    one = part.to_batches()[0]
    data, offsets = words.raw(one.column("body"))
    tag, doc, c, lo = (one.column(n).to_numpy() for n in ("tag", "id", "c", "lo"))
    counts = np.diff(offsets) - LENGTH + 1
    row = np.repeat(np.arange(len(counts)), counts)
    shift = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = offsets[row] + shift
    mine, same = sort_suffixes(data, at, tag[row])
    least = doc[row[mine]][np.maximum.accumulate(np.where(same, 0, np.arange(len(mine))))]
    hits = np.sort(mine[doc[row[mine]] > least])  # in the order of spans and places
    new = np.ones(len(hits), bool)
    new[1:] = (row[hits][1:] != row[hits][:-1]) | (hits[1:] != hits[:-1] + 1)
    heads = hits[new]
    ends = hits[np.append(np.flatnonzero(new)[1:], len(hits))[: len(heads)] - 1] if len(hits) else hits
    first = lo[row[heads]] + shift[heads]
    runs = _rows(doc[row[heads]], c[row[heads]], None, _run(first, lo[row[ends]] + shift[ends]))

    later = np.zeros(len(row), bool)
    later[mine[same]] = True
    keep = np.flatnonzero(~later & (tag[row] == tag[-1]))
    bodies = [data[i : i + LENGTH].tobytes() for i in at[keep].tolist()]
    firsts = pa.table(
        [pa.array(tag[row[keep]]), pa.array(doc[row[keep]]), pa.array(c[row[keep]]), pa.array(lo[row[keep]] + shift[keep]), pa.array(bodies, pa.binary())],
        schema=part.schema,
    )
    return runs, firsts


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs = batch.column("runs")
        data, offsets = words.raw(batch.column("t"))
        removed, spans, kept = [], [], []
        for row in range(batch.num_rows):
            own = data[offsets[row] : offsets[row + 1]]
            told = np.sort(runs[row].values.to_numpy()) if runs[row].is_valid else np.zeros(0, np.int64)
            edge = np.zeros(len(own) + 1, np.int32)
            np.add.at(edge, told >> 32, 1)
            np.add.at(edge, told & 0xFFFFFFFF, -1)
            gone = np.cumsum(edge[:-1]) > 0
            removed.append(int(gone.sum()))
            spans.append(int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0])))
            kept.append(own[~gone].tobytes())
        yield pa.record_batch(
            [batch.column("id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
            names=["id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def remove_repeats(df: DataFrame, key: str, text: str) -> DataFrame:
    """Returns per row ``key`` (an integer, under its name), ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``.

    ``kept`` are the bytes that remain, which need not be whole characters. A null text is empty. Rows that share an
    id remove nothing from each other, and each is judged by its own text. A row without an id has no place in the
    order: it loses nothing, and nothing goes for its sake. An empty table gives no rows; other columns are not read.

    Anchors are the only thing of the size of the input that is moved besides the texts, some 30 bytes for each 14. A
    class is one row of a chunk of texts by then, however many copies it has. Sorting is Spark's, so an anchor of any
    number of rows is read in order and not held; one that many different spans share is dealt out by their strings.
    """
    bounded_batches(df.sparkSession)
    docs = df.select(column(key).cast("long").alias("id"), F.coalesce(column(text), F.lit("")).alias("t"))
    shared = not docs.where("id IS NOT NULL").groupBy("id").count().where("count > 1").isEmpty()
    docs = docs.select("id", F.xxhash64("t").alias("c") if shared else F.lit(0).cast("bigint").alias("c"), "t")

    found = docs.where("id IS NOT NULL").mapInArrow(_anchored, _ANCHORED)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tag = F.shiftright("k1", 24)
    dealt = found.repartition(parts, F.coalesce(tag, F.xxhash64("id", "k2")))
    dealt = dealt.sortWithinPartitions("k1", "h", "id")
    told = written(dealt.mapInArrow(_classed, _TOLD))

    spans = told.where("tag IS NOT NULL")
    heavy = spans.groupBy("tag").count().where(F.col("count") > HEAVY).select("tag", F.lit(True).alias("heavy"))
    spans = spans.join(heavy, "tag", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))
    of = spans.groupBy("id", "c").agg(F.collect_list(F.struct("tag", "x", "heavy")).alias("spans"))
    # Both joins with the texts ask for the same rows, so that they are moved once.
    placed = docs.where("id IS NOT NULL")
    bodies = placed.distinct() if shared else placed
    cut = bodies.join(of, ["id", "c"]).select("id", "c", "t", "spans")
    cut = cut.mapInArrow(_cut, "tag bigint, id bigint, c bigint, lo bigint, body binary")
    more = cut.repartition(parts, "tag").sortWithinPartitions("tag", "id").mapInArrow(_sorted, _TOLD)

    runs = told.where("tag IS NULL").unionByName(more).groupBy("id", "c").agg(F.collect_list("x").alias("runs"))
    rows = placed.join(runs, ["id", "c"], "left").select("id", "t", "runs")
    lone = docs.where("id IS NULL").select("id", "t", F.lit(None).cast("array<bigint>").alias("runs"))
    out = rows.unionByName(lone).mapInArrow(_removed, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    kind = df.schema[key].dataType
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", key)
