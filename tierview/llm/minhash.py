"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

A text is the set of its distinct runs of five words. Texts with equal sets are one class, which its smallest id
stands for. A class's signature comes from two permutations of 32 bits: the first spreads the hashed shingles, and
coordinate k is the smallest value that the second gives to the spread shingles shifted around the circle by k. Bands
of coordinates are buckets, and classes that share one may be alike.

Inside a bucket pairs are not formed. Each member is held against the bucket's hub, the class that shares most
buckets, on the full sets. What is connected by then needs no further look. All classes that met a hub are its group;
where a group ended in several components, members of different ones are compared, block by block within tasks, and
only links come out, one for each class and component. So all links between buckets' members that matter are found,
and each is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierview.llm import words
from tierview.llm.components import components
from tierview.llm.session import bounded_batches, checkpointed, column

SHINGLE, PERCENT = 5, 75

#: A pair at 75 % shares a band of 5 with probability 0.237, so all 56 are missed by 3 pairs in 10 million.
BANDS, ROWS = 56, 5

#: Members that are held against a hub in one task, and members of a block when a group is compared within itself.
PART, BLOCK = 256, 256

_U32 = np.uint32
_SPREAD, _SHIFTED = (0x9E3779B9, 0x85EBCA6B, 0xC2B2AE35), (0x7F4A7C15, 0x2C1B3C6D, 0x297A2D39)


def _permuted(x: np.ndarray, keys: tuple[int, int, int]) -> np.ndarray:
    """A permutation of the 32-bit integers."""
    x = x ^ _U32(keys[0])
    x ^= x >> _U32(16)
    x *= _U32(keys[1])
    x ^= x >> _U32(15)
    x *= _U32(keys[2])
    x ^= x >> _U32(16)
    return x


def signatures(shingles: np.ndarray, begins: np.ndarray, size: int) -> np.ndarray:
    """Signature of each non-empty set; one row for each. ``begins`` as of ``words.shingled``, without the end."""
    spread = _permuted((shingles >> words.U64(32)).astype(_U32) ^ shingles.astype(_U32), _SPREAD)
    out = np.full((len(begins), size), 0xFFFFFFFF, _U32)
    ends = np.append(begins[1:], len(spread))
    block = 1 << 15  # stays in the processor's cache
    for at in range(0, len(spread), block):
        part = spread[at : at + block]
        lo = int(np.searchsorted(ends, at, side="right"))
        hi = int(np.searchsorted(begins, at + len(part), side="left"))
        cuts = np.maximum(begins[lo:hi] - at, 0)
        for k in range(size):
            least = np.minimum.reduceat(_permuted(part + _U32(k), _SHIFTED), cuts)
            np.minimum(out[lo:hi, k], least, out=out[lo:hi, k])
    return out


def _sets(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> list[np.ndarray]:
    hashes, bounds, _ = words.hashed(data, offsets, table)
    shingles, begins = words.shingled(hashes, bounds, SHINGLE)
    return [np.unique(shingles[a:b]) for a, b in zip(begins[:-1], begins[1:])]


def sketched(df: DataFrame, key: str, text: str) -> DataFrame:
    """Per row ``id``, ``n`` (set size), ``c1`` and ``c2`` (of equal sets alike) and ``bands``; null for empty sets."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = words.white_space_words()
        salt = words.PLACE[:ROWS]
        for batch in batches:
            data, offsets = words.raw(batch.column("t"))
            for lo, hi in words.chunks(offsets):
                sets = _sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], table)
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                c = np.zeros((len(sets), 2), np.int64)
                bands: list[np.ndarray | None] = [None] * len(sets)
                if len(full):
                    begins = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
                    signed = signatures(np.concatenate([sets[i] for i in full]), begins, BANDS * ROWS)
                    folded = (signed.reshape(len(full), BANDS, ROWS).astype(words.U64) + words.U64(1)) * salt
                    banded = words.mixed(folded.sum(axis=2) + np.arange(BANDS, dtype=words.U64) * words.PLACE[62]).view(np.int64)
                    for row, i in enumerate(full):
                        bands[i] = banded[row]
                        c[i] = np.frombuffer(blake2b(sets[i].tobytes(), digest_size=16).digest(), np.int64)
                empty = sizes == 0
                yield pa.record_batch(
                    [
                        batch.column("id")[lo:hi],
                        pa.array(sizes),
                        pa.array(c[:, 0], mask=empty),
                        pa.array(c[:, 1], mask=empty),
                        pa.array(bands, pa.list_(pa.int64())),
                    ],
                    names=["id", "n", "c1", "c2", "bands"],
                )

    bounded_batches(df.sparkSession)
    rows = df.select(column(key).alias("id"), F.coalesce(column(text), F.lit("")).alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(sketch, f"id {kind}, n bigint, c1 bigint, c2 bigint, bands array<bigint>")


def _verified(df: DataFrame, key: str, text: str, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are alike. Every a is a hub: its text goes before its members', in parts of them."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = words.white_space_words()
        group, hubs = None, []
        for batch in batches:
            data, offsets = words.raw(batch.column("t"))
            hub, part, member, ids = (batch.column(c).to_pylist() for c in ("hub", "part", "member", "id"))
            a, b = [], []
            for lo, hi in words.chunks(offsets):
                sets = _sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], table)
                for i, own in zip(range(lo, hi), sets):
                    if group != (hub[i], part[i]):
                        group, hubs = (hub[i], part[i]), []
                    if not member[i]:
                        hubs.append(own)
                        continue
                    for other in hubs:
                        # Equal numbers stand side by side once both sets are sorted together.
                        both = np.concatenate((own, other))
                        both.sort(kind="stable")
                        common = int(np.count_nonzero(both[1:] == both[:-1]))
                        if 100 * common >= PERCENT * (len(both) - common):
                            a.append(hub[i])
                            b.append(ids[i])
                            break
            yield pa.record_batch([pa.array(a, batch.column("hub").type), pa.array(b, batch.column("id").type)], names=["a", "b"])

    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).alias("parts"))
    dealt = pairs.join(sizes, "a").select(
        F.col("b").alias("id"), F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), "parts").alias("part"), F.lit(True).alias("member")
    )
    hubs = sizes.select(
        F.col("a").alias("id"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("member")
    )
    texts = df.select(column(key).alias("id"), column(text).alias("t")).where("t IS NOT NULL")
    wanted = texts.join(dealt.unionByName(hubs), "id").select("hub", "part", "member", "id", "t")
    kind = wanted.schema["id"].dataType.simpleString()
    together = wanted.repartition("hub", "part").sortWithinPartitions("hub", "part", "member")
    return together.mapInArrow(verify, f"a {kind}, b {kind}").distinct()


def _between(df: DataFrame, key: str, text: str, stars: DataFrame, grouped: DataFrame) -> DataFrame:
    """Links between members of a hub's group that are in different components.

    Most of a group is in the hub's component; the others are held against it, and against each other, in blocks.
    """
    group = stars.unionByName(stars.select("a", F.col("a").alias("b")).distinct()).select(F.col("a").alias("hub"), F.col("b").alias("id"))
    named = grouped.withColumnRenamed("node", "id")
    placed = group.join(named, "id", "left").withColumn("component", F.coalesce("component", "id"))
    # A hub with very many members: counts are summed up before they are moved, and no sum stands above a join on the
    # hub, so that Spark can split it.
    own = placed.where("id = hub").select("hub", F.col("component").alias("first")).distinct()
    inners = placed.join(own.withColumnRenamed("first", "component"), ["hub", "component"]).groupBy("hub").agg(F.count("*").alias("n"))
    sizes = placed.groupBy("hub").agg(F.count("*").alias("all")).join(inners, "hub").join(own, "hub")
    sizes = sizes.select("hub", "first", _blocks("n").alias("inners"), _blocks("all - n").alias("outers")).where("outers > 0")
    placed = placed.join(sizes, "hub").withColumn("inner", F.col("component") == F.col("first"))
    placed = checkpointed(placed.drop("first"))

    def block(blocks: str):
        return F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int").alias("y")

    # A pair of blocks is (kind, x, y): kind 1 is an outer block x against an inner block y, kind 0 two outer ones.
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    inner = placed.where("inner").select("hub", "id", "component", F.lit(1).alias("kind"), F.explode(upto("outers")).alias("x"), block("inners"), F.lit(1).alias("side"))
    outer = placed.where("NOT inner").withColumn("o", block("outers"))
    against = outer.select("hub", "id", "component", F.lit(1).alias("kind"), F.col("o").alias("x"), F.explode(upto("inners")).alias("y"), F.lit(0).alias("side"))
    among = outer.select("hub", "id", "component", "o", F.explode(upto("outers")).alias("p"))
    among = among.select(
        "hub", "id", "component", F.lit(0).alias("kind"), F.least("o", "p").alias("x"), F.greatest("o", "p").alias("y"), (F.col("o") > F.col("p")).cast("int").alias("side")
    )
    unit = ["hub", "kind", "x", "y"]
    texts = df.select(column(key).alias("id"), column(text).alias("t")).where("t IS NOT NULL")
    rows = texts.join(inner.unionByName(against).unionByName(among), "id").select(*unit, "side", "id", "component", "t")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(_compared, f"a {kind}, b {kind}").distinct()


def _blocks(rows: str):
    return F.ceil(F.expr(rows) / BLOCK).cast("int")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Holds the documents of one pair of blocks at a time. ``side`` tells the blocks apart, unless it is one block."""
    table = words.white_space_words()
    held, rows, kind = None, [], None
    for batch in batches:
        data, offsets = words.raw(batch.column("t"))
        unit = list(zip(*(batch.column(c).to_pylist() for c in ("hub", "kind", "x", "y"))))
        told = list(zip(*(batch.column(c).to_pylist() for c in ("side", "id", "component"))))
        kind = batch.column("id").type
        for lo, hi in words.chunks(offsets):
            sets = _sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], table)
            for i, own in zip(range(lo, hi), sets):
                if unit[i] != held:
                    yield _linked(held, rows, kind)
                    held, rows = unit[i], []
                rows.append((*told[i], own))
    if held is not None:
        yield _linked(held, rows, kind)


def _linked(unit: tuple | None, rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    """For each class of the first block, one link to each other component that it has links to."""
    a, b = [], []
    if unit is not None:
        one_block = unit[1] == 0 and unit[2] == unit[3]
        left = [r for r in rows if r[0] == 0]
        right = left if one_block else [r for r in rows if r[0] == 1]
        right = [r for r in right if len(r[3])]
        if left and right and len({r[2] for r in left + right}) > 1:
            tokens, inverse = np.unique(np.concatenate([r[3] for r in right]), return_inverse=True)
            sizes = np.array([len(r[3]) for r in right])
            begins = np.cumsum(sizes) - sizes
            parts = np.array([r[2] for r in right])
            marked = np.zeros(len(tokens), np.int32)
            for _, own, component, shingles in left:
                at = np.minimum(np.searchsorted(tokens, shingles), len(tokens) - 1)
                at = at[tokens[at] == shingles]
                marked[at] = 1
                common = np.add.reduceat(marked[inverse], begins)
                marked[at] = 0
                alike = (100 * common >= PERCENT * (sizes + len(shingles) - common)) & (parts != component)
                for n in dict(zip(parts[alike].tolist(), np.flatnonzero(alike).tolist())).values():
                    a.append(own)
                    b.append(right[n][1])
    return pa.record_batch([pa.array(a, kind or pa.int64()), pa.array(b, kind or pa.int64())], names=["a", "b"])


def near_duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """Returns per row ``key`` (under its name), ``n_shingles``, ``component_id`` and ``kept``.

    Words are what stands between ASCII white space, A-Z as a-z. Texts are linked from 75 % of common shingles on, and
    components are those of all links. Null and empty texts have no shingles and are linked with nothing; a text of
    less than five words is one shingle. Ids should be unique: rows that share one are judged each by its own text,
    but a link through that id counts for all of them. A row without an id is linked with nothing, has a null
    component and is kept. An empty table gives no rows; other
    columns are not read.
    """
    bounded_batches(df.sparkSession)
    sketches = checkpointed(sketched(df, key, text))
    known = sketches.where("n > 0 AND id IS NOT NULL")
    classes = known.groupBy("c1", "c2").agg(F.min("id").alias("rep"))
    firsts = known.join(classes, [known.c1 == classes.c1, known.c2 == classes.c2, known.id == classes.rep]).select("id", "bands")
    shared = firsts.select("id", F.explode("bands").alias("bucket"))
    sizes = shared.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = checkpointed(shared.join(sizes, "bucket"))

    ranks = members.groupBy("id").agg(F.sum("size").alias("weight"))
    ranked = members.join(ranks, "id")
    hubs = ranked.groupBy("bucket").agg(F.max_by("id", F.struct("weight", F.hash("id"), "id")).alias("hub"))
    stars = members.join(hubs, "bucket").where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    links = checkpointed(_verified(df, key, text, stars))
    grouped = components(links)

    more = _between(df, key, text, stars, grouped)
    grouped = components(links.unionByName(more))

    # From a row to its class, and from the class to its component.
    named = classes.join(grouped, classes.rep == grouped.node, "left").select("c1", "c2", F.coalesce("component", "rep").alias("component"))
    out = sketches.join(named, ["c1", "c2"], "left")
    found = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), found.alias("component_id")).withColumn(
        "kept", F.coalesce(column(key) == F.col("component_id"), F.lit(True))
    )
