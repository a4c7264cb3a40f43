from __future__ import annotations

import hashlib
import importlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tierview.llm import queries, suffixes


def brute(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    first: dict[bytes, int] = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, own in data:
        if i is not None:
            for at in range(len(own) - 49):
                s = own[at : at + 50]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, own in data:
        gone = bytearray(len(own))
        for at in range(len(own) - 49) if i is not None else ():
            if first[own[at : at + 50]] < i:
                gone[at : at + 50] = b"\x01" * 50
        kept = bytes(b for b, g in zip(own, gone) if not g)
        spans = sum(g and (n == 0 or not gone[n - 1]) for n, g in enumerate(gone))
        out.append((i, len(own), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def ours(df):
    out = suffixes.remove_repeats(df, "doc_id", "text").collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out), key=str)


def repeated(seed: int, count: int = 220) -> list[tuple[int, str]]:
    """Texts of pieces of one another, with changes, of all lengths around 50 bytes; of few letters, so that much recurs."""
    rng = random.Random(seed)
    alphabet = ["ab", "abcdefgh ", "aé "][seed % 3]
    out: list[str] = []
    for _ in range(count):
        text = ""
        for _ in range(rng.randrange(4)):
            if out and rng.random() < 0.6:
                source = rng.choice(out)
                at = rng.randrange(len(source) + 1)
                text += source[at : at + rng.randrange(20, 160)]
            else:
                text += "".join(rng.choices(alphabet, k=rng.randrange(90)))
        if text and rng.random() < 0.3:
            at = rng.randrange(len(text))
            text = text[:at] + "#" + text[at + 1 :]
        out.append(text)
    out += [out[3]] * 4 + ["x" * 500, "x" * 49, "x" * 50, "ab" * 300]
    ids = list(range(len(out)))
    rng.shuffle(ids)
    return list(zip(ids, out))


@pytest.mark.parametrize("seed", range(3))
def test_agrees_with_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(suffixes, "HEAVY", [4096, 3, 10][seed])
    monkeypatch.setattr(suffixes, "SORTED", [4096, 4096, 5][seed])
    rows = repeated(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert ours(df) == brute(rows)


def test_small_batches(spark):
    """Classes and tags that go on from batch to batch, and spans that are sorted in parts."""
    rng = random.Random(9)
    rows = repeated(0) + repeated(2)
    rows = [(i, t) for i, (_, t) in enumerate(rng.sample(rows, len(rows)))]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        assert ours(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)
    finally:
        spark.conf.set(key, before)


def test_awkward_texts(spark, awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    # A repeated row takes nothing from its like, nor does a text that shares an id.
    rows += [(20, rows[8][1]), (20, "w" * 60), (21, "w" * 60), (None, "w" * 60)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, id string, c string")
    assert ours(df) == brute(rows)
    assert suffixes.remove_repeats(nothing, "doc_id", "text").count() == 0


def test_suffixes_are_sorted_within_groups():
    rng = np.random.default_rng(6)
    data = np.concatenate([rng.integers(97, 99, 4000).astype(np.uint8), np.full(300, 97, np.uint8), np.zeros(50, np.uint8)])
    data[2000:2400] = data[1000:1400]
    at = rng.integers(0, 4250, 3000)
    group = np.sort(rng.integers(0, 9, 3000))
    order, same = suffixes.sort_suffixes(data, at, group)
    rows = [bytes(data[i : i + 50]) for i in at.tolist()]
    assert order.tolist() == sorted(range(3000), key=lambda i: (group[i], rows[i], i))
    for n in range(1, 3000):
        a, b = order[n - 1], order[n]
        assert same[n] == (group[a] == group[b] and rows[a] == rows[b])


def test_collisions_are_seen(monkeypatch):
    monkeypatch.setattr(suffixes, "_VALUE", np.ones(256, np.uint64))  # every hash collides
    data = np.frombuffer(b"a" * 60 + b"b" * 60 + b"a" * 60, np.uint8)
    order, same = suffixes.sort_suffixes(data, np.array([0, 60, 120]), np.zeros(3, np.int64))
    assert order.tolist() == [0, 2, 1] and same.tolist() == [False, True, False]


def colliding(name):
    """The step with one hash for all bytes, in the worker that runs it."""

    def run(batches):
        own = importlib.import_module("tierview.llm.suffixes")
        before, own._VALUE = own._VALUE, np.ones(256, np.uint64)
        try:
            yield from getattr(own, name)(batches)
        finally:
            own._VALUE = before

    return run


def test_collisions_remove_nothing(spark, monkeypatch):
    for name in ("_anchored", "_classed", "_cut", "_sorted"):
        monkeypatch.setattr(suffixes, name, colliding(name))
    rows = repeated(1, 60)
    assert ours(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_classes_of_a_chunk_are_told_by_bytes():
    texts = [b"a" * 60, b"b" * 60, b"a" * 60, b"a" * 59 + b"c"]
    data, first = np.frombuffer(b"".join(texts), np.uint8), np.arange(0, 240, 60)
    same = np.zeros(4, np.uint64)
    order, head = suffixes._classes(data, first, first + 10, np.arange(4), same, same)
    assert order.tolist() == [0, 2, 1, 3] and head.tolist() == [True, False, True, True]


def test_all_open_strings_are_sorted(monkeypatch):
    """Strings without a like among them, too."""
    seen, sort = [], suffixes.sort_suffixes
    monkeypatch.setattr(suffixes, "sort_suffixes", lambda data, at, group: (seen.extend(at.tolist()), sort(data, at, group))[1])
    rng = random.Random(3)
    bodies = [bytes(rng.choices(range(97, 123), k=60)) for _ in range(9)]
    bodies[8] = bodies[2][:55] + b"12345"
    told = [pa.array([1] * 9), pa.array(range(9)), pa.array([0] * 9, pa.int32()), pa.array([0] * 9), pa.array(bodies)]
    spans = pa.record_batch(told, names=["tag", "id", "c", "lo", "body"])
    (runs,) = suffixes._sorted(iter([spans]))
    assert seen == [60 * n + i for n in range(9) for i in range(11)]
    assert runs.to_pylist() == [{"id": 8, "c": 0, "tag": None, "x": 55}]


def test_query_agrees_with_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, queries.QUERIES["op9_suffix_dedup"](spark, sf_dir).collect()), key=str)
    assert got == brute(rows)
