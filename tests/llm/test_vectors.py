"""Codes and clusters of vectors against slow versions in Python's integers, and awkward vectors."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from tierview.llm import clusters, codes, queries, vectors

DIMS = 8
SCHEMA = "vec_id long, embedding array<double>, label int, id string, v int, x string, code string, cluster string"


def of(x, y):
    return sum((a - b) ** 2 for a, b in zip(x, y))


def counted(rows, scale):
    out = []
    for key, vector, label in rows:
        if vector is not None and len(vector) == DIMS and all(x is not None and math.isfinite(x) for x in vector):
            out.append((key, [max(-vectors.LIMIT, min(vectors.LIMIT, math.floor(scale * x) if abs(x) < 1e300 else int(x))) for x in vector], label))
    return out


def nearest(x, entries):
    return min((of(x, e), n) for n, e in enumerate(entries))


def moved(members, entries):
    out = []
    for n, entry in enumerate(entries):
        mine = [x for x, at in members if at == n]
        out.append([sum(c) // len(mine) for c in zip(*mine)] if mine else entry)
    return out


def slow_codes(rows, parts, entries, rounds, scale):
    rows = sorted(counted(rows, scale), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = DIMS // parts
    cut = lambda x, p: x[p * w : (p + 1) * w]
    books = [[cut(x, p) for _, x, _ in rows[:entries]] for p in range(parts)]
    for _ in range(rounds):
        books = [moved([(cut(x, p), nearest(cut(x, p), book)[1]) for _, x, _ in rows], book) for p, book in enumerate(books)]
    out = []
    for key, x, label in rows:
        told = [nearest(cut(x, p), book) for p, book in enumerate(books)]
        out.append((key, label, "".join(f"{n:02x}" for _, n in told), min(sum(d for d, _ in told), vectors.MOST)))
    return books, out


def slow_clusters(rows, count, rounds, scale):
    name = lambda k: hashlib.sha256(f"1:{'' if k is None else k}".encode()).hexdigest()
    rows = sorted(counted(rows, scale), key=lambda r: (name(r[0]), r[1]))
    table = [x for _, x, _ in rows[:count]]
    for _ in range(rounds):
        table = moved([(x, nearest(x, table)[1]) for _, x, _ in rows], table)
    return table, [(key, nearest(x, table)[1], min(nearest(x, table)[0], vectors.MOST)) for key, x, _ in rows]


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", 1, "b", "c", "d") for r in rows], SCHEMA).repartition(3)


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=str)


def awkward_rows():
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=DIMS) + 3 * (i % 3)).tolist(), i % 4 if i % 5 else None) for i in range(60)]
    rows += [(100 + i, [0.25, -0.25, 1e-9, -1e-9, 0.0, -0.0, 1.0, -1.0], 7) for i in range(40)]  # copies, and floors below 0
    rows += [(3, rows[3][1], 1), (3, rows[4][1], 1), (None, rows[5][1], 2), (None, [5.0] * DIMS, None)]
    rows += [(200, None, 1), (201, [], 1), (202, [1.0] * (DIMS - 1), 1), (203, [1.0] * (DIMS + 1), 1)]
    rows += [(210 + n, [1.0] * (DIMS - 1) + [bad], 1) for n, bad in enumerate((None, math.nan, math.inf, -math.inf))]
    return rows


HUGE = [(300, [1e6] * DIMS, 1), (301, [-3e9] * DIMS, 1), (302, [1e300] * DIMS, 1), (303, [-1.7e308] + [0.5] * (DIMS - 1), 1)]


@pytest.mark.parametrize("more", [[], HUGE[:1], HUGE], ids=["plain", "large", "beyond"])
def test_codes_are_those_of_the_slow_version(spark, more):
    rows = awkward_rows() + more
    df = table(spark, rows)
    books = codes.fit(df, "vec_id", "embedding", DIMS, parts=2, entries=5, rounds=3, scale=4096)
    got = codes.encode(df, "vec_id", "embedding", books, keep="label")
    assert got.columns == ["vec_id", "label", "code", "error"]
    slow, want = slow_codes(rows, 2, 5, 3, 4096)
    assert books.entries.tolist() == slow
    assert in_order(got.collect()) == in_order(want)
    assert books.digest() == hashlib.sha256(",".join(str(x) for b in slow for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize("more", [[], HUGE[:1], HUGE], ids=["plain", "large", "beyond"])
def test_clusters_are_those_of_the_slow_version(spark, more):
    rows = awkward_rows() + more
    df = table(spark, rows)
    found = clusters.fit(df, "vec_id", "embedding", DIMS, count=6, rounds=3, scale=64)
    slow, want = slow_clusters(rows, 6, 3, 64)
    assert found.table.tolist() == slow
    assert in_order(clusters.assign(df, "vec_id", "embedding", found).collect()) == in_order(want)


def test_nothing_that_counts(spark):
    for rows in ([], [(1, None, 1), (2, [1.0], 1)]):
        df = table(spark, rows)
        assert codes.fit(df, "vec_id", "embedding", DIMS, parts=2) is None
        assert clusters.fit(df, "vec_id", "embedding", DIMS) is None
    few = table(spark, [(1, [1.0] * DIMS, 1), (2, [2.0] * DIMS, 1)])
    books = codes.fit(few, "vec_id", "embedding", DIMS, parts=2)
    assert [r.error for r in codes.encode(few, "vec_id", "embedding", books).collect()] == [0, 0]
    assert {r.cluster for r in clusters.assign(few, "vec_id", "embedding", clusters.fit(few, "vec_id", "embedding", DIMS)).collect()} == {0, 1}
    with pytest.raises(ValueError):
        codes.fit(few, "vec_id", "embedding", DIMS, parts=3)


@pytest.mark.parametrize("spread", [2, 300, 1 << 61])
@pytest.mark.parametrize("count", [1, 2, 16, 70, 256])
def test_both_searches_are_exact(spread, count):
    rng = np.random.default_rng(count)
    entries, x = (rng.integers(-spread, spread, (n, 4)) for n in (count, 200))
    entries[count // 2] = entries[0]
    x[: min(count, 200)] = entries[:200]
    want = [nearest(row, entries.tolist()) for row in x.tolist()]
    for search in (codes.Slices(entries), clusters.Orchard(entries)):
        found, d = search.nearest(x)
        assert list(zip(d.tolist(), found.tolist())) == want


def test_candidates_are_the_box():
    rng = np.random.default_rng(0)
    entries, x, radius = rng.integers(-50, 50, (70, 3)), rng.integers(-50, 50, (90, 3)), rng.integers(0, 40, 90)
    masks = codes.Slices(entries).candidates(x, radius)
    bits = np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little")[:, :70].astype(bool)
    assert (bits == (np.abs(x[:, None] - entries[None]).max(axis=2) <= radius[:, None])).all()


def test_a_vector_far_from_most_centroids_measures_few(monkeypatch):
    """Two far groups of centroids: those of the other group are never measured once a near one is found."""
    centroids = np.concatenate([np.arange(8)[:, None] * 3, 10**6 + np.arange(8)[:, None] * 3])
    measured = []
    plain = vectors.squared
    search = clusters.Orchard(centroids)
    monkeypatch.setattr(vectors, "squared", lambda x, y: measured.append(len(x)) or plain(x, y))
    found, _ = search.nearest(np.array([[4]] * 10))
    assert found.tolist() == [1] * 10 and sum(measured) <= 10 * 8


def test_decoded_vectors_are_near(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    books = codes.fit(df, "vec_id", "embedding", 64)
    told = {r.vec_id: r for r in codes.encode(df, "vec_id", "embedding", books).collect()}
    for row in df.limit(20).collect():
        code, error = told[row.vec_id].code, told[row.vec_id].error
        gap = np.array(row.embedding) - books.decoded(code)
        assert abs((gap**2).sum() * 4096**2 - error) < 0.05 * error


def test_queries_leave_out_bad_rows(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=64).tolist(), None if i % 3 else i % 2) for i in range(40)] + [(50, None, 1), (51, [math.nan] * 64, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    for name in ("op11_vector_codes", "op13_orchard_clusters"):
        got = queries.QUERIES[name](spark, str(tmp_path))
        assert sorted(r.vec_id for r in got.collect()) == list(range(40))
        assert all(r[c] is not None for r in got.collect() for c in got.columns)
    empty = str(tmp_path / "none")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{empty}/embeddings.parquet")
    for name in ("op11_vector_codes", "op13_orchard_clusters"):
        assert queries.QUERIES[name](spark, empty).dtypes == queries.QUERIES[name](spark, str(tmp_path)).dtypes
        assert queries.QUERIES[name](spark, empty).count() == 0
