from __future__ import annotations

import inspect
import random
import re
import time

import pytest

import corpus_pipeline
from tierview.llm import leaks, queries

LOWER = {c: c + 32 for c in range(65, 91)}


def split(text):
    return re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", (text or "").translate(LOWER))


def brute(docs, items):
    """All diagonals of all pairs, all runs: without seeds, hits or hashes."""
    out = {}
    for d, doc in docs:
        own = split(doc)
        for i, item in items:
            theirs = split(item)
            least = min(leaks.LEAST_WORDS, len(theirs))
            best = (0, 0, 0)
            for lay in range(-len(theirs) + 1, len(own)):
                lo, hi = max(lay, 0), min(lay + len(theirs), len(own))
                equal = [own[p] == theirs[p - lay] for p in range(lo, hi)]
                if not theirs or len(equal) < least:
                    continue
                for a in range(len(equal)):
                    for b in range(len(equal), a + max(least, best[1] + 1) - 1, -1):
                        if equal[a] and equal[b - 1] and sum(equal[a:b]) >= 0.75 * (b - a):
                            best = (lo + a, b - a, sum(equal[a:b]))
                            break
            if best[1]:
                out[d, i] = best
    return out


def test_masks_reach_what_they_promise():
    for width in (12,):
        for changed in range(width):
            equal = [p != changed for p in range(width)]
            assert any(
                all(equal[p + q] for q, look in enumerate(mask) if look == "1")
                for mask in leaks.MASKS
                for p in range(width - len(mask) + 1)
            )


def fixture():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "don't", "A"]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([20, 40, 13, 12, 8, 5, 4, 3, 1, 0])] + [(10, None), (11, "w1, w2. w3; w4")]
    docs = []
    for n in range(60):
        own = rng.choices(vocabulary, k=rng.randrange(40))
        planted = split(items[n % 7][1])
        for _ in range(rng.randrange(5)):
            planted[rng.randrange(len(planted))] = "changed"
        a, b = sorted(rng.sample(range(len(planted) + 1), 2)) if n % 2 else (0, len(planted))
        docs.append((n, " ".join(own + planted[a:b] + rng.choices(vocabulary, k=rng.randrange(20))).replace("w5 ", "W5,\n")))
    return docs + [(100, None), (101, ""), (None, items[0][1]), (0, docs[0][1])], items


def test_agrees_with_brute_force(spark, nothing):
    docs, items = fixture()
    df = spark.createDataFrame([(*d, 0, "x") for d in docs], "doc_id long, text string, item_id int, id string")
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = [tuple(r) for r in leaks.overlaps(df, "doc_id", "text", bench, "item_id", "text").collect()]
    want = brute(docs, items)
    assert {(g[0], g[1]): g[3:] for g in got} == {k: v[1:] for k, v in want.items()}
    assert len(got) == len(want) + sum(k[0] == 0 for k in want) and len(want) > 20
    assert leaks.overlaps(nothing, "doc_id", "text", bench, "item_id", "text").count() == 0
    assert leaks.overlaps(df, "doc_id", "text", bench.limit(0), "item_id", "text").count() == 0


def test_blocks_change_nothing(spark, monkeypatch):
    docs, items = fixture()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    whole = sorted(map(str, leaks.overlaps(df, "doc_id", "text", bench, "item_id", "text").collect()))
    monkeypatch.setattr(leaks, "BLOCK_BYTES", 100)
    assert sorted(map(str, leaks.overlaps(df, "doc_id", "text", bench, "item_id", "text").collect())) == whole


def test_query_finds_planted_items(spark, sf_dir):
    docs = {r.doc_id: split(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    items = {r.item_id: split(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    whole = {(d, i) for d, own in docs.items() for i, theirs in items.items() if f" {' '.join(theirs)} " in f" {' '.join(own)} "}
    got = {(r.doc_id, r.item_id): r for r in queries.QUERIES["op10_decontaminate"](spark, sf_dir).collect()}
    assert whole and whole <= set(got)
    for (d, i), r in got.items():
        own, theirs = docs[d][r.first_word :][: r.n_words], items[i]
        assert max(sum(a == b for a, b in zip(own, theirs[o:])) for o in range(len(theirs))) == r.n_equal >= 0.75 * r.n_words


def patterns(n):
    """All ways in which an overlap of ``n`` words may be equal: at both ends, and ``SHARE`` of it."""
    if n == 1:
        return [1]
    ends = 1 | 1 << (n - 1)
    return [p for p in (ends | q << 1 for q in range(1 << (n - 2))) if p.bit_count() >= leaks.SHARE * n]


def missed(n):
    """Patterns that no mask finds by which an item of ``n`` words is looked for, as one of so few must be there whole."""
    masks = [(int(leaks._ALL_MASKS[k][::-1], 2), len(leaks._ALL_MASKS[k])) for k in leaks.masks_of(n)]
    return [p for p in patterns(n) if not any(p >> at & m == m for m, size in masks for at in range(n - size + 1))]


def test_no_pattern_is_missed():
    """Of all ways in which an overlap of up to 17 words may be equal."""
    assert {n: len(missed(n)) for n in range(1, 18)} == dict.fromkeys(range(1, 18), 0)


def test_short_items(spark):
    """Items of 1 to 14 words with changed ones, in documents that hold them whole, in part, or cut off at an end."""
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(25)]
    items = [(i, " ".join(rng.choices(vocabulary, k=1 + i % 14))) for i in range(56)]
    docs = []
    for n in range(150):
        planted = split(items[n % 56][1])
        for _ in range(rng.randrange(4)):
            planted[rng.randrange(len(planted))] = "changed"
        docs.append((n, " ".join(rng.choices(vocabulary, k=rng.randrange(15)) + planted + rng.choices(vocabulary, k=rng.randrange(6)))))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    got = {(r[0], r[1]): tuple(r[3:]) for r in leaks.overlaps(df, "doc_id", "text", bench, "item_id", "text").collect()}
    assert got == {k: v[1:] for k, v in brute(docs, items).items()} and len(got) > 300
    kept = {r.doc_id for r in leaks.clean(df, "text", bench.where("item_id % 14 > 3"), "text").collect()}
    assert kept == {d for d, _ in docs} - {d for d, i in got if i % 14 > 3}


def test_repeated_words(spark):
    """A text of 100,000 equal words against items of 25,000 and of a few, of two words in turn, and of two at random."""
    rng = random.Random(9)
    rows = [("a " * 100_000, "one"), ("a b " * 30_000, "two"), ("a b b a " * 200 + "c", "four"), (" ".join(rng.choices("xy", k=1500)), "mixed")]
    items = [("a " * 25_000, 1), ("b a " * 9_000, 2), ("a " * 13, 3), ("b b a a " * 150 + "d", 4), (" ".join(rng.choices("xy", k=300)), 5)]
    df, bench = spark.createDataFrame(rows, "text string, doc string"), spark.createDataFrame(items, "text string, item int")
    began = time.time()
    got = {(r[0], r[1]): tuple(r[2:]) for r in leaks.overlaps(df, "doc", "text", bench, "item", "text").collect()}
    assert time.time() - began < 60
    assert got["one", 1] == (0, 25_000, 25_000) and got["one", 3] == (0, 13, 13)
    assert got["two", 2] == (0, 17_999, 17_999) or got["two", 2] == (1, 18_000, 18_000)
    assert ("one", 2) not in got and ("four", 4) in got
    small = {(d, i): v for (d, i), v in got.items() if d in ("four", "mixed") and i in (3, 4, 5)}
    want = brute([(d, t) for t, d in rows if d in ("mixed",)], [(i, t) for t, i in items if i in (3, 5)])
    assert {k: v for k, v in small.items() if k[0] == "mixed" and k[1] in (3, 5)} == want


@pytest.mark.parametrize("listed", [1, 50, 1 << 20])
def test_lays_by_list_and_by_convolution_are_the_same(monkeypatch, listed):
    monkeypatch.setattr(leaks, "LISTED_HITS", listed)
    rng = random.Random(10)
    for n in range(30):
        own, item = rng.choices("ab" if n % 2 else "abcdefgh", k=rng.randrange(200)), rng.choices("ab" if n % 3 else "abcdefgh", k=rng.randrange(1, 60))
        text = leaks.Text(" ".join(own).encode() if own else b" ")
        theirs = leaks.Text(" ".join(item).encode()).words
        want = set()
        for mask in (leaks._ALL_MASKS[k] for k in leaks.masks_of(len(item))):
            looked = [p for p, look in enumerate(mask) if look == "1"]
            for a in range(len(own) - len(mask) + 1):
                want |= {a - b for b in range(len(item) - len(mask) + 1) if all(own[a + p] == item[b + p] for p in looked)}
        assert text.lays(theirs).tolist() == sorted(want)


def test_hashes_are_joined(spark, sf_dir):
    """Nothing of the size of either table goes through the driver; texts with many pairs go to several tasks."""
    source = inspect.getsource(leaks)
    assert "toLocalIterator" not in source and source.count(".collect()") == 2  # stretches of the bitmap, masks
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(400)))], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(f"w{i + j}" for j in range(14))) for i in range(300)], "item_id int, text string")
    whole = sorted(map(tuple, leaks.overlaps(docs, "doc_id", "text", items, "item_id", "text").collect()))
    assert whole == [(1, i, i, 14, 14) for i in range(300)]


def test_many_parts_and_joined_addresses_change_nothing(spark, monkeypatch):
    docs, items = fixture()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    whole = sorted(map(str, leaks.overlaps(df, "doc_id", "text", bench, "item_id", "text").collect()))
    kept = sorted(map(str, leaks.clean(df, "text", bench, "text").collect()))
    for name, value in (("PAIRS_PER_TASK", 1), ("SENT_ROWS", 0), ("BITS_PER_HASH", 1 / 4096), ("MOST_BITS", 1 << 23)):
        monkeypatch.setattr(leaks, name, value)
    assert sorted(map(str, leaks.overlaps(df, "doc_id", "text", bench, "item_id", "text").collect())) == whole
    assert sorted(map(str, leaks.clean(df, "text", bench, "text").collect())) == kept


def unseeded(docs, items, least=12):
    """All pairs that overlap, whatever the masks hit; of items of ``least`` words or more. Pairs of words that are equal
    are counted by diagonal, and only diagonals with enough of them are looked at."""
    number, postings = {}, {}
    theirs = {i: [number.setdefault(w, len(number)) for w in split(t)] for i, t in items}
    theirs = {i: own for i, own in theirs.items() if len(own) >= least}
    for i, own in theirs.items():
        for p, w in enumerate(own):
            postings.setdefault(w, []).append((i, p))
    out = set()
    for d, t in docs:
        own = [number.get(w, -1) for w in split(t)]
        diagonals = {}
        for at, w in enumerate(own):
            for i, p in postings.get(w, ()):
                diagonals.setdefault((i, at - p), []).append(at)
        for (i, _), places in diagonals.items():
            total = len(places)
            if (d, i) not in out and any(
                places[b] - places[a] + 1 >= least and b - a + 1 >= leaks.SHARE * (places[b] - places[a] + 1)
                for a in range(total)
                for b in range(a + int(leaks.SHARE * least) - 1, total)
            ):
                out.add((d, i))
    return out


def test_query_finds_all_leaks_of_the_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert min(len(split(t)) for _, t in items) >= 12
    want = unseeded(docs, items)
    assert want and {(r.doc_id, r.item_id) for r in queries.QUERIES["op10_decontaminate"](spark, sf_dir).collect()} == want


def test_stage_drops_all_leaks_of_the_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = [tuple(r) for r in table.select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {r.doc_id for r in corpus_pipeline.drop_leaks(spark, table, sf_dir).select("doc_id").collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in unseeded(docs, items)}
