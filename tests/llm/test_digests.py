from __future__ import annotations

import hashlib
from base64 import b64decode
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tierview.llm import digests, queries


def raw(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0] + [len(d) for d in data])


def entropy(window: bytes) -> int:
    total = sum(round(65536 * n * np.log2(n)) for n in Counter(window).values())
    return (round(65536 * 32 * 5) - total) * 1000 // round(65536 * 32 * 5)


def slow_selection(data: bytes, ranks) -> list[int]:
    """Windows by the definition: the leftmost rarest of every 32 neighbours, clipped at the ends."""
    n = len(data) - 31
    rank = [ranks[entropy(data[i : i + 32])] for i in range(n)]
    points = Counter()
    for start in range(-31, n):
        span = [i for i in range(max(start, 0), min(start + 32, n)) if rank[i] < digests._NEVER]
        if span:
            points[min(span, key=lambda i: (rank[i], i))] += 1
    return sorted(i for i, p in points.items() if p >= digests.POINTS)


TEXTS = ["", "short", "x" * 500, "The quick brown fox jumps over the lazy dog; and so on, it says. " * 3, "é" * 16, "a1b2c3d4e5" * 40]
TEXTS += ["".join(np.random.default_rng(n).choice(list("abcdefgh  .,\n"), 60 + 97 * n)) for n in range(9)]


def test_selection_follows_the_definition():
    rng = np.random.default_rng(8)
    ranks = digests.rarity(rng.integers(0, 50, digests.STEPS + 1))
    prints = digests.fingerprinted(*raw(TEXTS), ranks)
    for text, got in zip(TEXTS, prints):
        data = text.encode()
        at = slow_selection(data, ranks)
        seen = dict.fromkeys(data[i : i + 32] for i in at)
        features = len(seen) or bool(data)
        filters = -(-features // digests.FULL)
        assert len(b64decode(got)) == filters * digests.BITS // 8
        bits = int.from_bytes(b64decode(got), "little").bit_count()
        assert filters <= bits <= features * digests.HASHES
        assert digests.fingerprinted(*raw([text]), ranks) == [got]
        own = digests._entropies(digests._laid_out(*raw([text]))[0])[32:][: max(len(data) - 31, 0)]
        assert own.tolist() == [entropy(data[i : i + 32]) for i in range(len(data) - 31)]


def test_likeness():
    ranks = digests.rarity(np.arange(digests.STEPS + 1)[::-1].copy())
    rng = np.random.default_rng(1)
    one, two = ("".join(rng.choice(list("abcdefghijkl mnop."), 9000)) for _ in range(2))
    a, b, mixed = digests.fingerprinted(*raw([one, two, one[:4500] + two[:4500]]), ranks)
    assert digests.likeness(a, a) == 1 and digests.likeness("", "") == 1 and digests.likeness("", a) == 0
    assert digests.likeness(a, b) == digests.likeness(b, a) < 0.1
    assert 0.3 < digests.likeness(a, mixed) < 0.8


def test_entropies_are_counted_over_all_texts(awkward):
    got = digests.entropy_counts(awkward, "text")
    want = Counter()
    for r in awkward.collect():
        data = (r.text or "").encode()
        own = digests._entropies(digests._laid_out(*raw([r.text or ""]))[0])[32:][: max(len(data) - 31, 0)]
        want.update(own.tolist())
    assert {s: n for s, n in enumerate(got.tolist()) if n} == dict(want)


def test_order(spark, awkward, nothing):
    for parts in ("1", "3", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = digests.followed(awkward, "doc_id", "text").collect()
        rows = awkward.selectExpr("doc_id", "coalesce(text, '') t", "xxhash64(coalesce(text, '')) h").collect()
        rows.sort(key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))
        want = [(a.doc_id, a.t, b.t) for a, b in zip(rows, rows[1:] + rows[:1])]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
        assert digests.followed(nothing, "doc_id", "text").count() == 0
        one = digests.followed(awkward.where("doc_id = 5"), "doc_id", "text").collect()
        assert [tuple(r) for r in one] == [(5, " ", " ")]


def test_query(spark, sf_dir):
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in queries.QUERIES["op6_fingerprints"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    prints = {}
    for (i, own), (_, after) in zip(docs, docs[1:] + docs[:1]):
        half = len(own) // 2
        assert got[i].n_chars == len(own)
        assert got[i].edited_sha256 == hashlib.sha256((own[: len(own) - half] + after[:half]).encode()).hexdigest()
        assert prints.setdefault(own, got[i].fingerprint) == got[i].fingerprint
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    others = [i for i, t in docs if len(t) >= 200]
    assert np.mean([got[i].near_edited > got[i].near_next for i in others]) > 0.97


def slow_print(text: str, ranks) -> bytes:
    """The fingerprint by the definition, in Python's integers: features in order, filters of ``FULL`` of them."""
    data, top = text.encode(), 2**64
    if not data:
        return b""
    windows = list(dict.fromkeys(data[i : i + digests.WINDOW] for i in slow_selection(data, ranks)))
    mix = [int(x) for x in digests._MIX]
    features = [sum((b + 1) * m for b, m in zip(window, mix)) % top for window in windows]
    features = features or [int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")]
    filters = [[False] * digests.BITS for _ in range(-(-len(features) // digests.FULL))]
    for n, feature in enumerate(features):
        for step in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            feature = (feature ^ feature >> 33) * step % top
        feature ^= feature >> 33
        for k in range(digests.HASHES):
            filters[n // digests.FULL][(feature >> 11 * k) % digests.BITS] = True
    return b"".join(int("".join("01"[bit] for bit in own), 2).to_bytes(digests.BITS // 8, "big") for own in filters)


def slow_likeness(one: bytes, two: bytes) -> float:
    size = digests.BITS // 8
    if not one or not two:
        return float(one == two)
    a, b = ([int.from_bytes(x[i : i + size], "big") for i in range(0, len(x), size)] for x in (one, two))

    def alike(x, y):
        chance = x.bit_count() * y.bit_count() / digests.BITS
        least = min(x.bit_count(), y.bit_count())
        return min(1.0, max(0.0, ((x & y).bit_count() - chance) / max(least - chance, 1e-9)))

    def way(own, other):
        return sum(x.bit_count() * max(alike(x, y) for y in other) for x in own) / sum(x.bit_count() for x in own)

    ways = [way(a, b)] * (len(a) <= len(b)) + [way(b, a)] * (len(b) <= len(a))
    return sum(ways) / len(ways)


def test_fingerprints_and_likeness_by_brute_force():
    ranks = digests.rarity(np.random.default_rng(8).integers(0, 50, digests.STEPS + 1))
    long = "".join(np.random.default_rng(99).choice(list("abcdefghijklmnop  .,\n"), 12_000))
    texts = [*TEXTS, long, long[:7000] + "changed " * 40 + long[7000:], "ab" * 40 + TEXTS[5]]
    prints = digests.fingerprinted(*raw(texts), ranks)
    slow = [slow_print(text, ranks) for text in texts]
    assert [b64decode(p) for p in prints] == slow and max(map(len, slow)) > digests.BITS // 8
    for x, a in zip(prints, slow):
        for y, b in zip(prints, slow):
            assert abs(digests.likeness(x, y) - slow_likeness(a, b)) < 1e-12


def test_query_by_brute_force(spark, sf_dir, tmp_path):
    """All columns of the query on a table of short, long, empty, null and equal texts."""
    texts = [*TEXTS, None, TEXTS[3], TEXTS[8] + TEXTS[9]]
    spark.createDataFrame([(n, t, 1) for n, t in enumerate(texts)], "doc_id long, text string, k int").write.parquet(str(tmp_path / "documents.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ranks = digests.rarity(digests.entropy_counts(df, "text"))
    rows = sorted(((n, t or "") for n, t in enumerate(texts)), reverse=True)
    want = {}
    for (i, own), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        mine, theirs, changed = (slow_print(t, ranks) for t in (own, after, edited))
        want[i] = (len(own), hashlib.sha256(edited.encode()).hexdigest(), mine, changed, slow_likeness(mine, changed), slow_likeness(mine, theirs))
    for r in queries.QUERIES["op6_fingerprints"](spark, str(tmp_path)).collect():
        told = (r.n_chars, r.edited_sha256, b64decode(r.fingerprint), b64decode(r.edited_fingerprint), r.near_edited, r.near_next)
        assert told[:4] == want[r.doc_id][:4]
        assert max(abs(x - y) for x, y in zip(told[4:], want[r.doc_id][4:])) < 1e-12


def test_awkward_rows(spark, awkward, nothing):
    ranks = digests.rarity(digests.entropy_counts(awkward, "text"))
    rows = awkward.select("doc_id", "text", "k").withColumn("again", F.col("text"))
    prints = digests.fingerprints(rows, ["text", "again"], ranks, keep=["doc_id", "k"])
    alike = digests.compared(prints, {"same": ("text", "again")})
    assert alike.columns == ["doc_id", "k", "text", "again", "same"] and alike.count() == awkward.count()
    assert {r.same for r in alike.collect()} == {1.0}
    assert {r.text == "" for r in alike.join(rows.select("doc_id").where("coalesce(text, '') = ''"), "doc_id").collect()} == {True}
    assert digests.compared(digests.fingerprints(nothing, ["text"], ranks), {"x": ("text", "text")}).count() == 0
