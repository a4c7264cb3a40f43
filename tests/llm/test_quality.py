from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tierview.llm import quality, queries

from .conftest import TEXTS


def raw(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0] + [len(d) for d in data])


def test_features_do_not_depend_on_neighbours():
    texts = ["Some words, and more.\nA line", "", "x", "ÉÀ 12 | ## !!", "again again again", "\n\n", "a b c d e f " * 300]
    together = quality.features(*raw(texts))
    for text, row in zip(texts, together):
        assert np.allclose(quality.features(*raw([text]))[0], row)
    assert not together[1].any()


def test_preferences_are_learned_and_the_quantile_is_the_threshold():
    rng = np.random.default_rng(3)
    table = rng.normal(size=(600, 5))
    good = table @ [2.0, -1, 0, 0, 0.5] + 0.3 * rng.normal(size=600) > 0.8
    ranking = quality.learned(table, good)
    scores = ranking.scores(table)
    assert ((scores >= quality.THRESHOLD).sum()) == good.sum()
    assert ((scores >= quality.THRESHOLD) == good).mean() > 0.9
    assert (np.argsort(scores) == np.argsort(ranking.raw(table))).all() and 0 <= scores.min() <= scores.max() <= 1
    # The loss is at its smallest: its slope is about that of its penalty only.
    assert ranking.weights[0] > -ranking.weights[1] > ranking.weights[4] > 0.1


def test_without_labels(awkward, nothing):
    labels = nothing.selectExpr("doc_id", "size quality")
    ranking = quality.learn(awkward, "doc_id", "text", labels, "quality")
    out = quality.scored(awkward, "doc_id", "text", ranking)
    assert out.count() == awkward.count() and {round(r.score, 9) for r in out.collect()} == {0.7}
    assert quality.scored(nothing, "doc_id", "text", ranking).count() == 0


def test_bad_labels_and_repeats(spark, awkward):
    rows = [(i, i % 2) for i in range(16)] * 2 + [(None, 1), (3, None), (4, 7), (999, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    ranking = quality.learn(awkward, "doc_id", "text", labels, "quality")
    out = {r.doc_id: r.score for r in quality.scored(awkward, "doc_id", "text", ranking).collect()}
    assert len(out) == awkward.select("doc_id").distinct().count()
    assert all(0 <= s <= 1 for s in out.values()) and len(set(out.values())) > 5


def test_query_learns_from_rows_that_are_not_held_out(spark, sf_dir, tmp_path):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = {r.doc_id: r for r in queries.QUERIES["op1_quality"](spark, sf_dir).collect()}
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(r.predicted == (r.score >= 0.7) for r in got.values())
    mine = [i for i in truth if got[i].held_out]
    assert len(mine) > 50 and np.mean([got[i].predicted == truth[i] for i in mine]) > 0.95
    # Other labels of held-out rows, other sources and languages change nothing.
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({"source": F.lit("z"), "lang": F.lit("xx")})
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    turned.write.parquet(str(tmp_path / "labels.parquet"))
    again = {r.doc_id: r.score for r in queries.QUERIES["op1_quality"](spark, str(tmp_path)).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-9 for i in got)


def slow_features(text: str) -> list[float]:
    """The features by their meaning, a byte and a word at a time."""
    data = text.encode()
    if not data:
        raise ValueError("an empty text has zeros")
    kinds = [0] * (len(quality._KINDS) + 2)
    for byte in data:
        kinds[quality._BEYOND if byte >= 128 else next((k for k, own in enumerate(quality._KINDS) if chr(byte) in own), quality._OTHER)] += 1
    shares = [k / len(data) for k in kinds]
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in data)
    own = [w for w in re.split(rb"[\x20\x09-\x0d]+", lower) if w]
    runs = [tuple(own[i : i + 5]) for i in range(len(own) - 4)] if len(own) >= 5 else [tuple(own)] if own else []
    lines = [line for line in data.split(b"\n") if line]

    def distinct(items):
        return [len(set(items)) / len(items), max(Counter(items).values()) / len(items)] if items else [1.0, 1.0]

    length = (len(data) - kinds[3] - kinds[4]) / max(len(own), 1)
    logs = [math.log1p(x) for x in (len(data), len(own), length, len(own) / max(len(lines), 1))]
    echoed = sum(a == b for a, b in zip(own, own[1:])) / max(len(own), 1)
    return [*shares, *(math.log1p(1000 * s) for s in shares[5:]), *logs, *distinct(own), *distinct(runs), *distinct(lines), echoed]


def test_features_by_brute_force(spark, sf_dir):
    docs = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(400).collect()]
    texts = [*(t for t in TEXTS if t), *docs, "a\x0b\x0cb\r\r\n\nc", "AbC aBc ABC", "éé é\x00\x7f", "#$%&*|<>{}!", "\n \t"]
    made = quality.features(*raw(texts))
    for text, row in zip(texts, made):
        if text:
            assert np.allclose(row, slow_features(text), rtol=1e-12, atol=1e-12), text[:80]


def test_the_loss_and_the_quantile_by_brute_force():
    """The slope of the logistic loss on the same pairs, a pair at a time, and where the threshold lies."""
    rng = np.random.default_rng(4)
    table = rng.normal(size=(300, 4))
    good = table @ [1.0, -0.5, 0.2, 0] + rng.normal(size=300) > 0.3
    ranking = quality.learned(table, good, pairs=2000)
    x = [[max(-6, min(6, (v - m) / s)) for v, m, s in zip(row, ranking.mean, ranking.spread)] for row in table.tolist()]
    draw = np.random.default_rng(7)
    above, below = draw.choice(np.flatnonzero(good), 2000).tolist(), draw.choice(np.flatnonzero(~good), 2000).tolist()
    slope = [quality.PENALTY * w for w in ranking.weights]
    for a, b in zip(above, below):
        gap = [p - q for p, q in zip(x[a], x[b])]
        wrong = 1 / (1 + math.exp(sum(g * w for g, w in zip(gap, ranking.weights))))
        slope = [s - g * wrong / 2000 for s, g in zip(slope, gap)]
    assert max(map(abs, slope)) < 1e-6
    ranks = sorted(sum(v * w for v, w in zip(row, ranking.weights)) for row in x)
    bad = int((~good).sum())
    assert abs(ranking.cut - (ranks[bad - 1] + ranks[bad]) / 2) < 1e-9
    for row, score in zip(x, ranking.scores(table)):
        at = sum(v * w for v, w in zip(row, ranking.weights)) - ranking.cut + math.log(0.7 / 0.3)
        assert abs(score - 1 / (1 + math.exp(-at))) < 1e-9


def test_query_by_brute_force(spark, sf_dir):
    """Scores of the query from the ranking and the slow features."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    ranking = quality.learn(docs, "doc_id", "text", labels, "quality")
    got = {r.doc_id: r for r in queries.QUERIES["op1_quality"](spark, sf_dir).collect()}
    for r in docs.select("doc_id", "text").where("doc_id % 7 = 0").collect():
        own = slow_features(r.text) if r.text else [0.0] * len(ranking.mean)
        at = sum(max(-6, min(6, (v - m) / s)) * w for v, m, s, w in zip(own, ranking.mean, ranking.spread, ranking.weights))
        score = 1 / (1 + math.exp(-(at - ranking.cut + math.log(0.7 / 0.3))))
        assert abs(got[r.doc_id].score - score) < 1e-9


def test_the_next_text_echoes_nothing():
    texts = ["", "one word", "word", "word again", "", "again again", "again", " ", ""]
    together = quality.features(*raw(texts))
    for text, row in zip(texts, together):
        assert (quality.features(*raw([text]))[0] == row).all()
        assert not text or np.allclose(row, slow_features(text), rtol=1e-12, atol=1e-12)
    assert not quality.features(*raw(["", " "]))[:, -1].any()


def pairwise(table, good, ranking, weights):
    """Loss, slope and curvature over every pair of a good and a bad row."""
    x = np.clip((table - ranking.mean) / ranking.spread, -6, 6)
    difference = (x[good][:, None] - x[~good][None]).reshape(-1, table.shape[1])
    gap = difference @ weights
    p = 1 / (1 + np.exp(gap))
    loss = np.logaddexp(0, -gap).mean() + quality.PENALTY / 2 * weights @ weights
    slope = quality.PENALTY * weights - (difference * p[:, None]).mean(axis=0)
    curve = (difference * (p * (1 - p))[:, None]).T @ difference / len(gap) + quality.PENALTY * np.eye(len(weights))
    return loss, slope, curve


def test_every_pair_counts():
    """No pair is drawn: the slope over all of them is zero, and sums by node are those by pair, also far apart and in ties."""
    rng = np.random.default_rng(5)
    table = np.concatenate((rng.normal(size=(300, 4)), np.ones((300, 1))), axis=1)
    table[40:80] = table[0]
    for noise in (0, 0.3, 1):
        good = table @ [1.0, -0.5, 0.2, 0, 0] + noise * rng.normal(size=300) > 0.3
        ranking = quality.learned(table, good)
        assert np.abs(pairwise(table, good, ranking, ranking.weights)[1]).max() < 1e-9
        loss = quality._all_pairs(lambda part: {k: v.reshape(-1) for k, v in part(table, good).items()}, ranking, int(good.sum()), int((~good).sum()))
        for weights in (np.zeros(5), ranking.weights, 10 * rng.normal(size=5), np.array([2.0, 0, 0, 0, 0])):
            made, slope, curve = loss(weights)
            for mine, slow in zip((made, slope, curve()), pairwise(table, good, ranking, weights)):
                assert np.allclose(mine, slow, rtol=1e-10, atol=1e-10)


def test_learns_from_every_labelled_row(spark):
    """More labelled rows than were once learned from: mean, spread, weights and threshold are those of all of them."""
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["plain", "words", "Of", "some", "text,", "here.", "##", "77", "a\nb"], rng.integers(1, 9))) for _ in range(28_000)]
    marks = [int(t.count("#") + rng.random() < 1.2) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(marks)), "doc_id long, quality int").repartition(5)
    mine = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(mine) > 20_000
    table, good = quality.features(*raw([texts[i] for i in mine])), np.array([marks[i] == 1 for i in mine])
    whole = quality.learned(table, good)
    ranking = quality.learn(docs, "doc_id", "text", labels, "quality")
    for name in ("mean", "spread", "weights", "cut"):
        assert np.allclose(getattr(ranking, name), getattr(whole, name), rtol=1e-7, atol=1e-7), name
    ranks = np.sort(whole.raw(table))
    assert abs(ranking.cut - (ranks[(~good).sum() - 1] + ranks[(~good).sum()]) / 2) < 1e-7


def test_ranks_of_scores(spark):
    rng = np.random.default_rng(8)
    values = [*rng.normal(size=300).tolist(), *[0.25] * 200, np.nextafter(0.25, 1), np.nextafter(0.25, 0), -0.0, 0.0, -40.0, 1e9]
    frame = spark.createDataFrame([(float(v),) for v in values], "s double").repartition(4).cache()
    ranks = sorted(values)
    at = ranks.index(0.25)
    for rank in (1, 2, at - 1, at, at + 1, at + 199, at + 200, at + 201, len(values) - 1):
        assert quality._halfway(frame, rank) == (ranks[rank - 1] + ranks[rank]) / 2
