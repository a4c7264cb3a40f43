from __future__ import annotations

import importlib
from array import array

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tierview.llm import pieces, quality

from .test_leaks import brute as brute_leaks
from .test_leaks import fixture as leak_fixture
from .test_minhash import brute as brute_links
from .test_pieces import LIBRARY
from .test_secrets import brute as brute_secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], SCHEMA)


def masked(text):
    out, at = "", 0
    for start, _, _, end in brute_secrets(text):
        if start >= at:
            out += text[at:start] + "<secret>"
        at = max(at, end)
    return out + text[at:]


def test_stages_on_the_tables(spark, sf_dir, tmp_path):
    """Each stage against brute force on what the one before it kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [docs]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], sf_dir).write.parquet(str(tmp_path / str(n)))
        kept.append(spark.read.parquet(str(tmp_path / str(n))))
    rows = [{r.doc_id: r for r in df.collect()} for df in kept]
    assert all(df.columns == docs.columns for df in kept[:-1])

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ranking = quality.learn(docs, "doc_id", "text", labels, "quality")
    scores = {r.doc_id: r.score for r in quality.scored(docs, "doc_id", "text", ranking).collect()}
    assert set(rows[1]) == {i for i, s in scores.items() if s >= 0.7}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert sum(truth[i] for i in truth if i in rows[1]) >= 0.98 * sum(truth.values())

    links = brute_links([(i, r.text) for i, r in rows[1].items()])
    assert set(rows[2]) == {i for i, (_, _, first) in links.items() if first}

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    few = sorted(rows[2])[:60] + sorted(set(rows[2]) - set(rows[3]))
    leaked = {d for d, _ in brute_leaks([(i, rows[2][i].text) for i in few if len(rows[2][i].text) < 6000], items[:12])}
    assert leaked.isdisjoint(rows[3]) and len(rows[3]) < len(rows[2])

    assert set(rows[4]) == set(rows[3])
    assert all(r.text == masked(rows[3][i].text) and r.n_chars == len(r.text) for i, r in rows[4].items())
    assert any(r.text != rows[3][i].text for i, r in rows[4].items())

    want = {i: LIBRARY.encode(r.text, add_bos=True, add_eos=True) for i, r in rows[4].items()}
    assert {i: list(array("I", bytes(r.ids))) for i, r in rows[5].items()} == want


def test_run_is_all_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    one_by_one = {r.doc_id: bytes(r.ids) for r in docs.collect()}
    assert {r.doc_id: bytes(r.ids) for r in corpus_pipeline.run(spark, sf_dir).collect()} == one_by_one


def test_awkward_documents(spark, sf_dir, awkward):
    docs = awkward.select("doc_id", "text", F.lit("en").alias("lang"), F.col("t").alias("source"), F.lit(1).cast("long").alias("n_chars"), "k", "size")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        assert 0 < out.count() <= docs.count()
    kept = corpus_pipeline.keep_one_of_each(spark, docs, sf_dir)
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, [*(i for i in range(16) if i != 4), 3, None]))
    assert corpus_pipeline.encode(spark, docs, sf_dir).count() == docs.count()


def test_leaks_and_secrets_go(spark, sf_dir, tmp_path):
    texts, items = leak_fixture()
    spark.createDataFrame(items, "item_id int, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = frame(spark, [d for d in texts if d[0] is not None])
    kept = {r.doc_id for r in corpus_pipeline.drop_leaks(spark, docs, str(tmp_path)).collect()}
    assert kept == {d for d, _ in texts if d is not None} - {d for d, _ in brute_leaks(texts, items)}
    docs = frame(spark, [(1, "token=abcdefghijklmnop é"), (2, None), (3, "token=abcdefghijklmnop é"), (4, "")])
    out = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.mask_secrets(spark, docs, "").collect()}
    assert out == {1: ("<secret> é", 10), 2: (None, None), 3: ("<secret> é", 10), 4: ("", 0)}


def test_import_errors_are_not_hidden(monkeypatch):
    import __spark_entry__ as entry

    assert len([q for q in entry.queries() if q.startswith("op")]) >= 9 and "pipeline" in entry.queries()
    monkeypatch.setitem(__import__("sys").modules, "public_tokenizers", None)
    with pytest.raises(ModuleNotFoundError):
        importlib.reload(corpus_pipeline)
    monkeypatch.undo()
    importlib.reload(corpus_pipeline)
    assert pieces.model(corpus_pipeline.public_tokenizers.path("piece_bpe_32k.model"))
