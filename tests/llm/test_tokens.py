from __future__ import annotations

import json

import public_tokenizers
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tierview.llm import queries, tokens

from .conftest import by_key


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_awkward_texts(awkward, nothing, tokenizer, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = []
    for row in awkward.collect():
        text = row.text or ""
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        want.append((row.doc_id, len(text.encode()), n, n > 1024))
    got = by_key(tokens.count_tokens(awkward, "doc_id", "text", path))
    assert got == sorted(want, key=lambda r: (r[0] is not None, *map(str, r)))
    assert tokens.count_tokens(nothing, "doc_id", "text", path).count() == 0


def test_pieces_and_groups():
    text = "some words and a\n\nlast one's  end" * 50
    for limit in (1, 7, 30):
        parts = tokens.pieces(text, limit)
        assert "".join(parts) == text and len(parts) > 5
    assert tokens.pieces("x" * 99, 10) == ["x" * 99]
    made = tokens.groups([5, 1, 9, 4], 10)
    assert sorted(sum(made, [])) == [0, 1, 2, 3] and all(len(g) == 1 or sum([5, 1, 9, 4][i] for i in g) <= 10 for g in made)


def test_splits_change_no_count(tokenizer):
    text = "It's a  test, of:  spaces\n\n and <|endoftext|> 12 3.4 naïve\u00a0x\u3000y \x85 z " * 40
    whole = len(tokenizer.encode(text, add_special_tokens=False).ids)
    for limit in (1, 5, 64):
        assert sum(len(tokenizer.encode(p, add_special_tokens=False).ids) for p in tokens.pieces(text, limit)) == whole


def test_sentencepiece_file(awkward):
    path = public_tokenizers.path("piece_bpe_32k.model")
    processor = SentencePieceProcessor(model_file=path)
    small = awkward.where("length(coalesce(text, '')) < 1000")
    got = by_key(tokens.count_tokens(small, "doc_id", "text", path).select("doc_id", "n_tokens"))
    want = [(r.doc_id, len(processor.encode(r.text or ""))) for r in small.collect()]
    assert got == sorted(want, key=lambda r: (r[0] is not None, *map(str, r)))


def test_query_counts_every_document(spark, sf_dir, tokenizer):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in queries.QUERIES["op7_token_counts"](spark, sf_dir).collect()}
    ids = sorted(texts)
    counts = [len(e.ids) for e in tokenizer.encode_batch([texts[i] for i in ids], add_special_tokens=False)]
    assert got == {i: (len(texts[i].encode()), n) for i, n in zip(ids, counts)}


def test_groups_are_balanced_by_bytes(spark, monkeypatch):
    """Characters of one, two, three and four bytes: no group of several pieces has more bytes than the limit."""
    monkeypatch.setattr(tokens, "GROUP_BYTES", 1000)
    seen, plain = [], tokens.groups
    monkeypatch.setattr(tokens, "groups", lambda sizes: seen.append(plain(sizes, 1000)) or seen.append(sizes) or seen[-2])
    texts = [c * n for n in (90, 200, 300) for c in ("a", "é", "日", "🙂")] * 3
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array([len(t.encode()) for t in texts]), pa.array(texts)], names=["k", "n_bytes", "t"])
    plan = {}
    monkeypatch.setattr(tokens, "bounded_batches", lambda *_: None)

    class Rows:  # hands the task's function out instead of running it
        schema = spark.createDataFrame([], "k long").schema

        def mapInArrow(self, function, _):
            plan["task"] = function
            raise StopIteration

    df = spark.createDataFrame([(1, "a")], "k long, t string")
    monkeypatch.setattr(type(df), "select", lambda *_: Rows())
    with pytest.raises(StopIteration):
        tokens.count_tokens(df, "k", "t", public_tokenizers.path("byte_bpe_50k.json"))
    list(plan["task"](iter([batch])))
    made, sizes = seen
    assert sizes == [len(t.encode()) for t in texts]
    assert all(len(g) == 1 or sum(sizes[i] for i in g) <= 1000 for g in made) and len(made) > 5


def test_unknown_patterns_are_not_split(tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert tokens.splits_at_spaces(path)
    assert not tokens.splits_at_spaces(public_tokenizers.path("word_bpe_49k.json"))
    assert not tokens.splits_at_spaces(public_tokenizers.path("piece_bpe_32k.model"))
    about = json.loads(open(path, encoding="utf-8").read())
    for change in ({"pre_tokenizer": {"type": "Split"}}, {"normalizer": {"type": "NFKC"}}, {"added_tokens": [{**about["added_tokens"][0], "lstrip": True}]}):
        (tmp_path / "own.json").write_text(json.dumps({**about, **change}))
        assert not tokens.splits_at_spaces(str(tmp_path / "own.json"))
