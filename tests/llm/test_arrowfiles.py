"""Token files against the tokenizers library, and what is in them."""

from __future__ import annotations

import json
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tierview.llm import arrowfiles, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def wanted(rows, tokenizer, end=1):
    """rows: key, text. Key, start, ids in the order of the files."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), len(r[1] or "")))
    out, at = [], 0
    for key, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        out.append((key, at, len(ids), ids))
        at += len(ids)
    return out


@pytest.mark.parametrize("length", [1, 7, 2048])
def test_awkward_texts(awkward, nothing, tokenizer, monkeypatch, length):
    if length < 2048:
        awkward = awkward.where("length(coalesce(text, '')) < 5000")
    files = arrowfiles.write_files(awkward, "doc_id", "text", PATH, 1, length)
    want = wanted([(r.doc_id, r.text) for r in awkward.collect()], tokenizer)
    got = arrowfiles.read_documents(files, "doc_id", "bigint")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    sums = arrowfiles.read_checksums(files, "doc_id", "bigint").collect()
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted(map(str, map(tuple, sums))) == sorted(str((k, a, n, crc(ids))) for k, a, n, ids in want)
    assert sum(r.n_documents for r in files.collect()) == len(want)
    none = arrowfiles.write_files(nothing, "doc_id", "text", PATH, 1)
    assert none.count() == 0 and arrowfiles.read_documents(none, "doc_id", "bigint").count() == 0


def test_files_are_one_line_cut_into_sequences(spark, tokenizer):
    rows = [(i, "some words and others, " * (i % 40)) for i in range(400)]
    files = arrowfiles.write_files(spark.createDataFrame(rows, "k long, text string"), "k", "text", PATH, 1, 16).orderBy("part").collect()
    assert len(files) > 1
    line = []
    for row in files:
        file = arrowfiles.TokenFile(row.path)
        assert len(file) == row.n_sequences == -(-row.n_tokens // 16)
        for n in range(len(file)):
            ids, mask = file[n]
            mask = mask.to_numpy(zero_copy_only=False)
            assert len(ids) == len(mask) == 16
            assert mask.all() or n == len(file) - 1
            assert not ids[~mask].any()
            line += ids[mask].tolist()
        with pytest.raises(IndexError):
            file[len(file)]
    assert line == [i for *_, ids in wanted(rows, tokenizer) for i in ids]


def test_sequences_are_read_where_they_lie(spark):
    rows = [(i, "a b c d e f g " * 200) for i in range(100)]
    (row,) = arrowfiles.write_files(spark.createDataFrame(rows, "k long, text string").coalesce(1).where("k >= 0"), "k", "text", PATH, 1, 64).orderBy("part").limit(1).collect()
    file = arrowfiles.TokenFile(row.path)
    before = pa.total_allocated_bytes()
    ids, mask = file[len(file) // 2]
    assert not ids.flags.owndata and not ids.flags.writeable and ids.dtype == np.uint16
    assert mask.type == pa.bool_() and mask.true_count == len(mask) == 64
    assert pa.total_allocated_bytes() - before < 10_000
    with pa.OSFile(row.path) as raw:  # any reader of the format can do it
        assert pa.ipc.open_file(raw).schema == arrowfiles.file_schema(pa.int64(), np.uint16, 64)


def test_long_documents_cross_batches(spark, tokenizer, monkeypatch):
    rows = [(0, "x"), (1, "one two three " * 4000), (2, None), (3, "four " * 5000), (4, "")]
    files = arrowfiles.write_files(spark.createDataFrame(rows, "k long, text string").coalesce(1), "k", "text", PATH, 1, 8)
    got = sorted(map(tuple, arrowfiles.read_documents(files, "k", "bigint").collect()))
    assert got == wanted(rows, tokenizer)


def test_words_make_the_same_ids(tokenizer):
    texts = [
        "It's we'LL they'Re 'quoted' it 's", "a\x0bb\x0cc\rd\x1ce\x85f g　h​i", "é ́x Å 가 ΣαΣ Σ",
        "<|endoftext|>a <|startoftext|> <|endoftext|><|ENDOFTEXT|> < |endoftext|>", "", "   ", "x" * 3000, "\x00 a\x00b", "1234 5,6.7 ½ Ⅷ ①", "İstanbul ﬁ ß ẞ",
    ]
    encoder = arrowfiles.Encoder(PATH)
    assert encoder.by_words and encoder.type is np.uint16
    for _ in range(2):  # the second time from memory
        ids, sizes = encoder.encode(pa.array(texts))
        want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert sizes.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_remembered_words_are_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(arrowfiles, "REMEMBERED", 10)
    encoder = arrowfiles.Encoder(PATH)
    for n in range(0, 60, 6):
        text = " ".join(f"w{n + i}" for i in range(6))
        ids, _ = encoder.encode(pa.array([text]))
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(encoder.known) <= 16


def test_other_vocabularies_take_whole_texts(tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not arrowfiles.by_words(arrowfiles._about(path))
    encoder, texts = arrowfiles.Encoder(path), ["two  words\n and", "", "more"]
    ids, sizes = encoder.encode(pa.array(texts))
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
    about = json.loads(open(PATH, encoding="utf-8").read())
    about["added_tokens"].append({**about["added_tokens"][0], "id": 49408, "content": "two words"})
    (tmp_path / "own.json").write_text(json.dumps(about))
    assert not arrowfiles.by_words(arrowfiles._about(str(tmp_path / "own.json")))


def test_plain_words_have_the_library_s_ids(tokenizer):
    """All plain letters, in words of every kind and with every mark, and words that only look plain."""
    rng = random.Random(3)
    letters = [chr(c) for c in range(1, 0x250) if arrowfiles._PLAIN.fullmatch(chr(c)) and chr(c) not in ".,;:!?"]
    assert len(letters) == 52 + 62 + 123
    words = letters + ["".join(rng.choices(letters if n % 2 else letters[:52], k=rng.randrange(1, 12))) + rng.choice(["", *".,;:!?"]) for n in range(4000)]
    words += ["İ", "ı", "ĸ", "ŉ", "ſ", "é\u0301", "x\u0300", "a.b", "a..", ".a", "don't", "'s", "we'LL", "a²", "aª", "ΣΑΣ", "ﬁn", "Ǆ", "a\u00ad"]
    encoder = arrowfiles.Encoder(PATH)
    assert encoder.plain
    for _ in range(2):
        ids, sizes = encoder.encode(pa.array([*words, " ".join(words)]))
        want = [e.ids for e in tokenizer.encode_batch([*words, " ".join(words)], add_special_tokens=False)]
        assert sizes.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
    about = arrowfiles._about(PATH)
    about["normalizer"] = None
    assert not arrowfiles.plain_by_model(about)

def test_query_is_the_library_on_every_document(spark, sf_dir, tokenizer):
    texts = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.QUERIES["op12_token_files"](spark, sf_dir).collect()}
    at, want = 0, {}
    for (key, _), e in zip(texts, tokenizer.encode_batch([t for _, t in texts], add_special_tokens=False)):
        ids = np.array([*e.ids, 1], "<u4")
        want[key] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert got == want
