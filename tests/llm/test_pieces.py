from __future__ import annotations

import hashlib
from array import array

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from tierview.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")


LIBRARY = SentencePieceProcessor(model_file=PATH)


@pytest.fixture
def library():
    return LIBRARY


PARTS = ["a", "th", "he", " ", "   ", "▁", "\n", "é", "日本", "🙂", "12", "(", ");", "=", "the", "ing", "\t", "\x00", "_", "ß", "́", "»,"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=30).map("".join) | st.text(max_size=25))
def test_ids_are_the_librarys(text):
    library, ours = LIBRARY, pieces.model(PATH)
    text = text.encode("utf-8", "ignore").decode()
    ids = library.encode(text)
    assert list(array("I", ours.encode(text))) == ids
    assert ours.decode(array("I", ids)) == library.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 258) | st.integers(0, 31_999), max_size=9))
def test_any_ids_decode_as_in_the_library(ids):
    assert pieces.model(PATH).decode(array("I", ids)) == LIBRARY.decode(ids)


def test_awkward_texts(awkward, nothing, library):
    encoded = pieces.encode(awkward, "doc_id", "text", PATH).withColumn("list", pieces.unpacked(F.col("ids")))
    got = sorted((str(r.doc_id), r.n_tokens, list(r.list)) for r in encoded.collect())
    want = [(str(r.doc_id), library.encode(r.text or "", add_bos=True, add_eos=True)) for r in awkward.collect()]
    assert got == sorted((k, len(ids), ids) for k, ids in want)
    decoded = pieces.decode(encoded, "doc_id", "ids", PATH).collect()
    back = {str(r.doc_id): library.decode(library.encode(r.text or "")) for r in awkward.collect()}
    assert all(r.text == back[str(r.doc_id)] for r in decoded if r.doc_id != 3)
    assert pieces.encode(nothing, "doc_id", "text", PATH).count() == 0
    plain = pieces.encode(awkward, "doc_id", "text", PATH, bos=False, eos=False).where("doc_id = 1").first()
    assert (plain.n_tokens, bytes(plain.ids)) == (0, b"")
    null = awkward.sparkSession.sql("SELECT 1 AS doc_id, CAST(NULL AS BINARY) AS ids")
    assert pieces.decode(null, "doc_id", "ids", PATH).first().text == ""


def test_query_agrees_with_the_library(spark, sf_dir, library):
    def digest(data: bytes) -> str:
        return hashlib.sha256(data).hexdigest()

    want = []
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        want.append((r.doc_id, len(ids), digest(array("I", ids).tobytes()), digest(library.decode(ids).encode())))
    got = [tuple(r) for r in queries.QUERIES["op2_sentencepiece"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(want)
