"""Token counts of whole texts, by the library of the vocabulary file, in Arrow batches that return lengths only.

A long text is split where no token can cross: between a visible character and white space after it. There the
pattern that splits text before the merges always ends a word, whatever stands around, and no special string has a
space in it. That is known of one pattern; texts of a vocabulary with another one stay whole, and so does a text without
such a place. The pieces of a batch are counted in groups of about equal bytes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierview.llm.session import bounded_batches, column

#: Characters of a piece, and bytes of the pieces that are encoded at once.
PIECE_CHARS, GROUP_BYTES = 1 << 15, 1 << 20

#: A letter, digit or visible ASCII mark before a space or line feed.
_CUT = re.compile(r"(?:[^\W_]|[!-~])(?=[ \n])")


def pieces(text: str, limit: int = PIECE_CHARS) -> list[str]:
    """``text`` cut at the first safe place at or after every ``limit`` characters."""
    if len(text) <= limit:
        return [text]
    out, at = [], 0
    while len(text) - at > limit:
        found = _CUT.search(text, at + limit - 1)
        if found is None:
            break
        out.append(text[at : found.end()])
        at = found.end()
    out.append(text[at:])
    return out


def splits_at_spaces(vocabulary: str) -> bool:
    """Whether no token of this vocabulary crosses from a visible character to the white space after it.

    So it is with the library's own pattern on bytes, which takes white space into what follows it, where nothing is
    normalized before and no added token has white space in it or takes some from around it.
    """
    if not vocabulary.endswith(".json"):
        return False
    with open(vocabulary, encoding="utf-8") as file:
        about = json.load(file)
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    splits = about["pre_tokenizer"] or {}
    tokens = about["added_tokens"]
    return (
        about["normalizer"] is None
        and {k: splits.get(k) for k in plain} == plain
        and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in tokens)
    )


def groups(sizes: list[int], limit: int = GROUP_BYTES) -> list[list[int]]:
    """Indices in order of size, in groups of ``limit`` bytes (a larger piece alone), so that a group's are alike."""
    out: list[list[int]] = []
    held = 0
    for i in sorted(range(len(sizes)), key=sizes.__getitem__):
        if not out or held + sizes[i] > limit:
            out.append([])
            held = 0
        out[-1].append(i)
        held += sizes[i]
    return out


@lru_cache
def _counter(path: str) -> Callable[[list[str]], list[int]]:
    if path.endswith(".json"):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        return lambda texts: [len(e) for e in encode(texts, add_special_tokens=False)]
    from sentencepiece import SentencePieceProcessor

    processor = SentencePieceProcessor(model_file=path)
    return lambda texts: [len(ids) for ids in processor.encode(texts, num_threads=1)]


def count_tokens(df: DataFrame, key: str, text: str, vocabulary: str, limit: int = 1024) -> DataFrame:
    """Returns per row ``key`` (under its name), ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit``).

    ``vocabulary`` is a file that every executor has: ``.json`` of the tokenizers library, or ``.model`` of
    sentencepiece; texts are split only where :func:`splits_at_spaces`. No begin, end or added special
    tokens; special strings within a text count as the library has it by default. A null or empty text has 0 bytes
    and 0 tokens. An empty table gives no rows; other columns are not read.
    """
    splits = splits_at_spaces(vocabulary)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(vocabulary)
        for batch in batches:
            texts = batch.column("t").to_pylist()
            owners, parts = [], []
            for row, body in enumerate(texts):
                own = pieces(body) if splits else [body]
                parts += own
                owners += [row] * len(own)
            tokens = np.zeros(len(parts), np.int64)
            for group in groups(pc.binary_length(pa.array(parts, pa.large_string())).to_pylist()):
                tokens[group] = count([parts[i] for i in group])
            sums = np.zeros(len(texts), np.int64)
            np.add.at(sums, np.array(owners, np.int64), tokens)
            yield pa.record_batch([batch.column("k"), batch.column("n_bytes"), pa.array(sums)], names=["k", "n_bytes", "n_tokens"])

    bounded_batches(df.sparkSession)
    body = F.coalesce(column(text), F.lit(""))
    rows = df.select(column(key).alias("k"), F.octet_length(body).cast("long").alias("n_bytes"), body.alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    out = rows.mapInArrow(counted, f"k {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
