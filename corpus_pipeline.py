"""From raw documents to token ids, in stages that each keep their decisions.

A stage takes all that the one before it kept. All but the last return the columns of ``documents`` as they came, with
``text`` and ``n_chars`` changed where secrets were masked. Rows without an id cannot be told apart by the stages that
decide by document; they are left in, and secrets in them are masked.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierview.llm import leaks, minhash, pieces, quality, secrets
from tierview.llm.session import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. It learns from the labelled rows of ``documents``."""
    ranking = quality.learn(_table(spark, sf_dir, "documents"), "doc_id", "text", _table(spark, sf_dir, "labels"), "quality")
    return quality.filtered(docs, "text", ranking)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id (with all its rows)."""
    away = minhash.near_duplicates(docs, "doc_id", "text").where("NOT kept").select("doc_id")
    return docs.join(away, "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``."""
    return leaks.clean(docs, "text", _table(spark, sf_dir, "benchmark"), "text")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return secrets.cleaned(docs, "text").withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document, packed as little-endian 32-bit integers with begin and end."""
    return pieces.encode(docs, "doc_id", "text", public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", keep_one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", mask_secrets),
    ("SentencePiece encoding", encode),
]

#: The stages learn, link and tokenize, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``. What a stage keeps is written out, since the next one reads it more than once."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
