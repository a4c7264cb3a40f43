"""One registered query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierview.llm import arrowfiles, clusters, codes, digests, leaks, minhash, pieces, quality, secrets, shards, suffixes, tokens, urls, vectors
from tierview.llm.session import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = (
    urls.Rule("block", "net/"),
    urls.Rule("allow", "example.net/en/"),
    urls.Rule("block", "example.com/de/"),
    urls.Rule("allow", "org/fr/"),
)
#: What the automaton alone judges: kinds of hosts and files that a text corpus has no use for.
URL_GLOBS = tuple(
    urls.Glob("block", glob)
    for glob in ("*.casino*/**", "*.porn*/**", "*.ads.*/**", "**/login", "**.exe", "**.zip", "**.jpg", "**.png")
)


@query
def op1_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ranking = quality.learn(docs, "doc_id", "text", labels, "quality")
    return quality.scored(docs, "doc_id", "text", ranking).select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def piece_model() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op2_sentencepiece(spark, sf_dir):
    encoded = pieces.encode(table(spark, sf_dir, "documents"), "doc_id", "text", piece_model())
    decoded = pieces.decode(encoded, "doc_id", "ids", piece_model())
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


@query
def op3_url_filter(spark, sf_dir):
    judged = urls.judge_urls(table(spark, sf_dir, "pages"), "page_id", "url", URL_RULES, URL_GLOBS)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query
def op4_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    # The first scan fills the ledger; the second one finds every pair of blob and rule in it and scans nothing.
    _, seen = secrets.scan(docs, "doc_id", "text")
    findings, _ = secrets.scan(docs, "doc_id", "text", ledger=written(seen))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return findings.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(secrets.listed(F.col("spans")), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


@query
def op5_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def op6_fingerprints(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    ranks = digests.rarity(digests.entropy_counts(docs, "text"))
    n, half = F.length("t"), F.floor(F.length("t") / 2).cast("int")
    edited = F.concat(F.substr("t", F.lit(1), n - half), F.substr("next", F.lit(1), half))
    rows = digests.followed(docs, "doc_id", "text").withColumn("edited", edited)
    rows = rows.withColumns({"n_chars": n.cast("long"), "edited_sha256": F.sha2("edited", 256)})
    prints = digests.fingerprints(rows, ["t", "edited", "next"], ranks, keep=["k", "n_chars", "edited_sha256"])
    alike = digests.compared(prints, {"near_edited": ("t", "edited"), "near_next": ("t", "next")})
    return alike.select(
        F.col("k").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        F.col("t").alias("fingerprint"),
        F.col("edited").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


@query
def op7_token_counts(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    return tokens.count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", path)


@query
def op8_balanced_shards(spark, sf_dir):
    placed = shards.balanced_shards(table(spark, sf_dir, "documents"), "doc_id", "text", shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op9_suffix_dedup(spark, sf_dir):
    out = suffixes.remove_repeats(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op10_decontaminate(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = leaks.overlaps(docs, "doc_id", "text", items, "item_id", "text")
    return found.withColumn("similarity", F.col("n_equal") / F.col("n_words"))


#: Components of the vectors of ``embeddings``.
VECTOR_DIMS = 64

#: Labels up to which their sums are sent to every executor; more are joined by a shuffle.
SENT_LABELS = 100_000


@query
def op11_vector_codes(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    books = codes.fit(rows, "vec_id", "embedding", VECTOR_DIMS, parts=8, entries=16, rounds=6, scale=4096)
    if books is None:
        return spark.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    coded = written(codes.encode(rows, "vec_id", "embedding", books, keep="label"))
    by_label = written(coded.groupBy(F.col("label").alias("of")).agg(vectors.total("error").alias("label_error")))
    by_label = F.broadcast(by_label) if by_label.count() <= SENT_LABELS else by_label
    told = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return told.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


@query
def op12_token_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    files = arrowfiles.write_files(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return arrowfiles.read_checksums(files, "doc_id", docs.schema["doc_id"].dataType.simpleString())


@query
def op13_orchard_clusters(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    found = clusters.fit(rows, "vec_id", "embedding", VECTOR_DIMS, count=16, rounds=3, scale=64)
    if found is None:
        kinds = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        return spark.createDataFrame([], kinds)
    placed = written(clusters.assign(rows, "vec_id", "embedding", found))
    sums = {r.cluster: r.all for r in placed.groupBy("cluster").agg(vectors.total("distance").alias("all")).collect()}
    digests_of = found.digests()
    # A row for each centroid, of which there are ``count`` at most.
    about = spark.createDataFrame([(c, n, digests_of[c]) for c, n in sums.items()], "cluster int, cluster_inertia bigint, centroid_sha256 string")
    told = placed.join(F.broadcast(about), "cluster")
    inertia = F.lit(min(sum(sums.values()), vectors.MOST)).cast("bigint").alias("inertia")
    return told.select("vec_id", "cluster", "distance", "cluster_inertia", inertia, "centroid_sha256")
