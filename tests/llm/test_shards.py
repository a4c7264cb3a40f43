from __future__ import annotations

import zlib

import pytest

from tierview.llm import queries, shards


def brute(rows, n):
    """rows: (key, text). Nulls first, then by checksum and size."""
    sized = [(k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows]
    sized.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]))
    total, before, taken, out = sum(s for _, s, _ in sized), 0, [0] * n, []
    for k, size, crc in sized:
        shard = min(n - 1, (2 * before + size) * n // (2 * total))
        out.append((k, size, crc, shard, taken[shard]))
        taken[shard] += 1
        before += size
    return out


@pytest.mark.parametrize("n", [1, 3, 8])
def test_awkward_texts(awkward, nothing, n):
    got = shards.balanced_shards(awkward, "doc_id", "text", n)
    assert got.columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute([(r.doc_id, r.text) for r in awkward.collect()], n)))
    assert shards.balanced_shards(nothing, "doc_id", "text", n).count() == 0


def test_query_is_balanced_and_gapless(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.QUERIES["op8_balanced_shards"](spark, sf_dir).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got) == sorted(brute(rows, 8))
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in got)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * (i % 7)) for i in range(200)], "doc_id long, text string")
    placed = shards.balanced_shards(df, "doc_id", "text", 4)
    shards.write_shards(df, placed, "doc_id", str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and back.select("shard").distinct().count() == 4
