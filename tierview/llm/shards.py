"""Sharding by global prefix sums of byte sizes.

Rows are put into one global order, by key and then by content. Each partition's total is summed up, the totals
before a partition give every row in it the bytes before it, and the line of all bytes is cut at equal targets. Shards
are therefore contiguous in that order, and each is off its target by less than the largest row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierview.llm.session import checkpointed, column


def text_size(text: Column) -> Column:
    """UTF-8 bytes and one for the separator; a null text takes the separator only."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def balanced_shards(df: DataFrame, key: str, text: str, shards: int = 8) -> DataFrame:
    """Returns per row ``key`` (under its name), ``size``, ``text_crc32``, ``shard`` and ``slot``.

    Rows are ordered by key (null first), then checksum and size, so equal rows may change places but never the
    result. ``slot`` counts from 0 in each shard. A row belongs to the shard in which the middle of its bytes falls.
    An empty table gives no rows; a shard that no row's middle falls into stays empty. Other columns are not read.

    Texts are not moved: size and checksum are taken where a text is read, and only these are put in order. The
    driver holds one pair of sums per partition and one count per partition and shard in it.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    body = column(text)
    narrow = df.select(
        column(key).alias("k"),
        text_size(body).alias("size"),
        F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("crc"),
    )
    # Without a number of partitions of its own the exchange would be merged anew for each use.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("k", "crc", "size")
    # Cut off from its lineage: the passes below must see the same partitions, also after an executor is lost.
    ordered = checkpointed(narrow.repartitionByRange(parts, *order).sortWithinPartitions(*order))

    pid = F.spark_partition_id().alias("pid")
    totals = sorted(map(tuple, ordered.select(pid, "size").groupBy("pid").agg(F.sum("size"), F.count("*")).collect()))
    before, total = {}, 0
    for part, size, _ in totals:
        before[part] = total
        total += size

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("pid")[0].as_py()
            start = before[own] if at is None else at
            size = batch.column("size").to_numpy()
            ends = start + np.cumsum(size)
            at = int(ends[-1])
            # Twice the middle of the row, over twice the total; Python's integers, as the product may pass 64 bits.
            middle = 2 * (ends - size) + size
            shard = middle * shards // (2 * total) if at < 2**60 // shards else middle.astype(object) * shards // (2 * total)
            shard = np.minimum(shard, shards - 1).astype(np.int32)
            yield pa.record_batch([*batch.columns, pa.array(shard)], names=[*batch.schema.names, "shard"])

    key_type = ordered.schema["k"].dataType.simpleString()
    kinds = f"k {key_type}, size bigint, crc bigint, pid int, shard int"
    sharded = ordered.select("k", "size", "crc", pid).mapInArrow(placed, kinds)

    # A shard's first partition holds its slot 0; later ones go on where the one before them ended.
    first: dict[tuple[int, int], int] = {}
    seen: dict[int, int] = {}
    for part, shard, rows in sorted(map(tuple, sharded.groupBy("pid", "shard").count().collect())):
        first[part, shard] = seen.get(shard, 0)
        seen[shard] = first[part, shard] + rows

    def slotted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken: dict[int, int] = {}
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            slot = np.empty(len(shard), np.int64)
            for s in np.unique(shard).tolist():
                mine = np.flatnonzero(shard == s)
                part = batch.column("pid")[int(mine[0])].as_py()
                base = taken.get(s, first[part, s])
                slot[mine] = base + np.arange(len(mine))
                taken[s] = base + len(mine)
            yield pa.record_batch([*batch.columns, pa.array(slot)], names=[*batch.schema.names, "slot"])

    out = sharded.mapInArrow(slotted, kinds + ", slot bigint")
    return out.select(F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def write_shards(df: DataFrame, placed: DataFrame, key: str, path: str) -> None:
    """Writes ``df`` with one folder for each shard of ``placed``; keys must be unique and not null for this."""
    rows = df.join(placed.select(key, "shard", "slot"), key)
    rows.repartition("shard", F.floor(F.col("slot") / 100_000)).write.partitionBy("shard").parquet(path)
