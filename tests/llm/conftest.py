from __future__ import annotations

import pytest

#: Texts with every awkward case: null, empty, ties, repeats, long, beyond the basic plane.
TEXTS = [
    None, "", "a", "the same text here, twice over.", "the same text here, twice over.", " ", "\n\n\t x  y \n",
    "naïve café — déjà vu 🙂🙂 ok", "x" * 70_000, "word " * 20_000, "a b\n" * 12_000 + "end", "<|endoftext|> it's <|endoftext|>",
    "日本語のテキスト。" * 3000, "1234567890" * 400, "\x00\x01 odd \u2581 bytes", "tab\tand  two  spaces ",
]


@pytest.fixture
def awkward(spark):
    """Documents with a null and a repeated id, and with columns whose names operators use inside."""
    rows = [(i, t, "k", f"s{i}", 1, 2) for i, t in enumerate(TEXTS)] + [(None, "no id", "k", "s", 1, 2), (3, TEXTS[3], "k", "s", 1, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, k string, t string, size int, shard int").repartition(3)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, k string, t string, size int, shard int")


def by_key(df, key="doc_id"):
    return sorted((tuple(row) for row in df.collect()), key=lambda r: (r[0] is not None, *map(str, r)))
