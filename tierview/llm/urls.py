"""URL rules by a bit-parallel wildcard automaton.

Every rule is a glob over the canonical URL. All globs are packed one after another into words of 64 bits, one bit for
each number of bytes that a glob has matched so far. A byte advances all globs of a URL at once (Shift-And), and a
batch of URLs advances together.

In a glob ``*`` stands for any bytes without a slash, ``**`` for any bytes, ``?`` for one byte that is no slash.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierview.llm import words
from tierview.llm.session import column

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for the host in ``name`` (up to its slash) and its subdomains, where the path starts with the rest."""

    verdict: str
    name: str

    @property
    def glob(self) -> str:
        host, slash, path = self.name.partition("/")
        return f"*.{host}{slash}{path}**"


@dataclass(frozen=True)
class Glob:
    """``verdict`` for canonical URLs (a dot, the host, the path) that the whole glob matches."""

    verdict: str
    glob: str


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark, hash or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to a question mark, hash or the end; empty without ``://``."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


class Automaton:
    """The packed globs. ``matches`` gives for each URL which of them match the whole of it."""

    def __init__(self, globs: Sequence[str]):
        steps = [_steps(glob) for glob in globs]
        bits = sum(len(literals) + 1 for literals, _ in steps)
        self.words = max(1, -(-bits // 64))
        take = np.zeros((256, 64 * self.words), bool)  # may this byte be the literal that leads into the bit?
        stay = np.zeros((256, 64 * self.words), bool)  # may this byte be part of a star that stands at the bit?
        start, ends, at = np.zeros(64 * self.words, bool), [], 0
        for literals, stars in steps:
            start[at] = True
            for n, byte in enumerate(literals, 1):
                if byte is None:
                    take[:, at + n] = True
                    take[ord("/"), at + n] = False
                else:
                    take[byte, at + n] = True
            for n, every in stars.items():
                stay[:, at + n] = True
                stay[ord("/"), at + n] = every
            at += len(literals) + 1
            ends.append(at - 1)
        self.take, self.stay, self.start = _packed(take), _packed(stay), _packed(start[None])[0]
        self.ends = np.array(ends, np.int64)

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """``data``: the bytes of all URLs, ``offsets``: where each begins, and the end. One row for each URL."""
        if len(offsets) < 2:
            return np.zeros((0, len(self.ends)), bool)
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        begins, sizes = offsets[:-1][order], lengths[order]
        state = np.repeat(self.start[None], len(sizes), axis=0)
        left = len(sizes)
        for step in range(int(sizes[0]) if left else 0):
            left = int(np.searchsorted(-sizes[:left], -step, side="left"))  # those longer than step
            byte = data[begins[:left] + step]
            now = state[:left]
            shifted = now << np.uint64(1)
            shifted[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:left] = (shifted & self.take[byte]) | (now & self.stay[byte])
        hit = (state[:, self.ends // 64] >> (self.ends % 64).astype(np.uint64)) & np.uint64(1)
        out = np.empty((len(sizes), len(self.ends)), bool)
        out[order] = hit.astype(bool)
        return out


def _steps(glob: str) -> tuple[list[int | None], dict[int, bool]]:
    """The literals of a glob (None: any but a slash), and by literals before it each star: does it take slashes?"""
    literals: list[int | None] = []
    stars: dict[int, bool] = {}
    data = glob.encode()
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"**":
            stars[len(literals)] = True
            at += 2
            continue
        if data[at : at + 1] == b"*":
            stars.setdefault(len(literals), False)
        else:
            literals.append(None if data[at : at + 1] == b"?" else data[at])
        at += 1
    return literals, stars


def _packed(bits: np.ndarray) -> np.ndarray:
    words = bits.reshape(len(bits), -1, 64).astype(np.uint64) << np.arange(64, dtype=np.uint64)
    return np.bitwise_or.reduce(words, axis=2)


def judge_urls(
    df: DataFrame, key: str, url: str, rules: Sequence[Rule], globs: Sequence[Glob] = (), default: str = "allow"
) -> DataFrame:
    """Returns per row ``key`` (under its name), ``host``, ``path``, ``rule``, ``glob`` and ``verdict``.

    The longest matching rule by its name decides (of equally long ones, ``block`` before others, then the first).
    Without a rule the first matching glob decides, without that ``default``. A null url, or one without ``://``,
    has an empty host and path and matches no rule. An empty table gives no rows; other columns are not read. The
    number of rules bounds the state of a URL; URLs of any length are judged whole.
    """
    ranked = sorted(rules, key=lambda rule: (-len(rule.name), rule.verdict != "block"))
    listed = [*ranked, *globs]
    machine = Automaton([one.glob for one in listed])
    verdicts = np.array([one.verdict for one in listed] + [default], object)
    rule_names = np.array([rule.name for rule in ranked] + [None] * (len(globs) + 1), object)
    glob_names = np.array([None] * len(ranked) + [one.glob for one in globs] + [None], object)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = machine.matches(*words.raw(batch.column("canonical")))
            first = np.append(hit, np.ones((len(hit), 1), bool), axis=1).argmax(axis=1)  # the default, if no other
            yield pa.record_batch(
                [
                    *(batch.column(name) for name in ("k", "host", "path")),
                    *(pa.array(table[first], pa.string()) for table in (rule_names, glob_names, verdicts)),
                ],
                names=["k", "host", "path", "rule", "glob", "verdict"],
            )

    parts = df.select(column(key).alias("k"), host_of(column(url)).alias("host"), path_of(column(url)).alias("path"))
    parts = parts.withColumn("canonical", F.concat(F.lit("."), "host", "path"))
    kind = parts.schema["k"].dataType.simpleString()
    out = parts.mapInArrow(judged, f"k {kind}, host string, path string, rule string, glob string, verdict string")
    return out.select(F.col("k").alias(key), "host", "path", "rule", "glob", "verdict")
