"""SentencePiece encoding of the merge type by backtracking, and its decoding.

The library merges, in the whole text, the adjacent pair whose union is the piece of the highest score, the leftmost
of equals. The same result can be found from left to right: a sequence of pieces is the library's exactly if each
two neighbours stay as they are when merged on their own. At each place the longest piece is tried first (one pass
of an Aho-Corasick automaton over the reversed text), then its shorter prefixes; a piece must be compatible with the
one before it, which replaying both pieces' merges tells. The pieces before a place are unique, so a place from which
nothing fits is marked in a bitfield and never tried again.

Texts are cut into chunks where the vocabulary has no piece that could cross, and a worker remembers chunks.
"""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierview.llm.session import bounded_batches, column

SPACE = "▁"

#: Chunks, and pairs of pieces, that a worker remembers; beyond that it starts anew. Results do not depend on it.
REMEMBERED = 600_000

#: Stands for a control piece in joined bytes: no UTF-8, so that it is not overlooked.
_CONTROL = b"\xff"

#: Ids above all pieces stand for single characters that are no piece; they become bytes.
_CHARACTER = 1 << 24

#: Latin letters, and ASCII characters that are no letters; without the line feed, and spaces are escaped by then.
_LATIN, _MARK = r"A-Za-z\u00c0-\u024f", r"\x00-\x09\x0b-@\[-`{-\x7f"
_OTHER = rf"[^{_LATIN}{_MARK}{SPACE}\n]"
_CHUNKS = re.compile(rf"{SPACE}*(?:(?:[{_LATIN}]++|[{_MARK}]++)(?!{_OTHER})|[^{SPACE}\n]+)|\n|{SPACE}+")
_LINES = re.compile(rf"{SPACE}*[^{SPACE}\n]+|\n|{SPACE}+")
_WORDS = re.compile(rf"{SPACE}*[^{SPACE}]+|{SPACE}+")


class _Remembered(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= REMEMBERED:
            self.clear()
        made = self[key] = self.make(key)
        return made


class Model:
    """The pieces of a model file whose normalizer only escapes spaces and adds one in front."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=path)
        probe = "  ﬁ Ａ á\r\n\tx  "
        if library.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError(f"{path} normalizes texts; only spaces may be escaped and one be put in front")
        self.bos, self.eos, self.unknown = library.bos_id(), library.eos_id(), library.unk_id()
        self.byte_ids: dict[int, int] = {}
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.surface: list[bytes] = []
        self.is_byte: set[int] = set()
        for i in range(library.get_piece_size()):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.is_byte.add(i)
                self.surface.append(bytes([int(piece[1:-1], 16)]))
            elif library.is_control(i):
                self.surface.append(_CONTROL)
            elif library.is_unknown(i):
                self.surface.append(" ⁇ ".encode())
            else:
                self.ids[piece], self.scores[piece] = i, library.get_score(i)
                self.surface.append(piece.replace(SPACE, " ").encode())
        if len(self.byte_ids) != 256:
            raise ValueError(f"{path} has no piece for each byte")
        self.pieces = {i: piece for piece, i in self.ids.items()}
        self.chunks = self._chunks()

        # Pieces that their own merges do not arrive at never come out.
        self.events: dict[int, tuple[tuple, ...]] = {}
        for piece, i in self.ids.items():
            symbols, steps = self._merged(piece)
            if len(symbols) == 1:
                self.events[i] = steps
        self.longest = ahocorasick.Automaton()
        self.shorter: dict[int, int] = {}
        for i in self.events:
            piece = self.pieces[i]
            self.longest.add_word(piece[::-1], i)
            prefixes = (self.ids.get(piece[:n]) for n in range(len(piece) - 1, 0, -1))
            self.shorter[i] = next((p for p in prefixes if p in self.events), -1)
        self.longest.make_automaton()
        self.compatible = _Remembered(self._compatible)
        self.encoded = _Remembered(self._encoded)

    def _chunks(self) -> re.Pattern:
        """The finest cut that no piece crosses: at spaces, at line feeds, and between Latin letters and ASCII marks."""
        lone = all(SPACE not in piece.lstrip(SPACE) for piece in self.ids)
        if not lone:
            return re.compile(r"(?s:.+)")
        if any("\n" in piece for piece in self.ids):
            return _WORDS
        crossing = re.compile(f"[{_LATIN}][{_MARK}]|[{_MARK}][{_LATIN}]")
        return _LINES if any(map(crossing.search, self.ids)) else _CHUNKS

    def _merged(self, text: str) -> tuple[list[str], tuple[tuple, ...]]:
        """The library's merges of a short text: the symbols left, and each merge as (score, first, last symbol)."""
        symbols, steps = list(text), []
        while len(symbols) > 1:
            unions = [self.scores.get(a + b) for a, b in zip(symbols, symbols[1:])]
            best = max((s for s in unions if s is not None), default=None)
            if best is None:
                break
            at = unions.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            steps.append((best, symbols[0], symbols[-1]))
        return symbols, tuple(steps)

    def _text(self, token: int) -> str:
        return chr(token - _CHARACTER) if token >= _CHARACTER else self.pieces[token]

    def _compatible(self, pair: tuple[int, int]) -> bool:
        """Replays the merges of both pieces in the library's order: does a merge across them come first?"""
        left, right = pair
        lefts, rights = self.events.get(left, ()), self.events.get(right, ())
        end, begin = self._text(left)[-1], self._text(right)[0]
        i = j = 0
        while True:
            across = self.scores.get(end + begin)
            a = lefts[i][0] if i < len(lefts) else None
            b = rights[j][0] if j < len(rights) else None
            if across is not None and (a is None or across > a) and (b is None or across >= b):
                return False
            if a is not None and (b is None or a >= b):
                end, i = lefts[i][2], i + 1
            elif b is not None:
                begin, j = rights[j][1], j + 1
            else:
                return True

    def _backtracked(self, text: str) -> list[int]:
        n = len(text)
        found = array("l", [-1]) * n
        for at, token in self.longest.iter(text[::-1]):
            start = n - 1 - at
            if found[start] < 0:
                found[start] = token  # the longest comes first
        pieces, shorter, compatible = self.pieces, self.shorter, self.compatible
        failed = bytearray(n // 8 + 1)
        tokens: list[int] = []
        starts: list[int] = []
        pos, token = 0, -2  # -2: the longest piece here
        while pos < n:
            if token == -2:
                token = found[pos]
                if token < 0 and text[pos] not in self.ids:
                    token = _CHARACTER + ord(text[pos])
            fits = False
            while token >= 0:
                end = pos + (1 if token >= _CHARACTER else len(pieces[token]))
                if not failed[end >> 3] >> (end & 7) & 1 and (not tokens or compatible[tokens[-1], token]):
                    fits = True
                    break
                token = self._next(token, text, pos)
            if fits:
                tokens.append(token)
                starts.append(pos)
                pos, token = end, -2
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                token, pos = tokens.pop(), starts.pop()
                token = self._next(token, text, pos)
        return tokens

    def _next(self, token: int, text: str, pos: int) -> int:
        """The next shorter token at ``pos``; last, the character itself where it is no piece."""
        if token >= _CHARACTER:
            return -1
        token = self.shorter[token]
        return _CHARACTER + ord(text[pos]) if token < 0 and text[pos] not in self.ids else token

    def _encoded(self, chunk: str) -> bytes:
        out = array("I")
        for token in self._backtracked(chunk):
            if token >= _CHARACTER:
                out.extend(self.byte_ids[b] for b in chr(token - _CHARACTER).encode())
            else:
                out.append(token)
        return out.tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers, without begin and end."""
        if not text:
            return b""
        return b"".join(map(self.encoded.__getitem__, self.chunks.findall(SPACE + text.replace(" ", SPACE))))

    def decode(self, ids: array) -> str:
        """The text of ids: the space put in front is taken off, bytes that are no UTF-8 become U+FFFD each."""
        ids = ids[1:] if ids and ids[0] == self.bos else ids
        ids = ids[:-1] if ids and ids[-1] == self.eos else ids
        surface = self.surface
        try:
            text = b"".join([surface[i] for i in ids]).decode()
        except UnicodeDecodeError:
            return self._decoded_by_runs(ids)
        return text[1:] if ids and self.pieces.get(ids[0], "").startswith(SPACE) else text

    def _decoded_by_runs(self, ids: array) -> str:
        """As ``decode``; control pieces end a run of bytes and have no text."""
        text, started = "", False
        for is_byte, run in groupby(ids, self.is_byte.__contains__):
            if is_byte:
                text += b"".join(self.surface[i] for i in run).decode("utf-8", "each_byte")
                started = True
                continue
            for i in run:
                if self.surface[i] is not _CONTROL:
                    part = self.surface[i].decode()
                    text += part[1:] if not started and self.pieces.get(i, "").startswith(SPACE) else part
                    started = True
        return text


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "\ufffd", error.start + 1


codecs.register_error("each_byte", _each_byte)


@lru_cache(maxsize=4)
def model(path: str) -> Model:
    return Model(path)


def encode(df: DataFrame, key: str, text: str, path: str, bos: bool = True, eos: bool = True) -> DataFrame:
    """Returns per row ``key`` (under its name), ``n_tokens`` and ``ids``, packed as little-endian 32-bit integers.

    ``path`` is a model file that every executor has. A null or empty text has begin and end only. Texts are encoded
    whole, whatever their length. An empty table gives no rows; other columns are not read.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        front = array("I", [pieces.bos] * bos).tobytes()
        back = array("I", [pieces.eos] * eos).tobytes()
        for batch in batches:
            ids = [front + pieces.encode(str(body)) + back for body in batch.column("t")]
            counts = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.record_batch([batch.column("k"), counts, pa.array(ids, pa.binary())], names=["k", "n_tokens", "ids"])

    bounded_batches(df.sparkSession)
    rows = df.select(column(key).alias("k"), F.coalesce(column(text), F.lit("")).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(encoded, f"k {kind}, n_tokens bigint, ids binary").withColumnRenamed("k", key)


def decode(df: DataFrame, key: str, ids: str, path: str) -> DataFrame:
    """Returns per row ``key`` (under its name), ``ids`` and ``text``; null ids give an empty text."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            texts = [pieces.decode(array("I", x.as_py() or b"")) for x in batch.column("ids")]
            yield pa.record_batch([batch.column("k"), batch.column("ids"), pa.array(texts, pa.string())], names=["k", "ids", "text"])

    bounded_batches(df.sparkSession)
    rows = df.select(column(key).alias("k"), column(ids).cast("binary").alias("ids"))
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(decoded, f"k {kind}, ids binary, text string").withColumnRenamed("k", key)


def unpacked(ids: Column) -> Column:
    """Packed ids as an array of integers."""
    each = F.regexp_extract_all(F.hex(ids), F.lit("[0-9A-F]{8}"), F.lit(0))
    swapped = lambda h: F.concat(*(F.substr(h, F.lit(n), F.lit(2)) for n in (7, 5, 3, 1)))
    return F.transform(each, lambda h: F.conv(swapped(h), 16, 10).cast("int"))
