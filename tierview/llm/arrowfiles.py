"""Token ids as Arrow files of sequences of one length, with masks.

All documents, in order of their key, are one line of ids, dealt to files by ranges of the key. A file is in Arrow's
file format (its stream format with a footer that says where each batch is). Its rows are sequences of ``length`` ids
in a fixed-size list, a mask of the same length (a bit each) that is set where an id stands (only a file's last sequence is
filled up), and the documents that begin in the sequence, each with its key and place. All batches but the last have
``BATCH_SEQUENCES`` rows, so the n-th sequence is found by a division, and in a memory map it is read where it lies.

A task names its file by its attempt, and the list of files that Spark commits is what counts: a file of an attempt
that was lost or run twice is in no list.
"""

from __future__ import annotations

import itertools
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierview.llm import words
from tierview.llm.session import bounded_batches, column, shared_folder, written

#: Ids of a sequence, and sequences of a batch.
LENGTH, BATCH_SEQUENCES = 2048, 256

#: Words that a worker remembers the ids of. Beyond it the worker begins anew, so it bounds memory, not work.
REMEMBERED = 1 << 20

#: Characters of a text that are tokenized at once with others.
CHUNK_BYTES = 4 << 20

# A pattern that drops white space, and normalizers that leave it white and see no further than a word.
_DROPS_SPACE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WITHIN_WORDS = ("NFC", "Lowercase", "Replace")
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}

#: Words of Latin letters and perhaps a mark: letters that are composed already and have one lower-case letter each.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-įĲ-ķĹ-ňŊ-ž]+)([.,;:!?]?)")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in vocabularies of bytes: itself where it is visible, else one from 256 on."""
    out = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
    rest = [b for b in range(256) if b not in out]
    return out | {b: chr(256 + n) for n, b in enumerate(rest)}


def _about(vocabulary: str) -> dict:
    with open(vocabulary, encoding="utf-8") as file:
        return json.load(file)


def plain_by_model(about: dict) -> bool:
    """Whether the ids of ``_PLAIN`` words are those of the model, given the bytes of their letters in lower case and
    of their mark: after the pattern, bytes are all that is made of a word, and before it lower case."""
    first = about["normalizer"] or {}
    splits = about["pre_tokenizer"].get("pretokenizers", [])
    lowers = any(step["type"] == "Lowercase" for step in first.get("normalizers", [first]) if step)
    return lowers and len(splits) == 2 and {k: splits[1].get(k) for k in _BYTES} == _BYTES


def by_words(about: dict) -> bool:
    """Whether a tokenizer's ids of a text are those of its words between white space, one after the other.

    So it is if white space separates and is dropped: known of the pattern above, where normalizers work within words
    and no added token has white space in it or around it.
    """
    first = about["normalizer"] or {"type": "Sequence", "normalizers": []}
    steps = first.get("normalizers", [first])
    splits = about["pre_tokenizer"] or {}
    splits = splits.get("pretokenizers", [splits])
    return (
        all(s["type"] in _WITHIN_WORDS and (s["type"] != "Replace" or (s["pattern"], s["content"]) == ({"Regex": r"\s+"}, " ")) for s in steps)
        and splits[0].get("type") == "Split"
        and splits[0]["behavior"] == "Removed"
        and splits[0]["invert"]
        and splits[0]["pattern"] == {"Regex": _DROPS_SPACE}
        and not any(re.search(r"\s", t["content"]) or t["single_word"] for t in about["added_tokens"])
    )


class Encoder:
    """The ids of whole texts as the tokenizers library gives them, without added special tokens."""

    def __init__(self, vocabulary: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.type = np.uint16 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        about = _about(vocabulary)
        self.by_words = by_words(about)
        self.plain = self.by_words and plain_by_model(about)
        self.letters = _byte_letters()
        self.marks = {mark: self._library([mark])[0].tolist() for mark in ("", *".,;:!?")} if self.plain else {}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.sizes, self.used = np.zeros(1 << 16, self.type), np.zeros(1 << 16, np.int32), 0
        self.starts = np.zeros(1 << 16, np.int64)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        told = [e.ids for e in encode(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, told), np.int64, len(told))
        return np.fromiter(itertools.chain.from_iterable(told), self.type, int(sizes.sum())), sizes

    def _by_model(self, fresh: list[str]) -> tuple[list[str], list[list[int]], list[str]]:
        """The plain words among these with their ids, and the others. Words with equal letters are tokenized once."""
        near: dict[str, list[int]] = {}
        plain, told, rest = [], [], []
        tokenize = self.tokenizer.model.tokenize
        for word in fresh:
            found = _PLAIN.fullmatch(word)
            if found is None:
                rest.append(word)
                continue
            stem = found[1].lower()
            ids = near.get(stem)
            if ids is None:
                at = self.known.get(stem)
                if at is None:
                    body = stem if stem.isascii() else stem.encode().decode("latin-1").translate(self.letters)
                    ids = [token.id for token in tokenize(body)]
                else:
                    ids = self.flat[self.starts[at] : self.starts[at] + self.sizes[at]].tolist()
                near[stem] = ids
            plain.append(word)
            told.append(ids + self.marks[found[2]])
        return plain, told, rest

    def _learn(self, fresh: list[str]) -> None:
        if self.plain:
            plain, told, rest = self._by_model(fresh)
            sizes = np.fromiter(map(len, told), np.int64, len(told))
            flat = np.fromiter(itertools.chain.from_iterable(told), self.type, int(sizes.sum()))
            self._keep(plain, flat, sizes)
            fresh = rest
        if fresh:
            self._keep(fresh, *self._library(fresh))

    def _keep(self, fresh: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        at = len(self.known)
        self.known.update(zip(fresh, range(at, at + len(fresh))))
        while len(self.sizes) < len(self.known):
            self.sizes = np.concatenate((self.sizes, np.zeros_like(self.sizes)))
            self.starts = np.concatenate((self.starts, np.zeros_like(self.starts)))
        while len(self.flat) < self.used + len(flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.sizes[at : len(self.known)] = sizes
        self.starts[at : len(self.known)] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (no nulls), one after the other, and how many each has."""
        if not self.by_words:
            return self._library(texts.to_pylist())
        if len(self.known) > REMEMBERED:
            self._forget()
        split = pc.ascii_split_whitespace(texts)
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        found = split.flatten().dictionary_encode()
        distinct = found.dictionary.to_pylist()
        fresh = [w for w in distinct if w not in self.known]
        if fresh:
            self._learn(fresh)
        number = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[found.indices.to_numpy()]
        sizes = self.sizes[number].astype(np.int64)
        before = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.flat[np.repeat(self.starts[number] - before[:-1], sizes) + np.arange(before[-1])]
        bounds = np.concatenate(([0], np.cumsum(counts)))
        return ids, np.diff(before[bounds])


@lru_cache(maxsize=1)
def _encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    where = re.sub(r"^file:/*", "/", path)
    return (fs.LocalFileSystem(), where) if where.startswith("/") else fs.FileSystem.from_uri(path)


def file_schema(key: pa.DataType, ids: type, length: int) -> pa.Schema:
    document = pa.struct([("key", key), ("at", pa.int32())])
    return pa.schema(
        [
            pa.field("ids", pa.list_(pa.from_numpy_dtype(ids), length), nullable=False),
            pa.field("mask", pa.list_(pa.bool_(), length), nullable=False),
            pa.field("documents", pa.list_(document), nullable=False),
        ]
    )


class _Writer:
    """One file, written a batch of sequences at a time."""

    def __init__(self, path: str, key: pa.DataType, ids: type, length: int):
        self.schema, self.length, self.path = file_schema(key, ids, length), length, path
        system, where = _opened(path)
        self.sink = system.open_output_stream(where)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.keys: list[pa.Array] = []
        self.places: list[np.ndarray] = []  # of the held documents, in the file
        self.done = self.total = self.documents = 0

    def add(self, ids: np.ndarray, sizes: np.ndarray, keys: pa.Array) -> None:
        self.held.append(ids)
        self.keys.append(keys)
        self.places.append(self.total + np.cumsum(sizes) - sizes)
        self.total += len(ids)
        self.documents += len(sizes)
        whole = self.length * BATCH_SEQUENCES
        if self.total - self.done >= whole:
            self._write((self.total - self.done) // whole * BATCH_SEQUENCES)

    def _write(self, sequences: int) -> None:
        line = np.concatenate(self.held)
        keys, places = pa.concat_arrays(self.keys), np.concatenate(self.places)
        end = self.done + sequences * self.length
        now = int(np.searchsorted(places, end))
        ids = np.zeros(sequences * self.length, line.dtype)
        own = line[: len(ids)]
        ids[: len(own)] = own
        mask = np.arange(len(ids)) < len(own)
        offsets = np.searchsorted(places[:now], self.done + np.arange(sequences + 1) * self.length)
        at = pa.array((places[:now] - self.done) % self.length, pa.int32())
        kind = self.schema.field("documents").type.value_type
        documents = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([keys[:now], at], fields=list(kind)))
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length), documents]
        batch = pa.record_batch(arrays, schema=self.schema)
        for lo in range(0, sequences, BATCH_SEQUENCES):
            self.file.write_batch(batch.slice(lo, BATCH_SEQUENCES))
        self.held, self.keys, self.places = [line[len(own) :]], [keys[now:]], [places[now:]]
        self.done = min(end, self.total)

    def close(self) -> None:
        if self.total > self.done:
            self._write(-(-(self.total - self.done) // self.length))
        self.file.close()
        self.sink.close()


class TokenFile:
    """A file of sequences, read where it lies: opening it and taking a sequence copies no ids.

    ``file[n]`` is the n-th sequence, in numpy, and its mask, an Arrow array of bits, as views of the memory map (of a
    store that has none, of the one batch that is read).
    """

    def __init__(self, path: str):
        system, where = _opened(path)
        local = isinstance(system, fs.LocalFileSystem)
        self.reader = pa.ipc.open_file(pa.memory_map(where) if local else system.open_input_file(where))
        self.length = self.reader.schema.field("ids").type.list_size
        batches = self.reader.num_record_batches
        last = self.reader.get_batch(batches - 1).num_rows if batches else 0
        self.batches, self.sequences = batches, max(batches - 1, 0) * BATCH_SEQUENCES + last

    def __len__(self) -> int:
        return self.sequences

    def batch(self, n: int) -> tuple[np.ndarray, pa.BooleanArray, pa.Array]:
        """Of the n-th batch, the ids, a row for each sequence, the mask of all of them, and the documents that begin in each."""
        told = self.reader.get_batch(n)
        ids = told.column("ids").flatten().to_numpy().reshape(-1, self.length)
        return ids, told.column("mask").flatten(), told.column("documents")

    def __getitem__(self, n: int) -> tuple[np.ndarray, pa.BooleanArray]:
        if not 0 <= n < self.sequences:
            raise IndexError(n)
        ids, mask, _ = self.batch(n // BATCH_SEQUENCES)
        return ids[n % BATCH_SEQUENCES], mask.slice(n % BATCH_SEQUENCES * self.length, self.length)

    def documents(self) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """All documents in order, in blocks: keys, first ids' places in the file, and their ids in one array, which
        begins at the first one's place. Holds a batch and what is left of the document before it."""
        keys, places, rest, at = None, np.zeros(0, np.int64), np.zeros(0), 0
        for n in range(self.batches):
            ids, mask, documents = self.batch(n)
            line = ids.reshape(-1)
            if n == self.batches - 1:
                line = line[: mask.true_count]
            flat, counts = documents.flatten(), np.diff(documents.offsets.to_numpy())
            base = n * BATCH_SEQUENCES * self.length
            own = base + np.repeat(np.arange(len(ids)), counts) * self.length + flat.field("at").to_numpy()
            keys = flat.field("key") if keys is None else pa.concat_arrays([keys, flat.field("key")])
            places = np.concatenate((places, own))
            line = np.concatenate((rest, line)) if len(rest) else line
            if len(places) > 1:  # all but the last are whole
                yield keys[:-1], places[:-1], line[: places[-1] - at]
                rest, at = line[places[-1] - at :], int(places[-1])
                keys, places = keys[-1:], places[-1:]
            else:
                rest = line
        if len(places):
            yield keys, places, rest


_FILES = "part int, path string, n_documents bigint, n_tokens bigint, n_sequences bigint"


def write_files(df: DataFrame, key: str, text: str, vocabulary: str, end_id: int, length: int = LENGTH, folder: str | None = None) -> DataFrame:
    """Writes the files and returns a row for each, in order of the key: ``part``, ``path``, ``n_documents``,
    ``n_tokens`` and ``n_sequences``.

    ``vocabulary`` is a ``.json`` file of the tokenizers library that every executor has. A text's ids are the
    library's, without added special tokens, and ``end_id`` after them. A null or empty text has the end id only. Rows
    without a key come first; rows that share one are in order of their checksum and length, so equal rows may change
    places but never the line. An empty table has no files. Other columns are not read. ``folder`` (new) is on a file
    system that all executors share and pyarrow knows; unless given, it is one in ``spark.checkpoint.dir``.

    Each text is moved once, to its range of the key, and is tokenized and written there; a task holds one batch of
    texts and of sequences, however many rows its range has.
    """
    session = df.sparkSession
    bounded_batches(session)
    folder = folder or f"{shared_folder(session)}/tokens-{uuid.uuid4().hex}"
    system, where = _opened(folder)
    system.create_dir(where, recursive=True)
    rows = df.select(column(key).alias("k"), F.coalesce(column(text), F.lit("")).alias("t"))
    order = ("k", F.crc32(F.col("t").cast("binary")), F.length("t"))
    parts = int(session.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, encoder = None, _encoder(vocabulary)
        part = TaskContext.get().partitionId()
        for batch in batches:
            offsets = words.raw(batch.column("t"))[1]
            for lo, hi in words.chunks(offsets, CHUNK_BYTES):
                ids, sizes = encoder.encode(batch.column("t")[lo:hi])
                line = np.insert(ids, np.cumsum(sizes), encoder.type(end_id))
                if out is None:
                    path = f"{folder}/part-{part:06d}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}.arrow"
                    out = _Writer(path, batch.schema.field("k").type, encoder.type, length)
                out.add(line, sizes + 1, batch.column("k")[lo:hi])
        if out is not None:
            out.close()
            told = [[part], [out.path], [out.documents], [out.total], [-(-out.total // length)]]
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(v, k) for v, k in zip(told, kinds)], names=["part", "path", "n_documents", "n_tokens", "n_sequences"])

    return written(dealt.mapInArrow(write, _FILES))


def _read(files: DataFrame, key_type: str, kinds: str, of: Callable[[pa.Array, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch]) -> DataFrame:
    """``of`` gets keys, starts, sizes and ids of a block of documents. One file at a time in a task."""
    session = files.sparkSession
    # A row for each file, that is, for each partition that wrote one: the ids before a file are those of the files before.
    told, before = [], 0
    for row in sorted(files.select("part", "path", "n_tokens").collect()):
        told.append((row.path, before))
        before += row.n_tokens
    listed = session.createDataFrame(told, "path string, base bigint").repartition(max(1, len(told)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                for keys, places, ids in TokenFile(path).documents():
                    yield of(keys, base + places, np.diff(np.append(places, places[0] + len(ids))), ids)

    return listed.mapInArrow(read, f"k {key_type}, start bigint, n_tokens bigint, {kinds}")


def read_documents(files: DataFrame, key: str, key_type: str) -> DataFrame:
    """Every document of the files: its key, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids``."""

    def block(keys, starts, sizes, ids):
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(ids.astype(np.int32)))
        return pa.record_batch([keys, pa.array(starts), pa.array(sizes), lists], names=["k", "start", "n_tokens", "ids"])

    return _read(files, key_type, "ids array<int>", block).withColumnRenamed("k", key)


def read_checksums(files: DataFrame, key: str, key_type: str) -> DataFrame:
    """As :func:`read_documents`, with ``ids_crc32`` (of the ids as little-endian unsigned 32-bit integers) for ``ids``."""

    def block(keys, starts, sizes, ids):
        wide = memoryview(ids.astype("<u4")).cast("B")
        ends = 4 * np.cumsum(sizes)
        sums = [zlib.crc32(wide[a:b]) for a, b in zip((ends - 4 * sizes).tolist(), ends.tolist())]
        return pa.record_batch([keys, pa.array(starts), pa.array(sizes), pa.array(sums, pa.int64())], names=["k", "start", "n_tokens", "ids_crc32"])

    return _read(files, key_type, "ids_crc32 bigint", block).withColumnRenamed("k", key)
