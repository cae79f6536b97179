"""Encoding of a text column with a public byte-level BPE vocabulary.

Merging is the textbook one: the symbols of a word form a doubly linked list, adjacent pairs wait in a priority queue ordered
by merge rank and position, and entries whose symbols have changed since are skipped. Words repeat, so each task keeps the ids
of the pieces it has met (at most ``CACHE`` of them; the cache is emptied beyond that, which changes no result).
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed value: the pattern that splits text before the merges of the public rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHE = 400_000
LONGEST_CACHED = 80


def merge(symbols: list[int], ranks: dict[tuple[int, int], int]) -> list[int]:
    """Ids of one word, from the ids of its bytes. ``ranks`` gives the merged id of a pair; a lower id merges first."""
    n = len(symbols)
    if n < 2:
        return symbols
    sym, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    queue = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := ranks.get((sym[i], sym[i + 1]))) is not None]
    heapq.heapify(queue)
    while queue:
        new, i, a, b = heapq.heappop(queue)
        j = after[i]
        if sym[i] != a or j >= n or sym[j] != b:
            continue  # stale: one of both has been merged since
        sym[i], sym[j] = new, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get((new, sym[k]))) is not None:
                heapq.heappush(queue, (r, i, new, sym[k]))
        h = before[i]
        if h >= 0 and (r := ranks.get((sym[h], new))) is not None:
            heapq.heappush(queue, (r, h, sym[h], new))
    return [s for s in sym if s >= 0]


class _Odd(Exception):
    """A piece that touches more white space than the one blank before it."""


class _Pieces(dict):
    """Packed ids of pieces of text, each with ``lead`` before it; a missing one is encoded and, if short, kept."""

    def __init__(self, bpe: ByteBpe, lead: str, strict: bool):
        super().__init__()
        self.bpe, self.lead, self.strict = bpe, lead, strict

    def __missing__(self, piece: str) -> bytes:
        if self.strict and (not piece or self.bpe.white.match(piece[0]) or self.bpe.white.match(piece[-1])):
            raise _Odd
        ids = np.array(self.bpe.plain(self.lead + piece), np.int32).tobytes()
        if len(piece) <= LONGEST_CACHED:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids


class _Words(dict):
    """Ids of words between the cuts of the pattern."""

    def __init__(self, bpe: ByteBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> list[int]:
        raw = word.encode()
        whole = self.bpe.id_of.get(raw)
        ids = [whole] if whole is not None else merge([self.bpe.byte_ids[b] for b in raw], self.bpe.ranks)
        if len(word) <= LONGEST_CACHED:
            if len(self) >= CACHE:
                self.clear()
            self[word] = ids
        return ids


class ByteBpe:
    """A byte-level BPE of a rank file (one base64 token and its rank a line)."""

    def __init__(self, rank_file: bytes):
        self.id_of = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line.strip())}
        self.bytes_of = {i: t for t, i in self.id_of.items()}
        self.byte_ids = [self.id_of[bytes([b])] for b in range(256)]
        self.split = regex.compile(PATTERN)
        self.white = regex.compile(r"\s")
        self.single = regex.compile(r"(?<=\S) (?=\S)")
        self.ranks = _PairRanks(self.id_of, self.bytes_of)
        self.words = _Words(self)
        self.strict = _Pieces(self, "", True), _Pieces(self, " ", True)
        self.loose = _Pieces(self, "", False), _Pieces(self, " ", False)

    def plain(self, text: str) -> list[int]:
        """Ids of ``text`` without cutting it into pieces first."""
        return [i for word in self.split.findall(text) for i in self.words[word]]

    def packed(self, text: str | None) -> bytes:
        """Ids as packed 32-bit integers.

        A blank between two characters that are no white space always starts a new word of the pattern, so text may be cut there
        and each piece encoded alone. Text with other white space beside a blank takes a slower cut at just those blanks.
        """
        if not text:
            return b""
        try:
            (first, rest), (head, *tail) = self.strict, text.split(" ")
            return first[head] + b"".join(map(rest.__getitem__, tail))
        except _Odd:
            (first, rest), (head, *tail) = self.loose, self.single.split(text)
            return first[head] + b"".join(map(rest.__getitem__, tail))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        """Concatenates the vocabulary's byte strings."""
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


class _PairRanks(dict):
    """Merged id of a pair of ids, None if there is none; filled as pairs come up."""

    def __init__(self, id_of: dict[bytes, int], bytes_of: dict[int, bytes]):
        super().__init__()
        self.id_of, self.bytes_of = id_of, bytes_of

    def get(self, pair: tuple[int, int], default: None = None) -> int | None:  # type: ignore[override]
        try:
            return self[pair]
        except KeyError:
            r = self.id_of.get(self.bytes_of[pair[0]] + self.bytes_of[pair[1]])
            if len(self) < CACHE:
                self[pair] = r
            return r


_loaded: dict[int, ByteBpe] = {}


def loaded(rank_file: bytes) -> ByteBpe:
    """One tokenizer a Python worker."""
    key = hash(rank_file)
    if key not in _loaded:
        _loaded[key] = ByteBpe(rank_file)
    return _loaded[key]


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", vocab: str = VOCAB) -> DataFrame:
    """``key`` and ``ids`` (array of int) of every row; empty and null text give an empty list, rows are neither lost nor merged.

    ``vocab`` is a rank file; its bytes (under 1 MB) go to the tasks once. Other columns of ``df`` are not read.
    """
    shipped = df.sparkSession.sparkContext.broadcast(open(vocab, "rb").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(shipped.value)
        for batch in batches:
            packed = [bpe.packed(t) for t in batch.column(1).to_pylist()]
            ends = np.zeros(len(packed) + 1, np.int32)
            np.cumsum([len(p) // 4 for p in packed], out=ends[1:])
            flat = pa.array(np.frombuffer(b"".join(packed), np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["_key", "ids"])

    two = df.select(df[key].alias("_key"), df[text].alias("_text"))
    schema = T.StructType([T.StructField("_key", two.schema[0].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return two.mapInArrow(run, schema).withColumnRenamed("_key", key)


def token_counts(df: DataFrame, text: str = "text", vocab: str = VOCAB) -> DataFrame:
    """The columns of ``df`` without ``text``, and ``n_tokens`` (0 for null and empty text)."""
    shipped = df.sparkSession.sparkContext.broadcast(open(vocab, "rb").read())
    keep = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(shipped.value)
        for batch in batches:
            n = pa.array([len(bpe.packed(t)) // 4 for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=[*keep, "n_tokens"])

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("n_tokens", T.LongType())])
    return df.select(*keep, text).mapInArrow(run, schema)


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", vocab: str = VOCAB) -> DataFrame:
    """``key``, ``n_tokens`` and ``same``: whether decoding the ids gives the text again (null counts as empty)."""
    shipped = df.sparkSession.sparkContext.broadcast(open(vocab, "rb").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(shipped.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = [bpe.encode(t) for t in texts]
            same = [bpe.decode(i) == t for i, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array(same)], names=["_key", "n_tokens", "same"])

    two = df.select(df[key].alias("_key"), df[text].alias("_text"))
    schema = T.StructType([T.StructField("_key", two.schema[0].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("same", T.BooleanType())])
    return two.mapInArrow(run, schema).withColumnRenamed("_key", key)
