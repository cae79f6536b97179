"""Words of a text as numbers, and a true lower bound of the word-count difference of two texts.

Every word has one of ``BUCKETS`` hashed numbers. A text's bits tell for each of ``BITS`` groups of numbers whether it holds an odd
number of words. Where two texts' bits differ, their word counts differ by at least one, so the number of differing bits never
exceeds the sum of absolute differences of their word counts; of two texts of n and m words with c in common that sum is
n + m - 2 c. A pair with more differing bits than similarity allows cannot be similar, whatever its words, lengths and order.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 2**16
BITS = 256
LONGS = BITS // 64
CHUNK = (64, 2048)

_WORD = re.compile(r"[^\W_]+")
_ASCII = {i: chr(i) if chr(i).isalnum() else " " for i in range(128)}  # the same words as the pattern's where a text is plain ASCII


def fold(text: str | None) -> list[str] | None:
    """The words (runs of letters or digits) in lower case; text without any stands for itself as one word, null and blank text is None."""
    if not text:
        return None
    low = text.lower()
    found = low.translate(_ASCII).split() if low.isascii() else _WORD.findall(low)
    if found:
        return found
    if all(c.isspace() or unicodedata.category(c) in ("Cf", "Zs", "Zl", "Zp") for c in text):
        return None
    return [text.strip()]


class Hashes(dict):
    """A 64-bit hash of each word met; emptied beyond ``most`` words, which bounds a worker's memory and changes no result."""

    def __init__(self, salt: int = 0, most: int = 500_000) -> None:
        super().__init__()
        self.salt, self.most = salt.to_bytes(8, "little"), most

    def __missing__(self, word: str) -> int:
        if len(self) > self.most:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8, salt=self.salt).digest(), "little")
        return h


class Words:
    """The words of a batch of texts: ``hash`` and ``number`` of each, one text after the other, and each text's ``count`` (0 if it has none)."""

    def __init__(self, texts: list[str | None], hashes: Hashes) -> None:
        folded = [fold(t) or () for t in texts]
        self.count = np.fromiter(map(len, folded), np.int64, len(folded))
        self.hash = np.fromiter(map(hashes.__getitem__, chain.from_iterable(folded)), np.uint64, int(self.count.sum()))
        self.number = (self.hash >> np.uint64(48)).astype(np.int64)
        self.owner = np.repeat(np.arange(len(folded)), self.count)

    def sums(self) -> np.ndarray:
        """Two 64-bit sums of the words' mixed hashes for each text: equal for the same words in any order."""
        out = np.zeros((len(self.count), 2), np.uint64)
        some = np.flatnonzero(self.count)
        if len(some):
            starts = np.r_[0, np.cumsum(self.count)[:-1]][some]
            for i, odd in enumerate((0xBF58476D1CE4E5B9, 0x94D049BB133111EB)):
                mixed = (self.hash ^ (self.hash >> np.uint64(29 + i))) * np.uint64(odd)
                out[some, i] = np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), starts)
        return out

    def parities(self) -> np.ndarray:
        """``LONGS`` words of 64 bits for each text: which of the ``BITS`` groups hold an odd number of its words."""
        odd = np.bincount(self.owner * BITS + (self.number >> 8), minlength=len(self.count) * BITS) & 1
        return np.packbits(odd.astype(np.uint8).reshape(-1, BITS), axis=1).view(np.uint64)


def word_counts(df: DataFrame, fields: list[str]) -> tuple[np.ndarray, int]:
    """(occurrences of the words of each number over all texts, number of records); the fields number their words each in its own way.

    Each task counts into one array; ``BUCKETS`` rows at most come to the driver, whatever the size of the data.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = [Hashes(i) for i in range(len(fields))]
        seen, rows = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for c, h in zip(b.columns, hashes):
                seen += np.bincount(Words(c.to_pylist(), h).number, minlength=BUCKETS)
            rows += b.num_rows
        at = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], rows))], names=["b", "n"])

    sums = df.select(*fields).mapInArrow(run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toPandas()
    at, n = sums["b"].to_numpy(np.int64), sums["n"].to_numpy(np.int64)
    counts = np.zeros(BUCKETS, np.int64)
    counts[at[at >= 0]] = n[at >= 0]
    return counts, int(n[at < 0].sum())


def may_be_similar(xb: np.ndarray, xn: np.ndarray, yb: np.ndarray, yn: np.ndarray, similar: float) -> np.ndarray:
    """Row by row: whether two texts of ``xn`` and ``yn`` words (bits ``xb``, ``yb``) may be similar."""
    u, v = xn.astype(np.int64), yn.astype(np.int64)
    shorter, longer = np.minimum(u, v), np.maximum(u, v)
    return (shorter >= similar * longer - 1e-6) & (np.bitwise_count(xb ^ yb).sum(1, dtype=np.int64) <= _most(shorter, longer, similar))


def possible(x: list[tuple[np.ndarray, np.ndarray]], y: list[tuple[np.ndarray, np.ndarray]], similar: float, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all pairs of ``x`` and ``y`` that may be similar in every field; each side has (bits, number of words) of its fields.

    ``same``: both are one block, and each pair comes once. Rows are compared in the order of the first field's length, so that one limit
    serves a whole chunk.
    """
    (xb, xn), (yb, yn) = x[0], y[0]
    xo, yo = np.argsort(xn, kind="stable"), np.argsort(yn, kind="stable")
    left, right = np.ascontiguousarray(xb[xo].T), np.ascontiguousarray(yb[yo].T)
    xs, ys = xn[xo].astype(np.int64), yn[yo].astype(np.int64)
    for i in range(0, len(xs), CHUNK[0]):
        n = xs[i : i + CHUNK[0]]
        for j in range(i if same else 0, len(ys), CHUNK[1]):
            m = ys[j : j + CHUNK[1]]
            shorter, longer = min(n[-1], m[-1]), max(n[0], m[0])
            if shorter < similar * longer:
                continue
            limit = int(_most(shorter, longer, similar))
            a, b = left[:, i : i + CHUNK[0], None], right[:, None, j : j + CHUNK[1]]
            apart = np.bitwise_count(a[0] ^ b[0])
            for k in range(1, LONGS - 1):
                apart += np.bitwise_count(a[k] ^ b[k])
            last = np.bitwise_count(a[-1] ^ b[-1])  # the sum of all would not fit in a byte if every bit differs
            at = np.flatnonzero(apart <= limit - last.astype(np.int16)) if limit >= 255 - 64 else np.flatnonzero(apart + last <= limit)
            p, q = xo[i + at // len(m)], yo[j + at % len(m)]
            if same:
                p, q = (v[i + at // len(m) < j + at % len(m)] for v in (p, q))
            for (fb, fn), (gb, gn) in zip(x, y):
                keep = may_be_similar(fb[p], fn[p], gb[q], gn[q], similar)
                p, q = p[keep], q[keep]
            if len(p):
                yield p, q


def _most(shorter, longer, similar: float):
    """Of texts of so many words, the largest sum of count differences at which at least ``similar`` of the longer one's words are shared."""
    return shorter + longer - 2 * similar * longer + 1e-6
