"""Near-duplicate records by anchor-point covering.

A record's fingerprint is a vector of symbols (weighted minima over its words; rare words weigh more), so that similar records agree in
most symbols whatever the order of their words. Symbols come in tables of k + 1. The anchors of a table are the words of the
single-parity-check code over the integers modulo ``PRIME``: a covering code of radius 1, as any vector becomes a code word by
changing one symbol. Each fingerprint is replicated to all k + 1 anchors within that radius. Two fingerprints of a distance up to the
threshold 1 then share an anchor, the one both become by changing the symbol they differ in; had a fingerprint only gone to one home
anchor, the other would have to go out to radius plus threshold. At an anchor all pairs are compared by the true lower bound
of ``wordbits``, which loses none; what it leaves is checked exactly on its words.

The length of the code follows the number of records (``code_length``), so that an anchor's neighbourhood does not grow with the
data; the number of tables follows from the length (``tables``), so that a pair at the very limit of similarity meets with a
probability of ``1 - MISS``. Above the limit pairs meet all but surely; ``tests/llm`` measures it against brute force.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.components import connected_components
from quern.llm.wordbits import BUCKETS, LONGS, Hashes, Words, fold, may_be_similar, possible, word_counts
from quern.session import dropped, salted_lookup, written

PRIME = 65_537  # symbols are numbers below 2**16
AGREE = 0.58  # share of symbols in which texts at the limit of similarity agree; 0.63 on average, less in some pairs
MISS = 0.002
ROOMY = 2**18  # records up to which the shortest code is long enough; each further symbol serves eight times as many
RARITY = 1.0
SEED = 11
BUCKET_ROWS = 100_000
CELL_ROWS = 400_000
LAGS = 64
SIMILAR = 0.75


def code_length(records: int) -> int:
    """Symbols k of a table in which two records must agree (of k + 1)."""
    return 2 + max(0, math.ceil(math.log(max(1, records) / ROOMY, 8)))


def tables(k: int) -> int:
    """Tables after which a pair that agrees in each symbol with probability ``AGREE`` has met at no anchor with probability ``MISS``."""
    meet = (k + 1) * AGREE**k * (1 - AGREE) + AGREE ** (k + 1)
    return math.ceil(math.log(MISS) / math.log(1 - meet))


class Fingerprints:
    """Symbols of texts: for each symbol the word number with the least exponential variate, sped up by its weight (rare words weigh more)."""

    def __init__(self, counts: np.ndarray, records: int, symbols: int, seed: int = SEED) -> None:
        weight = np.maximum(np.log1p(records / np.maximum(counts, 1)) ** RARITY, 1e-3)
        score = (np.random.default_rng(seed).exponential(size=(BUCKETS, symbols)) / weight[:, None]).astype(np.float32)
        self.score = score.view(np.uint32).astype(np.uint64) << np.uint64(16) | np.arange(BUCKETS, dtype=np.uint64)[:, None]  # positive floats order as their bits do

    def of(self, numbers: np.ndarray, count: np.ndarray, step: int = 500) -> np.ndarray:
        """A row of symbols for each text (of one word or more); ``numbers`` holds the words of all, one text after the other."""
        edges = np.r_[0, np.cumsum(count)]
        out = np.empty((len(count), self.score.shape[1]), np.uint16)
        for i in range(0, len(count), step):
            at = edges[i : min(i + step, len(count)) + 1]
            out[i : i + step] = np.minimum.reduceat(self.score[numbers[at[0] : at[-1]]], at[:-1] - at[0], axis=0).astype(np.uint16)
        return out


def anchors(symbols: np.ndarray, k: int) -> np.ndarray:
    """Names of the code words within radius 1 of each row's tables (tables of k + 1 symbols each), tables x (k + 1) of them a row.

    Changing symbol i so that all add up to 0 gives the code word; it is named by a hash of its symbols and its table.
    """
    t = symbols.reshape(len(symbols), -1, k + 1).astype(np.uint64)
    change = (np.uint64(PRIME) - t.sum(2, dtype=np.uint64) % np.uint64(PRIME)) % np.uint64(PRIME)
    mixer = np.random.default_rng(SEED).integers(1, 2**63, (t.shape[1], k + 1), dtype=np.uint64) | np.uint64(1)
    whole = (t * mixer).sum(2, dtype=np.uint64)  # modulo 2**64, as are all names
    moved = (t + change[:, :, None]) % np.uint64(PRIME)
    names = whole[:, :, None] - t * mixer + moved * mixer + mixer[:, :1]
    names = (names ^ (names >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (names ^ (names >> np.uint64(32))).reshape(len(symbols), -1).astype(np.int64)


def fingerprinted(df: DataFrame, key: str, fields: list[str], counts: np.ndarray, records: int, symbols: int) -> DataFrame:
    """``<key>, class, bits, symbols`` of each record with all ``fields``; others have no row.

    ``class`` is a 128-bit digest of each field's words whatever their order; ``bits`` holds for each field its parities and number of words.
    """
    shipped = df.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, hashes = Fingerprints(shipped.value, records, symbols), [Hashes(i) for i in range(len(fields))]
        for b in batches:
            words = [Words(c.to_pylist(), h) for c, h in zip(b.columns[1:], hashes)]
            whole = np.logical_and.reduce([w.count > 0 for w in words])
            at = np.flatnonzero(whole)
            if not len(at):
                continue
            digest = np.concatenate([w.sums() for w in words], axis=1)[at]
            bits = np.concatenate([np.concatenate([w.parities(), w.count[:, None].astype(np.uint64)], axis=1) for w in words], axis=1)[at]
            owner = np.concatenate([w.owner for w in words])
            order = np.argsort(owner, kind="stable")
            order = order[whole[owner[order]]]
            own = prints.of(np.concatenate([w.number for w in words])[order], sum(w.count for w in words)[at])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *(pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary()) for x in (digest, bits, own))], names=["_key", "class", "bits", "symbols"])

    some = df.select(df[key].alias("_key"), *fields)
    schema = T.StructType([T.StructField("_key", some.schema[0].dataType), *(T.StructField(c, T.BinaryType()) for c in ("class", "bits", "symbols"))])
    return some.mapInArrow(run, schema).withColumnRenamed("_key", key)


def replicated(prints: DataFrame, key: str, k: int) -> DataFrame:
    """A row ``anchor, _key, bits`` for each anchor of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            own = anchors(np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint16).reshape(b.num_rows, -1), k)
            at = pa.array(np.repeat(np.arange(b.num_rows), own.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(own.ravel()), b.column(0).take(at), b.column(1).take(at)], names=["anchor", "_key", "bits"])

    some = prints.select(prints[key].alias("_key"), "bits", "symbols")
    schema = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("_key", some.schema[0].dataType), T.StructField("bits", T.BinaryType())])
    return some.mapInArrow(run, schema)


def met(names: np.ndarray, sides: np.ndarray, rows: np.ndarray, fields: int, similar: float, cross: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row numbers at one anchor that may be similar in all fields; with ``cross`` only pairs of both ``sides``.

    Short runs of an anchor are compared at lag 1, 2, ... at once for all of them, long ones block by block.
    """
    order = np.argsort(names, kind="stable")
    starts = np.flatnonzero(np.r_[True, names[order][1:] != names[order][:-1]]) if len(order) else np.zeros(0, np.int64)
    length = np.diff(np.r_[starts, len(order)])
    width = LONGS + 1
    field = lambda at, f: (rows[at, f * width : f * width + LONGS], rows[at, f * width + LONGS].astype(np.int64))
    left = np.repeat(starts + length, length) - np.arange(len(order)) - 1  # rows of the run after this one
    left[np.repeat(length > LAGS, length)] = 0
    at = np.flatnonzero(left > 0)
    lag = 1
    while len(at):
        p, q = order[at], order[at + lag]
        if cross:
            differ = sides[p] != sides[q]
            p, q = p[differ], q[differ]
        for f in range(fields):
            keep = may_be_similar(*field(p, f), *field(q, f), similar)
            p, q = p[keep], q[keep]
        if len(p):
            yield p, q
        lag += 1
        at = at[left[at] >= lag]
    for s, n in zip(starts[length > LAGS].tolist(), length[length > LAGS].tolist()):
        run = order[s : s + n]
        x, y = (run[sides[run] == v] for v in (0, 1)) if cross else (run, run)
        if len(x) and len(y):
            part = lambda at: [(np.ascontiguousarray(b), n) for b, n in (field(at, f) for f in range(fields))]
            for p, q in possible(part(x), part(y), similar, not cross):
                yield x[p], y[q]


def candidates(prints: DataFrame, key: str, fields: int, k: int, similar: float = SIMILAR) -> DataFrame:
    """Distinct pairs ``a`` < ``b`` of rows of :func:`fingerprinted` that meet at an anchor and may be similar in every field.

    Anchors are dealt into buckets of about ``BUCKET_ROWS`` rows. A bucket that a hot anchor swells beyond ``CELL_ROWS`` is cut into
    sides by the records' keys, and each pair of sides is one cell, so that no task holds more than about two sides.
    """
    copies = written(replicated(prints, key, k), "anchors")
    buckets = max(1, math.ceil(copies.count() / BUCKET_ROWS))
    rows = copies.withColumn("bucket", F.pmod("anchor", F.lit(buckets)).cast("int"))
    hot = rows.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("parts")).where("parts > 1")
    rows = rows.join(F.broadcast(hot), "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))  # a hundred-thousandth of the rows at most
    rows = rows.withColumn("part", F.pmod(F.xxhash64("_key"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = ["bucket", F.least("part", "other").alias("first"), F.greatest("part", "other").alias("second")]
    rows = rows.select(*cell, "part", "anchor", "_key", "bits")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        first, second = t.column("first")[0].as_py(), t.column("second")[0].as_py()
        keys = t.column("_key").combine_chunks()
        bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(-1, fields * (LONGS + 1))
        sides = (t.column("part").to_numpy() == second).astype(np.int8)
        found = list(met(t.column("anchor").to_numpy(), sides, bits, fields, similar, first != second))
        p, q = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else ((), ())))
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(p)), keys.take(pa.array(q))], names=["a", "b"])

    kind = prints.schema[key].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    pairs = rows.groupBy("bucket", "first", "second").applyInArrow(compare, schema)
    out = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "candidates")
    dropped(copies)
    return out


def common_share(x: list[str], y: list[str]) -> float:
    """Share of the longer text's words that occur in the other too, repeats counted."""
    longer = max(len(x), len(y))
    return sum((Counter(x) & Counter(y)).values()) / longer


def similar_in_all(a: list[str], b: list[str], least: float) -> Column:
    """Whether two texts are similar in each of the columns ``a`` against ``b``."""

    def same(x: str | None, y: str | None) -> bool:
        p, q = fold(x), fold(y)
        return bool(p and q) and min(len(p), len(q)) >= least * max(len(p), len(q)) and common_share(p, q) >= least

    def run(*cols: pd.Series) -> pd.Series:
        half = len(cols) // 2
        return pd.Series([all(same(row[i], row[half + i]) for i in range(half)) for row in zip(*cols)], dtype=bool)

    return F.pandas_udf(run, "boolean")(*a, *b)


def verified(pairs: DataFrame, df: DataFrame, key: str, fields: list[str], similar: float, ends: tuple[str, str] = ("a", "b")) -> DataFrame:
    """The rows of ``pairs`` whose two records are similar in every field, by their words; only texts of candidates are moved."""
    x, y = ends
    ids = pairs.select(F.col(x).alias("_id")).unionByName(pairs.select(F.col(y).alias("_id"))).distinct()
    n = range(len(fields))
    some = df.select(F.col(key).alias("_id"), *(F.col(f).alias(f"_{i}") for i, f in enumerate(fields))).join(ids, "_id", "left_semi")
    left = some.select(F.col("_id").alias(x), *(F.col(f"_{i}").alias(f"_a{i}") for i in n))
    right = some.select(F.col("_id").alias(y), *(F.col(f"_{i}").alias(f"_b{i}") for i in n))
    both = pairs.join(left, x).join(right, y)
    return both.where(similar_in_all([f"_a{i}" for i in n], [f"_b{i}" for i in n], similar)).select(*pairs.columns)


def near_duplicates(df: DataFrame, key: str, fields: list[str], similar: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(members, links): ``<key>, rep``, each record's class of equal words, and the pairs ``a`` < ``b`` of classes similar in every field.

    Similar means that of the longer text's words at least ``similar`` occur in the other. Records with a null or blank field match
    nothing and are in neither; text without letters or digits equals only itself. ``rep`` is the smallest key of a class, which may hold
    any share of all records, as only keys are grouped. A repeated key stands for all its rows.
    """
    counts, records = word_counts(df, fields)
    k = code_length(records)
    prints = written(fingerprinted(df, key, fields, counts, records, tables(k) * (k + 1)), "prints")
    reps = prints.groupBy("class").agg(F.min(key).alias("rep"), F.any_value("bits").alias("bits"), F.any_value("symbols").alias("symbols"))
    reps = written(reps, "classes")
    members = written(salted_lookup(prints.select(key, "class"), reps.select("class", "rep"), "class", key, how="inner").select(key, "rep").distinct(), "members")
    dropped(prints)
    pairs = candidates(reps, "rep", len(fields), k, similar)
    dropped(reps)
    links = verified(pairs, df, key, fields, similar)
    return members, written(links.distinct(), "links")


def duplicate_pairs(members: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """All pairs of records, ``<key>_a`` < ``<key>_b``, in linked or equal classes."""
    a = members.select(F.col("rep").alias("a"), F.col(key).alias("x"))
    b = members.select(F.col("rep").alias("b"), F.col(key).alias("y"))
    linked = links.join(a, "a").join(b, "b").select("x", "y")
    several = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("rep").alias("a"))
    equal = a.join(several, "a", "left_semi").join(b, F.col("a") == F.col("b")).where("x < y").select("x", "y")
    return linked.unionByName(equal).select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))


def duplicate_groups(members: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """``<key>``, ``rep`` (its class of equal texts), ``group`` (smallest record of all that links reach) and ``links`` of the class."""
    parts = connected_components(links, "a", "b").select(F.col("node").alias("rep"), F.col("component").alias("group"))
    ends = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    known = parts.join(ends, "rep", "left")
    out = members.join(known, "rep", "left")
    return out.select(key, "rep", F.coalesce("group", "rep").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))
