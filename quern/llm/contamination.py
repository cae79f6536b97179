"""Records of evaluation splits that occur again, exactly or almost, in the training split.

Texts are normalised to an order of their words that does not depend on the order in the text: rarest first, ties by the word's number.
The passages of an evaluation text are its pairs of neighbours in that order, with a mark at both ends. An Aho-Corasick automaton
over the passages of one shard of evaluation texts scans the normalised training texts of the same entity; the intervals it matches
are merged into the coverage of each evaluation text.

No similar pair is lost, whatever its order, edits and length: two sorted texts of n and m words with c in common, of which one
has n + 1 passages, lose at most two passages for each of its n - c words that are missing and one for each of the m - c words that
are new, so at least 3 c - n - m + 1 survive (``surviving``), which is above m / 4 where c is three quarters of the longer. Pairs
with fewer hits are dropped, all others are checked exactly on their words. The commonest passages of a text, up to half of that
number, are left out of the automaton and of the number of hits needed, which spares the longest lists.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.neardup import SIMILAR, verified
from quern.llm.wordbits import Hashes, Words, word_counts
from quern.session import dropped, salted_lookup, written

SHARD = 20_000  # evaluation texts whose passages make one automaton
BLOCK = 100_000  # training texts in one task at most; an entity with fewer is dealt into up to SPREAD blocks of LEAST texts or more
SPREAD, LEAST = 16, 4_096
START, END, FIRST = 1, 2, 0x10000  # characters: the marks, and the rarest word


def surviving(n: int, m: int, similar: float = SIMILAR) -> int:
    """Passages of a text of ``n`` words that a similar text of ``m`` words holds at least."""
    return 3 * math.ceil(similar * max(n, m) - 1e-9) - n - m + 1


def normalised(ranks: np.ndarray) -> str:
    """A sorted text as characters, one a word, between the marks."""
    c = np.empty(len(ranks) + 2, np.uint32)
    c[0], c[-1] = START, END
    c[1:-1] = ranks.astype(np.uint32) + FIRST
    return c.tobytes().decode("utf-32-le")


class Shard:
    """Evaluation texts (sorted word ranks) and the automaton of their passages."""

    def __init__(self, texts: list[np.ndarray], similar: float = SIMILAR) -> None:
        self.similar, self.texts = similar, [normalised(t) for t in texts]
        self.n = np.array([len(t) for t in texts], np.int64)
        codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int64) for t in self.texts]
        pairs = np.concatenate([(c[:-1] << 32) | c[1:] for c in codes])
        owner = np.repeat(np.arange(len(texts)), self.n + 1)
        known, passage, often = np.unique(pairs, return_inverse=True, return_counts=True)
        self.spared = np.maximum(0, np.floor(((3 * similar - 2) * self.n + 1) / 2)).astype(np.int64)  # half of the least number that survives, whatever the other text
        order = np.lexsort((-often[passage], owner))  # the commonest of each text first
        place = np.arange(len(order)) - np.repeat(np.r_[0, np.cumsum(self.n + 1)[:-1]], self.n + 1)
        kept = order[place >= self.spared[owner[order]]]
        kept = kept[np.argsort(passage[kept], kind="stable")]
        self.owners, of = owner[kept], passage[kept]
        self.starts = np.searchsorted(of, np.arange(len(known) + 1))
        self.automaton = ahocorasick.Automaton()
        for i in np.unique(of).tolist():
            self.automaton.add_word(chr(known[i] >> 32) + chr(known[i] & 0xFFFFFFFF), i)
        self.automaton.make_automaton()

        self.bits = np.array([parities(t) for t in texts], np.uint64).reshape(len(texts), -1)
        self.ranks, self.needed = texts, {}

    def _need(self, m: int) -> np.ndarray:
        """Hits that each evaluation text needs of a text of ``m`` words; more than it has where their lengths alone rule it out."""
        if m not in self.needed:
            longer = np.maximum(self.n, m)
            need = np.maximum(1, 3 * np.ceil(self.similar * longer - 1e-9) - self.n - m + 1 - self.spared)
            self.needed[m] = np.where(np.minimum(self.n, m) >= self.similar * longer - 1e-9, need, self.n + 2)
        return self.needed[m]

    def scan(self, ranks: np.ndarray) -> list[tuple[int, float]]:
        """(number, coverage) of the evaluation texts that may be similar to a training text (sorted word ranks).

        Of those with enough hits a parity bound and the words in common, both on ranks, leave hardly any that is not similar; words of
        one rank only add to what is in common.
        """
        text, m = normalised(ranks), len(ranks)
        hits = {i for _, i in self.automaton.iter(text)}
        if not hits:
            return []
        starts, owners = self.starts, self.owners
        found = np.bincount(np.concatenate([owners[starts[i] : starts[i + 1]] for i in hits]), minlength=len(self.n))
        maybe = np.flatnonzero(found >= self._need(m))
        if len(maybe):
            apart = np.bitwise_count(self.bits[maybe] ^ parities(ranks)).sum(1, dtype=np.int64)
            n = self.n[maybe]
            maybe = maybe[apart <= n + m - 2 * self.similar * np.maximum(n, m) + 1e-6]
        if not len(maybe):
            return []
        held, own = set(zip(text, text[1:])), Counter(ranks.tolist())
        kept = [i for i in maybe.tolist() if sum((Counter(self.ranks[i].tolist()) & own).values()) >= self.similar * max(len(self.ranks[i]), m) - 1e-9]
        return [(i, coverage(self.texts[i], held)) for i in kept]


def parities(ranks: np.ndarray) -> np.ndarray:
    """Which of 256 groups of ranks hold an odd number of words, as four words of 64 bits."""
    groups = (ranks.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(24)
    return np.packbits((np.bincount(groups, minlength=256) & 1).astype(np.uint8)).view(np.uint64)


def coverage(text: str, held: set) -> float:
    """Share of an evaluation text's words (without its marks) that the merged intervals of its matched passages cover."""
    covered, end = 0, 0
    for i, pair in enumerate(zip(text, text[1:])):
        if pair in held:
            covered += i + 2 - max(i, end)
            end = i + 2
    n = len(text) - 2
    marks = (text[0], text[1]) in held, (text[-2], text[-1]) in held
    return max(0, covered - sum(marks)) / n


def sorted_texts(df: DataFrame, key: str, text: str, keep: list[str], counts: np.ndarray) -> DataFrame:
    """``<key>, <keep>, class, ranks``: a digest of the words in any order, and their sorted ranks as bytes; null and blank text has no row."""
    rank = np.empty(len(counts), np.uint16)
    rank[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))  # the rarest word is 0
    shipped = df.sparkSession.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, order = Hashes(), shipped.value
        for b in batches:
            w = Words(b.column(0).to_pylist(), hashes)
            at = np.flatnonzero(w.count)
            ranks = order[w.number]
            ranks = ranks[np.lexsort((ranks, w.owner))]
            ends = np.cumsum(w.count)
            texts = [ranks[e - n : e].tobytes() for e, n in zip(ends[at].tolist(), w.count[at].tolist())]
            digests = [r.tobytes() for r in w.sums()[at]]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in b.columns[1:]), pa.array(digests, pa.binary()), pa.array(texts, pa.binary())], names=[*b.schema.names[1:], "class", "ranks"])

    some = df.select(df[text].alias("_text"), df[key].alias("_key"), *(df[c] for c in keep))
    schema = T.StructType([*some.schema.fields[1:], T.StructField("class", T.BinaryType()), T.StructField("ranks", T.BinaryType())])
    return some.mapInArrow(run, schema).withColumnRenamed("_key", key)


def _cells(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evaluation and training texts by cell: an entity's shard against one of its blocks of training texts.

    Up to ``SHARD`` evaluation texts no training text is copied, beyond that once a shard; an evaluation text is copied once a block.
    Copies are of sorted ranks, two bytes a word.
    """
    n = texts.groupBy("entity").agg(F.count_if("evaluation").alias("_e"), F.count_if(~F.col("evaluation")).alias("_t"))
    n = n.where("_e > 0 and _t > 0").select("entity", F.ceil(F.col("_e") / SHARD).cast("int").alias("_s"), F.greatest(F.ceil(F.col("_t") / BLOCK), F.least(F.lit(SPREAD), F.floor(F.col("_t") / LEAST)), F.lit(1)).cast("int").alias("_b"))
    t = salted_lookup(texts, n, "entity", "rep", how="inner")
    spread = F.xxhash64("rep", F.lit(3))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    e = t.where("evaluation").withColumn("shard", F.pmod(spread, F.col("_s")).cast("int")).withColumn("block", every("_b"))
    r = t.where(~F.col("evaluation")).withColumn("block", F.pmod(spread, F.col("_b")).cast("int")).withColumn("shard", every("_s"))
    fresh = [F.col(c).alias(c) for c in ("entity", "shard", "block", "rep", "ranks")]  # new columns: both sides have one origin
    return e.select(*fresh), r.select(*fresh)


def cross_split_overlaps(df: DataFrame, key: str, name: Column, entities: DataFrame, text: str, split: str, similar: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(members, links) of the records whose text occurs in the other kind of split.

    ``entities`` has ``key`` (a value of ``name``) and ``entity``, one row a key; only records of one entity are compared. members:
    ``<key>, rep, evaluation``, classes of equal words within an entity and kind of split. links: ``e, t``, the classes that are similar,
    with ``coverage``. Splits are ``train`` against ``val`` and ``test``, in any case; records of other or no split, without entity, or with
    null or blank text match nothing. A repeated key stands for all its rows. Copies are scanned once however many there are.
    """
    s = F.lower(F.trim(F.col(split)))
    own = df.select(F.col(key), F.col(text), name.alias("_name"), s.isin("val", "test").alias("evaluation"), s.alias("_s")).where("_s in ('train', 'val', 'test') and _name is not null").drop("_s")
    counts, _ = word_counts(own, [text])
    t = sorted_texts(own, key, text, ["_name", "evaluation"], counts)
    t = salted_lookup(t, entities.select(F.col("key").alias("_name"), "entity"), "_name", key, how="inner")
    t = t.withColumn("class", F.concat_ws("|", F.hex("class"), F.col("entity").cast("string"), F.col("evaluation").cast("string")))
    t = written(t.select(key, "entity", "evaluation", "class", "ranks"), "sides")
    reps = t.groupBy("class").agg(F.min(key).alias("rep"), *(F.any_value(c).alias(c) for c in ("entity", "evaluation", "ranks")))
    reps = written(reps, "classes")
    members = written(salted_lookup(t.select(key, "class"), reps.select("class", "rep", "evaluation"), "class", key, how="inner").select(key, "rep", "evaluation").distinct(), "members")
    dropped(t)
    evals, trains = _cells(reps)
    kind = reps.schema["rep"].dataType

    def scan(e: pa.Table, r: pa.Table) -> pa.Table:
        left, right, share = [], [], []
        if e.num_rows and r.num_rows:
            texts = lambda t: [np.frombuffer(x, np.uint16) for x in t.column("ranks").to_pylist()]
            shard, ids = Shard(texts(e), similar), r.column("rep").to_pylist()
            names = e.column("rep").to_pylist()
            for rep, ranks in zip(ids, texts(r)):
                for i, c in shard.scan(ranks):
                    left.append(names[i])
                    right.append(rep)
                    share.append(c)
        of = e.schema.field("rep").type
        return pa.table([pa.array(left, of), pa.array(right, of), pa.array(share, pa.float64())], names=["e", "t", "coverage"])

    schema = T.StructType([T.StructField("e", kind), T.StructField("t", kind), T.StructField("coverage", T.DoubleType())])
    cell = ["entity", "shard", "block"]
    maybe = written(evals.groupBy(*cell).cogroup(trains.groupBy(*cell)).applyInArrow(scan, schema), "hits")
    dropped(reps)
    return members, written(verified(maybe, df, key, [text], similar, ("e", "t")), "overlaps")


def overlap_pairs(members: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Each pair of an evaluation and a training record in linked classes: ``<key>_a`` < ``<key>_b`` and ``eval_key``."""
    e = members.where("evaluation").select(F.col("rep").alias("e"), F.col(key).alias("x"))
    t = members.where(~F.col("evaluation")).select(F.col("rep").alias("t"), F.col(key).alias("y"))
    both = links.select("e", "t").join(e, "e").join(t, "t")
    return both.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"), F.col("x").alias("eval_key"))


def overlap_report(df: DataFrame, members: DataFrame, links: DataFrame, key: str, split: str, source: str) -> DataFrame:
    """For each evaluation ``split`` and ``source`` (null sources are one): ``records``, ``overlapping`` of them and ``pairs``.

    Pairs are counted from class sizes, never listed.
    """
    sizes = members.where(~F.col("evaluation")).groupBy(F.col("rep").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    per = links.join(sizes, "t").groupBy(F.col("e").alias("rep")).agg(F.sum("n").alias("n"))
    hit = members.where("evaluation").join(per, "rep").select(F.col(key).alias("_k"), "n")
    s = F.lower(F.trim(F.col(split)))
    e = df.where(s.isin("val", "test")).select(F.col(key).alias("_k"), s.alias("split"), F.col(source).alias("source")).join(hit, "_k", "left")
    return e.groupBy("split", "source").agg(F.count(F.lit(1)).alias("records"), F.count("n").alias("overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))
