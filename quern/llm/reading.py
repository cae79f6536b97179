"""Reading level of documents by harmonic propagation over the document-word graph.

Nodes are documents and hashed words (``BUCKETS`` of them, so a round's word values are a broadcast of bounded size), plus words
that stand for sentence length. Graded examples, a hash sample of English prose graded by words per sentence and syllables
per word, keep their grade. In each round a word takes the weighted mean of its documents and every other document that of its
words, rarer words weighing more. A line fitted on the examples, each valued from its words alone, turns values into school grades.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import written

BUCKETS = 2**16
EXAMPLES = 0.2  # share of the English prose whose grades are clamped, by a hash of the key
TOLERANCE = 0.05  # grades by which a word value changes in the last round, on average over all links
ROUNDS = 30
LEAST_WORDS = 40
EASY, HARD = 5.0, 13.0
SLACK = 1.5  # grades by which a document's own sentences and syllables may miss the band its propagated level is in

#: Frequent words that tell the languages of the corpus apart.
ENGLISH = set("the and of to is it in for with your you that are was on as be this can if or not by at from have has will may they when which were an more than but their there do my his her".split())
OTHER = set(
    "der das und ist nicht ein eine mit zu den dem sie auf für von bei wenn ihr ihre im oder nach le les des et est une un pour dans que qui vous votre avec sur au aux ne pas ou du el los las y una por con para su se al como más si lo del os um uma não é com seu sua ao na em mais da dos e".split()
)
_TAG = re.compile(r"<[^<>]{1,200}>")
#: Abbreviations whose stop ends no sentence; those of the second row only at the start of a word.
_INSIDE = ["e.g.", "i.e.", "approx.", "et al."]
_TITLES = ["dr.", "mr.", "mrs.", "ms.", "prof.", "vs.", "fig.", "cf."]
_DECIMAL = re.compile(r"([0-9])\.(?=[0-9])")
_STOP = re.compile(r"[.!?]+(?=[\s\"'”’)\]]|$)|[\r\n]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_VOWELS = re.compile(r"[aeiouyāēīōūáéíóúàèìòùâêîôûäëïöü]+")
_BULLET = re.compile(r"^[ \t]*[*+#]+ ", re.M)  # marks of list items and headings are no symbols of code
_SYMBOLS = "{}[]=_\\|<>@#$^~`/*+"


def _without_abbreviations(t: str) -> str:
    for a in _INSIDE:
        if a in t:
            t = t.replace(a, a.replace(".", ""))
    for a in _TITLES:
        if a in t:
            for lead in (" ", "\n", "("):
                t = t.replace(lead + a, lead + a[:-1])
            t = a[:-1] + t[len(a) :] if t.startswith(a) else t
    return t


def syllables(word: str) -> int:
    """Vowel groups of a word in lower case, without a silent closing e; one at least."""
    n = len(_VOWELS.findall(word))
    if n > 1 and (word.endswith(("e", "es", "ed")) and not word.endswith(("le", "les", "ted", "ded", "ses", "zes", "ges", "ces", "ches", "shes"))):
        n -= 1
    return max(1, n)


def grade(n_words: int, n_sentences: int, n_syllables: int) -> float:
    """School grade from words per sentence and syllables per word (the Flesch-Kincaid weights)."""
    return 0.39 * n_words / max(1, n_sentences) + 11.8 * n_syllables / max(1, n_words) - 15.59


class Reader:
    """Counts of a text; knows each word's syllables and bucket from the first time on."""

    def __init__(self) -> None:
        self.words: dict[str, tuple[int, int]] = {}

    def word(self, w: str) -> tuple[int, int]:
        got = self.words.get(w)
        if got is None:
            if len(self.words) > 500_000:
                self.words.clear()
            got = self.words[w] = syllables(w), zlib.crc32(w.encode()) % BUCKETS
        return got

    def read(self, text: str | None) -> tuple[float, int, bool, list[int]]:
        """(grade, words, English prose or not, buckets of the distinct words and of the sentence length)."""
        if not text:
            return 0.0, 0, False, []
        t = text.lower()
        t = _TAG.sub("\n", t) if "<" in t else t
        t = _DECIMAL.sub(r"\1", _without_abbreviations(t))
        counts: Counter = Counter()
        sentences = 0
        for s in _STOP.split(t):
            if s and (found := _WORD.findall(s)):
                sentences += 1
                counts.update(found)
        n = sum(counts.values())
        if not n:
            return 0.0, 0, False, []
        syl, nodes = 0, []
        for w, k in counts.items():
            s, b = self.word(w)
            syl += s * k
            nodes.append(b)
        nodes.append(self.word(f"# {min(40, n // sentences)}")[1])
        english = sum(counts[w] for w in ENGLISH & counts.keys())
        other = sum(counts[w] for w in OTHER & counts.keys())
        letters = sum(map(operator.mul, map(len, counts), counts.values()))
        bare = _BULLET.sub("", t) if "*" in t or "+" in t or "#" in t else t
        solid = letters >= 0.8 * len("".join(bare.split())) and sum(map(bare.count, _SYMBOLS)) <= 0.02 * len(bare)
        ascii_ = t.isascii() or sum(len(w) * k for w, k in counts.items() if w.isascii()) >= 0.9 * letters
        return grade(n, sentences, syl), n, bool(solid and ascii_ and other <= max(0.06 * n, 0.35 * english)), nodes


def readings(df: DataFrame, key: str, text: str) -> DataFrame:
    """``<key>, grade, n_words, prose, nodes`` of every document; null and empty text have 0 words and no nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for b in batches:
            g, n, p, nodes = zip(*map(reader.read, b.column(1).to_pylist())) if b.num_rows else ((), (), (), ())
            cols = [b.column(0), pa.array(g, pa.float64()), pa.array(n, pa.int32()), pa.array(p, pa.bool_()), pa.array(nodes, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=["_key", "grade", "n_words", "prose", "nodes"])

    two = df.select(df[key].alias("_key"), df[text].alias("_text"))
    kind = two.schema["_key"].dataType.simpleString()
    return two.mapInArrow(run, f"_key {kind}, grade double, n_words int, prose boolean, nodes array<int>").withColumnRenamed("_key", key)


def _flat(batch: pa.RecordBatch, col: int) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column(col)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(lists.offsets.to_numpy()).astype(np.int64)


def _means(nodes: np.ndarray, n: np.ndarray, value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted mean of the nodes of each document; NaN where no node has a value."""
    w = np.where(np.isnan(value[nodes]), 0.0, weight[nodes])
    owner = np.repeat(np.arange(len(n)), n)
    top = np.bincount(owner, w * np.nan_to_num(value[nodes]), len(n))
    total = np.bincount(owner, w, len(n))
    return np.divide(top, total, out=np.full(len(n), np.nan), where=total > 0)


def _round(docs: DataFrame, value: np.ndarray | None, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words' new values and document counts from documents (``grade, example, nodes``) under the words' old values."""
    shipped = docs.sparkSession.sparkContext.broadcast((value, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, wt = shipped.value
        top, total, df = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS)
        for b in batches:
            nodes, n = _flat(b, 2)
            if not len(nodes):
                continue
            own = np.where(b.column(1).to_numpy(zero_copy_only=False), b.column(0).to_numpy(zero_copy_only=False), np.nan if old is None else _means(nodes, n, old, wt))
            has = np.repeat(~np.isnan(own), n)
            top += np.bincount(nodes, np.nan_to_num(np.repeat(own, n)) * has, BUCKETS)
            total += np.bincount(nodes, has.astype(float), BUCKETS)
            df += np.bincount(nodes, minlength=BUCKETS)
        at = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(top[at]), pa.array(total[at]), pa.array(df[at])], names=["b", "top", "total", "df"])

    sums = docs.select("grade", "example", "nodes").mapInArrow(run, "b long, top double, total double, df double")
    rows = sums.groupBy("b").agg(F.sum("top").alias("top"), F.sum("total").alias("total"), F.sum("df").alias("df")).toPandas()  # BUCKETS rows at most
    new, df = np.full(BUCKETS, np.nan), np.zeros(BUCKETS)
    b = rows["b"].to_numpy(np.int64)
    total = rows["total"].to_numpy(float)
    new[b] = np.divide(rows["top"].to_numpy(float), total, out=np.full(len(b), np.nan), where=total > 0)
    df[b] = rows["df"].to_numpy(float)
    return new, df


def reading_levels(df: DataFrame, key: str = "doc_id", text: str = "text", examples: float = EXAMPLES, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """``<key>, level, grade, n_words, prose`` of every document; ``level`` is the propagated school grade.

    ``grade`` is that of the text's own sentences and syllables. A share ``examples`` of the prose is clamped, whatever the size of the
    corpus; rounds end when word values move by less than ``tolerance`` (at most ``rounds``). Documents without words have null level
    and grade; with no graded example every level is null. Repeated documents are graded alike.
    """
    docs = readings(df, key, text)
    docs = written(docs.withColumn("_pick", F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1_000_000))), "readings")
    docs = docs.withColumn("example", F.col("prose") & (F.col("n_words") >= LEAST_WORDS) & (F.col("_pick") < int(1_000_000 * examples)))
    value, weight = None, np.ones(BUCKETS)
    for _ in range(rounds):
        old = value
        value, seen = _round(docs, value, weight)
        weight = 1.0 / np.sqrt(np.maximum(seen, 1.0))
        known = ~np.isnan(value)
        if not known.any() or old is not None and np.average(np.abs(np.nan_to_num(old, nan=np.inf) - value)[known], weights=seen[known]) < tolerance:
            break
    shipped = df.sparkSession.sparkContext.broadcast((value, weight))

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w = shipped.value
        for b in batches:
            nodes, size = _flat(b, b.num_columns - 1)
            raw = _means(nodes, size, v, w)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(raw, mask=np.isnan(raw))], names=[*b.schema.names[:-1], "raw"])

    cols = docs.select(key, F.when(F.col("n_words") > 0, F.col("grade")).alias("grade"), "n_words", "prose", "example", "nodes")
    kind = cols.schema[key].dataType.simpleString()
    out = written(cols.mapInArrow(level, f"{key} {kind}, grade double, n_words int, prose boolean, example boolean, raw double"), "levels")
    fit = out.where("example and raw is not null").agg(F.regr_slope("grade", "raw").alias("a"), F.regr_intercept("grade", "raw").alias("b")).first()
    a, b = (fit["a"], fit["b"]) if fit and fit["a"] is not None else (None, None)
    scaled = F.lit(None).cast("double") if a is None else F.col("raw") * F.lit(a) + F.lit(b)
    return out.select(key, scaled.alias("level"), "grade", "n_words", "prose")


def bands(levels: DataFrame, key: str = "doc_id") -> DataFrame:
    """``<key>, band``: English prose of ``LEAST_WORDS`` words or more that is ``easy`` or ``hard`` by its propagated level.

    A document whose own grade is more than ``SLACK`` outside the band has no band.
    """
    p = levels.where((F.col("n_words") >= LEAST_WORDS) & F.col("prose"))
    band = F.when((F.col("level") <= EASY) & (F.col("grade") <= EASY + SLACK), "easy").when((F.col("level") >= HARD) & (F.col("grade") >= HARD - SLACK), "hard")
    return p.select(key, band.alias("band")).where("band is not null")
