"""Defective answers: empty, refusing, copying their question, in another language, or cut off.

Languages are told apart by naive Bayes over hashed character trigrams, trained on documents labelled with a language; the
posteriors of an answer and of the dialogue's query are compared. Cut-off answers are found by the likelihood that a text ends
after its last words: n-gram counts of all answers, with how often a sentence ends after each. Both statistics cover all rows;
only the language model is fitted on a bounded sample (``FIT_DOCS`` documents of each language).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import plain
from quern.session import salted_lookup, written

FIT_DOCS = 2_000
BUCKETS = 2**15
MARGIN = 6.0
LETTERS = 12
ENDS = 0.03
SEEN = 3
OPENING = 5

#: Placeholders that say nothing, once all but letters and digits is gone.
PLACEHOLDERS = "n a|na|n d|null|nul|none|nil|nan|tbd|tba|tbc|todo|blank|empty|no (answer|response|reply|text|content|data)|not (available|applicable|provided|specified|given)|undefined|missing|placeholder|answer here|lorem ipsum"
#: What a refusal says, in words parted by blanks; each pattern names the answering itself, so that "can t sleep" or "can t see it from here" are none.
REFUSALS = [
    r"\b(can ?t|cannot|can not|could not|couldn t|won t|will not|unable to|not able to|not (going|allowed|permitted|authori[sz]ed) to|must not|may not|not feel able to) (be able to |be in a position to )?(help|assist|answer|comply|continue|discuss|respond|engage|advise|reply|diagnose|give (you )?(any )?(medical|health) advice|offer (you )?(any )?(medical|health)|provide|talk about|comment|fulfil|support (this|that|your) request)",
    r"\b(have|need|forced|obliged) to (decline|refuse)\b|\bi (must |respectfully )?(decline|refuse)\b|\b(request|question|prompt|query|answer) (was |is |has been )?(declined|refused|rejected|denied|blocked)\b|\bdeclined to (answer|respond)\b",
    r"\bas an? (ai|a i|artificial intelligence|(large )?language model|assistant|virtual assistant|chatbot|bot)\b|\bi (m|am) (just |only )?an? (ai|artificial intelligence|(large )?language model|chatbot)\b",
    r"\b(guidelines|policy|policies|rules|instructions|programming) (do not|don t|does not|doesn t|forbids?|prevents?|prohibits?|not) ?(allow|permit|let|me)?|\bviolates? (the |our |my )?[a-z ]{0,20}(policy|policies|guidelines|terms)\b|\bno answer was produced\b|\bagainst (my|our|the) (policy|policies|guidelines|rules)\b",
    r"\b(rather|prefer) not (to )?(answer|say anything|comment|discuss|respond|help)\b|\boutside (of )?(my|the|what i)\b[a-z ]{0,30}\b(scope|remit|permitted|allowed|able|capabilities|expertise)\b|\bnot something i (can|am able to|m able to)\b",
    r"\b(not|don t|n t|never) (feel |be |being )?comfortable (answering|responding|replying|discussing|helping|advising|giving|providing|with)\b|\bnot possible for me to (give|answer|provide|help|assist|offer|discuss|respond|diagnose|comment|continue|advise|say)\b|\bno can do\b|\b(off limits|out of bounds) for (this|an?|your|the|me)\b",
]
#: One of these is in every refusal; looking for them first spares the patterns on most texts.
REFUSAL_MARKS = ["can t", "couldn t", " a i", "no answer", "cant ", "cannot", "can not", "not", "won t", "unable to", "declin", "refus", "rejected", "denied", "blocked", " ai", "intelligence", "language model", "assistant", "bot", "guidelines", "polic", "rules", "instructions", "programming", "violate", "outside", "comfortable", "can do", "off limits", "out of bounds"]
FIELDS = {"clarifying_question": "patient_query", "patient_response": "clarifying_question", "reasoning_decision": "patient_query"}


def says_nothing(c: Column, said: Column) -> Column:
    """Null, blank, without letters or digits, or a placeholder; ``said`` are the words of ``c``. A placeholder closed by a full stop is an answer."""
    holder = (F.length(said) <= 24) & said.rlike(f"^({PLACEHOLDERS})$")
    return F.coalesce(said == "", F.lit(True)) | (holder & ~c.rlike(r"\p{L}[.!?]\s*$"))


def refuses(said: Column) -> Column:
    """Whether words parted by blanks decline to answer."""
    mark, out = F.lit(False), F.lit(False)
    for m in REFUSAL_MARKS:
        mark = mark | F.contains(said, F.lit(m))
    for p in REFUSALS:
        out = out | said.rlike(p)
    return F.coalesce(mark & out, F.lit(False))


def copies(said: Column, asked: Column, whole: float = 0.8, part: float = 0.6) -> Column:
    """Whether the distinct words of a question mostly come again in the answer and the answer has little else.

    Both are words parted by blanks; how often a word comes does not count.
    """
    a, q = F.array_distinct(F.split(said, " ")), F.array_distinct(F.split(asked, " "))
    both = F.size(F.array_intersect(a, q))
    return F.coalesce((F.size(q) >= 3) & (both >= whole * F.size(q)) & (both >= part * F.size(a)), F.lit(False))


def _trigrams(text: str) -> np.ndarray:
    t = re.sub(r"[\W\d_]+", " ", text.lower()).strip()
    c = np.frombuffer(f" {t} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    return ((c[:-2] * np.uint64(1000003) + c[1:-1]) * np.uint64(1000003) + c[2:]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(49) if len(c) > 4 else np.zeros(0, np.uint64)


def language_model(docs: DataFrame, text: str, lang: str) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities of trigram buckets, for the driver to ship: languages x ``BUCKETS`` numbers.

    Labels are read as their first two letters; labels of other form and texts without letters are left out. At most about
    ``FIT_DOCS`` documents of a language are used, by a hash of their text. Mislabelled documents only blur the model.
    """
    label = F.regexp_extract(F.lower(F.trim(F.col(lang))), r"^([a-z]{2})([-_].*)?$", 1)
    d = docs.select(label.alias("lang"), F.col(text).alias("text")).where("lang <> '' and length(text) > 40")
    n = {r["lang"]: r["count"] for r in d.groupBy("lang").count().collect()}
    n = {k: v for k, v in n.items() if v >= max(3, 0.002 * sum(n.values()))}
    share = F.create_map(*(x for k, v in n.items() for x in (F.lit(k), F.lit(int(1_000_000 * min(1.0, FIT_DOCS / v)))))) if n else F.lit(None)
    if not n:
        return [], np.zeros((0, BUCKETS), np.float32)
    d = d.where(F.col("lang").isin(*n)).where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = sums.setdefault(k, np.zeros(BUCKETS, np.int64))
                s += np.bincount(_trigrams(t).astype(np.int64), minlength=BUCKETS)
        for k, s in sums.items():
            at = np.nonzero(s)[0]
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(at), pa.array(s[at])], names=["lang", "bucket", "n"])

    counts = d.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # languages x BUCKETS rows at most, as Arrow
    names = sorted(n)
    m = np.full((len(names), BUCKETS), 0.5)
    m[np.searchsorted(names, counts["lang"].to_numpy(str)), counts["bucket"].to_numpy(np.int64)] += counts["n"].to_numpy(np.int64)
    return names, np.log(m / m.sum(1, keepdims=True)).astype(np.float32)


def other_language(query: str, answers: list[str], names: list[str], model: DataFrame):
    """UDF: for each of ``answers`` (columns) whether its language differs from that of ``query``, both being clear beyond ``MARGIN``.

    Texts of fewer than ``LETTERS`` trigrams, or two words, have no language.
    """
    shipped = model

    def scores(t: str | None) -> np.ndarray | None:
        if not t or " " not in t.strip():
            return None
        g = _trigrams(t)
        return shipped.value[:, g].sum(1) if len(g) >= LETTERS else None

    def run(q: pd.Series, *cols: pd.Series) -> pd.Series:
        out = []
        for query_, *own in zip(q, *cols):
            s, row = scores(query_), []
            for a in own:
                r = scores(a) if s is not None else None
                if r is None:
                    row.append(False)
                    continue
                i, j = int(s.argmax()), int(r.argmax())
                row.append(i != j and s[i] - s[j] > MARGIN and r[j] - r[i] > MARGIN)
            out.append(row)
        return pd.Series(out)

    return F.pandas_udf(run, "array<boolean>")(query, *answers)


_SENTENCE = re.compile(r"([.!?]+)(?:[\"'”’)\]]*\s+|[\"'”’)\]]*$)|\n+")
_WORDS = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def ending_counts(texts: DataFrame) -> DataFrame:
    """``gram``, ``ends`` and ``goes_on`` over all texts of the one column ``text``.

    Grams are single words, pairs of words, and ``^`` with up to the first ``OPENING`` words of a text. A word or pair ends if a full stop,
    question or exclamation mark follows; the last words of a text without such a mark count in neither. A ``^`` gram ends if the
    text has no more words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: Counter = Counter()
        goes_on: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                parts = _SENTENCE.split(t.lower())  # text, mark, text, mark, ..., text
                first = True
                for k in range(0, len(parts), 2):
                    w = _WORDS.findall(parts[k])
                    if not w:
                        continue
                    more = k + 1 < len(parts)
                    if first:
                        for n in range(1, min(OPENING, len(w)) + 1):
                            whole = n == len(w) and not any(_WORDS.search(p or "") for p in parts[k + 1 :])
                            (ends if whole else goes_on)["^ " + " ".join(w[:n])] += 1
                        first = False
                    pairs = list(map(" ".join, zip(w, w[1:])))
                    goes_on.update(w[:-1])
                    goes_on.update(pairs[:-1])
                    if more and parts[k + 1] and parts[k + 1] != "...":
                        ends[w[-1]] += 1
                        if pairs:
                            ends[pairs[-1]] += 1
                    elif more and not parts[k + 1]:
                        goes_on[w[-1]] += 1
                        if pairs:
                            goes_on[pairs[-1]] += 1
            if len(ends) + len(goes_on) > 400_000:
                yield _rows(ends, goes_on)
                ends.clear()
                goes_on.clear()
        yield _rows(ends, goes_on)

    parts = texts.mapInArrow(count, "gram string, ends long, goes_on long")
    return parts.groupBy("gram").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on"))


def _rows(ends: Counter, goes_on: Counter) -> pa.RecordBatch:
    grams = list(ends.keys() | goes_on.keys())
    return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array([ends[g] for g in grams], pa.int64()), pa.array([goes_on[g] for g in grams], pa.int64())], names=["gram", "ends", "goes_on"])


def cut_off(open_: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows of ``open_`` (with ``text``, no closing mark) that stop before their sentence is finished.

    A mark that goes on (comma, dash, bracket, dots) settles it. Else the likelihood of an end after the last two words decides, after
    the last word alone where the pair is rare. A last word met nowhere else is a cut word if it begins a known one. Texts of up to
    ``OPENING`` words are cut if texts go on after them more often than they end.
    """
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"), 0)
    t = open_.withColumn("_w", w).withColumn("_n", F.size("_w")).where("_n > 0").withColumn("_id", F.monotonically_increasing_id())
    t = t.withColumn("_one", F.element_at("_w", -1)).withColumn("_two", F.when(F.col("_n") > 1, F.array_join(F.slice("_w", -2, 2), " ")))
    t = t.withColumn("_all", F.when(F.col("_n") <= OPENING, F.concat(F.lit("^ "), F.array_join("_w", " "))))
    t = written(t.withColumn("_mark", F.rtrim("text").rlike(r"(…|\.\.\.|[,;:(\[–—/&-])$")), "open-texts")
    for c in ("_one", "_two", "_all"):
        own = t.select(F.col(c).alias("gram")).where("gram is not null").distinct()
        got = counts.join(own, "gram", "left_semi").select(F.col("gram").alias(c), F.col("ends").alias(f"{c}_e"), F.col("goes_on").alias(f"{c}_g"))
        t = salted_lookup(t, got, c, "_id").fillna(0, [f"{c}_e", f"{c}_g"])  # one last word may close a third of the texts
    rare = t.where(F.col("_one_e") + F.col("_one_g") < SEEN).select("_one").distinct()
    known = counts.where((F.col("ends") + F.col("goes_on") >= SEEN) & ~F.col("gram").contains(" ") & (F.length("gram") > 1))
    starts = known.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("gram") - 1), lambda i: F.substring("gram", F.lit(1), i))).alias("_one")).distinct()
    t = t.join(starts.join(rare, "_one", "left_semi").withColumn("_begins", F.lit(True)), "_one", "left")
    two, one = F.col("_two_e") + F.col("_two_g"), F.col("_one_e") + F.col("_one_g")
    cut = (
        F.when(F.col("_mark") | ((one < SEEN) & F.coalesce("_begins", F.lit(False))), True)
        .when((F.col("_n") <= OPENING) & (F.col("_all_e") + F.col("_all_g") > 0), F.col("_all_g") > F.col("_all_e"))
        .when(one < SEEN, False)
        .when(two >= SEEN, F.col("_two_e") < ENDS * two)
        .otherwise(F.col("_one_e") < ENDS * one)
    )
    return t.where(cut)


def defects(df: DataFrame, key: str, docs: DataFrame, doc_text: str = "text", doc_lang: str = "lang", fields: dict[str, str] = FIELDS, query: str = "patient_query") -> DataFrame:
    """``<key>, field, defect`` of every defective answer; a field has at most one defect.

    Order of precedence: empty, refusal, copy, language, truncated. A null question is never copied, and a null query has no
    language. Repeated rows give repeated defects. Without any labelled document no language is told.
    """
    names, logs = language_model(docs, doc_text, doc_lang)
    shipped = df.sparkSession.sparkContext.broadcast(logs)
    if len(names) > 1:
        differs = other_language(query, list(fields), names, shipped)
    else:
        differs = F.array(*(F.lit(False) for _ in fields))
    names_ = list(dict.fromkeys([query, *fields, *fields.values()]))
    wide = df.select(key, *names_).withColumn("_d", differs)
    wide = wide.select(key, "_d", *(F.col(f).alias(f"_t_{f}") for f in fields), *(plain(F.col(f)).alias(f"_w_{f}") for f in names_))
    cells = [F.struct(F.lit(f).alias("field"), F.col(f"_t_{f}").alias("text"), F.col(f"_w_{f}").alias("said"), F.col(f"_w_{q}").alias("asked"), F.col("_d")[i].alias("differs")) for i, (f, q) in enumerate(fields.items())]
    rows = wide.select(key, F.explode(F.array(*cells)).alias("c")).select(key, "c.*")
    closed = F.rtrim("text").rlike(r"""[.!?]["'”’)\]]*$""") & ~F.rtrim("text").rlike(r"\.\.\.$")
    said = F.col("said")
    defect = F.when(says_nothing(F.col("text"), said), "empty").when(refuses(said), "refusal").when(copies(said, F.col("asked")), "copy").when(F.col("differs"), "language").when(~closed, "open")
    rows = written(rows.select(key, "field", defect.alias("defect"), F.when(defect == "open", F.col("text")).alias("text")).where("defect is not null"), "defects")
    texts = df.select(F.explode(F.array(*fields)).alias("text")).where("text is not null")
    counts = written(ending_counts(texts), "endings")
    cut = cut_off(rows.where("defect = 'open'").select(key, "field", "text"), counts)
    return rows.where("defect <> 'open'").select(key, "field", "defect").unionByName(cut.select(key, "field", F.lit("truncated").alias("defect")))
