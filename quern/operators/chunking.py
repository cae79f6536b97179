"""Cutting documents into chunks, with offsets into the document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed_windows(df: DataFrame, key: str, text: str, size: int, overlap: int = 0) -> DataFrame:
    """``key, chunk_no, char_start, char_end, chunk``: windows of ``size`` characters every ``size - overlap``; empty and null text give none."""
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap))
    w = df.where(n > 0).select(key, F.col(text).alias("_t"), F.posexplode(starts).alias("chunk_no", "char_start"))
    chunk = F.substring(F.col("_t"), F.col("char_start") + 1, F.lit(size))
    return w.select(key, "chunk_no", "char_start", (F.col("char_start") + F.length(chunk)).alias("char_end"), chunk.alias("chunk"))


def paragraphs(df: DataFrame, key: str, text: str, least: int = 25) -> DataFrame:
    """``key, chunk_no, chunk``: parts between blank lines, trimmed, of ``least`` characters or more; numbers count all parts."""
    p = df.select(key, F.posexplode(F.split(text, r"\n[ \t]*\n")).alias("chunk_no", "_c"))
    return p.select(key, "chunk_no", F.trim("_c").alias("chunk")).where(F.length("chunk") >= least)


def sentences(c: Column) -> Column:
    """Sentences: text up to a closing mark and white space; the rest is the last one."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def sentence_lengths(c: Column) -> Column:
    """Number of words of each sentence."""
    return F.transform(sentences(c), lambda s: F.size(F.split(s, r"\s+")))


def packed(lengths: Column, budget: Column, overlap: Column) -> Column:
    """Packs of sentences in order as an array of ``first, last`` (from 0) and ``words``: up to ``budget`` words, each starting with the last ``overlap`` sentences of the one before.

    A sentence beyond the budget is a pack of its own (after the overlap). A fold over the numbers of words keeps only where packs start
    and end.
    """
    kind = "struct<first:int,last:int,words:int>"
    state = f"struct<done:array<{kind}>,now:{kind},i:int>"
    start = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("now"), F.lit(0).alias("i"))
    words_of = lambda first, i: F.aggregate(F.slice(lengths, first + 1, i - first + 1), F.lit(0), lambda a, x: a + x)

    def step(acc: Column, w: Column) -> Column:
        now, i = acc["now"], acc["i"]
        grown = F.struct(now["first"].alias("first"), i.alias("last"), (now["words"] + w).alias("words"))
        first = F.greatest(now["first"], i - overlap)
        fresh = F.struct(first.alias("first"), i.alias("last"), words_of(first, i).alias("words"))
        one = F.struct(i.alias("first"), i.alias("last"), w.alias("words"))
        closes = now.isNotNull() & (now["words"] + w > budget)
        done = F.when(closes, F.concat(acc["done"], F.array(now))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(now.isNull(), one).when(closes, fresh).otherwise(grown).cast(kind).alias("now"), (i + 1).alias("i")).cast(state)

    return F.aggregate(lengths, start.cast(state), step, lambda a: F.when(a["now"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["now"]))))


def sentence_packs(df: DataFrame, key: str, text: str, budget: int, overlap: int = 0) -> DataFrame:
    """``key, chunk_no, chunk, n_sentences``: the sentences of each document in packs (:func:`packed`), sliced out once at the end; null text gives none."""
    t = df.where(F.col(text).isNotNull()).select(key, sentences(F.col(text)).alias("_s"), sentence_lengths(F.col(text)).alias("_w"))
    cut = t.select(key, "_s", F.posexplode(packed(F.col("_w"), F.lit(budget), F.lit(overlap))).alias("chunk_no", "p"))
    own = F.slice("_s", F.col("p.first") + 1, F.col("p.last") - F.col("p.first") + 1)
    return cut.select(key, "chunk_no", F.array_join(own, " ").alias("chunk"), F.size(own).alias("n_sentences"))


def embedding_text(original: Column, text: Column, context: Column) -> Column:
    """What to embed: the text, and its context after a blank line if there is any."""
    body = F.coalesce(original, text)
    return F.when(F.length(context) > 0, F.concat(body, F.lit("\n\nContext: "), context)).otherwise(body)


def lexical_text(original: Column, text: Column, context: Column, contextual: Column) -> Column:
    """What to index for BM25: text and context of a contextual chunk, else the text."""
    return F.when(F.coalesce(contextual, F.lit(False)), F.concat_ws(" ", text, context)).otherwise(F.coalesce(text, original))


def numbered_context(number: str, source: str, text: str) -> Column:
    """Aggregate: ``[1] (source) text`` lines of a case's hits in order; a case has a bounded number of hits."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), F.col(source).alias("s"), F.col(text).alias("t"))))
    return F.array_join(F.transform(lines, lambda x: F.concat(F.lit("["), x["n"].cast("string"), F.lit("] ("), x["s"], F.lit(") "), x["t"])), "\n")


def prompt(query: Column, context: Column) -> Column:
    """The question, the context if there is any, and what is asked for."""
    middle = F.when(F.length(context) > 0, F.concat(F.lit("Context:\n"), context, F.lit("\n\n"))).otherwise("")
    return F.concat(F.lit("Patient query: "), F.coalesce(query, F.lit("")), F.lit("\n\n"), middle, F.lit("Provide triage decision, next steps, and reasoning:"))
