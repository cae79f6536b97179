"""Curating names and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.text import words


def filter_reason(c: Column, rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds, null if none does."""
    out = None
    for name, rule in rules:
        out = F.when(rule, name) if out is None else out.when(rule, name)
    return out


def keep_first(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key; null keys are one key."""
    kept = df.columns
    first = df.withColumn("_key", key).groupBy("_key").agg(F.min_by(F.struct(*kept), F.struct(*order)).alias("_r"))
    return first.select("_r.*").select(kept)


def fuzzy_best(left: DataFrame, lkey: str, ltext: str, right: DataFrame, rkey: str, rtext: str, least: float = 0.5) -> DataFrame:
    """``lkey, rkey, jaccard`` of the best match by token sets, at least ``least``; the smallest ``rkey`` wins ties.

    Pairs meet on shared tokens and the overlap is counted, so no row is compared with one it shares nothing with. Texts without
    words match nothing.
    """
    a = left.select(F.col(lkey).alias("l"), F.array_distinct(words(F.col(ltext))).alias("t")).where(F.size("t") > 0)
    b = right.select(F.col(rkey).alias("r"), F.array_distinct(words(F.col(rtext))).alias("t")).where(F.size("t") > 0)
    x = a.select("l", F.size("t").alias("nl"), F.explode("t").alias("w"))
    y = b.select("r", F.size("t").alias("nr"), F.explode("t").alias("w"))
    both = x.join(y, "w").groupBy("l", "r", "nl", "nr").agg(F.count(F.lit(1)).alias("n"))
    s = both.withColumn("jaccard", F.col("n") / (F.col("nl") + F.col("nr") - F.col("n"))).where(F.col("jaccard") >= least)
    best = s.groupBy("l").agg(F.max_by(F.struct("r", "jaccard"), F.struct("jaccard", -F.col("r"))).alias("m"))
    return best.select(F.col("l").alias(lkey), F.col("m.r").alias(rkey), F.col("m.jaccard").alias("jaccard"))


def majority_label(df: DataFrame, by: list[str], label: str, priority: dict[str, int]) -> DataFrame:
    """``by, label, votes, source_count``: the commonest label, ties by priority, then by name."""
    prio = F.coalesce(F.create_map(*(F.lit(x) for kv in priority.items() for x in kv))[F.col(label)], F.lit(0))
    n = df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count(F.lit(1)).alias("votes"))
    return n.groupBy(*by).agg(F.max_by(F.struct(label, "votes"), F.struct("votes", prio, label)).alias("m"), F.sum("votes").alias("source_count")).select(*by, F.col(f"m.{label}").alias("label"), "m.votes", "source_count")


def ordered_union(df: DataFrame, by: list[str], items: str, order: str) -> DataFrame:
    """``by, items``: list columns of a group concatenated in order, first occurrences kept.

    Each item of a group is one row with its first place before anything is collected, so a list is as long as the group has
    different items, however many rows it has. Null lists and null items give nothing.
    """
    one = df.select(*by, F.col(order).alias("_o"), F.posexplode(items).alias("_p", "_x")).where("_x is not null")
    first = one.groupBy(*by, "_x").agg(F.min(F.struct("_o", "_p")).alias("_first"))
    lists = F.array_sort(F.collect_list(F.struct("_first", "_x")))
    return first.groupBy(*by).agg(F.transform(lists, lambda s: s["_x"]).alias(items))


def first_n(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


def name_key(c: Column) -> Column:
    """Lower case with underscores and hyphens as blanks, squeezed: what an exact lookup of names compares."""
    return F.trim(F.regexp_replace(F.lower(c), r"[\s_-]+", " "))


def lookup(left: DataFrame, lkey: str, ltext: str, right: DataFrame, rkey: str, rtext: str, least: float = 0.5) -> DataFrame:
    """``lkey, rkey, how, jaccard``: the entry of the same name (``exact``), else the best by token sets (``fuzzy``).

    Of several entries of one name the smallest key counts. Names that match nothing have no row.
    """
    known = right.select(F.col(rkey).alias("r"), name_key(F.col(rtext)).alias("k")).where("k <> ''").groupBy("k").agg(F.min("r").alias("r"))
    own = left.select(F.col(lkey).alias("l"), name_key(F.col(ltext)).alias("k"))
    exact = own.join(known, "k").select("l", "r", F.lit("exact").alias("how"), F.lit(1.0).alias("jaccard"))
    rest = left.join(exact.select(F.col("l").alias(lkey)), lkey, "left_anti")
    fuzzy = fuzzy_best(rest, lkey, ltext, right, rkey, rtext, least).select(F.col(lkey).alias("l"), F.col(rkey).alias("r"), F.lit("fuzzy").alias("how"), "jaccard")
    return exact.unionByName(fuzzy).withColumnsRenamed({"l": lkey, "r": rkey})


#: Endings of drug names, names of procedures and names that are too general.
DRUG_ENDINGS = ["mab", "prazole", "olol", "pril", "sartan", "pine", "ine", "statin", "cillin", "mycin", "floxacin", "tidine", "zole", "pam", "barbital", "thiazide"]
PROCEDURES = [
    "acupuncture", "amniocentesis", "anaesthesia", "angioplasty and stents", "antenatal blood tests", "barium enema", "barium swallow and barium meal", "bone scan", "bronchoscopy", "caesarean section", "colonoscopy",
    "colposcopy", "cone biopsy", "coronary angiography", "ct scan", "ct calcium score", "dexa scan", "dialysis", "echocardiogram", "electrocardiograph", "eye examination", "fluoroscopy", "gastroscopy",
    "mammogram", "mri scan", "spirometry", "ultrasound", "x-ray", "blood tests", "blood transfusion", "chemotherapy", "cortisone injections", "vaccination", "vaccines", "surgery", "surgical mesh", "telehealth", "wound healing",
]
GENERIC = [
    "cancer", "pain", "surgery", "ageing topics", "allergy topics", "anxiety topics", "arthritis topics", "asthma topics", "autoimmune disease topics", "back and neck pain topics", "blindness and low vision topics",
    "blood clot topics", "blood pressure topics", "blood tests topics", "cancer screening topics", "cancer topics", "cardiovascular and heart disease topics", "children's common health problems topics", "coeliac disease topics",
    "contraception topics", "copd topics", "covid-19 management topics", "covid-19 medicine topics", "covid-19 vaccination topics", "dementia topics", "depression topics", "diabetes test topics", "diabetes topics",
    "driving and road safety topics", "eating disorders", "eczema topics", "epilepsy topics", "eye care and treatment topics", "eye condition topics", "fever topics", "first aid topics", "food allergy topics",
    "gambling harm topics", "gender diversity topics", "gout topics", "lgbtqi topics", "nsaid topics", "opioid topics", "phobia topics", "sexual health", "what is pain", "brand changes", "common symptoms and what to do",
    "global dro", "illegal drugs", "theranostics",
]


def vocabulary_reason(df: DataFrame, name: str, medications: DataFrame) -> DataFrame:
    """``df`` with ``reason``: why a cleaned name is no condition, null if it is one; the first rule that holds counts.

    Rules in order: a known medication (``medications`` has them in lower case in its column ``medication``), a procedure, a general
    term, a drug ending, fewer than three characters, more than 30 % of other characters than ASCII letters and white space.
    """
    low = F.lower(name)
    known = medications.where("medication is not null").select(F.col("medication").alias("_m")).distinct()
    t = df.withColumn("_low", low).join(known, F.col("_low") == F.col("_m"), "left")
    rules = [("medication", F.col("_m").isNotNull()), ("procedure", low.isin(PROCEDURES)), ("generic", low.isin(GENERIC))]
    rules += [(f"medication_pattern (.*{e}$)", low.rlike(f"^.*{e}$")) for e in DRUG_ENDINGS]
    rules += [("too_short", F.length(F.regexp_replace(name, " ", "")) < 3), ("too_many_special_chars", F.length(F.regexp_replace(name, r"[a-zA-Z\s]", "")) > 0.3 * F.length(name))]
    return t.withColumn("reason", filter_reason(F.col(name), rules)).drop("_low", "_m")


def complete_entry(level: str, symptoms: str, steps: str) -> Column:
    """Whether a structured entry has a level, symptoms and next steps."""
    filled = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    return F.coalesce(F.length(level) > 0, F.lit(False)) & filled(symptoms) & filled(steps)
