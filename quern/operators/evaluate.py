"""Evaluating rankings and classifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.text import keywords, strip_case

LABELS = ["ED", "GP", "HOME", "UNKNOWN"]
WEIGHTS = {"ED": 5.0, "GP": 2.0, "HOME": 1.0}  # fixed values: clinical weights


def relevant_by_name(symptom: Column, document: Column) -> Column:
    """Whether a document name holds the expected name, or two of its key words (all, if it has fewer)."""
    name = F.lower(F.regexp_replace(strip_case(symptom), "_", " "))
    doc = F.lower(F.regexp_replace(F.regexp_replace(document, r"\.txt$", ""), "_", " "))
    kw = keywords(strip_case(symptom))
    hits = F.size(F.filter(kw, lambda k: F.contains(doc, k)))
    return F.coalesce(F.contains(doc, name) | ((F.size(kw) > 0) & (hits >= F.least(F.lit(2), F.size(kw)))), F.lit(False))


def relevant_by_keywords(symptom: Column, document: Column) -> Column:
    """Whether the raw document name holds two of the key words of the expected one (all, if it has fewer)."""
    kw = keywords(strip_case(symptom))
    hits = F.size(F.filter(kw, lambda k: F.contains(F.lower(document), k)))
    return F.coalesce((F.size(kw) > 0) & (hits >= F.least(F.lit(2), F.size(kw))), F.lit(False))


#: Conditions whose documents go by other names.
SYNONYMS = {
    "abdominal_aortic_aneurysm": ["aortic", "aneurysm"],
    "acute_myocardial_infarction": ["heart_attack", "myocardial", "cardiac"],
    "asthma": ["asthma"],
    "migraine": ["migraine"],
}


def relevant_by_synonym(symptom: Column, document: Column, synonyms: dict[str, list[str]] = SYNONYMS) -> Column:
    """Whether a document name holds the symptom, or, for the first known condition in the symptom, one of its other names."""
    s, d = F.lower(strip_case(symptom)), F.lower(document)
    out = F.when(F.contains(d, s), True)
    for condition, names in synonyms.items():
        other = F.lit(False)
        for n in names:
            other = other | F.contains(d, F.lit(n))
        out = out.when(F.contains(s, F.lit(condition)), other)
    return F.coalesce(out.otherwise(False), F.lit(False))


def pass_at_k(hits: DataFrame, cases: DataFrame, by: list[str], case: str, rank: str, relevant: Column, ks: list[int]) -> DataFrame:
    """``by, cases, pass_at_<k>``: share of all cases with a relevant hit among the first k; a case without hits fails.

    ``cases`` holds each (by, case) that counts; the first relevant rank of a case is one aggregate, whatever the number of ks.
    """
    first = hits.groupBy(*by, case).agg(F.min(F.when(relevant, F.col(rank))).alias("_first"))
    all_ = cases.select(*by, case).distinct().join(first, [*by, case], "left")
    return all_.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"), *(F.avg(F.coalesce((F.col("_first") <= k).cast("int"), F.lit(0))).alias(f"pass_at_{k}") for k in ks))


def any_vote(label: Column, order: tuple[str, ...] = ("ED", "GP", "HOME")) -> Column:
    """Aggregate: the first label of ``order`` that any row has, else UNKNOWN."""
    out = None
    for x in order:
        has = F.coalesce(F.bool_or(label == x), F.lit(False))
        out = F.when(has, x) if out is None else out.when(has, x)
    return out.otherwise("UNKNOWN")


def known_label(c: Column, other: str) -> Column:
    return F.when(c.isin(LABELS[:3]), c).otherwise(other)


def confusion(df: DataFrame, by: list[str], truth: str, predicted: str) -> DataFrame:
    """``by, true_label, pred_label, n`` with all 16 cells of every group, zeros included.

    Truths outside the labels count as GP and predictions as UNKNOWN; nulls likewise.
    """
    spark = df.sparkSession
    counted = df.select(*by, known_label(F.col(truth), "GP").alias("true_label"), known_label(F.col(predicted), "UNKNOWN").alias("pred_label"))
    counted = counted.groupBy(*by, "true_label", "pred_label").agg(F.count(F.lit(1)).alias("n"))
    spine = spark.createDataFrame([(t, p) for t in LABELS for p in LABELS], "true_label string, pred_label string")
    groups = counted.select(*by).distinct() if by else spark.range(1).select()
    full = groups.crossJoin(F.broadcast(spine)).join(counted, [*by, "true_label", "pred_label"], "left")
    return full.withColumn("n", F.coalesce("n", F.lit(0)))


def class_report(cells: DataFrame, by: list[str], beta: float = 2.0) -> DataFrame:
    """``by, label, precision, recall, f1, fbeta, support`` from :func:`confusion`; undefined ratios are 0."""
    both = F.array(F.struct(F.col("true_label").alias("label"), F.lit(True).alias("t")), F.struct(F.col("pred_label").alias("label"), F.lit(False).alias("t")))
    e = cells.select(*by, "true_label", "pred_label", "n", F.explode(both).alias("e")).select(*by, "e.label", "e.t", "n", (F.col("true_label") == F.col("pred_label")).alias("hit"))
    s = e.groupBy(*by, "label").agg(
        F.sum(F.when(F.col("hit") & F.col("t"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("t"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(~F.col("t"), F.col("n")).otherwise(0)).alias("predicted"),
    )
    zero = F.lit(0.0)
    s = s.withColumn("precision", F.coalesce(F.try_divide("tp", "predicted"), zero)).withColumn("recall", F.coalesce(F.try_divide("tp", "support"), zero))

    def f(b: float) -> Column:
        p, r = F.col("precision"), F.col("recall")
        return F.coalesce(F.try_divide((1 + b * b) * p * r, b * b * p + r), zero)

    return s.select(*by, "label", "precision", "recall", f(1.0).alias("f1"), f(beta).alias("fbeta"), "support")


def weighted_scores(report: DataFrame, by: list[str]) -> DataFrame:
    """``by, weighted_f1, weighted_f2, macro_f1, clinical_f2``: by support, over four labels, and by the clinical weights."""
    w = F.col("support")
    clinical = sum((F.sum(F.when(F.col("label") == k, v * F.col("fbeta")).otherwise(0.0)) for k, v in WEIGHTS.items()), F.lit(0.0)) / sum(WEIGHTS.values())
    mean = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * w), F.sum(w)), F.lit(0.0))
    aggs = [mean("f1").alias("weighted_f1"), mean("fbeta").alias("weighted_f2"), (F.sum("f1") / len(LABELS)).alias("macro_f1"), clinical.alias("clinical_f2")]
    return report.groupBy(*by).agg(*aggs) if by else report.agg(*aggs)


def safety_gate(report: DataFrame, by: list[str]) -> DataFrame:
    """``by, ed_recall, ed_f2, ed_fnr, safe``: emergency recall of .95, F2 of .90 and at most .05 missed."""
    ed = report.where("label = 'ED'").select(*by, F.col("recall").alias("ed_recall"), F.col("fbeta").alias("ed_f2"), (1 - F.col("recall")).alias("ed_fnr"))
    return ed.withColumn("safe", (F.col("ed_recall") >= 0.95) & (F.col("ed_f2") >= 0.90) & (F.col("ed_fnr") <= 0.05))


def vote_uncertainty(votes: DataFrame, by: list[str], label: str, limit: float = 0.3) -> DataFrame:
    """``by, majority, confidence, entropy, uncertain`` of repeated votes; ties go to the smallest label, null votes are left out."""
    n = votes.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy(*by)))
    out = p.groupBy(*by).agg(
        F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("majority"), F.max("p").alias("confidence"), F.abs(F.sum(F.col("p") * F.log(F.col("p") + 1e-10))).alias("entropy")
    )
    return out.withColumn("uncertain", F.col("entropy") > limit)


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key: the one with the greatest ``order``, all columns kept; rows that differ in nothing else are one."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(order), F.xxhash64(*rest))).alias("_r"))
    return best.select(*keys, "_r.*").select(df.columns)


def production_gate(quality: Column, ms: Column, least: float = 0.85, most: float = 50.0) -> Column:
    """Whether a configuration is above ``least`` (a share) and below ``most`` milliseconds; missing figures fail."""
    return F.coalesce((quality > least) & (ms < most), F.lit(False))


def case_record(df: DataFrame) -> DataFrame:
    """Results as records: a failed case has the label ERROR, zeros and a message, a successful one no message; nothing is thrown away."""
    ok = F.coalesce(F.col("success"), F.lit(False))
    right = F.coalesce(ok & (F.col("predicted_triage") == F.col("expected_triage")), F.lit(False))
    zero = lambda c: F.when(ok, F.col(c)).otherwise(F.lit(0).cast(df.schema[c].dataType)).alias(c)
    return df.select(
        "case_id", "config", F.when(ok, F.coalesce("predicted_triage", F.lit("UNKNOWN"))).otherwise("ERROR").alias("predicted"), right.alias("is_correct"), zero("inference_time"), zero("rag_time"), zero("context_length"),
        F.when(~ok, F.coalesce("error", F.lit("unknown error"))).alias("error"),
    )
