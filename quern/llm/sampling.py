"""Samples that match target category proportions, with floors for small categories.

Records are grouped by their category signature; a plan's sample is settled on the counts of signatures alone. It starts from a
seeded random sample of the right size that satisfies every floor, then swap repair exchanges counts between the signature
furthest above its target and the one furthest below it for as long as that lowers the total deviation. Only then are records
drawn, at random, to fill the counts. The driver holds one number for each plan and category, whatever the size of the data.
"""

from __future__ import annotations

import random
from decimal import ROUND_CEILING, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import written

SHARE = T.DecimalType(18, 9)
BUCKETS = 4096
SEED = 42


def triage_category(c: Column) -> Column:
    """ED, GP, HOME, ERROR or UNKNOWN of a free-text decision.

    Failed generations come first (their message may name anything), then texts that state no decision; null, empty and blank text
    state none. Emergency beats practice beats home where several are named.
    """
    t = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}&]+", " "))
    dotless = F.regexp_replace(t, r"\b(e|g|a) (d|p|e)\b", "$1$2")
    return (
        F.when(dotless.rlike(r"\b(error|err|exception|failed|failure|timeout|timed out|traceback|crash(ed)?)\b"), "ERROR")
        .when(dotless.rlike(r"\b(un|not |in)(known|decided|determined|clear|certain|sure|specified|stated|available|conclusive)\b|\bundetermined\b|\b(unkn?|na|n a|none|null|nil|nan|tbd|tbc|pending)\b"), "UNKNOWN")
        .when(dotless.rlike(r"\b(ed|er|ae|a&e|a & e|emergency|emergencies|ambulance|hospital|111|911|999)\b"), "ED")
        .when(dotless.rlike(r"\b(gp|gps|general pract\w*|practitioner|practice|family (doctor|physician)|doctors?|physician|clinic|primary care|medical cent(re|er))\b"), "GP")
        .when(dotless.rlike(r"\b(home|self ?care|selfcare|self manage\w*|self treat\w*|pharmacy|rest)\b"), "HOME")
        .otherwise("UNKNOWN")
    )


def category_counts(df: DataFrame, category: Column) -> DataFrame:
    """``category`` and ``available``, the number of records of it."""
    return df.groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("available"))


def availability(df: DataFrame, category: Column, targets: DataFrame) -> DataFrame:
    """Each row of ``targets`` with ``available``, the plan's ``sample_size``, ``needed`` (exact decimal) and ``falls_short``.

    A category without records is available 0 times; every record counts towards the size, whatever its category.
    """
    counts = written(category_counts(df, category), "category-counts")  # a row a category, read twice
    total = counts.agg(F.coalesce(F.sum("available"), F.lit(0)).alias("n_rows"))
    want = targets.select("plan", "category", *(F.col(c).cast(SHARE).alias(c) for c in ("target_share", "min_share", "sample_share")))
    t = want.crossJoin(F.broadcast(total)).join(F.broadcast(counts), "category", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    needed = F.greatest("target_share", "min_share") * F.col("sample_share") * F.col("n_rows").cast(T.DecimalType(14, 0))
    return t.withColumn("needed", needed).withColumn("falls_short", F.col("available") < F.col("needed"))


def swap_repair(size: int, wanted: dict[str, float], floors: dict[str, int], available: dict[str, int], seed: int = SEED) -> dict[str, int]:
    """Counts of each category in a sample of ``size`` (fewer if too few records exist).

    Starts from a random sample that satisfies the floors (each as far as records exist) and exchanges counts until no exchange
    lowers the total absolute deviation from ``wanted``.
    """
    names = sorted(wanted)
    size = min(size, sum(available.get(c, 0) for c in names))
    take = {c: min(floors.get(c, 0), available.get(c, 0)) for c in names}
    low = dict(take)
    while (over := sum(take.values()) - size) > 0:  # floors beyond the size: the largest give way
        c = max(names, key=lambda x: (take[x], x))
        take[c] -= min(over, max(1, take[c] - sorted(take.values())[-2] if len(names) > 1 else over))
        low[c] = take[c]
    rng = random.Random(seed)
    left = size - sum(take.values())
    while left > 0:  # the random start: what is left goes to records drawn at random
        open_ = [c for c in names if take[c] < available.get(c, 0)]
        weights = [available[c] - take[c] for c in open_]
        for c, w in zip(open_, weights):
            got = min(w, left, round(left * w / sum(weights) * rng.uniform(0.5, 1.0)) + 1)
            take[c] += got
            left -= got
            if not left:
                break
    while True:
        up = max((c for c in names if take[c] > low[c]), key=lambda c: take[c] - wanted[c], default=None)
        down = min((c for c in names if take[c] < available.get(c, 0)), key=lambda c: take[c] - wanted[c], default=None)
        if up is None or down is None or up == down:
            return take
        a, b = take[up] - wanted[up], wanted[down] - take[down]
        k = max(1, min(int(min(a, b)), take[up] - low[up], available[down] - take[down]))
        if abs(a - k) + abs(b - k) >= abs(a) + abs(b) - 1e-9:
            return take
        take[up] -= k
        take[down] += k


def planned_counts(rows: list) -> list[tuple]:
    """Settles all plans: (plan, category, sample_size, available, wanted, floor, taken) from the rows of :func:`availability`."""
    out = []
    for plan in sorted({r["plan"] for r in rows}):
        own = [r for r in rows if r["plan"] == plan]
        size = int((own[0]["sample_share"] * own[0]["n_rows"]).to_integral_value(ROUND_CEILING))
        wanted = {r["category"]: float(r["target_share"] * r["sample_share"] * r["n_rows"]) for r in own}
        floors = {r["category"]: int((r["min_share"] * r["sample_share"] * r["n_rows"]).to_integral_value(ROUND_CEILING)) for r in own}
        available = {r["category"]: int(r["available"]) for r in own}
        floored = {c: max(wanted[c], floors[c]) for c in wanted}
        scale = Decimal(size) / Decimal(max(1e-9, sum(floored.values())))
        aim = {c: floored[c] * float(min(scale, 1)) for c in floored}
        taken = swap_repair(size, aim, floors, available)
        out += [(plan, c, size, available[c], wanted[c], floors[c], taken[c]) for c in sorted(wanted)]
    return out


def shortfalls(rows: list) -> list[tuple]:
    """(plan, category) whose need no sample can meet, from the rows of :func:`availability`.

    Swap repair settles each plan with every category's need as its target; where no exchange is left and a category is still
    below its need, records of it have run out.
    """
    out = []
    for plan in sorted({r["plan"] for r in rows}):
        own = {r["category"]: r for r in rows if r["plan"] == plan}
        need = {c: int(r["needed"].to_integral_value(ROUND_CEILING)) for c, r in own.items()}
        taken = swap_repair(sum(need.values()), need, dict.fromkeys(need, 0), {c: int(r["available"]) for c, r in own.items()})
        out += [(plan, c) for c in sorted(need) if taken[c] < need[c]]
    return out


PLANNED = "plan string, category string, sample_size long, available long, wanted double, floor long, taken long"


def proportional_sample(df: DataFrame, key: str, category: Column, targets: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(sample, report): ``plan, category, <key>`` of the drawn records, and ``PLANNED`` with the count taken of each category.

    A record may be in the samples of several plans, in each once. Exact: the hash of a record's key orders its category, a
    histogram of the hashes finds the bucket that the count ends in, and only that bucket is ranked, so that no task ever holds a
    category. Categories that no plan names are never drawn; repeated keys count as records of their own.
    """
    spark = df.sparkSession
    rows = availability(df, category, targets).collect()
    planned = spark.createDataFrame(planned_counts(rows), PLANNED)
    cells = df.select(F.col(key), category.alias("category"), F.xxhash64(F.col(key), F.lit(seed)).alias("_h"))
    cells = cells.withColumn("_b", F.pmod(F.shiftright("_h", 20), F.lit(BUCKETS)).cast("int"))
    histogram = cells.groupBy("category", "_b").agg(F.count(F.lit(1)).alias("_n"))
    run = W.partitionBy("category").orderBy("_b")
    ends = histogram.withColumn("_end", F.sum("_n").over(run)).withColumn("_start", F.col("_end") - F.col("_n"))
    # for each plan: the buckets wholly in, and how many records of the one it ends in
    cut = planned.where("taken > 0").select("plan", "category", "taken").join(ends, "category").where("_start < taken")
    cut = cut.select("plan", "category", "_b", F.least(F.col("_n"), F.col("taken") - F.col("_start")).alias("_want"), F.col("_n"))
    plans = cut.groupBy("category", "_b").agg(F.collect_list(F.struct("plan", "_want")).alias("_plans"), F.max(F.col("_want") < F.col("_n")).alias("_partly"))
    hit = cells.join(F.broadcast(plans), ["category", "_b"])  # categories x buckets rows at most, each with a struct a plan
    inside = hit.where(~F.col("_partly")).select(key, "category", F.explode("_plans.plan").alias("plan"))
    rank = F.row_number().over(W.partitionBy("category", "_b").orderBy("_h", key))
    edge = hit.where("_partly").withColumn("_r", rank).select(key, "category", "_r", F.explode("_plans").alias("p")).where("_r <= p._want")
    sample = inside.unionByName(edge.select(key, "category", F.col("p.plan").alias("plan"))).select("plan", "category", key)
    return sample, planned
