"""Seeded samples and splits that give the same rows on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.ordering import group_ranks


def stratified(df: DataFrame, stratum: Column, quotas: dict[str, int], order: list[Column]) -> DataFrame:
    """The first ``quotas[stratum]`` rows of each stratum in ``order``; short strata are taken whole, others not at all."""
    most = max(quotas.values(), default=0)
    q = F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv))
    t = df.withColumn("stratum", stratum).where(F.col("stratum").isin(*quotas))
    t = t.withColumn("rn", F.row_number().over(W.partitionBy("stratum").orderBy(*order))).where(F.col("rn") <= most)
    return t.where(F.col("rn") <= q[F.col("stratum")])


def split_within_groups(df: DataFrame, group: str, order: list[str], train: float = 0.7, val: float = 0.15) -> DataFrame:
    """``df`` with ``part``: within each group the first max(1, floor(.7 n)) rows train, the next max(1, floor(.15 n)) validate, the rest test.

    A group of more than two rows without test rows moves one from training to testing. Null groups are one group; a group may hold
    any share of all rows (:func:`quern.operators.ordering.group_ranks`).
    """
    t = group_ranks(df, [group], order)
    tr = F.greatest(F.lit(1), F.floor(F.lit(train) * F.col("_n") + 1e-9))
    va = F.greatest(F.lit(1), F.floor(F.lit(val) * F.col("_n") + 1e-9))
    moved = F.when((F.col("_n") - tr - va <= 0) & (F.col("_n") > 2), tr - 1).otherwise(tr)
    return t.withColumn("part", F.when(F.col("_i") <= moved, "train").when(F.col("_i") <= moved + va, "val").otherwise("test")).drop("_n", "_i")
