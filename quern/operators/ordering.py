"""Ranks over whole tables and large groups: sorted by ranges, so that no task holds more than one range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.session import written


def seeded(c: Column | str, seed: int = 42) -> Column:
    """A text that orders rows at random, the same on every run and engine: md5 of the key and the seed."""
    return F.md5(F.concat_ws(":", F.col(c) if isinstance(c, str) else c, F.lit(str(seed))).cast("binary"))


def _order(names: list[str]) -> list[Column]:
    return [F.col(n[1:]).desc() if n.startswith("-") else F.col(n).asc() for n in names]


def row_numbers(df: DataFrame, order: list[str], name: str = "rn") -> DataFrame:
    """``df`` with ``name``, the number of each row (from 1) in ``order``: names of columns, with a minus sign for descending ones.

    The order should end in a key. Rows are dealt into ranges of the order; a range's rows are numbered by themselves and moved by
    the number of rows in the ranges before (one small row a range). Nulls come first, as in Spark; empty tables stay empty.
    """
    t = written(df.repartitionByRange(*_order(order)).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = t.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row a range
    own = F.row_number().over(W.partitionBy("_range").orderBy(*_order(order)))
    return t.join(F.broadcast(before), "_range").withColumn(name, (own + F.col("_before")).cast("long")).select(*df.columns, name)


def group_ranks(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``_i``, the row's number within its group, and ``_n``, the group's size; a group may hold any share of all rows.

    Null groups are one group. Rows are numbered over the whole table in the order of their groups; a group's first number and its
    size are aggregates.
    """
    t = row_numbers(df, [*by, *order], "_rn")
    g = t.groupBy(*by).agg(F.min("_rn").alias("_first"), F.count(F.lit(1)).alias("_n")).withColumnsRenamed({c: f"_g_{c}" for c in by})
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return t.join(g, on).withColumn("_i", F.col("_rn") - F.col("_first") + 1).select(*df.columns, "_i", "_n")


def exact_quantiles(df: DataFrame, by: str, value: str, shares: list[float]) -> DataFrame:
    """``by, share, value``: exact quantiles of each group with linear interpolation; nulls are left out.

    No group is ever held in one task: the rows next to each quantile are picked by their number within the group.
    """
    t = group_ranks(df.where(F.col(value).isNotNull()).select(by, value), [by], [value])
    at = F.explode(F.array(*(F.lit(float(s)) for s in shares)))
    t = t.withColumn("share", at).withColumn("_at", F.col("share") * (F.col("_n") - 1) + 1)
    near = t.where((F.col("_i") == F.floor("_at")) | (F.col("_i") == F.ceil("_at")))
    weight = 1 - F.abs(F.col("_at") - F.col("_i"))
    return near.groupBy(by, "share").agg(F.sum(F.col(value) * weight).alias("value"))


def batches(df: DataFrame, order: list[str], size: int = 100) -> DataFrame:
    """``df`` with ``id`` (from 1 in ``order``) and ``batch``, so that each batch but the last has ``size`` rows."""
    t = row_numbers(df, order, "id")
    return t.withColumn("batch", F.floor((F.col("id") - 1) / size))
