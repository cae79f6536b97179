"""Tables over evaluation results: gains, ranks, pivots, pairs, correlation and distribution."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.ordering import row_numbers


def marginal_gains(df: DataFrame, by: list[str], points: list[tuple[int, str]]) -> DataFrame:
    """``by, from_k, to_k, gain, gain_per_step, cumulative_gain``: differences of the means at adjacent points; long form of a wide row."""
    means = df.groupBy(*by).agg(*(F.avg(c).alias(c) for _, c in points))
    long = means.select(*by, F.explode(F.array(*(F.struct(F.lit(k).alias("to_k"), F.col(c).alias("value")) for k, c in points))).alias("p")).select(*by, "p.*")
    w = W.partitionBy(*by).orderBy("to_k")
    out = long.select(*by, F.lag("to_k").over(w).alias("from_k"), "to_k", (F.col("value") - F.lag("value").over(w)).alias("gain"))
    run = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    out = out.where("from_k is not null").withColumn("cumulative_gain", F.sum("gain").over(run))
    return out.select(*by, "from_k", "to_k", "gain", (F.col("gain") / (F.col("to_k") - F.col("from_k"))).alias("gain_per_step"), "cumulative_gain")


def side_by_side_ranks(df: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """``df`` with ``<metric>_rank`` of each metric, best first, ties by key; each rank is a distributed sort."""
    out = df
    for m in metrics:
        out = row_numbers(out, [f"-{m}", key], f"{m}_rank")
    return out


def scaled(df: DataFrame, c: str, name: str) -> DataFrame:
    """``df`` with ``name``, the min-max scaled ``c``: (x - min) / (max - min + 1e-10); the extremes are one broadcast row."""
    ends = df.agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"))
    return df.crossJoin(F.broadcast(ends)).withColumn(name, (F.col(c) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-10)).drop("_lo", "_hi")


def paired_difference(df: DataFrame, keys: list[str], kind: str, a: str, b: str, value: str) -> DataFrame:
    """``keys, value_a, value_b, diff`` where both kinds exist; means where a kind repeats."""
    m = df.groupBy(*keys).agg(F.avg(F.when(F.col(kind) == a, F.col(value))).alias("value_a"), F.avg(F.when(F.col(kind) == b, F.col(value))).alias("value_b"))
    return m.where("value_a is not null and value_b is not null").withColumn("diff", F.col("value_a") - F.col("value_b"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """``x, y, r`` for each pair of columns, in one pass."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*(F.corr(x, y).alias(f"{x}|{y}") for x, y in pairs))
    return row.select(F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"`{x}|{y}`").alias("r")) for x, y in pairs))).alias("c")).select("c.*")


def histogram(df: DataFrame, c: str, bins: int) -> DataFrame:
    """``bin`` (1..bins), ``n``: equal bins between the extremes, the last one closed; nulls are left out."""
    ends = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"))
    at = F.least(F.lit(bins), F.floor((F.col(c) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)) + 1)
    return df.where(F.col(c).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def right_closed(c: str, edges: list[float]) -> Column:
    """Number of the bin (edges[i-1], edges[i]] of a value, null outside."""
    e = None
    for i in range(1, len(edges)):
        inside = (F.col(c) > edges[i - 1]) & (F.col(c) <= edges[i])
        e = F.when(inside, i) if e is None else e.when(inside, i)
    return e


def map_shares(m: Column) -> Column:
    """Percentage of each value of a map of counts in their sum; an empty sum gives nulls."""
    total = F.aggregate(F.map_values(m), F.lit(0).cast("double"), lambda s, x: s + x)
    return F.transform_values(m, lambda _, v: F.try_divide(100.0 * v, total))


def overlap_gain(df: DataFrame, method: str, value: str) -> DataFrame:
    """``base, without, with_, gain``: mean ``value`` of a base method (its name without ``_o<n>``) with overlap and without (``_o0`` or none)."""
    base = F.regexp_replace(method, r"_o\d+", "")
    plain = ~F.col(method).rlike(r"_o[1-9]")
    g = df.groupBy(base.alias("base")).agg(F.avg(F.when(plain, F.col(value))).alias("without"), F.avg(F.when(~plain, F.col(value))).alias("with_"))
    return g.where("without is not null and with_ is not null").withColumn("gain", F.col("with_") - F.col("without"))
