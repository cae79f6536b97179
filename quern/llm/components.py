"""Connected components by alternating large-star and small-star steps, as grouped minima and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import dropped, salted_lookup, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of its neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = salted_lookup(both, least, "u", "v", how="inner", few=0)
    return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = salted_lookup(down, least, "u", "v", how="inner", few=0).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 40) -> DataFrame:
    """``node`` and ``component`` (the smallest node of it) of every node of an edge; loops give a component of one node.

    Edges may repeat and have any direction; edges with a null end are ignored; no edges give no rows. Neighbour lists are never
    collected: minima are aggregated before the shuffle and looked up with hot nodes salted. Each round is written to the shared
    folder, which cuts the lineage; it ends when a round changes no edge.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    loops = e.select("u").unionByName(e.select(F.col("v").alias("u"))).distinct()
    loops = written(loops, "nodes")
    now = written(e.where("u <> v").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        then = written(_small_star(_large_star(now)).distinct(), "edges")
        mark = then.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        dropped(now)
        now = then
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"no fixed point in {max_rounds} rounds")
    roots = now.groupBy("u").agg(F.min("v").alias("component"))
    return loops.join(roots, "u", "left").select(F.col("u").alias("node"), F.coalesce("component", "u").alias("component"))
