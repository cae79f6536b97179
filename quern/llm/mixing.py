"""Mixing sources to target token weights.

The tokens a mix asks for are cut into blocks of equal size. Sainte-Laguë apportionment gives the blocks to the sources, always
to the highest quotient weight / (2 * blocks so far + 1) among the sources that still have tokens within their repeat cap; the
blocks of a source go to its shards (hash ranges of documents) in the same way, in proportion to the shards' tokens. The seeded order
of a shard's documents is cut into blocks, of which its quota is taken: whole passes first, then the blocks of part of one more.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import written

BLOCKS = 10_000
SLOTS = 4096
SHARD_DOCS = 500
SEED = 42
SHARE = T.DecimalType(18, 9)


def source_tokens(counted: DataFrame, source: Column, named: list[str]) -> DataFrame:
    """``source_key`` and its ``tokens`` for the ``named`` sources; all other documents are one row with a null key."""
    return counted.groupBy(F.when(source.isin(named), source).alias("source_key")).agg(F.sum("n_tokens").alias("tokens"))


def mix_capacity(counted: DataFrame, source: Column, targets: DataFrame, target_source: Column) -> DataFrame:
    """Each row of ``targets`` with ``tokens`` of its source, ``all_tokens``, ``asked`` and ``capacity`` (with repeats).

    Shares are exact decimals. A source without documents has 0 tokens; documents without source count in ``all_tokens`` only.
    ``targets`` is a small table of settings; only its sources have rows of their own.
    """
    want = targets.withColumn("source_key", target_source)
    named = [r[0] for r in want.select("source_key").where("source_key is not null").distinct().collect()]
    per = written(source_tokens(counted, source, named), "source-tokens")  # one row a target source, read twice
    total = per.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"))
    t = want.join(F.broadcast(per), "source_key", "left").crossJoin(F.broadcast(total))
    t = t.withColumn("tokens", F.coalesce("tokens", F.lit(0))).withColumn("capacity", F.col("tokens") * F.col("max_repeats"))
    asked = F.col("weight").cast(SHARE) * F.col("size_share").cast(SHARE) * F.col("all_tokens").cast(T.DecimalType(20, 0))
    return t.withColumn("asked", asked)


def apportion(blocks: int, weights: dict, caps: dict) -> dict:
    """Sainte-Laguë: integer blocks of each key, never above its cap; fewer in all if the caps don't allow more."""
    got = dict.fromkeys(weights, 0)
    queue = [(-w, str(k), k) for k, w in weights.items() if w > 0 and caps[k] > 0]
    heapq.heapify(queue)
    for _ in range(blocks):
        if not queue:
            break
        _, s, k = heapq.heappop(queue)
        got[k] += 1
        if got[k] < caps[k]:
            heapq.heappush(queue, (-weights[k] / (2 * got[k] + 1), s, k))
    return got


def block_quotas(rows: list, blocks: int = BLOCKS) -> list[dict]:
    """Each target row with ``block`` (tokens), its ``quota`` by the weights alone, the ``blocks`` it gets and whether it ``falls_short``.

    Apportionment by the weights alone gives the quota. A source that runs out before it has its quota falls short; what it leaves
    goes to the others by the same quotients, so the mix keeps its size as long as any source has blocks left.
    """
    out = []
    for mix in sorted({r["mix"] for r in rows}):
        own = {r["source"]: r for r in rows if r["mix"] == mix}
        weights = {k: float(r["weight"]) for k, r in own.items()}
        block = max(1.0, float(sum(r["asked"] for r in own.values())) / blocks)
        n = round(float(sum(r["asked"] for r in own.values())) / block)
        quota = apportion(n, weights, dict.fromkeys(weights, n))
        caps = {k: int(r["capacity"] // block) for k, r in own.items()}
        got = apportion(n, weights, caps)
        out += [dict(mix=mix, source=k, source_key=r["source_key"], block=block, quota=quota[k], blocks=got[k], falls_short=got[k] < quota[k], row=r) for k, r in own.items()]
    return out


def shard_counts(sizes: list) -> dict[str, int]:
    """Shards of each source: a power of two up to ``SLOTS`` that leaves ``SHARD_DOCS`` documents or more to a shard, so that cutting inside documents hardly matters."""
    docs: dict[str, int] = {}
    for r in sizes:
        docs[r["source_key"]] = docs.get(r["source_key"], 0) + r["docs"]
    return {k: max(1, 1 << max(0, min(SLOTS, d // SHARD_DOCS).bit_length() - 1)) for k, d in docs.items()}


def shard_quotas(quotas: list[dict], sizes: list, counts: dict[str, int]) -> list[tuple]:
    """(mix, source_key, shard, blocks, tokens of a block, max_repeats): the blocks of a source apportioned to its shards by their tokens."""
    of: dict = {}
    for r in sizes:
        own = of.setdefault(r["source_key"], {})
        s = r["slot"] * counts[r["source_key"]] // SLOTS
        own[s] = own.get(s, 0) + r["tokens"]
    out = []
    for q in quotas:
        shards, repeats = of.get(q["source_key"], {}), int(q["row"]["max_repeats"])
        room = {s: int(-(-t * repeats // q["block"])) for s, t in shards.items()}
        out += [(q["mix"], q["source_key"], s, n, q["block"], repeats) for s, n in apportion(q["blocks"], shards, room).items() if n]
    return out


def mixed(counted: DataFrame, key: str, source: Column, targets: DataFrame, target_source: Column, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(selection, report).

    selection: ``mix, source_key, <key>, repeats, tokens`` (of one copy); no document occurs more than its ``max_repeats``.
    report: each target row with ``asked``, ``taken`` tokens, ``target_share`` and ``actual_share`` of the mix, and ``falls_short``.
    ``counted`` has ``n_tokens`` (:func:`quern.llm.tokenizer.token_counts`); documents without tokens or source are never chosen.
    """
    spark = counted.sparkSession
    docs = counted.select(F.col(key), source.alias("source_key"), "n_tokens")
    rows = mix_capacity(counted, source, targets, target_source).collect()  # the target rows
    quotas = block_quotas(rows)
    docs = docs.where(F.col("source_key").isin([r["source_key"] for r in rows]) & (F.col("n_tokens") > 0)).withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)))
    docs = docs.withColumn("slot", F.pmod("_h", F.lit(SLOTS)).cast("int"))
    sizes = docs.groupBy("source_key", "slot").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).collect()  # target sources x SLOTS rows
    counts = shard_counts(sizes)
    shards = spark.createDataFrame(shard_quotas(quotas, sizes, counts), "mix string, source_key string, shard int, blocks long, block double, max_repeats int")
    layout = F.broadcast(spark.createDataFrame(list(counts.items()), "source_key string, _shards int"))
    docs = docs.join(layout, "source_key").withColumn("shard", F.floor(F.col("slot") * F.col("_shards") / SLOTS).cast("int"))
    order = W.partitionBy("source_key", "shard").orderBy("_h", key)
    ran = docs.withColumn("_end", F.sum("n_tokens").over(order)).withColumn("_all", F.sum("n_tokens").over(W.partitionBy("source_key", "shard")))
    hit = ran.join(F.broadcast(shards), ["source_key", "shard"])
    # the seeded order is cut into blocks; a document is of the block that holds its middle, and whole passes over the shard come first
    quota = F.least(F.col("blocks") * F.col("block"), F.col("_all") * F.col("max_repeats"))
    passes = F.floor(quota / F.col("_all"))
    block = F.floor((F.col("_end") - F.col("n_tokens") / 2) / F.col("block"))
    more = (block < F.round((quota - passes * F.col("_all")) / F.col("block"))).cast("long")
    chosen = hit.withColumn("repeats", F.least(F.col("max_repeats").cast("long"), passes + more)).where("repeats > 0")
    chosen = chosen.select("mix", "source_key", key, "repeats", F.col("n_tokens").alias("tokens"))
    taken = chosen.groupBy("mix", "source_key").agg(F.sum(F.col("repeats") * F.col("tokens")).alias("taken"))
    small = spark.createDataFrame(
        [(q["mix"], q["source"], q["source_key"], float(q["row"]["weight"]), float(q["row"]["asked"]), int(q["quota"]), int(q["blocks"]), int(q["row"]["capacity"]), q["falls_short"]) for q in quotas],
        "mix string, source string, source_key string, target_share double, asked double, quota long, blocks long, capacity long, falls_short boolean",
    )
    report = small.join(F.broadcast(taken), ["mix", "source_key"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    report = report.withColumn("actual_share", F.try_divide("taken", F.sum("taken").over(W.partitionBy("mix"))))
    return chosen, report.select("mix", "source", "target_share", "actual_share", "asked", "taken", "quota", "blocks", "capacity", "falls_short")


def short_sources(counted: DataFrame, source: Column, targets: DataFrame, target_source: Column) -> DataFrame:
    """``mix, source`` of the targets whose source runs out of blocks before it has its quota (:func:`block_quotas`)."""
    quotas = block_quotas(mix_capacity(counted, source, targets, target_source).collect())
    return counted.sparkSession.createDataFrame([(q["mix"], q["source"]) for q in quotas if q["falls_short"]], "mix string, source string")
