"""Splits that keep related records together.

Records are linked to the entities they name; entities that are one thing under several names are linked to each other. The
connected components of that graph (alternating large-star and small-star) are the groups; a hash of the component places it
in the split ranges. Records only enter the graph through their distinct entity names, so its size is that of the vocabulary in
use; a name held by a third of all records is one node.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.components import connected_components
from quern.session import salted_lookup, written

#: Letters written in several ways, and what file names add to a name.
ACCENTED = "áàâäãåāéèêëēíìîïīóòôöõōúùûüūçñ"
PLAIN = "aaaaaaaeeeeeiiiiioooooouuuuucn"
SUFFIXES = r"(\s+(txt|json|md|html?|pdf|csv|docx?|structured|case\s*\d*))+$"
HEAVY = 0.005
SLOTS = 4096
SEED = 42


def name_words(c: Column, fold: bool = True) -> Column:
    """The words of a name in one spelling: percent codes decoded, accents, case number and file suffix removed, ae/oe written e if ``fold``."""
    t = F.coalesce(F.try_url_decode(F.regexp_replace(c, r"\+", " ")), c)
    t = F.regexp_replace(F.lower(t), r"[\p{Cf}]+", "")
    t = F.regexp_replace(F.regexp_replace(F.translate(t, ACCENTED, PLAIN), "œ", "oe"), "æ", "ae")
    t = F.regexp_replace(t, "[oa]e", "e") if fold else t
    t = F.regexp_replace(t, r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(F.regexp_replace(F.concat(F.lit(" "), F.trim(t)), SUFFIXES, ""), " "), lambda w: w != "")


def name_key(words: Column) -> Column:
    """One key for the same words in any order; null if there are none."""
    return F.when(F.size(words) > 0, F.array_join(F.array_sort(words), " "))


def _stubs(word: Column) -> Column:
    """A word and all it becomes by losing one letter."""
    n = F.length(word)
    return F.array_distinct(F.concat(F.array(word), F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))))


def word_corrections(words: DataFrame, vocabulary: DataFrame, shortest: int = 4) -> DataFrame:
    """``word`` and the ``right`` vocabulary words within one edit (letter lost, added, changed or moved); words with digits have none.

    Both frames have ``word`` and ``raw``, the word before ae and oe are folded, as an edit may fall on these. Pairs meet on what
    their words or raw words become by losing a letter, so no two lists are crossed.
    """
    letters = ~F.col("word").rlike(r"\p{N}")
    stubs = lambda: F.explode(F.array_union(_stubs(F.col("word")), _stubs(F.col("raw")))).alias("stub")
    a = words.where((F.length("raw") >= shortest) & letters).select("word", "raw", stubs())
    b = vocabulary.where((F.length("raw") >= shortest - 1) & letters).select("word", "raw", stubs()).withColumnsRenamed({"word": "right", "raw": "right_raw"})
    near = F.lit(False)
    for x, y in (("word", "right"), ("raw", "right_raw")):
        moved = (F.length(x) == F.length(y)) & (F.array_sort(F.split(x, "")) == F.array_sort(F.split(y, "")))
        near = near | (F.levenshtein(x, y) <= 1) | moved
    return a.join(b, "stub").where(near).groupBy("word").agg(F.collect_set("right").alias("right"))


def name_links(df: DataFrame, name: str, vocabulary: DataFrame) -> DataFrame:
    """``key`` of each distinct name in ``df`` and ``entity``, the vocabulary entry it names, null if none or several.

    ``vocabulary`` has ``entity`` and ``name`` (one row a name, thousands at most). A key that is no vocabulary key is held against the
    names of as many words: it is one whose words can be paired with the key's words or their corrections. Names of one entity count.
    """
    spelled = lambda c: (name_words(F.col(c)).alias("words"), name_words(F.col(c), fold=False).alias("raws"))
    names = vocabulary.select("entity", *spelled("name")).withColumn("key", name_key(F.col("words")))
    known = names.where("key is not null").groupBy("key").agg(F.min("entity").alias("entity"), F.count_distinct("entity").alias("n")).where("n = 1").drop("n")
    keys = df.select(F.col(name).alias("_name")).distinct().select(*spelled("_name")).withColumn("key", name_key(F.col("words"))).where("key is not null")
    keys = written(keys.groupBy("key").agg(F.min_by(F.struct("words", "raws"), F.array_join("raws", " ")).alias("w")).select("key", "w.*"), "names")
    pairs = lambda: F.explode(F.arrays_zip("words", "raws")).alias("w")
    vocab_words = names.select(pairs()).select(F.col("w.words").alias("word"), F.col("w.raws").alias("raw")).distinct()
    open_ = keys.join(F.broadcast(known), "key", "left_anti")
    parts = open_.select("key", F.posexplode(F.arrays_zip("words", "raws")).alias("pos", "w")).select("key", "pos", F.col("w.words").alias("word"), F.col("w.raws").alias("raw"))
    unknown = parts.select("word", "raw").distinct().join(F.broadcast(vocab_words.select("word").distinct()), "word", "left_anti")
    fixes = written(word_corrections(unknown, vocab_words), "corrections")
    slots = names.where("key is not null").select("key", F.col("words").alias("_w")).distinct().join(known, "key")
    slots = slots.select(F.col("key").alias("vkey"), "entity", F.size("_w").alias("n"), F.posexplode("_w").alias("vpos", "right"))
    sizes = open_.select("key", F.size("words").alias("n"))
    tried = parts.join(fixes, "word", "left").join(sizes, "key").select("key", "n", "pos", F.explode(F.coalesce("right", F.array("word"))).alias("right"))
    met = tried.join(F.broadcast(slots), ["right", "n"]).groupBy("key", "vkey", "entity", "n").agg(F.collect_set(F.struct("pos", "vpos")).alias("links"), F.count_distinct("pos").alias("own"), F.count_distinct("vpos").alias("its"))
    mended = met.where((F.col("own") == F.col("n")) & (F.col("its") == F.col("n")) & _matched(F.col("links"), F.col("n"))).groupBy("key").agg(F.min("entity").alias("entity"), F.count_distinct("entity").alias("n"))
    mended = mended.where("n = 1").drop("n")
    return keys.select("key").join(known.unionByName(mended), "key", "left")


def _matched(links: Column, n: Column) -> Column:
    """Whether ``n`` words and ``n`` words of another name can be paired along ``links`` (structs of two positions)."""

    def whole(pairs, size: int) -> bool:
        to: dict[int, list[int]] = {}
        for p in pairs:
            to.setdefault(p["pos"], []).append(p["vpos"])
        taken: dict[int, int] = {}

        def place(x: int, seen: set) -> bool:
            for y in to.get(x, []):
                if y not in seen:
                    seen.add(y)
                    if y not in taken or place(taken[y], seen):
                        taken[y] = x
                        return True
            return False

        return all(place(x, set()) for x in range(size))

    def run(pairs: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([whole(p, int(k)) for p, k in zip(pairs, size)], dtype=bool)

    return F.pandas_udf(run, "boolean")(links, n)


def named_entities(df: DataFrame, key: str, name: str, vocabulary: DataFrame) -> DataFrame:
    """``<key>`` and ``entity``, the vocabulary entry that the record's name is of; records that name none are left out."""
    links = written(name_links(df, name, vocabulary).where("entity is not null"), "links")
    return salted_lookup(df.select(key, name_key(name_words(F.col(name))).alias("key")), links, "key", key, how="inner").select(key, "entity")


def entity_groups(df: DataFrame, key: str, name: str, vocabulary: DataFrame, others: tuple[str, ...] = ()) -> DataFrame:
    """``<key>``, ``component`` and ``entity`` (the only one of the component, else null) of every record.

    The graph's nodes are names, entities and the values of the columns ``others`` (authors, sources, ...). Its edges link a name in use to
    its entity, an entity to its own names, and the first value of a record to each further one, so records that share any value
    are one component, however long the chain. A record without any value that something shares is a component of its own,
    ``alone:<key>``; null and empty values link nothing.
    """
    links = written(name_links(df, name, vocabulary), "links")
    names = vocabulary.select("entity", name_key(name_words(F.col("name"))).alias("key")).where("key is not null")
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    edges = links.where("entity is not null").select("key", "entity").unionByName(names.select("key", "entity"))
    edges = edges.select(node("name", "key").alias("a"), node("entity", "entity").alias("b"))
    of_name = links.where("entity is not null").select("key", node("name", "key").alias("_name"))
    rows = salted_lookup(df.select(key, name_key(name_words(F.col(name))).alias("key"), *(F.when(F.col(c).cast("string") != "", node(c, c)).alias(f"_o_{c}") for c in others)), of_name, "key", key)
    rows = rows.withColumn("_nodes", F.array_compact(F.array("_name", *(f"_o_{c}" for c in others))))
    rows = rows.select(key, F.try_element_at("_nodes", F.lit(1)).alias("node"), *(["_nodes"] if others else []))
    if others:
        rows = written(rows, "nodes-of-records")
        chain = rows.where(F.size("_nodes") > 0).select("node", F.explode("_nodes").alias("b")).distinct()
        edges = edges.unionByName(chain.select(F.col("node").alias("a"), "b"))
    parts = written(connected_components(edges, "a", "b"), "components")
    held = parts.where(F.col("node").startswith("entity:")).groupBy("component").agg(F.min("node").alias("entity"), F.count(F.lit(1)).alias("n")).where("n = 1")
    entity = F.substring_index("entity", ":", -1).cast(vocabulary.schema["entity"].dataType).alias("entity")
    groups = written(parts.join(held.select("component", entity), "component", "left"), "groups-of-nodes")
    out = salted_lookup(rows.select(key, "node"), groups.select("node", "component", "entity"), "node", key)
    return out.select(key, "entity", F.coalesce("component", F.concat(F.lit("alone:"), F.col(key).cast("string"))).alias("component"))


def heavy_first(sizes: list[tuple[str, int]], total: int, shares: dict[str, float], seed: int = SEED) -> tuple[dict[str, str], dict[str, float]]:
    """Splits of the components above ``HEAVY`` of all records (fewer than 1 / HEAVY of them), and the shares the rest should have.

    Largest first, each to the split that lacks the most; ties are broken by a seeded order of the splits.
    """
    names = sorted(shares)
    random.Random(seed).shuffle(names)
    lack = {s: shares[s] * total for s in names}
    where = {}
    for comp, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        s = max(names, key=lambda x: lack[x])
        where[comp] = s
        lack[s] -= n
    rest = {s: max(0.0, v) for s, v in lack.items()}
    whole = sum(rest.values())
    return where, {s: (v / whole if whole else shares[s]) for s, v in rest.items()}


def assign_splits(groups: DataFrame, key: str, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """``<key>``, ``component`` and ``split`` of every record of :func:`entity_groups`; shares are shares of records.

    The hash of a component names one of ``SLOTS`` slots; slots follow each other by their record counts, so a split's range of
    hashes holds its share of records and not just of components. Components above ``HEAVY`` of all records go first, to the
    split that lacks most. Targets are normalised to 1; no targets give a null split.
    """
    spark = groups.sparkSession
    shares = {r["split_name"]: float(r["target_share"]) for r in targets.where("split_name is not null and target_share > 0").collect()}
    whole = sum(shares.values())
    if not whole:
        return groups.select(key, "component", F.lit(None).cast("string").alias("split"))
    shares = {s: v / whole for s, v in shares.items()}
    groups = groups.select(key, "component", F.pmod(F.xxhash64("component", F.lit(seed)), F.lit(SLOTS)).cast("int").alias("slot"))
    sizes = written(groups.groupBy("component", "slot").agg(F.count(F.lit(1)).alias("n")), "sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy = [(r["component"], r["n"]) for r in sizes.where(F.col("n") > max(1.0, HEAVY * total)).collect()]
    fixed, rest = heavy_first(heavy, total, shares, seed)
    slots = sizes.where(F.col("n") <= max(1.0, HEAVY * total)).groupBy("slot").agg(F.sum("n").alias("n"))
    run = W.orderBy("slot")  # SLOTS rows
    slots = slots.withColumn("at", (F.sum("n").over(run) - F.col("n") / 2) / F.sum("n").over(W.partitionBy(F.lit(1))))
    pick, edge = None, 0.0
    for s in sorted(rest):
        edge += rest[s]
        pick = F.when(F.col("at") <= edge, s) if pick is None else pick.when(F.col("at") <= edge, s)
    slots = slots.select("slot", pick.otherwise(max(rest, key=lambda s: (rest[s], s))).alias("by_hash"))
    big = spark.createDataFrame(list(fixed.items()), "component string, by_size string")
    out = groups.join(F.broadcast(slots), "slot", "left").join(F.broadcast(big), "component", "left")
    return out.select(key, "component", F.coalesce("by_size", "by_hash").alias("split"))


def split_report(splits: DataFrame, targets: DataFrame) -> DataFrame:
    """``split``, ``target_share``, ``rows``, ``components`` and ``actual_share``; a split without records has 0 rows."""
    n = splits.groupBy("split", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("split").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("components"))
    t = targets.select(F.col("split_name").alias("split"), "target_share").join(F.broadcast(n), "split", "left")
    t = t.withColumn("rows", F.coalesce("rows", F.lit(0))).withColumn("components", F.coalesce("components", F.lit(0)))
    return t.withColumn("actual_share", F.try_divide("rows", F.sum("rows").over(W.partitionBy(F.lit(1)))))
