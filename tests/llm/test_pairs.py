"""Splits, overlaps and near-duplicates against brute force on small fixtures."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.llm import components, contamination, neardup, splits, wordbits

WORDS = [f"w{i:03d}" for i in range(400)]


def words(t):
    return re.findall(r"[^\W_]+", t.lower())


def near(a, b, least=0.75):
    if not (a or "").strip() or not (b or "").strip():
        return False
    x, y = words(a), words(b)
    if not x or not y:
        return a.strip() == b.strip()
    return sum((Counter(x) & Counter(y)).values()) >= least * max(len(x), len(y))


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        if out and rng.random() < 0.4:
            w = words(rng.choice(out))
            for _ in range(rng.randrange(0, 5)):
                i = rng.randrange(len(w))
                w[i : i + 1] = rng.choice([[], [rng.choice(WORDS)], [w[i], rng.choice(WORDS)]])
            cut = rng.randrange(len(w))
            w = w[cut:] + w[:cut] if rng.random() < 0.3 else w
            out.append(" ".join(w).upper() if rng.random() < 0.2 else ", ".join(w))
        else:
            out.append(" ".join(rng.choice(WORDS) for _ in range(rng.randrange(30, 60))))
    return out


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(500, i) for i in range(501, 560)] + [(7, 7), (600, 600), (None, 3)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    want = {x: root(x) for x in list(up)}
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_long_chain_is_one_component(spark):
    e = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components.connected_components(e, "a", "b").select("component").distinct().count() == 1


VOCAB = [(1, "Auricular oedema"), (1, "TQ101"), (2, "Auricular oedema type 1"), (3, "Auricular oedema type 2"), (4, "Nasal haemorrhage"), (4, "Heavy bleed of the nose")]


@pytest.mark.parametrize(
    "name, want",
    [
        ("Auricular_oedema (Case 3)", 1), ("auricular%20edema.txt [Case 03]", 1), ("OEDEMA, AURICULAR - case 1", 1), ("tq101_structured", 1), ("TQ102", None), ("Auricular oedema type 1", 2), ("auricualr oedmea type 2", 3),
        ("nasal haemorrhae", 4), ("nasal hameorrhage（Case 2）", 4), ("Nasal hemmorrhage", 4), ("heavy_bleed_of_the_nose (Case 1)", 4), ("﻿nasal\xa0hæmorrhage​", 4), ("nasal", None), ("Unknown (Case 1)", None), ("", None), (None, None), ("%zz", None),
    ],
)
def test_names(spark, name, want):
    df = spark.createDataFrame([(1, name)], "k int, s string")
    got = splits.named_entities(df, "k", "s", spark.createDataFrame(VOCAB, "entity int, name string")).collect()
    assert [r["entity"] for r in got] == ([want] if want else [])


def test_splits_keep_entities_together(spark):
    rng = random.Random(2)
    names = ["Auricular_oedema", "tq101", "auricular edema type 1", "Auricular oedema type 2", "nasal haemorrhage", None, "", "nothing"]
    df = spark.createDataFrame([(i, rng.choice(names), "x") for i in range(2000)], "k int, s string, entity string")
    vocab = spark.createDataFrame(VOCAB, "entity int, name string")
    groups = splits.entity_groups(df, "k", "s", vocab)
    targets = spark.createDataFrame([("train", 0.7), ("val", 0.15), ("test", 0.15)], "split_name string, target_share double")
    out = splits.assign_splits(groups, "k", targets)
    assert out.count() == 2000 and out.where("split is null").count() == 0
    assert out.groupBy("component").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert groups.where("entity = 1").select("component").distinct().count() == 1
    shares = {r["split"]: r["actual_share"] for r in splits.split_report(out, targets).collect()}
    assert abs(shares["train"] - 0.7) < 0.03
    assert splits.assign_splits(groups.limit(0), "k", targets).count() == 0


def test_records_that_share_any_column_stay_together(spark):
    rows = [(1, "auricular oedema", "ann", "x"), (2, "TQ101", None, "y"), (3, None, "ann", "z"), (4, "nothing known", "bob", "z"), (5, "nasal haemorrhage", "eve", None), (6, None, None, None), (7, "", "", ""), (8, None, "bob", "q")]
    df = spark.createDataFrame(rows, "k int, s string, author string, site string")
    vocab = spark.createDataFrame(VOCAB, "entity int, name string")
    got = {r["k"]: r for r in splits.entity_groups(df, "k", "s", vocab, ("author", "site")).collect()}
    part = lambda *ks: {got[k]["component"] for k in ks}
    assert len(part(1, 2, 3, 4, 8)) == 1 and len(part(1, 5, 6, 7)) == 4 and got[6]["component"] == "alone:6"
    assert got[1]["entity"] == 1 and got[8]["entity"] == 1 and got[5]["entity"] == 4 and got[7]["entity"] is None
    plain = {r["k"]: r for r in splits.entity_groups(df, "k", "s", vocab).collect()}
    assert plain[1]["component"] == plain[2]["component"] != plain[3]["component"] and plain[4]["entity"] is None


def test_many_wrong_words_in_one_name(spark):
    long = [(9, "alpha bravo carol delta eagle fancy grape hotel"), (10, "alpha bravo carol delta eagle fancy grape house")]
    df = spark.createDataFrame([(1, "alpho brava caral delto eagla fancu grapo hotal"), (2, "alpho brava caral delto eagla fancu grapo hoxyl")], "k int, s string")
    got = splits.named_entities(df, "k", "s", spark.createDataFrame(long, "entity int, name string")).collect()
    assert [(r["k"], r["entity"]) for r in got] == [(1, 9)]


def test_very_long_and_odd_texts(spark):
    rng = random.Random(12)
    vocab = [f"v{i}" for i in range(5000)]
    long = [rng.choice(vocab) for _ in range(40_000)]
    longer = long + rng.choices(vocab, k=8_000)
    rng.shuffle(longer)
    other = [f"o{rng.randrange(5000)}" for _ in range(40_000)]
    odd = ["\ud800 lone", "ＦＵＬＬ width", "e\u0301 combining", "\u200b\ufeff", "١٢٣ digits"]
    rows = [(1, " ".join(long), "train"), (2, " ".join(longer), "val"), (3, " ".join(other), "test")] + [(10 + i, t.replace("\ud800", "?"), s) for i, t in enumerate(odd) for s in ("train",)] + [(20 + i, t.replace("\ud800", "?"), "val") for i, t in enumerate(odd)]
    df = spark.createDataFrame([(k, "e", t, s, "clash", "clash") for k, t, s in rows], "k int, e string, t string, split string, class string, ranks string")
    members, links = overlaps(df)
    got = {(r["k_a"], r["k_b"]) for r in contamination.overlap_pairs(members, links, "k").collect()}
    assert got == {(1, 2), *((10 + i, 20 + i) for i in range(5) if i != 3)}
    members, links = neardup.near_duplicates(df, "k", ["t", "t"])
    assert {(r["k_a"], r["k_b"]) for r in neardup.duplicate_pairs(members, links, "k").collect()} == got


def test_nothing_to_scan(spark):
    none = spark.createDataFrame([], "k int, e string, t string, split string, source string")
    one = spark.createDataFrame([(1, "e", "some words here", "val", None), (2, "e", None, "train", "s")], none.schema)
    for df in (none, one):
        members, links = overlaps(df)
        assert contamination.overlap_pairs(members, links, "k").count() == 0
        report = contamination.overlap_report(df, members, links, "k", "split", "source").collect()
        assert [(r["split"], r["records"], r["overlapping"], r["pairs"]) for r in report] == ([("val", 1, 0, 0)] if df is one else [])


def scanned(e, t):
    """Pairs of numbers that the automaton over ``e`` leaves of ``t``."""
    import numpy as np

    hashes = wordbits.Hashes()
    ranks = lambda x: np.sort(wordbits.Words([x], hashes).number)
    shard = contamination.Shard([ranks(x) for x in e])
    return {(i, j): c for j, y in enumerate(t) for i, c in shard.scan(ranks(y))}


def test_no_similar_pair_escapes_the_automaton():
    rng = random.Random(3)
    texts = corpus(160, 3) + ["a b c d", "d c a", "x", "x x x x", "x x x", "!!!", "a b", "b a"]
    e, t = texts[::2], texts[1::2]
    got = scanned(e, t)
    want = {(i, j) for i, a in enumerate(e) for j, b in enumerate(t) if near(a, b)}
    assert want and want <= set(got) and len(got) < len(e) * len(t) / 3
    for n in (1, 2, 3, 4, 5, 7, 8, 23, 24, 30, 60, 120):
        w = [f"w{i}" if rng.random() < 0.6 else rng.choice(["and", "the", "a"]) for i in range(n)]
        k = n // 4
        kinds = {
            "order": rng.sample(w, n),
            "insertions": [x for i, v in enumerate(w) for x in ([v, f"new{i}"] if i % 3 == 2 else [v])],
            "replacements": [f"new{i}" if i % 4 == 3 else v for i, v in enumerate(w)],
            "deletions": rng.sample(w, n - k),
            "rare first": [f"zz{i}" for i in range(k)] + w[k:],
            "appended": w + ["and"] * (n // 3),
        }
        for kind, v in kinds.items():
            assert near(" ".join(w), " ".join(v)), (n, kind)
            assert scanned([" ".join(w)], [" ".join(v)]) and scanned([" ".join(v)], [" ".join(w)]), (n, kind)


def test_coverage_merges_intervals():
    assert scanned(["a b c d e f g h"], ["a b c d e f g h"]) == {(0, 0): 1.0}
    (share,) = scanned(["a b c d e f g h"], ["a b c d e f g h i"]).values()
    assert share == 1.0
    assert all(0 < c <= 1 for c in scanned(corpus(60, 6), corpus(60, 6)).values())


def overlaps(df, key="k"):
    names = df.select(F.col("e").alias("key"), F.col("e").alias("entity")).where("e is not null").distinct()
    return contamination.cross_split_overlaps(df, key, F.col("e"), names, "t", "split")


@pytest.fixture(scope="module")
def pairs(spark):
    texts = corpus(300, 4)
    rows = [(i, f"e{i % 3}", t, ["train", "VAL ", "test", None][i % 4], "s") for i, t in enumerate(texts)]
    rows += [(900, "e0", "!!!", "train", "s"), (901, "e0", "!!!", "val", "s"), (902, "e0", None, "val", "s"), (903, "e0", " ", "train", "s"), (904, None, texts[0], "val", None)]
    rows += [(1000 + i, "e1", texts[1], "train", "s") for i in range(30)]
    return rows


def test_cross_split_overlaps(spark, pairs):
    df = spark.createDataFrame(pairs, "k int, e string, t string, split string, entity string")
    members, links = overlaps(df)
    got = {(r["k_a"], r["k_b"]) for r in contamination.overlap_pairs(members, links, "k").collect()}
    side = {k: (s or "").strip().lower() for k, _, _, s, _ in pairs}
    by = {k: (e, t) for k, e, t, *_ in pairs}
    ev, tr = [k for k in side if side[k] in ("val", "test")], [k for k in side if side[k] == "train"]
    want = {(min(a, b), max(a, b)) for a in ev for b in tr if by[a][0] and by[a][0] == by[b][0] and near(by[a][1], by[b][1])}
    assert got == want and (900, 901) in got
    report = contamination.overlap_report(df, members, links, "k", "split", "entity").collect()
    assert sum(r["pairs"] for r in report) == len(want) and sum(r["records"] for r in report) == len(ev)


def test_blocks_of_hot_entities(spark, pairs, monkeypatch):
    df = spark.createDataFrame(pairs, "k int, e string, t string, split string, x string")
    whole = contamination.overlap_pairs(*overlaps(df), "k").count()
    monkeypatch.setattr(contamination, "SHARD", 7)
    monkeypatch.setattr(contamination, "BLOCK", 5)
    monkeypatch.setattr(contamination, "LEAST", 3)
    assert contamination.overlap_pairs(*overlaps(df), "k").count() == whole


def test_anchors_cover():
    import numpy as np

    rng = np.random.default_rng(0)
    for k in (2, 3, 4):
        t = neardup.tables(k)
        x = rng.integers(0, 2**16, (400, t * (k + 1)))
        own = neardup.anchors(x, k)
        assert own.shape == x.shape and len(np.unique(own)) == own.size
        y = x.copy()
        y[:, 0] = rng.integers(0, 2**16, 400)  # one symbol of the first table
        y[:, k + 1 :] = rng.integers(0, 2**16, (400, (t - 1) * (k + 1)))
        assert all(set(a) & set(b) for a, b in zip(own.tolist(), neardup.anchors(y, k).tolist()))
        y[:, 1] = rng.integers(0, 2**16, 400)  # two symbols are beyond the threshold
        assert not any(set(a) & set(b) for a, b in zip(own.tolist(), neardup.anchors(y, k).tolist()))
    assert [neardup.code_length(n) for n in (0, 2**18, 2**18 + 1, 2**21, 75_000_000)] == [2, 2, 3, 3, 5]


def test_hot_anchors_are_compared_whole(spark, monkeypatch):
    a, b = corpus(250, 5), corpus(250, 5)
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(a, b))], "k int, p string, q string")
    whole = sorted(tuple(r) for r in neardup.near_duplicates(df, "k", ["p", "q"])[1].collect())
    monkeypatch.setattr(neardup, "BUCKET_ROWS", 600)
    monkeypatch.setattr(neardup, "CELL_ROWS", 200)
    monkeypatch.setattr(neardup, "LAGS", 3)
    assert whole and sorted(tuple(r) for r in neardup.near_duplicates(df, "k", ["p", "q"])[1].collect()) == whole


def test_near_duplicates(spark):
    a, b = corpus(250, 5), corpus(250, 5)
    rows = [(i, x, y) for i, (x, y) in enumerate(zip(a, b))] + [(300 + i, a[0], b[0]) for i in range(20)] + [(400, "?!", "?!"), (401, "?!", "?!"), (402, None, "x"), (403, a[1], None), (404, "", "")]
    df = spark.createDataFrame(rows, "k int, p string, q string")
    members, links = neardup.near_duplicates(df, "k", ["p", "q"])
    got = {(r["k_a"], r["k_b"]) for r in neardup.duplicate_pairs(members, links, "k").collect()}
    want = {(r[0], s[0]) for r in rows for s in rows if r[0] < s[0] and near(r[1], s[1]) and near(r[2], s[2])}
    assert got <= want and len(got) >= 0.97 * len(want)
    groups = neardup.duplicate_groups(members, links, "k")
    assert groups.count() == members.count() and groups.where("k >= 300 and k < 320").select("group").distinct().count() == 1


def edited(rng, text, similarity):
    """The words of ``text`` with as many replaced or added as that similarity allows, in another order."""
    w = text.split(" ")
    if rng.random() < 0.5:
        for i in rng.sample(range(len(w)), int((1 - similarity) * len(w))):
            w[i] = rng.choice(WORDS)
    else:
        w += [rng.choice([*WORDS, w[0]]) for _ in range(int(len(w) / similarity) - len(w))]
    rng.shuffle(w)
    return " ".join(w)


def test_pairs_at_the_limit_are_found(spark):
    rng = random.Random(9)
    rows = []
    for i in range(120):
        p, q = (" ".join(rng.choice(WORDS) for _ in range(rng.randrange(30, 160))) for _ in "pq")
        rows += [(2 * i, p, q), (2 * i + 1, edited(rng, p, 0.76), edited(rng, q, 0.76))]
    base = " ".join(WORDS[:160])
    rows += [(900, base, "same words"), (901, base + " w001" * 32, "same words")]
    want = {(r[0], s[0]) for r in rows for s in rows if r[0] < s[0] and near(r[1], s[1]) and near(r[2], s[2])}
    members, links = neardup.near_duplicates(spark.createDataFrame(rows, "k int, p string, q string"), "k", ["p", "q"])
    got = [(r["a"], r["b"]) for r in links.collect()]
    assert set(got) <= want and len(got) == len(set(got)) >= 0.99 * len(want) and len(want) > 120


def test_nothing_to_compare(spark):
    df = spark.createDataFrame([], "k int, p string, q string")
    members, links = neardup.near_duplicates(df, "k", ["p", "q"])
    assert neardup.duplicate_pairs(members, links, "k").count() == 0 and neardup.duplicate_groups(members, links, "k").count() == 0
