import math

import pytest
from pyspark.sql import functions as F

from quern.functions import labels, text
from quern.operators import analytics, chunking, curate, evaluate, ordering, retrieval, sampling

GOLDEN = [[43, 308, 0, 2], [141, 1348, 2, 13], [18, 100, 0, 0], [0, 0, 0, 0]]


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("o")).first()["o"]


def test_text_functions(spark):
    assert one(spark, "  Whānau's 2 DOGS—ok ", text.words) == ["whānau", "s", "2", "dogs", "ok"]
    assert one(spark, None, text.words) is None and one(spark, "", text.words) == []
    assert [one(spark, v, text.blank) for v in (None, "", " ​ \t", "x")] == [True, True, True, False]
    assert one(spark, " Kowhai-Health ", text.source_key) == "kowhaihealth" and one(spark, "--", text.source_key) is None
    assert one(spark, "A_b (Case 12)", text.strip_case) == "A_b"
    assert one(spark, '"quoted"', text.strip_quotes) == "quoted" and one(spark, 'in "mid"', text.strip_quotes) == 'in "mid"'
    assert one(spark, "Pain_of_the_Ear and", text.keywords) == ["pain", "ear"]


def test_labels(spark):
    assert [one(spark, v, labels.triage_legacy) for v in (None, "Triage decision: gp", "needed rest", "stay home or GP", "mild", "")] == ["UNKNOWN", "GP", "ED", "HOME", "HOME", "UNKNOWN"]
    assert one(spark, "needed rest", labels.triage_strict) == "HOME"
    assert one(spark, "see a doctor", labels.triage_normalised) == "GP"


def test_golden_confusion_metrics(spark):
    names = evaluate.LABELS
    rows = [(names[i], names[j]) for i, r in enumerate(GOLDEN) for j, n in enumerate(r) for _ in range(n)]
    cells = evaluate.confusion(spark.createDataFrame(rows, "t string, p string"), [], "t", "p")
    assert cells.count() == 16 and cells.agg(F.sum("n")).first()[0] == 1975
    report = evaluate.class_report(cells, [])
    ed = report.where("label = 'ED'").first()
    assert math.isclose(ed["precision"], 0.21287128712871287) and math.isclose(ed["recall"], 0.12181303116147309)
    w = evaluate.weighted_scores(report, []).first()
    assert math.isclose(w["weighted_f1"], 0.6574672770153084) and math.isclose(w["weighted_f2"], 0.6842102561304392)
    assert not evaluate.safety_gate(report, []).first()["safe"]


@pytest.mark.parametrize("grid", [False, True])
def test_bm25_against_a_plain_loop(spark, monkeypatch, grid):
    if grid:  # all queries are too many to broadcast: blocks meet in cells
        monkeypatch.setattr(retrieval, "SMALL_TERMS", 0)
        monkeypatch.setattr(retrieval, "Q_BLOCK", 1)
        monkeypatch.setattr(retrieval, "C_BLOCK", 2)
    docs = [("a", "d1", "the red fox the"), ("a", "d2", "the blue whale"), ("a", "d3", "the"), ("a", "d4", None), ("b", "d5", "red\u00a0red fox"), ("b", "d6", "cat"), (None, "d7", "red")]
    q = [(1, "red fox red"), (2, "the"), (3, ""), (4, None)]
    got = retrieval.bm25_topk(spark.createDataFrame(q, "q int, t string"), "q", "t", spark.createDataFrame(docs, "p string, d string, t string"), "p", "d", "t", 10)
    got = {(r["q"], r["d"]): r["score"] for r in got.collect()}
    want = {}
    for part in "ab":
        own = {d: (t or "").split() for p, d, t in docs if p == part}
        n, avg = len(own), sum(map(len, own.values())) / len(own)
        idf = {w: math.log(n - k + 0.5) - math.log(k + 0.5) for w in {w for t in own.values() for w in t} if (k := sum(w in t for t in own.values()))}
        mean = sum(idf.values()) / len(idf)
        idf = {w: v if v >= 0 else 0.25 * mean for w, v in idf.items()}
        for i, t in q:
            for d, ws in own.items():
                hits = [w for w in (t or "").split() if w in ws]
                score = sum(idf[w] * ws.count(w) * 2.5 / (ws.count(w) + 1.5 * (0.25 + 0.75 * len(ws) / avg)) for w in hits)
                if hits and score > 0:
                    want[i, d] = score
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-8) for k in want)
    best = retrieval.bm25_topk(spark.createDataFrame(q, "q int, t string"), "q", "t", spark.createDataFrame(docs, "p string, d string, t string"), "p", "d", "t", 1)
    assert best.groupBy("q", "p").count().where("count > 1").count() == 0


@pytest.mark.parametrize("drop_zero", [True, False])
def test_bm25_passes_and_blocks_agree_with_a_plain_loop(spark, monkeypatch, drop_zero):
    """Parts of many blocks, terms common and rare in them, and equal documents; five passes over the index."""
    import random

    rnd = random.Random(5)
    text_of = lambda n: " ".join(rnd.choice(["the", "of", *(f"w{int(rnd.paretovariate(0.6))}" for _ in range(3))]) for _ in range(n))
    docs = [("big" if i % 4 else "small", f"d{i:03d}", text_of(rnd.randint(1, 12))) for i in range(300)]
    docs += [("big", f"e{i:03d}", docs[i % 3][2]) for i in range(60)] + [("one", "f", "the w1"), ("bare", "g", None)]
    q = [(i, text_of(rnd.randint(1, 6))) for i in range(40)]
    corpus, asked = spark.createDataFrame(docs, "p string, d string, t string"), spark.createDataFrame(q, "q int, t string")
    monkeypatch.setattr(retrieval, "SMALL_TERMS", sum(len(set(t.split())) for _, t in q) // 5)
    monkeypatch.setattr(retrieval, "C_BLOCK", 50)
    monkeypatch.setattr(retrieval, "TILE", 700)
    got = {(r["q"], r["p"], r["rank"]): (r["d"], r["score"]) for r in retrieval.bm25_topk(asked, "q", "t", corpus, "p", "d", "t", 4, drop_zero=drop_zero).collect()}
    want = {}
    for part in ("big", "small", "one"):
        own = {d: t.split() for p, d, t in docs if p == part}
        n, avg = len(own), sum(map(len, own.values())) / len(own)
        idf = {w: math.log(n - k + 0.5) - math.log(k + 0.5) for w in {w for t in own.values() for w in t} if (k := sum(w in t for t in own.values()))}
        mean = sum(idf.values()) / len(idf)
        idf = {w: v if v >= 0 else 0.25 * mean for w, v in idf.items()}
        for i, t in q:
            scores = {d: sum(idf[w] * ws.count(w) * 2.5 / (ws.count(w) + 1.5 * (0.25 + 0.75 * len(ws) / avg)) for w in t.split() if w in ws) for d, ws in own.items() if set(ws) & set(t.split())}
            best = sorted((-round(s, 9), d) for d, s in scores.items() if round(s, 9) > 0 or not drop_zero)[:4]
            want |= {(i, part, rank): (d, -s) for rank, (s, d) in enumerate(best, 1)}
    assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and math.isclose(got[x][1], want[x][1], abs_tol=2e-9) for x in want)


def test_bm25_scores_are_not_rounded(spark):
    """A score rounded to nine places and then to six can differ from one rounded once."""
    e = spark.createDataFrame([("a", "d1", "red fox"), ("a", "d2", "cat"), ("a", "d3", "dog")], "p string, d string, t string")
    q = spark.createDataFrame([(1, "red")], "q int, t string")
    s = retrieval.bm25_topk(q, "q", "t", e, "p", "d", "t", 1).first()["score"]
    want = (math.log(2.5) - math.log(1.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / (4 / 3)))
    assert math.isclose(s, want, rel_tol=1e-14) and s != round(s, 9)


def test_tfidf_against_a_plain_loop(spark):
    """Null texts, a null key, repeated candidates and query rows, no shared term; with and without the cut to the commonest terms."""
    cands = [(1, "a", "Red fox, the RED hen"), (1, "b", "blue whale x"), (1, "c", None), (1, "a", "fox den"), (1, None, "red hen"), (2, "a", "cat dog"), (2, "b", "dog dog emu"), (3, "a", "cow"), (4, "a", "cow")]
    asked = [(1, "a red fox"), (2, "dog cat"), (2, "dog cat"), (2, "the dog"), (3, None), (5, "cow")]
    pairs = spark.createDataFrame(cands, "q int, d string, t string").select("q", "d", retrieval.content_terms(F.col("t")).alias("terms"))
    queries = spark.createDataFrame(asked, "q int, t string")
    for most in (5000, 2):
        got = {(r["q"], r["d"]): r["score"] for r in retrieval.tfidf_scores(pairs, queries, "q", "d", "terms", "t", most).collect()}
        want = {}
        for q in (1, 2, 3):
            own = [t for i, t in asked if i == q]
            texts = [(d, t) for i, d, t in cands if i == q for _ in own] + [(None, t) for t in set(own)]
            words = lambda t: [w for w in (t or "").lower().replace(",", " ").split() if len(w) > 1 and w not in retrieval.STOP_WORDS]
            tf: dict = {}
            for d, t in texts:
                for w in words(t):
                    tf.setdefault(d, {}).setdefault(w, 0)
                    tf[d][w] += 1
            terms = {w for x in tf.values() for w in x}
            kept = sorted(terms, key=lambda w: (-sum(x.get(w, 0) for x in tf.values()), w))[:most]
            weight = {d: {w: x[w] * (math.log((1 + len(texts)) / (1 + sum(w in y for y in tf.values()))) + 1) for w in kept if w in x} for d, x in tf.items()}
            norm = {d: math.sqrt(sum(v * v for v in x.values())) for d, x in weight.items()}
            of_query = weight.get(None, {})
            for d in {d for d, _ in texts if d} | ({None} if any(i == q and d is None for i, d, _ in cands) else set()):
                shared = [] if d is None else [w for w in weight.get(d, {}) if w in of_query]
                want[q, d] = sum(weight[d][w] * of_query[w] for w in shared) / (norm[d] * norm[None]) if shared else 0.0
        assert got.keys() == want.keys() and all(math.isclose(got[x], want[x], abs_tol=1e-12) for x in want), (got, want)


def test_knn_blocks_agree_and_break_ties_by_id(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 4)).round(1).tolist()
    v[7] = v[3]
    v[9] = [0.0] * 4
    df = spark.createDataFrame([(i, f"s{i % 3}", x) for i, x in enumerate(v)] + [(99, "s0", None)], "id long, s string, v array<double>")
    q = df.where("id % 10 = 0").select(F.col("id").alias("q"), "v")
    rows = lambda: retrieval.knn(q, "q", df, "id", "v", 3, "s").toPandas().sort_values(["q", "s", "rank"]).values.tolist()
    a = rows()
    monkeypatch.setattr(retrieval, "Q_BLOCK", 2)
    monkeypatch.setattr(retrieval, "C_BLOCK", 7)
    assert a == rows() and len(a) == 6 * 9 and all(r[0] != r[2] for r in a)
    index = retrieval.vector_index(df, "id", "v", "s")
    assert index.count() == 60 and abs(index.where("key = 1").select(F.aggregate("vec", F.lit(0.0), lambda x, y: x + y * y)).first()[0] - 1) < 1e-12


def test_corpus_is_scanned_once(spark, small):
    from quern.operators.retrieval import lexical_index

    c = spark.read.parquet(f"{small}/chunks.parquet")
    index = lexical_index(c.where("source is not null"), "source", "chunk_id", "text")
    assert not any("chunks.parquet" in f for f in index.inputFiles()) and index.count() > 0


def test_fused_searches(spark):
    x = spark.createDataFrame([(1, "s", "a", 1), (1, "s", "b", 2), (1, "s", "c", 3), (1, "t", "d", 1)], "q int, p string, d string, rank int")
    y = spark.createDataFrame([(1, "s", "c", 1), (1, "s", "e", 2), (2, "s", "a", 1)], "q int, p string, d string, rank int")
    pr = spark.createDataFrame([("one", "s", 1), ("one", "t", 0), ("two", "s", 2)], "profile string, p string, quota int")
    got = sorted((r["q"], r["profile"], r["d"], r["rank"], r["pos"]) for r in retrieval.hybrid_quota(x, y, pr, ["q"], "p", "d", ["profile"]).collect())
    want = [(1, "one", "a", 1, 1), (1, "two", "c", 1, 1), (1, "two", "a", 2, 2), (2, "one", "a", 1, 1), (2, "two", "a", 1, 1)]  # profile one takes two of each list
    assert got == sorted(want)
    fused = spark.createDataFrame([(1, "a", 1, 0.1), (1, "b", 2, 0.9), (1, "c", 3, 0.5), (2, "a", 1, 0.1), (2, "b", 2, 0.9)], "q int, d string, rank int, f double")
    got = sorted((r["q"], r["rank"], r["d"], r["reranked"]) for r in retrieval.two_stage(fused, ["q"], F.col("f"), "d", 2).collect())
    assert got == [(1, 1, "b", True), (1, 2, "c", True), (2, 1, "a", False), (2, 2, "b", False)]
    routes = spark.createDataFrame([(1, "x"), (2, "none")], "q int, kind string")
    assert [r["d"] for r in retrieval.dispatched({"x": x.select("q", "d"), "y": y.select("q", "d")}, routes, "q", "kind").orderBy("d").collect()] == ["a", "b", "c", "d"]


def test_ranks_by_ranges(spark):
    import random

    rows = [(i, "hot" if i % 3 else None, random.Random(i).randrange(50)) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, g string, v int")
    got = [r["k"] for r in ordering.row_numbers(df, ["-v", "k"]).orderBy("rn").collect()]
    assert got == [k for k, _, v in sorted(rows, key=lambda r: (-r[2], r[0]))]
    assert sorted(r["rn"] for r in ordering.row_numbers(df, ["-v", "k"]).collect()) == list(range(1, 501))
    g = ordering.group_ranks(df, ["g"], ["v", "k"]).collect()
    for name in ("hot", None):
        own = sorted((r for r in g if r["g"] == name), key=lambda r: (r["v"], r["k"]))
        assert [r["_i"] for r in own] == list(range(1, len(own) + 1)) and {r["_n"] for r in own} == {len(own)}
    import numpy as np

    q = {(r["g"], r["share"]): r["value"] for r in ordering.exact_quantiles(df, "g", "v", [0.25, 0.5]).collect()}
    assert all(math.isclose(q[name, s], np.quantile([v for _, x, v in rows if x == name], s)) for name in ("hot", None) for s in (0.25, 0.5))
    assert ordering.row_numbers(df.limit(0), ["k"]).count() == 0
    b = ordering.batches(df, ["k"], 100).groupBy("batch").count().collect()
    assert sorted(r["count"] for r in b) == [100] * 5
    assert analytics.side_by_side_ranks(df, "k", ["v", "k"]).where("k_rank = 1").first()["k"] == 499


def test_lookup_and_rules(spark):
    a = spark.createDataFrame([("Heart_attack",), ("attack heart now",), ("nothing",)], "t string").withColumn("k", F.col("t"))
    v = spark.createDataFrame([(1, "heart attack"), (2, "Heart-Attack"), (3, "kidney stone")], "r int, n string")
    assert sorted((r["k"], r["r"], r["how"]) for r in curate.lookup(a, "k", "t", v, "r", "n").collect()) == [("Heart_attack", 1, "exact"), ("attack heart now", 1, "fuzzy")]
    names = spark.createDataFrame([("Aspirin",), ("CT scan",), ("Pain",), ("Atenolol",), ("ab",), ("12%-34",), ("Gout",), ("children's common health problems topics",), (None,)], "name string")
    known = spark.createDataFrame([("aspirin",), (None,)], "medication string")
    got = {r["name"]: r["reason"] for r in curate.vocabulary_reason(names, "name", known).collect()}
    want = {"Aspirin": "medication", "CT scan": "procedure", "Pain": "generic", "Atenolol": "medication_pattern (.*olol$)", "ab": "too_short", "12%-34": "too_many_special_chars", "Gout": None, None: None}
    assert {k: got[k] for k in want} == want and got["children's common health problems topics"] == "generic"
    r = spark.createDataFrame([("c", "x", "ED", "ED", True, 1.0, 0.5, 9, None), ("d", "x", "GP", None, False, 2.0, 0.1, 3, None)], "case_id string, config string, expected_triage string, predicted_triage string, success boolean, inference_time double, rag_time double, context_length int, error string")
    got = {x["case_id"]: (x["predicted"], x["is_correct"], x["inference_time"], x["error"]) for x in evaluate.case_record(r).collect()}
    assert got == {"c": ("ED", True, 1.0, None), "d": ("ERROR", False, 0.0, "unknown error")}
    m = spark.createDataFrame([("a_o0", 1.0), ("a_o50", 3.0), ("b", 1.0)], "m string, v double")
    assert [tuple(x) for x in analytics.overlap_gain(m, "m", "v").collect()] == [("a", 1.0, 3.0, 2.0)]
    assert one(spark, {"a": 1, "b": 3}, analytics.map_shares, "map<string,int>") == {"a": 25.0, "b": 75.0}


def test_contexts(spark):
    h = spark.createDataFrame([(1, 2, "s", "b"), (1, 1, "t", "a")], "q int, n int, s string, t string")
    assert h.groupBy("q").agg(chunking.numbered_context("n", "s", "t").alias("c")).first()["c"] == "[1] (t) a\n[2] (s) b"
    assert "Context" not in one(spark, "q", lambda c: chunking.prompt(c, F.lit(None).cast("string"))) and one(spark, "q", lambda c: chunking.prompt(c, F.lit("x"))).startswith("Patient query: q\n\nContext:\nx\n\n")


def test_long_documents_are_packed_in_time(spark):
    t = " ".join(f"Sentence number {i} has six words." for i in range(4000))
    got = chunking.sentence_packs(spark.createDataFrame([(1, t)], "k int, t string"), "k", "t", 60, 2).orderBy("chunk_no").collect()
    assert got[0]["n_sentences"] == 10 and got[1]["chunk"].startswith("Sentence number 8 ") and got[-1]["chunk"].endswith("number 3999 has six words.")


def test_rrf_and_quota(spark):
    x = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "q int, d string, rank int")
    y = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "q int, d string, rank int")
    s = {r["d"]: r["score"] for r in retrieval.rrf([(x, 0.7), (y, 0.3)], ["q"], "d").collect()}
    assert math.isclose(s["b"], 0.7 / 62 + 0.3 / 61) and math.isclose(s["a"], 0.7 / 61) and math.isclose(s["c"], 0.3 / 62)
    p = spark.createDataFrame([("s", 1), ("t", 0)], "p string, quota int")
    r = spark.createDataFrame([("s", 1), ("s", 2), ("t", 1)], "p string, rank int")
    assert [tuple(z) for z in retrieval.with_quota(r, p, "p", 5).select("p", "rank").collect()] == [("s", 1)]


def test_relevance_and_pass_at_k(spark):
    h = spark.createDataFrame([("c1", 1, "Heart_attack (Case 2)", "kidney.txt"), ("c1", 4, "Heart_attack (Case 2)", "Heart_Attack_facts.txt"), ("c2", 1, None, "x.txt")], "case string, rank int, s string, d string")
    cases = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "case string")
    p = evaluate.pass_at_k(h, cases, [], "case", "rank", evaluate.relevant_by_name(F.col("s"), F.col("d")), [1, 4, 10]).first()
    assert p["cases"] == 3 and p["pass_at_1"] == 0 and math.isclose(p["pass_at_4"], 1 / 3) and p["pass_at_4"] == p["pass_at_10"]


def test_chunks_rebuild_the_text(spark):
    t = "abcdefghij" * 5 + "xyz"
    df = spark.createDataFrame([(1, t), (2, ""), (3, None), (4, "short")], "k int, t string")
    c = chunking.fixed_windows(df, "k", "t", 10, 3).where("k = 1").orderBy("chunk_no").collect()
    out = ""
    for r in c:
        assert t[r["char_start"] : r["char_end"]] == r["chunk"]
        out = out[: r["char_start"]] + r["chunk"]
    assert out == t
    assert {r["k"] for r in chunking.fixed_windows(df, "k", "t", 10, 3).collect()} == {1, 4}
    s = spark.createDataFrame([(1, "One two three. Four five! Six seven eight nine? Ten."), (2, None), (3, " ")], "k int, t string")
    packs = [(r["chunk"], r["n_sentences"]) for r in chunking.sentence_packs(s, "k", "t", 5, 1).orderBy("k", "chunk_no").collect()]
    assert packs == [("One two three. Four five!", 2), ("Four five! Six seven eight nine?", 2), ("Six seven eight nine? Ten.", 2)]
    p = spark.createDataFrame([(1, "first paragraph here\n \nno\n\nsecond paragraph here")], "k int, t string")
    assert [r["chunk_no"] for r in chunking.paragraphs(p, "k", "t", 10).collect()] == [0, 2]


@pytest.mark.parametrize("n, want", [(1, (1, 0, 0)), (2, (1, 1, 0)), (3, (1, 1, 1)), (4, (2, 1, 1)), (7, (4, 1, 2)), (10, (7, 1, 2))])
def test_group_split(spark, n, want):
    df = sampling.split_within_groups(spark.range(n).withColumn("g", F.lit("x")), "g", ["id"])
    got = {r["part"]: r["count"] for r in df.groupBy("part").count().collect()}
    assert tuple(got.get(p, 0) for p in ("train", "val", "test")) == want


def test_stratified_takes_short_strata_whole(spark):
    df = spark.range(10).withColumn("s", F.when(F.col("id") < 2, "a").otherwise("b"))
    got = {r["stratum"]: r["count"] for r in sampling.stratified(df, F.col("s"), {"a": 5, "b": 3}, [F.col("id")]).groupBy("stratum").count().collect()}
    assert got == {"a": 2, "b": 3}


def test_curation(spark):
    a = spark.createDataFrame([(1, "heart attack"), (2, "zzz"), (3, None), (4, "")], "k int, t string")
    b = spark.createDataFrame([(10, "Attack, heart"), (11, "heart attack"), (12, "kidney")], "r int, t string")
    assert [tuple(r) for r in curate.fuzzy_best(a, "k", "t", b, "r", "t").collect()] == [(1, 10, 1.0)]
    v = spark.createDataFrame([("g", "HOME"), ("g", "ED"), ("h", "GP"), ("h", None)], "g string, l string")
    m = {r["g"]: (r["label"], r["votes"], r["source_count"]) for r in curate.majority_label(v, ["g"], "l", {"ED": 3, "GP": 2, "HOME": 1}).collect()}
    assert m == {"g": ("ED", 1, 2), "h": ("GP", 1, 1)}
    u = spark.createDataFrame([("g", 2, ["b", "c"]), ("g", 1, ["a", "b"])], "g string, o int, x array<string>")
    assert curate.ordered_union(u, ["g"], "x", "o").first()["x"] == ["a", "b", "c"]
    k = spark.createDataFrame([(2, "A"), (1, "a"), (3, None)], "i int, n string")
    assert sorted(r["i"] for r in curate.keep_first(k, F.lower("n"), [F.col("i")]).collect()) == [1, 3]


def test_analytics_edges(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (10.1,), (None,), (50.0,)], "v double")
    assert [r[0] for r in df.select(analytics.right_closed("v", [0, 10, 50])).collect()] == [None, 1, 2, None, 2]
    assert {r["bin"]: r["n"] for r in analytics.histogram(df, "v", 5).collect()} == {1: 1, 2: 2, 5: 1}
    g = analytics.marginal_gains(spark.createDataFrame([("c", 0.1, 0.3, 0.9)], "c string, a double, b double, d double"), ["c"], [(1, "a"), (2, "b"), (5, "d")]).orderBy("to_k").collect()
    assert [(r["from_k"], r["to_k"], round(r["gain_per_step"], 9), round(r["cumulative_gain"], 9)) for r in g] == [(1, 2, 0.2, 0.2), (2, 5, 0.2, 0.8)]


def test_operators_on_empty_tables(spark):
    e = spark.createDataFrame([], "k int, t string, p string")
    assert chunking.fixed_windows(e, "k", "t", 5).count() == 0 and chunking.sentence_packs(e, "k", "t", 5).count() == 0
    assert retrieval.bm25_topk(e, "k", "t", e.withColumnRenamed("k", "d"), "p", "d", "t", 3).count() == 0
    assert evaluate.confusion(e, ["p"], "t", "t").count() == 0


def test_synonyms(spark):
    df = spark.createDataFrame([("Acute_Myocardial_Infarction (Case 1)", "heart_attack.txt"), ("asthma", "child_asthma"), ("gout", "asthma"), (None, "x"), ("x", None)], "s string, d string")
    assert [r[0] for r in df.select(evaluate.relevant_by_synonym(F.col("s"), F.col("d"))).collect()] == [True, True, False, False, False]
