import json

from pyspark.sql import functions as F

from quern.sources import html, readers, sinks
from quern.streaming import frontier

PAGE = """<html><nav><p>menu entry to be ignored</p></nav><p>lost before the first heading</p><h1>Title</h1><p>A paragraph that is long enough.</p><p>short</p>
<ul><li>one</li><li class="ad x">advert</li></ul><h2>Empty</h2><h2>More</h2><p><a href="/a">a</a> <a href="b#frag">b</a> <a href="http://other.org/c">c</a></p><p>Kept text &amp; entity here.</p></html>"""


def test_sections(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>just one plain paragraph</p>"), (4, "<p>unclosed <b>bold")], "k int, h string")
    t = {r["k"]: r["t"] for r in df.select("k", html.sectioned(html.elements(F.col("h"), ["ad"])).alias("t")).collect()}
    assert t[1].split("\n\n") == ["--- Title ---", "A paragraph that is long enough.", "• one", "--- More ---", "Kept text & entity here."]
    assert t[2] == "" and t[3] == "just one plain paragraph" and t[4] == "unclosed bold"


def test_links(spark):
    df = spark.createDataFrame([("http://x.org/p/", PAGE), ("http://x.org/p/", PAGE), (None, None)], "u string, h string")
    assert sorted(r[0] for r in html.links(df, "u", "h").collect()) == ["http://x.org/a", "http://x.org/p/b"]
    assert html.links(df, "u", "h", same_host=False).count() == 3


def test_merged_pages(spark):
    df = spark.createDataFrame([("u", "2", "b"), ("u", "1", "a"), ("u", "3", "")], "u string, p string, t string")
    assert html.merged_pages(df, "u", "p", "t").first()["text"] == "=== 1 ===\n\na\n\n=== 2 ===\n\nb"


def test_chunk_and_case_files(spark, tmp_path):
    (tmp_path / "site_a_chunks_fixed_c512.json").write_text(json.dumps([{"chunk_id": "1", "text": "t"}, {"chunk_id": "2", "text": "u", "contextual_info": "c"}]))
    c = {r["chunk_id"]: r for r in readers.chunk_files(spark, str(tmp_path / "*_chunks_*.json")).collect()}
    assert c["1"]["source"] == "site_a" and c["1"]["strategy"] == "fixed_c512" and c["1"]["original_text"] == "t" and not c["1"]["is_contextual"] and c["2"]["is_contextual"]
    assert readers.complete_strategies(readers.chunk_files(spark, str(tmp_path / "*_chunks_*.json"))).count() == 0
    (tmp_path / "cases.json").write_text(json.dumps([{"id": 1, "query": "q"}, {"id": 2, "patient_query": '"p"', "patient_response": "r"}, {"id": 3}]))
    assert sorted((r["id"], r["query"]) for r in readers.case_files(spark, str(tmp_path / "cases.json")).collect()) == [(1, "q"), (2, "p r")]


def test_small_files(spark, tmp_path):
    (tmp_path / "v.txt").write_text("   1. Flu\nheading\n  12. Sore throat \n")
    assert [r["name"] for r in readers.numbered_lines(spark, str(tmp_path / "v.txt")).collect()] == ["Flu", "Sore throat"]
    assert [r["stem"] for r in readers.file_stems(spark, str(tmp_path / "*.txt")).collect()] == ["v"]
    assert readers.latest_file(spark, str(tmp_path / "*.txt")).endswith("v.txt")
    (tmp_path / "r.json").write_text(json.dumps({"timestamp": "x", "results": [{"config": {"config_name": "c"}, "pass_at_5": 0.5, "source_distribution": {"a": 3}}]}))
    r = readers.result_files(spark, str(tmp_path / "r.json")).first()
    assert r["config_name"] == "c" and r["pass_at_5"] == 0.5 and r["source_distribution"] == {"a": 3}


def test_incremental_write(spark, tmp_path):
    p = str(tmp_path / "t")
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, s string")
    assert readers.write_missing(a, p, ["k"], "s").count() == 2
    readers.write_missing(spark.createDataFrame([(2, "y"), (3, "y")], "k int, s string"), p, ["k"], "s")
    assert sorted(r["k"] for r in spark.read.parquet(p).collect()) == [1, 2, 3]
    m = {r["s"]: r["items"] for r in readers.manifest(spark.read.parquet(p).select(F.col("s").cast("string").alias("s")), "s").collect()}
    assert m == {"x": 1, "y": 2, None: 3}


def test_streamed_pages_are_taken_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "url string, crawled_at timestamp"
    rows = lambda *u: spark.createDataFrame([(x,) for x in u], "url string").withColumn("crawled_at", F.lit("2025-01-01 00:00:00").cast("timestamp"))
    rows("a", "b", "a").coalesce(1).write.parquet(src + "/1")
    for extra in (None, ("b", "c")):
        if extra:
            rows(*extra).coalesce(1).write.parquet(src + "/2")
        s = frontier.new_pages(spark, src + "/*", schema)
        frontier.append_missing(s, out, str(tmp_path / "cp"), ["url"]).awaitTermination()
    assert sorted(r["url"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_windows_over_a_table(spark):
    e = spark.createDataFrame([("2025-01-01 00:10:00", "a", 1.0), ("2025-01-01 00:50:00", "a", 2.0), ("2025-01-01 01:10:00", "a", 4.0)], "t string, k string, v double").withColumn("t", F.col("t").cast("timestamp"))
    assert sorted(r["total"] for r in frontier.windowed_counts(e, "t", "k", "v").collect()) == [3.0, 4.0]


def test_broken_and_nested_markup(spark):
    page = "<h1>Top<p>One paragraph inside <b>of <i>nested</i></b> tags</p><div><ul><li>item <ul><li>inner</li></ul></li></ul><p>Contact us at the desk today</p><p><a>x</a> <a>y</a></p><h2>Open & <em>closed"
    df = spark.createDataFrame([(page,), ("<" * 50,), ("<p>" * 300 + "deep enough text",)], "h string")
    got = [r["t"] for r in df.select(html.sectioned(html.content(html.elements(F.col("h")), least=4)).alias("t")).collect()]
    assert "of nested tags" in got[0] and "Contact us" not in got[0] and "deep enough text" in got[2]
    assert [r["n"] for r in df.select(F.size(html.content(html.elements(F.col("h")), phrases=[], least=4)).alias("n")).collect()][0] >= 4


def test_fallbacks_and_combined_sources(spark, tmp_path):
    for s in ("a", "c"):
        (tmp_path / f"{s}_chunks_fixed.json").write_text(json.dumps([{"chunk_id": f"{s}1", "text": "t"}]))
    c = readers.combined_chunks(spark, str(tmp_path), ["a", "b", "c"], "fixed")
    assert sorted((r["source"], r["source_ord"]) for r in c.collect()) == [("a", 0), ("c", 2)]
    (tmp_path / "v2.txt").write_text("1. Flu\n")
    assert readers.numbered_lines(spark, [str(tmp_path / "none.txt"), str(tmp_path / "v2.txt")]).count() == 1
    (tmp_path / "cases.json").write_text(json.dumps([{"id": i, "query": f"q{i}"} for i in (3, 1, 2)]))
    cases = readers.case_files(spark, str(tmp_path / "missing.json"), fallback=str(tmp_path / "cases.json"))
    assert [r["id"] for r in readers.first_cases(cases, 2).orderBy("id").collect()] == [1, 2]
    (tmp_path / "q.json").write_text(json.dumps({"profiles": {"wide": {"b": 3, "a": 4}}}))
    assert sorted((r["source"], r["source_ord"], r["quota"]) for r in readers.quota_profiles(spark, str(tmp_path / "q.json"), "main").collect()) == [("a", 1, 4), ("b", 2, 3)]


def test_nested_results(spark, tmp_path):
    (tmp_path / "flat.json").write_text(json.dumps([{"config_name": "c", "pass_at_5": 0.5, "memory_stats": {"peak_memory_mb": 9.0, "start_memory_mb": 4.0}, "source_distribution": {"a": 1, "b": 3}}, {"config_name": "d"}]))
    r = {x["config_name"]: x for x in readers.flat_results(spark, str(tmp_path / "flat.json")).collect()}
    assert r["c"]["peak_mb"] == 5.0 and r["c"]["total"] == 4 and r["c"]["pct"] == {"a": 25.0, "b": 75.0} and r["c"]["pass_at_1"] == 0.0 and r["d"]["total"] is None
    one = {"config": {"model_name": "Fam-135M_4bit", "rag_config": None, "test_name": "t"}, "triage_accuracy": 0.5, "cases_evaluated": 10, "unknown_triage_count": 2, "classification_report": {"ED": {"precision": 0.1, "recall": 0.2, "f1-score": 0.3}}}
    (tmp_path / "e.json").write_text(json.dumps({"results": [one]}))
    e = readers.evaluation_files(spark, str(tmp_path / "e.json")).first()
    assert e["family"] == "Fam" and e["rag_config"] == "NoRAG" and e["ed_f1"] == 0.3 and e["gp_f1"] is None and e["extraction_rate"] == 0.8


def test_sinks(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    df = spark.createDataFrame([("a", 0.5, {"x": 1}), ("b", 0.9, None), ("c", None, None)], "config string, m double, d map<string,int>")
    sinks.write_summaries(df, at("j"))
    assert spark.read.json(at("j")).count() == 3
    for i in (1, 2, 2):
        sinks.append_snapshot(df.limit(i), at("s"), i)
    assert sorted(r["iteration"] for r in spark.read.parquet(at("s")).collect()) == [1, 2, 2]
    cases = spark.createDataFrame([(c, f"k{i}") for c in "abc" for i in range(4)], "config string, case_id string")
    sinks.write_details(df, cases, at("d"), "m", top=2, first=3)
    assert sorted((r["config"], r["case_id"]) for r in spark.read.json(at("d")).collect()) == [(c, f"k{i}") for c in "ab" for i in range(3)]
    sinks.write_csv(df, at("c"))
    assert {r["config"]: r["d"] for r in spark.read.option("header", True).option("escape", "\\").csv(at("c")).collect()}["a"] is not None
    sinks.write_report(df.orderBy("config"), at("r"), lambda r: f"{r['config']} {r['m']}", "Results")
    assert [r["value"] for r in spark.read.text(at("r")).collect()] == ["Results", "-------", "a 0.5", "b 0.9", "c None"]
    sinks.write_prompts(spark.createDataFrame([("p", "c"), ("", "c"), (None, "c")], "prompt string, completion string"), at("p"))
    assert [tuple(r) for r in spark.read.json(at("p")).select("prompt", "completion").collect()] == [("p", "c")]


def test_indexes_are_written_and_read(spark, tmp_path):
    from quern.operators import retrieval

    c = spark.createDataFrame([("k1", "s", "a b a", [3.0, 4.0]), ("k2", "s", None, None)], "k string, p string, t string, v array<double>")
    sinks.write_vectors(retrieval.vector_index(c, "k", "v", "p"), str(tmp_path / "v"))
    assert [r["vec"] for r in spark.read.parquet(str(tmp_path / "v")).collect()] == [[0.6, 0.8]]
    sinks.write_postings(retrieval.lexical_index(c, "p", "k", "t"), str(tmp_path / "p"))
    assert sorted((r["term"], r["key"], r["tf"], r["dl"]) for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [("a", "k1", 2, 3), ("b", "k1", 1, 3)]


def test_chunks_in_sql(spark):
    from quern.functions import udtf

    udtf.register(spark)
    spark.createDataFrame([(1, "abcdef"), (2, None)], "k int, t string").createOrReplaceTempView("texts")
    got = spark.sql("select k, c.chunk from texts, lateral chunk(t, 4, 2) c order by k, chunk_no").collect()
    assert [tuple(r) for r in got] == [(1, "abcd"), (1, "cdef"), (1, "ef")]


def test_shared_folder_is_asked_for(spark, monkeypatch):
    import pytest

    from quern import session

    class Away:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

    with pytest.raises(RuntimeError):
        session.shared_dir(Away)


def test_hot_keys_are_looked_up_both_ways(spark):
    from quern.session import salted_lookup

    left = spark.createDataFrame([(i, "hot" if i % 3 else None if i % 2 else f"k{i}") for i in range(300)], "i int, k string")
    right = spark.createDataFrame([("hot", 1), ("k6", 2), (None, 3)], "k string, v int")
    for how in ("left", "inner"):
        few, many = (sorted((r["i"], r["v"] or 0) for r in salted_lookup(left, right, "k", "i", how=how, few=n).select("i", "v").collect()) for n in (10, 0))
        assert few == many and len(few) == (300 if how == "left" else 201)
    plan = salted_lookup(left, right, "k", "i", few=0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
