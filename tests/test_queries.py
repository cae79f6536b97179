import pytest

from quern.plans import catalogue
from tests.compare import canonical, views

NAMES = sorted(catalogue.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, small, name):
    got = catalogue.queries()[name](spark, small).toPandas()
    want = views(small).execute(catalogue.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry_and_names(spark, small):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    df = e.entry(spark)
    assert df.columns[:3] == ["dialogue_id", "src", "chunk_id"] and df.count() > 0


def test_rank_limits_reach_the_plan(spark, small):
    from pyspark.sql import functions as F

    from quern.operators.retrieval import ranked

    df = spark.range(100).select((F.col("id") % 3).alias("g"), "id", (F.col("id") % 7).cast("double").alias("score"))
    plan = ranked(df, ["g"], "id", 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_tfidf_moves_no_terms_and_copies_no_documents(spark, small, monkeypatch):
    """Beyond the size of one broadcast too: documents are not dealt to blocks of queries, and terms of candidates are never rows."""
    from quern.operators import retrieval

    monkeypatch.setattr(retrieval, "SMALL_TERMS", 100)
    monkeypatch.setattr(retrieval, "C_BLOCK", 20)
    df = catalogue.queries()["tfidf_rerank"](spark, small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CoGroups" not in plan and "Generate" not in plan and plan.count("FlatMapGroupsInArrow") == 1
    want = views(small).execute(catalogue.oracle_sql()["tfidf_rerank"]).fetchdf()
    assert canonical(df.toPandas()) == canonical(want)


def test_scans_read_only_what_they_need(spark, small):
    plan = catalogue.queries()["group_means"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in plan and "l_orderkey" not in plan
    plan = catalogue.queries()["pass_at_k"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_entry_without_the_subpackage(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as e

    for name in [n for n in sys.modules if n.startswith("quern.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "quern.llm", None)
    alone = importlib.reload(e)
    assert set(alone.queries()) == set(NAMES) | (set(catalogue.queries()) - set(NAMES)) and not any(n.startswith("p1_") for n in alone.queries())
    monkeypatch.undo()
    importlib.reload(e)
