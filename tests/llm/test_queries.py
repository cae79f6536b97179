from quern.llm import queries
from tests.compare import canonical, views


def test_all_queries_match_their_sql(spark, small):
    c = views(small)
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, small).toPandas(), c.execute(sql).fetchdf()
        assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want), name


def test_found_columns(spark, small):
    want = {"p5_found": ["plan", "category"], "p6_ids": ["doc_id", "ids"], "p7_found": ["mix", "source"], "p8_found": ["doc_id", "band"], "p1_found": ["dialogue_id", "condition_id"]}
    for name, cols in want.items():
        assert queries.queries()[name](spark, small).columns == cols


def test_groups_have_a_row_for_each_dialogue(spark, small):
    g = queries.p3_groups(spark, small)
    ids = spark.read.parquet(f"{small}/dialogues.parquet").select("dialogue_id")
    assert g.count() == ids.count() and g.select("dialogue_id").exceptAll(ids).count() == 0 and g.where("rep is null or group is null or links is null").count() == 0
