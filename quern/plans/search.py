"""Registered searches: BM25, exact vectors, fusion, quotas, reranking and what is built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import labels
from quern.functions.text import SPACE, source_key
from quern.operators import chunking, evaluate, retrieval
from quern.plans.registry import query, r6
from quern.session import table, written

SRC = r"regexp_replace(lower(source), '[\s _\-]+', '', 'g')"
BODY = "CASE WHEN coalesce(is_contextual, false) THEN concat_ws(' ', text, contextual_info) ELSE coalesce(text, original_text) END"


def _bm25_sql(p: str = "", part: str = SRC, k1: float = 1.5) -> str:
    """Common tables ``<p>bmr``: BM25 scores with ranks. ``p`` keeps several of them apart."""
    return rf"""
{p}ch AS (SELECT {part} AS src, chunk_id, {BODY} AS body FROM chunks),
{p}tok AS (SELECT src, chunk_id, list_filter(string_split_regex(lower(body), '{SPACE}'), lambda x: x <> '') AS t FROM {p}ch WHERE src IS NOT NULL),
{p}post AS (SELECT src, chunk_id, len(t) AS dl, u.term, count(*) AS tf FROM {p}tok, unnest(t) AS u(term) GROUP BY ALL),
{p}st AS (SELECT src, count(*) AS n, avg(coalesce(len(t), 0)) AS avgdl FROM {p}tok GROUP BY src),
{p}raw AS (SELECT {p}post.src, term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS v FROM {p}post JOIN {p}st USING (src) GROUP BY {p}post.src, term),
{p}mu AS (SELECT src, avg(v) AS m FROM {p}raw GROUP BY src),
{p}idf AS (SELECT {p}raw.src, term, CASE WHEN v < 0 THEN 0.25 * m ELSE v END AS idf FROM {p}raw JOIN {p}mu USING (src)),
{p}qt AS (SELECT dialogue_id, u.term, count(*) AS qtf FROM (SELECT dialogue_id, list_filter(string_split_regex(lower(patient_query), '{SPACE}'), lambda x: x <> '') AS t
    FROM dialogues WHERE dialogue_id % 50 = 0), unnest(t) AS u(term) GROUP BY ALL),
{p}bm AS (SELECT q.dialogue_id, d.src, d.chunk_id, sum(qtf * idf * tf * {k1 + 1} / (tf + {k1} * (0.25 + 0.75 * dl / avgdl))) AS score
    FROM {p}qt q JOIN {p}post d USING (term) JOIN {p}idf i ON i.src = d.src AND i.term = d.term JOIN {p}st s ON s.src = d.src GROUP BY ALL),
{p}bmr AS (SELECT *, row_number() OVER (PARTITION BY dialogue_id, src ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM {p}bm WHERE round(score, 9) > 0)
"""


def _dense_sql(p: str = "", part: str = SRC) -> str:
    """Common tables ``<p>dnr``: cosines of hashed term vectors with ranks."""
    dim = "CAST('0x' || substr(md5(u.term), 1, 6) AS BIGINT) % 64"
    return rf"""
{p}cv AS (SELECT src, chunk_id, {dim} AS dim, count(*)::DOUBLE AS v FROM (SELECT {part} AS src, chunk_id, list_filter(string_split_regex(lower({BODY}), '{SPACE}'), lambda x: x <> '') AS t FROM chunks), unnest(t) AS u(term) GROUP BY ALL),
{p}qv AS (SELECT dialogue_id, {dim} AS dim, count(*)::DOUBLE AS v FROM (SELECT dialogue_id, list_filter(string_split_regex(lower(patient_query), '{SPACE}'), lambda x: x <> '') AS t FROM dialogues WHERE dialogue_id % 50 = 0), unnest(t) AS u(term) GROUP BY ALL),
{p}cn AS (SELECT chunk_id, sqrt(sum(v * v)) AS n FROM {p}cv GROUP BY chunk_id), {p}qn AS (SELECT dialogue_id, sqrt(sum(v * v)) AS n FROM {p}qv GROUP BY dialogue_id),
{p}dot AS (SELECT dialogue_id, chunk_id, sum(c.v * q.v) AS dot FROM {p}cv c JOIN {p}qv q USING (dim) GROUP BY ALL),
{p}dn AS (SELECT a.dialogue_id, c.src, c.chunk_id, round(coalesce(dot / ({p}cn.n * {p}qn.n), 0), 9) AS score FROM (SELECT dialogue_id FROM dialogues WHERE dialogue_id % 50 = 0) a
    CROSS JOIN (SELECT {part} AS src, chunk_id FROM chunks) c LEFT JOIN {p}dot USING (dialogue_id, chunk_id) LEFT JOIN {p}cn USING (chunk_id) LEFT JOIN {p}qn USING (dialogue_id) WHERE src IS NOT NULL),
{p}dnr AS (SELECT *, row_number() OVER (PARTITION BY dialogue_id, src ORDER BY score DESC, chunk_id) AS rank FROM {p}dn)
"""


def chunks(spark: SparkSession, d: str, part: bool = True) -> DataFrame:
    c = table(spark, d, "chunks")
    body = chunking.lexical_text(F.col("original_text"), F.col("text"), F.col("contextual_info"), F.col("is_contextual"))
    return c.select((source_key(F.col("source")) if part else F.lit("all")).alias("src"), "chunk_id", body.alias("body"))


def cases(spark: SparkSession, d: str) -> DataFrame:
    """The query set: every dialogue whose id is divisible by 50."""
    return table(spark, d, "dialogues").where("dialogue_id % 50 = 0").select("dialogue_id", "patient_query")


def _bm25(spark: SparkSession, d: str, k: int, part: bool = True, k1: float = retrieval.K1) -> DataFrame:
    return retrieval.bm25_topk(cases(spark, d), "dialogue_id", "patient_query", chunks(spark, d, part), "src", "chunk_id", "body", k, k1)


def _dense(spark: SparkSession, d: str, k: int, part: bool = True) -> DataFrame:
    q = cases(spark, d).select("dialogue_id", retrieval.hashed_terms(F.col("patient_query")).alias("v"))
    c = chunks(spark, d, part).where("src is not null").withColumn("v", retrieval.hashed_terms(F.col("body")))
    return retrieval.knn(q, "dialogue_id", c, "chunk_id", "v", k, part="src", leave_out_self=False)


@query(f"WITH {_bm25_sql()} SELECT dialogue_id, src, chunk_id, round(score, 6) AS score, rank FROM bmr WHERE rank <= 10")
def retrieval_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """Ten best chunks of each source by BM25."""
    return _bm25(spark, d, 10).select("dialogue_id", "src", "chunk_id", r6("score").alias("score"), "rank")


@query(f"WITH {_bm25_sql(part="'all'", k1=1.2)} SELECT dialogue_id, chunk_id, round(score, 6) AS score, rank FROM bmr WHERE rank <= 20")
def full_text_search(spark: SparkSession, d: str) -> DataFrame:
    """BM25 over all chunks with the saturation of full-text indexes; what is asked for is clamped to 20 hits."""
    asked = 25
    return _bm25(spark, d, min(asked, 20), part=False, k1=1.2).select("dialogue_id", "chunk_id", r6("score").alias("score"), "rank")


_KNN = """
e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS n FROM e),
s AS (SELECT q.vec_id AS query_id, c.vec_id, c.label, q.label AS query_label, round(list_dot_product(q.v, c.v) / (q.n * c.n), 9) AS score
    FROM u q JOIN u c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
"""


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.withColumn("src", F.col("label").cast("string"))


@query(f"WITH {_KNN} r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def knn_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """Exact nearest neighbours by cosine."""
    q, e = _vectors(spark, d)
    return retrieval.knn(q, "query_id", e, "vec_id", "embedding", 10).select("query_id", "vec_id", r6("score").alias("score"), "rank")


@query("SELECT vec_id, label::VARCHAR AS src, round(sqrt(list_dot_product(v, v)), 6) > 0 AS filled, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, round(v[64] / sqrt(list_dot_product(v, v)), 6) AS last FROM (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL)")
def vector_index(spark: SparkSession, d: str) -> DataFrame:
    """The written index of normalised vectors, each with its own key; its ends and whether it is filled."""
    v = retrieval.vector_index(table(spark, d, "embeddings"), "vec_id", "embedding", "label")
    return v.select(F.col("key").alias("vec_id"), F.col("part").alias("src"), (r6(F.sqrt(retrieval.dot(F.col("vec"), F.col("vec")))) > 0).alias("filled"), r6(F.get("vec", F.lit(0))).alias("first"), r6(F.get("vec", F.lit(63))).alias("last"))


_QUOTA = "p AS (SELECT label::VARCHAR AS src, (label % 4)::INT AS quota, label AS ord FROM (SELECT DISTINCT label FROM embeddings))"


def _quota(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("label").cast("string").alias("src"), (F.col("label") % 4).cast("int").alias("quota"), F.col("label").alias("ord")).distinct()


@query(
    f"""WITH {_KNN} {_QUOTA}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS rank FROM s),
    h AS (SELECT query_id, src, vec_id, score, rank, ord FROM r JOIN p ON p.src = r.label::VARCHAR WHERE rank <= quota)
    SELECT query_id, src, vec_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS pos, row_number() OVER (PARTITION BY query_id ORDER BY ord, rank) AS legacy_pos FROM h"""
)
def quota_dense(spark: SparkSession, d: str) -> DataFrame:
    """Per-source quotas on exact neighbours; ``pos`` by score, ``legacy_pos`` by source order."""
    q, e = _vectors(spark, d)
    h = retrieval.with_quota(retrieval.knn(q, "query_id", e, "vec_id", "embedding", 3, part="src"), _quota(spark, d), "src", 3)
    pos = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    legacy = F.row_number().over(W.partitionBy("query_id").orderBy("ord", "rank"))
    return h.select("query_id", "src", "vec_id", "rank", pos.alias("pos"), legacy.alias("legacy_pos"))


@query(
    """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
    u AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS n FROM e),
    s AS (SELECT q.vec_id AS q, q.label AS ql, c.label AS cl, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.v, c.v) / (q.n * c.n), 9) DESC, c.vec_id) AS rank
        FROM u q JOIN u c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
    f AS (SELECT q, min(rank) FILTER (ql = cl) AS first FROM s WHERE rank <= 10 GROUP BY q)
    SELECT count(*) AS cases, round(avg(coalesce((first <= 1)::INT, 0)), 6) AS pass_at_1, round(avg(coalesce((first <= 5)::INT, 0)), 6) AS pass_at_5, round(avg(coalesce((first <= 10)::INT, 0)), 6) AS pass_at_10 FROM f"""
)
def pass_at_k_dense(spark: SparkSession, d: str) -> DataFrame:
    """Pass@k of exact search where a vector of the same label is relevant."""
    q, e = _vectors(spark, d)
    own = e.select("vec_id", "label")
    h = retrieval.knn(q, "query_id", e, "vec_id", "embedding", 10).join(own, "vec_id")
    h = h.join(own.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label")), "query_id")
    out = evaluate.pass_at_k(h, q, [], "query_id", "rank", F.col("label") == F.col("query_label"), [1, 5, 10])
    return out.select("cases", *(r6(c).alias(c) for c in out.columns if c.startswith("pass")))


def hit_lists(spark: SparkSession, d: str) -> DataFrame:
    """One row a hit (exact repeats are one), with its best rank."""
    h = table(spark, d, "hits")
    return h.groupBy("config", "case_id", source_key(F.col("source")).alias("src"), "chunk_id").agg(F.min("rank").alias("rank"), F.max("score").alias("score"))


HITS = r"""hl AS (SELECT config, case_id, regexp_replace(lower(source), '[\s _\-]+', '', 'g') AS src, chunk_id, min(rank) AS rank, max(score) AS score FROM hits GROUP BY ALL)"""


_CONFIG = r"'^(.*)_(semantic|hybrid|bm25)_(.*)$'"


@query(
    f"""WITH {HITS}, two AS (SELECT regexp_extract(config, {_CONFIG}, 1) AS chunking, regexp_extract(config, {_CONFIG}, 2) AS kind, regexp_extract(config, {_CONFIG}, 3) AS profile, case_id, src, chunk_id, rank FROM hl),
    d AS (SELECT chunking, profile, case_id, src, chunk_id, rank AS r FROM two WHERE kind = 'semantic'), l AS (SELECT chunking, profile, case_id, src, chunk_id, rank AS r FROM two WHERE kind = 'bm25'),
    f AS (SELECT coalesce(d.chunking, l.chunking) AS chunking, coalesce(d.profile, l.profile) AS profile, coalesce(d.case_id, l.case_id) AS case_id, coalesce(d.src, l.src) AS src, coalesce(d.chunk_id, l.chunk_id) AS chunk_id,
        coalesce(0.7 / (60 + d.r), 0) + coalesce(0.3 / (60 + l.r), 0) AS fused, 0.7 / (60 + coalesce(d.r, 1000000)) + 0.3 / (60 + coalesce(l.r, 1000000)) AS mobile
        FROM d FULL JOIN l ON d.chunking = l.chunking AND d.profile = l.profile AND d.case_id = l.case_id AND d.src IS NOT DISTINCT FROM l.src AND d.chunk_id = l.chunk_id)
    SELECT chunking, profile, case_id, src, chunk_id, round(fused, 8) AS fused, round(mobile, 8) AS mobile FROM f"""
)
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Reciprocal-rank fusion of the vector and the BM25 hits of each chunking and profile, with and without a term for missing ranks."""
    parts = [F.regexp_extract("config", r"^(.*)_(semantic|hybrid|bm25)_(.*)$", i).alias(n) for i, n in ((1, "chunking"), (2, "kind"), (3, "profile"))]
    h = hit_lists(spark, d).select(*parts, "case_id", "src", "chunk_id", "rank")
    by = ["chunking", "profile", "case_id", "src"]
    lists = [(h.where("kind = 'semantic'"), 0.7), (h.where("kind = 'bm25'"), 0.3)]
    both = retrieval.rrf(lists, by, "chunk_id", also_missing=1_000_000)
    return both.select(*by, "chunk_id", F.round("score", 8).alias("fused"), F.round("score_missing", 8).alias("mobile"))


@query(
    f"""WITH {HITS} , p AS (SELECT profile, suite, regexp_replace(lower(source), '[\\s _\\-]+', '', 'g') AS src, source_ord, quota FROM quota_profiles WHERE quota > 0),
    x AS (SELECT suite, profile, config, case_id, hl.src, chunk_id, source_ord, row_number() OVER (PARTITION BY suite, profile, config, case_id, hl.src ORDER BY rank, chunk_id) AS rn, quota FROM hl JOIN p USING (src))
    SELECT suite, profile, config, src, count(*) AS hits FROM x WHERE rn <= quota GROUP BY ALL"""
)
def quota_profile_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits of each configuration under every quota profile, by source."""
    p = table(spark, d, "quota_profiles").where("quota > 0").select("suite", "profile", source_key(F.col("source")).alias("src"), "quota")
    x = hit_lists(spark, d).withColumn("rn", F.row_number().over(W.partitionBy("config", "case_id", "src").orderBy("rank", "chunk_id")))
    return x.join(F.broadcast(p), "src").where("rn <= quota").groupBy("suite", "profile", "config", "src").agg(F.count(F.lit(1)).alias("hits"))


_PROFILES = rf"pf AS (SELECT suite, profile, {SRC} AS src, quota FROM quota_profiles WHERE quota > 0)"
_FUSED = f"""{_PROFILES}, dl AS (SELECT dialogue_id, suite, profile, d.src, chunk_id, rank AS r FROM dnr d JOIN pf USING (src) WHERE rank <= 2 * quota),
    ll AS (SELECT dialogue_id, suite, profile, b.src, chunk_id, rank AS r FROM bmr b JOIN pf USING (src) WHERE rank <= 2 * quota),
    fu AS (SELECT dialogue_id, suite, profile, src, chunk_id, coalesce(0.7 / (60 + dl.r), 0) + coalesce(0.3 / (60 + ll.r), 0) AS score FROM dl FULL JOIN ll USING (dialogue_id, suite, profile, src, chunk_id)),
    fr AS (SELECT *, row_number() OVER (PARTITION BY dialogue_id, suite, profile, src ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM fu),
    hq AS (SELECT fr.*, row_number() OVER (PARTITION BY dialogue_id, suite, profile ORDER BY round(score, 9) DESC, src, chunk_id) AS pos FROM fr JOIN pf USING (suite, profile, src) WHERE rank <= quota)"""


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "quota_profiles").select("suite", "profile", source_key(F.col("source")).alias("src"), "quota")


def _hybrid_quota(spark: SparkSession, d: str, most: int = 20) -> DataFrame:
    """``most`` is twice the largest quota of the profiles (10)."""
    return retrieval.hybrid_quota(_dense(spark, d, most), _bm25(spark, d, most), _profiles(spark, d), ["dialogue_id"], "src", "chunk_id", ["suite", "profile"])


@query(f"WITH {_bm25_sql()}, {_dense_sql()}, {_FUSED} SELECT dialogue_id, suite, profile, src, chunk_id, round(score, 8) AS score, rank, pos FROM hq")
def hybrid_quota(spark: SparkSession, d: str) -> DataFrame:
    """Vectors and BM25 with twice the quota from each, fused, ranked anew and cut to the quota of each profile."""
    return _hybrid_quota(spark, d).select("dialogue_id", "suite", "profile", "src", "chunk_id", F.round("score", 8).alias("score"), "rank", "pos")


def _one_sql(cut: int) -> str:
    return f"""one AS (SELECT dialogue_id, chunk_id, coalesce(0.7 / (60 + d.rank), 0) + coalesce(0.3 / (60 + b.rank), 0) AS score
    FROM (SELECT * FROM dnr WHERE rank <= {2 * cut}) d FULL JOIN (SELECT * FROM bmr WHERE rank <= {2 * cut}) b USING (dialogue_id, chunk_id)),
    oner AS (SELECT *, row_number() OVER (PARTITION BY dialogue_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM one)"""


def _hybrid(spark: SparkSession, d: str, k: int) -> DataFrame:
    return retrieval.hybrid(_dense(spark, d, 2 * k, False), _bm25(spark, d, 2 * k, False), ["dialogue_id"], "chunk_id", k)


_ALL = f"{_bm25_sql(part="'all'")}, {_dense_sql(part="'all'")}"


@query(f"WITH {_ALL}, {_one_sql(20)} SELECT dialogue_id, chunk_id, round(score, 8) AS score, rank FROM oner WHERE rank <= 20")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Twenty best of all chunks from both lists of forty, fused."""
    return _hybrid(spark, d, 20).select("dialogue_id", "chunk_id", F.round("score", 8).alias("score"), "rank")


_SETS = rf"""list_distinct(list_filter(string_split_regex(lower(coalesce(patient_query, '')), '{SPACE}'), lambda x: x <> '')) AS q, list_distinct(list_filter(string_split_regex(lower(coalesce(body, '')), '{SPACE}'), lambda x: x <> '')) AS dd"""
_FEATURE = "2.0 * len(list_intersect(q, dd)) + 1.5 * coalesce(len(list_intersect(q, dd)) / nullif(len(q) + len(dd) - len(list_intersect(q, dd)), 0), 0) + coalesce(len(list_intersect(q, dd)) / nullif(len(q), 0), 0)"
_STAGES = f"""{_one_sql(30)}, hits_ AS (SELECT o.*, {_SETS}, count(*) OVER (PARTITION BY o.dialogue_id) AS n FROM (SELECT * FROM oner WHERE rank <= 30) o JOIN ch USING (chunk_id) JOIN dialogues USING (dialogue_id)),
    ts AS (SELECT dialogue_id, chunk_id, n > 10 AS reranked, row_number() OVER (PARTITION BY dialogue_id ORDER BY CASE WHEN n > 10 THEN round({_FEATURE}, 9) ELSE -rank END DESC, chunk_id) AS rank FROM hits_)"""


def _reranked(spark: SparkSession, d: str, fused: DataFrame, k: int) -> DataFrame:
    h = fused.join(chunks(spark, d, False).drop("src"), "chunk_id").join(cases(spark, d), "dialogue_id")
    return retrieval.two_stage(retrieval.with_feature_scores(h, "patient_query", "body"), ["dialogue_id"], F.col("feature_score"), "chunk_id", k)


@query(f"WITH {_ALL}, {_STAGES} SELECT dialogue_id, chunk_id, reranked, rank FROM ts WHERE rank <= 10")
def two_stage_search(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search for thirty hits, reranked by features only where more than ten came, cut to ten."""
    return _reranked(spark, d, _hybrid(spark, d, 30), 10).select("dialogue_id", "chunk_id", "reranked", "rank")


@query(
    f"""WITH {_ALL}, {_STAGES}, al AS (SELECT 'semantic' AS kind, dialogue_id, chunk_id, rank FROM dnr UNION ALL SELECT 'bm25', dialogue_id, chunk_id, rank FROM bmr UNION ALL SELECT 'hybrid', dialogue_id, chunk_id, rank FROM oner
    UNION ALL SELECT 'contextual', dialogue_id, chunk_id, rank FROM ts) SELECT dialogue_id, kind, chunk_id, rank FROM al WHERE rank <= 10 AND kind = (['semantic', 'bm25', 'hybrid', 'contextual'])[(dialogue_id // 50) % 4 + 1]"""
)
def dispatched_search(spark: SparkSession, d: str) -> DataFrame:
    """One batch of queries, each sent to the search that its row names; four distinct searches."""
    names = ["semantic", "bm25", "hybrid", "contextual"]
    routes = cases(spark, d).select("dialogue_id", F.get(F.array(*map(F.lit, names)), (F.floor(F.col("dialogue_id") / 50) % 4).cast("int")).alias("kind"))
    cut = lambda df: df.where("rank <= 10").select("dialogue_id", "chunk_id", "rank")
    dense, lexical = written(_dense(spark, d, 60, False), "dense"), written(_bm25(spark, d, 60, False), "lexical")  # each read by several searches
    fused = retrieval.hybrid(dense, lexical, ["dialogue_id"], "chunk_id", 30)
    kinds = {"semantic": dense, "bm25": lexical, "hybrid": fused, "contextual": _reranked(spark, d, fused, 10)}
    return retrieval.dispatched({k: cut(v) for k, v in kinds.items()}, routes, "dialogue_id", "kind").select("dialogue_id", "kind", "chunk_id", "rank")


@query(
    f"""WITH {_bm25_sql()}, top AS (SELECT dialogue_id, src, chunk_id, body, patient_query FROM bmr JOIN ch USING (src, chunk_id) JOIN dialogues USING (dialogue_id) WHERE rank <= 10),
    t AS (SELECT *, {_SETS} FROM top), f AS (SELECT dialogue_id, src, chunk_id, {_FEATURE} AS feature_score FROM t)
    SELECT dialogue_id, src, chunk_id, round(feature_score, 6) AS feature_score, row_number() OVER (PARTITION BY dialogue_id ORDER BY round(feature_score, 9) DESC, chunk_id) AS rank FROM f"""
)
def feature_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The ten BM25 candidates of each source reranked by token overlap."""
    top = _bm25(spark, d, 10).drop("score", "rank").join(chunks(spark, d), ["src", "chunk_id"]).join(cases(spark, d), "dialogue_id")
    s = retrieval.with_feature_scores(top, "patient_query", "body").select("dialogue_id", "src", "chunk_id", "feature_score")
    return retrieval.ranked(s, ["dialogue_id"], "chunk_id", 10**9, score="feature_score").withColumn("feature_score", r6("feature_score"))


_STOPS = ", ".join(f"'{w}'" for w in retrieval.STOP_WORDS)


@query(
    rf"""WITH {_bm25_sql()}, top AS (SELECT dialogue_id, chunk_id, body, patient_query FROM bmr JOIN ch USING (src, chunk_id) JOIN dialogues USING (dialogue_id) WHERE rank <= 10),
    both_ AS (SELECT dialogue_id, chunk_id, body AS t FROM top UNION ALL SELECT DISTINCT dialogue_id, NULL, patient_query FROM top),
    n AS (SELECT dialogue_id, count(*) AS n FROM both_ GROUP BY dialogue_id),
    tf AS (SELECT dialogue_id, chunk_id, u.term, count(*) AS tf FROM (SELECT dialogue_id, chunk_id, list_filter(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({_STOPS})) AS l FROM both_), unnest(l) AS u(term) GROUP BY ALL),
    df0 AS (SELECT dialogue_id, term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY ALL), df AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dialogue_id ORDER BY total DESC, term) AS r FROM df0) WHERE r <= 5000),
    w AS (SELECT tf.dialogue_id, chunk_id, tf.term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (dialogue_id, term) JOIN n USING (dialogue_id)),
    norm AS (SELECT dialogue_id, chunk_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
    u AS (SELECT w.dialogue_id, w.chunk_id, term, w / norm AS u FROM w JOIN norm ON w.dialogue_id = norm.dialogue_id AND w.chunk_id IS NOT DISTINCT FROM norm.chunk_id),
    s AS (SELECT d.dialogue_id, d.chunk_id, sum(d.u * q.u) AS score FROM u d JOIN u q ON q.dialogue_id = d.dialogue_id AND q.term = d.term AND q.chunk_id IS NULL WHERE d.chunk_id IS NOT NULL GROUP BY ALL)
    SELECT dialogue_id, chunk_id, round(coalesce(score, 0), 6) AS score FROM (SELECT DISTINCT dialogue_id, chunk_id FROM top) LEFT JOIN s USING (dialogue_id, chunk_id)"""
)
def tfidf_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of tf-idf vectors fitted on each query and its ten candidates of each source, without stop words."""
    own = chunks(spark, d).select("src", "chunk_id", retrieval.content_terms(F.col("body")).alias("terms"))  # once a chunk, not once a hit
    top = _bm25(spark, d, 10).drop("score", "rank").join(own, ["src", "chunk_id"])
    return retrieval.tfidf_scores(top, cases(spark, d), "dialogue_id", "chunk_id", "terms", "patient_query").withColumn("score", r6("score"))


_NAMES = r"""nm AS (SELECT dialogue_id, lower(replace(regexp_replace(symptom, '\s*\(Case\s+\d+\)$', ''), '_', ' ')) AS e, list_filter(string_split_regex(lower(replace(regexp_replace(symptom, '\s*\(Case\s+\d+\)$', ''), '_', ' ')), '\s+'), lambda x: len(x) > 2 AND x NOT IN ('the', 'and', 'for', 'with')) AS kw FROM dialogues),
    dc AS (SELECT chunk_id, lower(replace(regexp_replace(source_document, '\.txt$', ''), '_', ' ')) AS s FROM chunks)"""


@query(
    f"""WITH {_bm25_sql()}, {_dense_sql()}, {_FUSED}, {_NAMES},
    pd AS (SELECT dialogue_id, suite, profile, d.src, chunk_id, row_number() OVER (PARTITION BY dialogue_id, suite, profile ORDER BY score DESC, d.src, chunk_id) AS pos FROM dnr d JOIN pf USING (src) WHERE rank <= quota),
    al AS (SELECT 'dense' AS kind, dialogue_id, suite, profile, chunk_id, pos FROM pd UNION ALL SELECT 'hybrid', dialogue_id, suite, profile, chunk_id, pos FROM hq),
    rl AS (SELECT kind, suite, profile, al.dialogue_id, min(pos) FILTER (coalesce(contains(s, e) OR (len(kw) > 0 AND len(list_filter(kw, lambda k: contains(s, k))) >= least(2, len(kw))), false)) AS first FROM al JOIN nm USING (dialogue_id) JOIN dc USING (chunk_id) GROUP BY ALL),
    grid AS (SELECT kind, suite, profile, dialogue_id FROM (SELECT unnest(['dense', 'hybrid']) AS kind) CROSS JOIN (SELECT DISTINCT suite, profile FROM pf) CROSS JOIN (SELECT dialogue_id FROM dialogues WHERE dialogue_id % 50 = 0))
    SELECT kind, suite, profile, count(*) AS cases, round(avg(coalesce((first <= 5)::INT, 0)), 6) AS pass_at_5, round(avg(coalesce((first <= 10)::INT, 0)), 6) AS pass_at_10 FROM grid LEFT JOIN rl USING (kind, suite, profile, dialogue_id) GROUP BY ALL"""
)
def pass_at_k_by_profile(spark: SparkSession, d: str) -> DataFrame:
    """The grid of retrieval kinds and quota profiles, each judged on all cases."""
    dense = written(_dense(spark, d, 20), "dense")  # read by both kinds
    p = F.broadcast(_profiles(spark, d).where("quota > 0"))
    pure = dense.join(p, "src").where("rank <= quota").withColumn("pos", F.row_number().over(W.partitionBy("dialogue_id", "suite", "profile").orderBy(F.round("score", 9).desc(), "src", "chunk_id")))
    fused = retrieval.hybrid_quota(dense, _bm25(spark, d, 20), _profiles(spark, d), ["dialogue_id"], "src", "chunk_id", ["suite", "profile"])
    cols = ["dialogue_id", "suite", "profile", "chunk_id", "pos"]
    hits = pure.select(F.lit("dense").alias("kind"), *cols).unionByName(fused.select(F.lit("hybrid").alias("kind"), *cols))
    names = table(spark, d, "dialogues").where("dialogue_id % 50 = 0").select("dialogue_id", "symptom")
    judged = hits.join(names, "dialogue_id").join(table(spark, d, "chunks").select("chunk_id", "source_document"), "chunk_id")
    kinds = spark.createDataFrame([("dense",), ("hybrid",)], "kind string")
    grid = names.select("dialogue_id").crossJoin(F.broadcast(_profiles(spark, d).where("quota > 0").select("suite", "profile").distinct().crossJoin(F.broadcast(kinds))))
    out = evaluate.pass_at_k(judged, grid, ["kind", "suite", "profile"], "dialogue_id", "pos", evaluate.relevant_by_name(F.col("symptom"), F.col("source_document")), [5, 10])
    return out.select("kind", "suite", "profile", "cases", r6("pass_at_5").alias("pass_at_5"), r6("pass_at_10").alias("pass_at_10"))


@query(
    rf"""WITH {_bm25_sql()}, {_dense_sql()}, {_FUSED}, st2 AS (SELECT c.chunk_id, c.text || CASE WHEN strategy = 'structured' AND triage_level IS NOT NULL THEN chr(10) || 'Triage level: ' || triage_level ELSE '' END AS t
        FROM chunks c LEFT JOIN documents USING (doc_id) LEFT JOIN conditions USING (condition_id)),
    lv AS (SELECT dialogue_id, coalesce(nullif(upper(regexp_extract(t, '(?i)Triage level: (ED|GP|HOME)', 1)), ''), 'UNKNOWN') AS l, length(t) AS n FROM hq JOIN st2 USING (chunk_id) WHERE suite = 'main' AND profile = 'wide'),
    v AS (SELECT dialogue_id, CASE WHEN bool_or(l = 'ED') THEN 'ED' WHEN bool_or(l = 'GP') THEN 'GP' WHEN bool_or(l = 'HOME') THEN 'HOME' ELSE 'UNKNOWN' END AS predicted, sum(n)::BIGINT AS context_length, count(*) AS hits FROM lv GROUP BY dialogue_id),
    x AS (SELECT dialogue_id, upper(trim(final_triage_decision)) AS u FROM dialogues WHERE dialogue_id % 50 = 0)
    SELECT dialogue_id, predicted, context_length, hits, predicted = CASE WHEN contains(u, 'ED') OR contains(u, 'EMERGENCY') THEN 'ED' WHEN contains(u, 'GP') OR contains(u, 'DOCTOR') THEN 'GP' WHEN contains(u, 'HOME') THEN 'HOME' ELSE u END AS is_correct FROM v JOIN x USING (dialogue_id)"""
)
def rule_classifier(spark: SparkSession, d: str) -> DataFrame:
    """The triage level that the retrieved chunks state, the most urgent one wins; against the normalised decision."""
    level = table(spark, d, "documents").select("doc_id", "condition_id").join(F.broadcast(table(spark, d, "conditions").select("condition_id", "triage_level")), "condition_id", "left")
    stated = F.when((F.col("strategy") == "structured") & F.col("triage_level").isNotNull(), F.concat(F.lit("\nTriage level: "), "triage_level")).otherwise("")
    text = table(spark, d, "chunks").join(level.select("doc_id", "triage_level"), "doc_id", "left").select("chunk_id", F.concat("text", stated).alias("t"))
    hits = _hybrid_quota(spark, d).where("suite = 'main' and profile = 'wide'").join(text, "chunk_id")
    said = F.upper(F.regexp_extract("t", "(?i)Triage level: (ED|GP|HOME)", 1))
    voted = hits.groupBy("dialogue_id").agg(evaluate.any_vote(said).alias("predicted"), F.sum(F.length("t")).alias("context_length"), F.count(F.lit(1)).alias("hits"))
    truth = table(spark, d, "dialogues").select("dialogue_id", labels.triage_normalised(F.col("final_triage_decision")).alias("expected"))
    return voted.join(truth, "dialogue_id").select("dialogue_id", "predicted", "context_length", "hits", (F.col("predicted") == F.col("expected")).alias("is_correct"))


@query(
    f"""WITH {_bm25_sql()}, {_dense_sql()}, {_FUSED}, tx AS (SELECT dialogue_id, pos, src, text FROM hq JOIN chunks USING (chunk_id) WHERE suite = 'main' AND profile = 'wide' AND pos <= 10 AND length(text) > 0),
    cx AS (SELECT dialogue_id, string_agg('[' || pos || '] (' || src || ') ' || text, chr(10) ORDER BY pos) AS context FROM tx GROUP BY dialogue_id)
    SELECT dialogue_id, length(context)::INT AS context_length, md5('Patient query: ' || coalesce(patient_query, '') || chr(10) || chr(10) || CASE WHEN context IS NULL THEN '' ELSE 'Context:' || chr(10) || context || chr(10) || chr(10) END || 'Provide triage decision, next steps, and reasoning:') AS prompt_md5
    FROM dialogues LEFT JOIN cx USING (dialogue_id) WHERE dialogue_id % 50 = 0"""
)
def numbered_context(spark: SparkSession, d: str) -> DataFrame:
    """The ten best hits of a case as a numbered context, and the prompt made with it; a case without hits has none."""
    hits = _hybrid_quota(spark, d).where("suite = 'main' and profile = 'wide' and pos <= 10").join(table(spark, d, "chunks").select("chunk_id", "text"), "chunk_id").where("length(text) > 0")
    context = hits.groupBy("dialogue_id").agg(chunking.numbered_context("pos", "src", "text").alias("context"))
    p = chunking.prompt(F.col("patient_query"), F.col("context"))
    return cases(spark, d).join(context, "dialogue_id", "left").select("dialogue_id", F.length("context").alias("context_length"), F.md5(p.cast("binary")).alias("prompt_md5"))
