"""Registered queries of the core operators and their SQL.

Each query reads whole tables of the data folder. Searches are in ``search``, tables over evaluation results in ``reports``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import labels, parse
from quern.functions.text import keywords, safe_filename, source_key, squeeze, strip_case, strip_quotes
from quern.operators import analytics, chunking, curate, evaluate, ordering, sampling
from quern.plans import reports, search  # noqa: F401 - they register their queries
from quern.plans.registry import QUERIES, SQL, query, r6
from quern.plans.search import HITS as _HITS
from quern.plans.search import hit_lists as _hit_lists
from quern.session import table
from quern.streaming.frontier import windowed_counts

def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# --------------------------------------------------------------------------------------------------------------- evaluation
_REL = r"""
case_ AS (SELECT 'case-' || dialogue_id AS case_id, regexp_replace(symptom, '\s*\(Case\s+\d+\)$', '') AS nm FROM dialogues),
doc AS (SELECT chunk_id, regexp_replace(source_document, '\.txt$', '') AS dn FROM chunks),
rel AS (SELECT config, hits.case_id, rank, lower(replace(nm, '_', ' ')) AS e, lower(replace(dn, '_', ' ')) AS s,
    list_filter(string_split_regex(lower(replace(nm, '_', ' ')), '\s+'), lambda x: len(x) > 2 AND x NOT IN ('the', 'and', 'for', 'with')) AS kw
    FROM hits LEFT JOIN case_ ON case_.case_id = hits.case_id LEFT JOIN doc ON doc.chunk_id = hits.chunk_id),
ok AS (SELECT config, case_id, rank, coalesce(contains(s, e) OR (len(kw) > 0 AND len(list_filter(kw, lambda k: contains(s, k))) >= least(2, len(kw))), false) AS r FROM rel),
"""


def _judged_hits(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "dialogues").select(F.concat(F.lit("case-"), "dialogue_id").alias("case_id"), "symptom")
    docs = table(spark, d, "chunks").select("chunk_id", "source_document")
    return table(spark, d, "hits").join(cases, "case_id", "left").join(docs, "chunk_id", "left")


@query(
    f"""WITH {_REL} f AS (SELECT config, case_id, min(rank) FILTER (r) AS first FROM ok GROUP BY ALL)
    SELECT config, count(*) AS cases, {", ".join(f"round(avg(coalesce((first <= {k})::INT, 0)), 6) AS pass_at_{k}" for k in (1, 2, 3, 4, 5, 10, 20))} FROM f GROUP BY config"""
)
def pass_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Share of cases with a relevant hit among the first k, by configuration."""
    h = _judged_hits(spark, d)
    rel = evaluate.relevant_by_name(F.col("symptom"), F.col("source_document"))
    out = evaluate.pass_at_k(h, table(spark, d, "hits"), ["config"], "case_id", "rank", rel, [1, 2, 3, 4, 5, 10, 20])
    return out.select("config", "cases", *(r6(c).alias(c) for c in out.columns if c.startswith("pass")))


@query(f"WITH {_HITS} SELECT config, src, count(*) AS hits, round(count(*) / sum(count(*)) OVER (PARTITION BY config), 6) AS share FROM hl GROUP BY config, src")
def source_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Hits by source, with shares."""
    from pyspark.sql import Window as W

    n = _hit_lists(spark, d).groupBy("config", "src").agg(F.count(F.lit(1)).alias("hits"))
    return n.withColumn("share", r6(F.col("hits") / F.sum("hits").over(W.partitionBy("config"))))


_RESULTS = """res AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY config, case_id ORDER BY loaded_at DESC) AS rn FROM case_results) WHERE rn = 1),
lab AS (SELECT *, CASE WHEN expected_triage IN ('ED', 'GP', 'HOME') THEN expected_triage ELSE 'GP' END AS t, CASE WHEN predicted_triage IN ('ED', 'GP', 'HOME') THEN predicted_triage ELSE 'UNKNOWN' END AS p FROM res WHERE success),
l4 AS (SELECT unnest(['ED', 'GP', 'HOME', 'UNKNOWN']) AS l),
cm AS (SELECT c.config, a.l AS true_label, b.l AS pred_label, count(lab.config) AS n FROM (SELECT DISTINCT config FROM lab) c CROSS JOIN l4 a CROSS JOIN l4 b
    LEFT JOIN lab ON lab.config = c.config AND lab.t = a.l AND lab.p = b.l GROUP BY ALL)"""
_REPORT = f"""{_RESULTS},
pr AS (SELECT config, l AS label, sum(n) FILTER (true_label = l AND pred_label = l) AS tp, sum(n) FILTER (true_label = l) AS support, sum(n) FILTER (pred_label = l) AS predicted FROM cm CROSS JOIN l4 GROUP BY config, l),
rp AS (SELECT config, label, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, support FROM pr),
rep AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, coalesce(5 * precision * recall / nullif(4 * precision + recall, 0), 0) AS fbeta FROM rp)"""


def _results(spark: SparkSession, d: str) -> DataFrame:
    """The last load of each case of a configuration."""
    return evaluate.latest(table(spark, d, "case_results"), ["config", "case_id"], "loaded_at")


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.confusion(_results(spark, d).where("success"), ["config"], "expected_triage", "predicted_triage")


@query(f"WITH {_RESULTS} SELECT config, true_label, pred_label, n FROM cm")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    """4 x 4 counts of each configuration, zeros included."""
    return _cells(spark, d)


@query(f"WITH {_REPORT} SELECT config, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(fbeta, 6) AS fbeta, support::BIGINT AS support FROM rep")
def class_report(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall, F1 and F2 of each class."""
    r = evaluate.class_report(_cells(spark, d), ["config"])
    return r.select("config", "label", *(r6(c).alias(c) for c in ("precision", "recall", "f1", "fbeta")), "support")


@query(
    f"""WITH {_REPORT} SELECT config, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(sum(fbeta * support) / sum(support), 6) AS weighted_f2, round(sum(f1) / 4, 6) AS macro_f1,
    round(sum(CASE label WHEN 'ED' THEN 5 * fbeta WHEN 'GP' THEN 2 * fbeta WHEN 'HOME' THEN fbeta ELSE 0 END) / 8, 6) AS clinical_f2 FROM rep GROUP BY config"""
)
def weighted_fbeta(spark: SparkSession, d: str) -> DataFrame:
    """Support-weighted and clinically weighted scores."""
    w = evaluate.weighted_scores(evaluate.class_report(_cells(spark, d), ["config"]), ["config"])
    return w.select("config", *(r6(c).alias(c) for c in w.columns if c != "config"))


@query(f"WITH {_REPORT} SELECT config, round(recall, 6) AS ed_recall, round(fbeta, 6) AS ed_f2, round(1 - recall, 6) AS ed_fnr, recall >= 0.95 AND fbeta >= 0.9 AND 1 - recall <= 0.05 AS safe FROM rep WHERE label = 'ED'")
def safety_gate(spark: SparkSession, d: str) -> DataFrame:
    """Emergency recall, F2 and miss rate with the gate."""
    g = evaluate.safety_gate(evaluate.class_report(_cells(spark, d), ["config"]), ["config"])
    return g.select("config", *(r6(c).alias(c) for c in ("ed_recall", "ed_f2", "ed_fnr")), "safe")


@query(
    f"""WITH {_RESULTS} SELECT config, count(*) AS cases, round(avg(is_correct::INT) FILTER (success), 6) AS accuracy, count(*) FILTER (NOT success) AS errors,
    count(*) FILTER (success AND predicted_triage = 'UNKNOWN') AS unknown, round(avg(inference_time) FILTER (inference_time > 0), 6) AS avg_inference, round(sum(inference_time), 4) AS total_inference,
    round(avg(rag_time) FILTER (rag_time > 0), 6) AS avg_rag, round(avg(context_length) FILTER (context_length > 0), 4) AS avg_context FROM res GROUP BY config"""
)
def timing_stats(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy, failures and conditional means."""
    pos = lambda c: F.avg(F.when(F.col(c) > 0, F.col(c)))
    return _results(spark, d).groupBy("config").agg(
        F.count(F.lit(1)).alias("cases"),
        r6(F.avg(F.when(F.col("success"), F.col("is_correct").cast("int")))).alias("accuracy"),
        F.count_if(~F.col("success")).alias("errors"),
        F.count_if(F.col("success") & (F.col("predicted_triage") == "UNKNOWN")).alias("unknown"),
        r6(pos("inference_time")).alias("avg_inference"),
        F.round(F.sum("inference_time"), 4).alias("total_inference"),
        r6(pos("rag_time")).alias("avg_rag"),
        F.round(pos("context_length"), 4).alias("avg_context"),
    )


@query(
    """WITH n AS (SELECT case_id, predicted_triage AS l, count(*) AS n FROM case_results WHERE predicted_triage IS NOT NULL GROUP BY ALL),
    p AS (SELECT *, n / sum(n) OVER (PARTITION BY case_id) AS p, row_number() OVER (PARTITION BY case_id ORDER BY n DESC, l) AS rn FROM n)
    SELECT case_id, max(l) FILTER (rn = 1) AS majority, round(max(p), 6) AS confidence, round(abs(sum(p * ln(p + 1e-10))), 6) AS entropy, -sum(p * ln(p + 1e-10)) > 0.3 AS uncertain FROM p GROUP BY case_id"""
)
def mc_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Majority, confidence and entropy of the predictions of a case over configurations."""
    v = evaluate.vote_uncertainty(table(spark, d, "case_results"), ["case_id"], "predicted_triage")
    return v.select("case_id", "majority", r6("confidence").alias("confidence"), r6("entropy").alias("entropy"), "uncertain")


@query(
    """WITH n AS (SELECT expected_triage AS label, count(*) AS n FROM case_results WHERE expected_triage IN ('ED', 'GP', 'HOME') GROUP BY ALL)
    SELECT label, round((CASE label WHEN 'ED' THEN 5.0 WHEN 'GP' THEN 2.0 ELSE 1.0 END) / (n / sum(n) OVER ()) / 3, 6) AS weight FROM n"""
)
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    """Inverse-frequency class weights, with the base weights joined from their table."""
    base = F.broadcast(spark.createDataFrame(list(evaluate.WEIGHTS.items()), "label string, base double"))
    n = table(spark, d, "case_results").groupBy(F.col("expected_triage").alias("label")).agg(F.count(F.lit(1)).alias("n")).join(base, "label")
    total = F.broadcast(n.agg(F.sum("n").alias("total")))
    return n.crossJoin(total).select("label", r6(F.col("base") / (F.col("n") / F.col("total")) / 3).alias("weight"))


_LEGACY = r"""CASE WHEN regexp_extract(x, '(?i)Triage\s+decision:\s*(ED|GP|HOME)', 1) <> '' THEN upper(regexp_extract(x, '(?i)Triage\s+decision:\s*(ED|GP|HOME)', 1))
    WHEN regexp_matches(u, 'ED|EMERGENCY') THEN 'ED' WHEN regexp_matches(u, 'HOME|SELF-CARE') THEN 'HOME' WHEN regexp_matches(u, 'GP|GENERAL PRACTITIONER') THEN 'GP'
    WHEN regexp_matches(u, 'URGENT|SEVERE|IMMEDIATE|CHEST PAIN') THEN 'ED' WHEN regexp_matches(u, 'MILD|REST|MONITOR|OTC') THEN 'HOME' ELSE 'UNKNOWN' END"""
_STRICT = r"""CASE WHEN regexp_extract(x, '(?i)Triage\s+decision:\s*(ED|GP|HOME)\b', 1) <> '' THEN upper(regexp_extract(x, '(?i)Triage\s+decision:\s*(ED|GP|HOME)\b', 1))
    WHEN regexp_matches(u, '\b(ED|EMERGENCY)\b') THEN 'ED' WHEN regexp_matches(u, '\b(HOME|SELF-CARE)\b') THEN 'HOME' WHEN regexp_matches(u, '\b(GP|GENERAL PRACTITIONER)\b') THEN 'GP'
    WHEN regexp_matches(u, '\b(URGENT|SEVERE|IMMEDIATE|CHEST PAIN)\b') THEN 'ED' WHEN regexp_matches(u, '\b(MILD|REST|MONITOR|OTC)\b') THEN 'HOME' ELSE 'UNKNOWN' END"""


@query(f"SELECT config, case_id, loaded_at, {_LEGACY} AS legacy, {_STRICT} AS strict FROM (SELECT config, case_id, loaded_at, coalesce(response, '') AS x, upper(coalesce(response, '')) AS u FROM case_results)")
def triage_extract(spark: SparkSession, d: str) -> DataFrame:
    """Labels read from the responses, in the loose and the strict dialect."""
    return table(spark, d, "case_results").select("config", "case_id", "loaded_at", labels.triage_legacy(F.col("response")).alias("legacy"), labels.triage_strict(F.col("response")).alias("strict"))


# ------------------------------------------------------------------------------------------------------- chunks and curation
@query(
    """WITH s AS (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, 412)) AS char_start FROM documents WHERE length(text) > 0)
    SELECT doc_id, (char_start // 412)::INT AS chunk_no, char_start::INT AS char_start, (char_start + length(substring(text, char_start + 1, 512)))::INT AS char_end, md5(substring(text, char_start + 1, 512)) AS chunk_md5 FROM s"""
)
def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 512 characters with an overlap of 100."""
    w = chunking.fixed_windows(table(spark, d, "documents"), "doc_id", "text", 512, 100)
    return w.select("doc_id", "chunk_no", "char_start", "char_end", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@query(
    r"""WITH p AS (SELECT doc_id, string_split_regex(text, '\n[ \t]*\n') AS l FROM documents), u AS (SELECT doc_id, unnest(range(len(l))) AS i, l FROM p), c AS (SELECT doc_id, i::INT AS chunk_no, trim(l[i + 1], ' ') AS chunk FROM u)
    SELECT doc_id, chunk_no, length(chunk)::INT AS n_chars FROM c WHERE length(chunk) >= 50"""
)
def chunk_paragraph(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of 50 characters or more."""
    return chunking.paragraphs(table(spark, d, "documents"), "doc_id", "text", 50).select("doc_id", "chunk_no", F.length("chunk").alias("n_chars"))


@query(
    r"""WITH RECURSIVE s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') AS t FROM documents WHERE text IS NOT NULL AND NOT contains(text, chr(1))),
    w AS (SELECT doc_id, t, list_transform(t, lambda x: len(string_split_regex(x, '[ \t\n\x0B\f\r]+'))) AS w FROM s WHERE len(t) > 0),
    p AS (SELECT doc_id, 1 AS i, 0 AS no, 1 AS first, w[1] AS n FROM w UNION ALL
        SELECT p.doc_id, i + 1, CASE WHEN n + w[i + 1] <= 128 THEN no ELSE no + 1 END, CASE WHEN n + w[i + 1] <= 128 THEN first ELSE i END, CASE WHEN n + w[i + 1] <= 128 THEN n + w[i + 1] ELSE w[i] + w[i + 1] END FROM p JOIN w USING (doc_id) WHERE i < len(w)),
    c AS (SELECT doc_id, no, min(first) AS first, max(i) AS last FROM p GROUP BY ALL)
    SELECT doc_id, no::INT AS chunk_no, md5(array_to_string(t[first:last], ' ')) AS chunk_md5, (last - first + 1)::INT AS n_sentences FROM c JOIN w USING (doc_id)"""
)
def chunk_sentence(spark: SparkSession, d: str) -> DataFrame:
    """Sentences packed up to 128 words, one sentence of overlap; texts with the control character 1 are left to the tests."""
    docs = table(spark, d, "documents").where(~F.contains("text", F.lit("\x01")))
    return chunking.sentence_packs(docs, "doc_id", "text", 128, 1).select("doc_id", "chunk_no", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"), "n_sentences")


@query(
    """SELECT chunk_id, md5(CASE WHEN length(contextual_info) > 0 THEN coalesce(original_text, text) || chr(10) || chr(10) || 'Context: ' || contextual_info ELSE coalesce(original_text, text) END) AS embed_md5,
    coalesce(length(contextual_info) > 0, false) AS is_contextual, md5(CASE WHEN coalesce(is_contextual, false) THEN concat_ws(' ', text, contextual_info) ELSE coalesce(text, original_text) END) AS lexical_md5 FROM chunks"""
)
def contextual_text(spark: SparkSession, d: str) -> DataFrame:
    """What a chunk gives to the vector and the lexical index."""
    e = chunking.embedding_text(F.col("original_text"), F.col("text"), F.col("contextual_info"))
    x = chunking.lexical_text(F.col("original_text"), F.col("text"), F.col("contextual_info"), F.col("is_contextual"))
    return table(spark, d, "chunks").select(
        "chunk_id", F.md5(e.cast("binary")).alias("embed_md5"), F.coalesce(F.length("contextual_info") > 0, F.lit(False)).alias("is_contextual"), F.md5(x.cast("binary")).alias("lexical_md5")
    )


@query(
    r"""WITH v AS (SELECT trim(regexp_extract(value, '^\s*\d+\.\s+(.+)', 1)) AS name, condition_id FROM conditions)
    SELECT name, count(doc_id) AS documents FROM v LEFT JOIN documents d ON d.condition_id = v.condition_id WHERE name <> '' GROUP BY name"""
)
def vocabulary_use(spark: SparkSession, d: str) -> DataFrame:
    """Names of numbered lines and how many documents are about each."""
    v = table(spark, d, "conditions").select("condition_id", F.trim(F.regexp_extract("value", r"^\s*\d+\.\s+(.+)", 1)).alias("name")).where("name <> ''")
    n = table(spark, d, "documents").groupBy("condition_id").agg(F.count(F.lit(1)).alias("n"))
    return v.join(n, "condition_id", "left").groupBy("name").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("documents"))


@query(r"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN success THEN 'ok' WHEN error IS NULL THEN 'no message' ELSE regexp_extract(error, '^[^:]*') END AS reason FROM case_results) GROUP BY reason""")
def reason_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of failures by reason."""
    reason = F.when(F.col("success"), "ok").when(F.col("error").isNull(), "no message").otherwise(F.regexp_extract("error", "^[^:]*", 0))
    return table(spark, d, "case_results").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, url FROM (SELECT doc_id, url, row_number() OVER (PARTITION BY lower(url) ORDER BY crawled_at, doc_id) AS rn FROM documents WHERE url IS NOT NULL) WHERE rn = 1")
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    """First crawl of each address, whatever its case."""
    docs = table(spark, d, "documents").where("url is not null").select("doc_id", "url", "crawled_at")
    return curate.keep_first(docs, F.lower("url"), [F.col("crawled_at"), F.col("doc_id")]).select("doc_id", "url")


@query(
    r"""WITH t AS (SELECT DISTINCT title FROM documents WHERE title IS NOT NULL), a AS (SELECT title, list_distinct(list_filter(string_split_regex(lower(title), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS t FROM t),
    b AS (SELECT condition_id, list_distinct(list_filter(string_split_regex(lower(condition), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS t FROM conditions),
    s AS (SELECT title, condition_id, len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) AS j FROM a, b WHERE len(list_intersect(a.t, b.t)) > 0)
    SELECT title, condition_id, round(j, 6) AS jaccard FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY j DESC, condition_id) AS rn FROM s WHERE j >= 0.5) WHERE rn = 1"""
)
def fuzzy_best_match(spark: SparkSession, d: str) -> DataFrame:
    """Condition of each distinct title by token sets."""
    titles = table(spark, d, "documents").where("title is not null").select(F.col("title"), F.col("title").alias("t")).distinct()
    return curate.fuzzy_best(titles, "title", "t", table(spark, d, "conditions"), "condition_id", "condition").withColumn("jaccard", r6("jaccard"))


@query(
    """WITH n AS (SELECT case_id, predicted_triage AS label, count(*) AS votes FROM case_results WHERE predicted_triage IS NOT NULL GROUP BY ALL),
    r AS (SELECT *, sum(votes) OVER (PARTITION BY case_id)::BIGINT AS source_count, row_number() OVER (PARTITION BY case_id ORDER BY votes DESC, CASE label WHEN 'ED' THEN 3 WHEN 'GP' THEN 2 WHEN 'HOME' THEN 1 ELSE 0 END DESC, label DESC) AS rn FROM n)
    SELECT case_id, label, votes, source_count FROM r WHERE rn = 1"""
)
def structured_majority(spark: SparkSession, d: str) -> DataFrame:
    """Majority label with priority tie-break."""
    return curate.majority_label(table(spark, d, "case_results"), ["case_id"], "predicted_triage", {"ED": 3, "GP": 2, "HOME": 1})


@query("SELECT case_id, CASE WHEN bool_or(predicted_triage = 'ED') THEN 'ED' WHEN bool_or(predicted_triage = 'GP') THEN 'GP' WHEN bool_or(predicted_triage = 'HOME') THEN 'HOME' ELSE 'UNKNOWN' END AS label FROM case_results GROUP BY case_id")
def any_vote(spark: SparkSession, d: str) -> DataFrame:
    """Any vote for the more urgent label wins."""
    return table(spark, d, "case_results").groupBy("case_id").agg(evaluate.any_vote(F.col("predicted_triage")).alias("label"))


@query(
    """WITH p AS (SELECT DISTINCT doc_type, condition_id FROM documents WHERE doc_type IS NOT NULL AND condition_id IS NOT NULL)
    SELECT doc_type, array_to_string(list_sort(list_distinct(flatten(list(next_steps)))), '|') AS next_steps FROM p JOIN conditions USING (condition_id) GROUP BY doc_type"""
)
def list_union_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Union of the next steps of all conditions that documents of a type are about (sorted for comparison)."""
    docs = table(spark, d, "documents").where("doc_type is not null and condition_id is not null").select("doc_type", "condition_id").distinct()
    c = docs.join(F.broadcast(table(spark, d, "conditions").select("condition_id", "next_steps")), "condition_id")
    return curate.ordered_union(c, ["doc_type"], "next_steps", "condition_id").select("doc_type", F.array_join(F.array_sort("next_steps"), "|").alias("next_steps"))


@query(
    r"""SELECT dialogue_id, regexp_replace(symptom, '\s*\(Case\s+\d+\)$', '') AS stem, array_to_string(list_filter(string_split_regex(lower(replace(regexp_replace(symptom, '\s*\(Case\s+\d+\)$', ''), '_', ' ')), '\s+'),
    lambda x: len(x) > 2 AND x NOT IN ('the', 'and', 'for', 'with')), ' ') AS keywords, translate(regexp_replace(symptom, '[<>:"/\\|?*]', '', 'g'), ' ', '_') AS file_name, regexp_replace(symptom, '\s*\(Case\s+\d+\)$', '') || '.txt' AS doc_name,
    CASE WHEN starts_with(patient_query, '"') THEN md5(regexp_replace(patient_query, '^"+|"+$', '', 'g')) ELSE md5(patient_query) END AS query_md5 FROM dialogues"""
)
def name_functions(spark: SparkSession, d: str) -> DataFrame:
    """File stems, key words, safe names and stripped quotes."""
    return table(spark, d, "dialogues").select(
        "dialogue_id",
        strip_case(F.col("symptom")).alias("stem"),
        F.array_join(keywords(strip_case(F.col("symptom"))), " ").alias("keywords"),
        safe_filename(F.col("symptom")).alias("file_name"),
        F.concat(strip_case(F.col("symptom")), F.lit(".txt")).alias("doc_name"),
        F.md5(strip_quotes(F.col("patient_query")).cast("binary")).alias("query_md5"),
    )


@query(
    r"""WITH t AS (SELECT doc_id, regexp_replace(lower(source), '[\s _\-]+', '', 'g') AS src, length(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'), ' ')) AS n FROM documents WHERE source IS NOT NULL)
    SELECT doc_id, rank FROM (SELECT doc_id, row_number() OVER (PARTITION BY src ORDER BY doc_id) AS rank FROM t WHERE n >= 60) WHERE rank <= 200"""
)
def mobile_pack(spark: SparkSession, d: str) -> DataFrame:
    """The first 200 documents of 60 cleaned characters or more of each source."""
    t = table(spark, d, "documents").where("source is not null").select("doc_id", source_key(F.col("source")).alias("src"), F.length(squeeze(F.col("text"))).alias("n"))
    return curate.first_n(t.where("n >= 60"), ["src"], [F.col("doc_id")], 200).select("doc_id", "rank")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.doc_id = d.doc_id)")
def resume_anti(spark: SparkSession, d: str) -> DataFrame:
    """Documents that no chunk comes from yet."""
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "chunks").select("doc_id"), "doc_id", "left_anti")


@query("SELECT strategy, count(DISTINCT regexp_replace(lower(source), '[\\s _\\-]+', '', 'g')) AS sources, count(*) AS chunks FROM chunks GROUP BY strategy HAVING count(DISTINCT regexp_replace(lower(source), '[\\s _\\-]+', '', 'g')) >= 3")
def complete_methods(spark: SparkSession, d: str) -> DataFrame:
    """Chunking strategies present in three sources or more."""
    g = table(spark, d, "chunks").groupBy("strategy").agg(F.count_distinct(source_key(F.col("source"))).alias("sources"), F.count(F.lit(1)).alias("chunks"))
    return g.where("sources >= 3")


@query(
    """SELECT dialogue_id, md5('Query: ' || patient_query || chr(10) || 'Question: ' || coalesce(clarifying_question, '')) AS prompt_md5, md5(coalesce(reasoning_decision, '') || chr(10) || 'Triage decision: ' || final_triage_decision) AS completion_md5
    FROM dialogues WHERE patient_query IS NOT NULL AND final_triage_decision IS NOT NULL"""
)
def prompt_completion(spark: SparkSession, d: str) -> DataFrame:
    """P5: prompt and completion of each complete dialogue."""
    t = table(spark, d, "dialogues").where("patient_query is not null and final_triage_decision is not null")
    p = F.concat(F.lit("Query: "), "patient_query", F.lit("\nQuestion: "), F.coalesce("clarifying_question", F.lit("")))
    c = F.concat(F.coalesce("reasoning_decision", F.lit("")), F.lit("\nTriage decision: "), "final_triage_decision")
    return t.select("dialogue_id", F.md5(p.cast("binary")).alias("prompt_md5"), F.md5(c.cast("binary")).alias("completion_md5"))


@query("SELECT stratum, doc_id, rn FROM (SELECT doc_type AS stratum, doc_id, row_number() OVER (PARTITION BY doc_type ORDER BY md5(doc_id || ':42'), doc_id) AS rn FROM documents) WHERE (stratum = 'faq' AND rn <= 152) OR (stratum = 'guide' AND rn <= 36) OR (stratum = 'article' AND rn <= 12)")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """Fixed counts of each stratum, in a seeded order; short strata are taken whole."""
    s = sampling.stratified(table(spark, d, "documents"), F.col("doc_type"), {"faq": 152, "guide": 36, "article": 12}, [ordering.seeded("doc_id"), F.col("doc_id")])
    return s.select("stratum", "doc_id", "rn")


@query(
    r"""WITH g AS (SELECT dialogue_id, regexp_replace(symptom, '\s*\(Case\s+\d+\)$', '') AS grp FROM dialogues WHERE symptom IS NOT NULL),
    n AS (SELECT *, count(*) OVER (PARTITION BY grp) AS n, row_number() OVER (PARTITION BY grp ORDER BY md5(dialogue_id || ':42'), dialogue_id) AS i FROM g), c AS (SELECT *, greatest(1, floor(0.7 * n + 1e-9)) AS tr, greatest(1, floor(0.15 * n + 1e-9)) AS va FROM n),
    m AS (SELECT *, CASE WHEN n - tr - va <= 0 AND n > 2 THEN tr - 1 ELSE tr END AS t2 FROM c)
    SELECT dialogue_id, CASE WHEN i <= t2 THEN 'train' WHEN i <= t2 + va THEN 'val' ELSE 'test' END AS part FROM m"""
)
def group_split(spark: SparkSession, d: str) -> DataFrame:
    """70/15/15 within each symptom stem, in a seeded order."""
    t = table(spark, d, "dialogues").where("symptom is not null").select("dialogue_id", strip_case(F.col("symptom")).alias("grp"), ordering.seeded("dialogue_id").alias("_h"))
    return sampling.split_within_groups(t, "grp", ["_h", "dialogue_id"]).select("dialogue_id", "part")


@query("SELECT event_type, count(*) AS n, count(json_extract(props, '$')) AS with_props, round(avg(len(json_keys(props))), 4) AS mean_keys FROM events GROUP BY event_type")
def json_flatten(spark: SparkSession, d: str) -> DataFrame:
    """JSON text columns."""
    e = table(spark, d, "events").withColumn("m", F.from_json("props", "map<string,string>"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("m").alias("with_props"), F.round(F.avg(F.size(F.map_keys("m"))), 4).alias("mean_keys"))


# ---------------------------------------------------------------------------------------------------------------- analytics
@query("SELECT l_returnflag, l_linestatus, round_even(avg(l_quantity), 4) AS mean_qty, round_even(avg(l_extendedprice), 4) AS mean_price, round_even(avg(l_discount), 6) AS mean_disc, round_even(avg(l_tax), 6) AS mean_tax, count(*) AS n FROM lineitem GROUP BY ALL")
def group_means(spark: SparkSession, d: str) -> DataFrame:
    """Means, rounded half to even, and counts by two keys."""
    m = lambda c, n, k: F.bround(F.avg(c), k).alias(n)
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        m("l_quantity", "mean_qty", 4), m("l_extendedprice", "mean_price", 4), m("l_discount", "mean_disc", 6), m("l_tax", "mean_tax", 6), F.count(F.lit(1)).alias("n")
    )


@query("SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS least, max(o_totalprice) AS most, round(stddev_samp(o_totalprice) / avg(o_totalprice) * 100, 6) AS cv_pct FROM orders GROUP BY ALL")
def multi_stats(spark: SparkSession, d: str) -> DataFrame:
    """Mean, sample deviation, extremes and coefficient of variation."""
    c = "o_totalprice"
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(
        F.round(F.avg(c), 4).alias("mean"), F.round(F.stddev_samp(c), 4).alias("std"), F.min(c).alias("least"), F.max(c).alias("most"), r6(F.stddev_samp(c) / F.avg(c) * 100).alias("cv_pct")
    )


@query("SELECT c_mktsegment, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS F, round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 4) AS O, round(avg(o_totalprice) FILTER (o_orderstatus = 'P'), 4) AS P FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def pivot_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Means by segment and status, as a matrix with given columns."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy("c_mktsegment").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.avg("o_totalprice"), 4))


@query("WITH m AS (SELECT l_suppkey, avg(l_extendedprice) FILTER (l_returnflag = 'A') AS a, avg(l_extendedprice) FILTER (l_returnflag = 'R') AS b FROM lineitem GROUP BY ALL) SELECT l_suppkey, round(a, 4) AS value_a, round(b, 4) AS value_b, round(a - b, 4) AS diff FROM m WHERE a IS NOT NULL AND b IS NOT NULL")
def paired_diff(spark: SparkSession, d: str) -> DataFrame:
    """Paired difference of two kinds on the same key, without a self join."""
    p = analytics.paired_difference(table(spark, d, "lineitem"), ["l_suppkey"], "l_returnflag", "A", "R", "l_extendedprice")
    return p.select("l_suppkey", *(F.round(c, 4).alias(c) for c in ("value_a", "value_b", "diff")))


_GAIN = [(1, "p1"), (2, "p2"), (5, "p5"), (10, "p10")]


@query(
    f"""WITH {_REL} f AS (SELECT config, case_id, min(rank) FILTER (r) AS first FROM ok GROUP BY ALL),
    m AS (SELECT config, {", ".join(f"avg(coalesce((first <= {k})::INT, 0)) AS p{k}" for k, _ in _GAIN)} FROM f GROUP BY config),
    l AS (SELECT config, unnest([1, 2, 5, 10]) AS to_k, unnest([p1, p2, p5, p10]) AS v, p1 FROM m), g AS (SELECT *, lag(to_k) OVER (PARTITION BY config ORDER BY to_k) AS from_k, v - lag(v) OVER (PARTITION BY config ORDER BY to_k) AS gain FROM l)
    SELECT config, from_k, to_k, round(gain, 6) AS gain, round(gain / (to_k - from_k), 6) AS gain_per_step, round(v - p1, 6) AS cumulative_gain FROM g WHERE from_k IS NOT NULL"""
)
def marginal_gain(spark: SparkSession, d: str) -> DataFrame:
    """Gains and their running sum of Pass@k between adjacent k, by configuration."""
    p = evaluate.pass_at_k(_judged_hits(spark, d), table(spark, d, "hits"), ["config"], "case_id", "rank", evaluate.relevant_by_name(F.col("symptom"), F.col("source_document")), [k for k, _ in _GAIN])
    g = analytics.marginal_gains(p, ["config"], [(k, f"pass_at_{k}") for k, _ in _GAIN])
    return g.select("config", "from_k", "to_k", *(r6(c).alias(c) for c in ("gain", "gain_per_step", "cumulative_gain")))


@query(
    """WITH m AS (SELECT l_suppkey, avg(l_quantity) AS q, avg(l_discount) AS dd, sum(l_extendedprice) AS s FROM lineitem GROUP BY ALL)
    SELECT l_suppkey, row_number() OVER (ORDER BY round(q, 9) DESC, l_suppkey) AS q_rank, row_number() OVER (ORDER BY round(dd, 9) DESC, l_suppkey) AS dd_rank, row_number() OVER (ORDER BY round(s, 2) DESC, l_suppkey) AS s_rank,
    round((q - min(q) OVER ()) / (max(q) OVER () - min(q) OVER () + 1e-10), 6) AS q_scaled FROM m"""
)
def efficiency_rank(spark: SparkSession, d: str) -> DataFrame:
    """Ranks on three metrics side by side, and min-max scaling, over one row a supplier; each rank is a sort by ranges."""
    m = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("q0"), F.round(F.avg("l_quantity"), 9).alias("q"), F.round(F.avg("l_discount"), 9).alias("dd"), F.round(F.sum("l_extendedprice"), 2).alias("s"))
    ranks = analytics.side_by_side_ranks(analytics.scaled(m, "q0", "q_scaled"), "l_suppkey", ["q", "dd", "s"])
    return ranks.select("l_suppkey", "q_rank", "dd_rank", "s_rank", r6("q_scaled").alias("q_scaled"))


@query("SELECT b AS bin, count(*) AS n, round(avg(l_extendedprice), 4) AS mean_price FROM (SELECT l_extendedprice, CASE WHEN l_quantity > 0 AND l_quantity <= 10 THEN 1 WHEN l_quantity > 10 AND l_quantity <= 25 THEN 2 WHEN l_quantity > 25 AND l_quantity <= 50 THEN 3 END AS b FROM lineitem) WHERE b IS NOT NULL GROUP BY b")
def binned_mean(spark: SparkSession, d: str) -> DataFrame:
    """Means in right-closed bins."""
    t = table(spark, d, "lineitem").withColumn("bin", analytics.right_closed("l_quantity", [0, 10, 25, 50])).where("bin is not null")
    return t.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean_price"))


@query("SELECT 'l_quantity' AS x, 'l_extendedprice' AS y, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem")
def corr_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Upper triangle of the correlation matrix."""
    return analytics.correlations(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("r", r6("r"))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem GROUP BY ALL")
def linear_fit(spark: SparkSession, d: str) -> DataFrame:
    """Least-squares line of each group."""
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 3).alias("intercept"))


@query("SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(median(o_totalprice), 4) AS med, round(quantile_cont(o_totalprice, 0.75), 4) AS q3 FROM orders GROUP BY ALL")
def quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact quartiles from ranks; no group is held in one buffer."""
    q = ordering.exact_quantiles(table(spark, d, "orders"), "o_orderpriority", "o_totalprice", [0.25, 0.5, 0.75])
    pick = lambda s, n: F.round(F.max(F.when(F.col("share") == s, F.col("value"))), 4).alias(n)
    return q.groupBy("o_orderpriority").agg(pick(0.25, "q1"), pick(0.5, "med"), pick(0.75, "q3"))


@query("WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT least(20, floor((l_extendedprice - lo) / ((hi - lo) / 20)) + 1)::INT AS bin, count(*) AS n FROM lineitem, e GROUP BY 1")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    """Twenty equal bins."""
    return analytics.histogram(table(spark, d, "lineitem"), "l_extendedprice", 20)


@query("SELECT o_orderpriority, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS o_orderkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY ALL")
def argmax_group(spark: SparkSession, d: str) -> DataFrame:
    """The row with the greatest value of each group; the smallest key wins ties."""
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("o_orderkey"), F.max("o_totalprice").alias("o_totalprice"))


@query(
    """WITH a AS (SELECT o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50), b AS (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50), u AS (SELECT * FROM a UNION SELECT * FROM b)
    SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM u)"""
)
def top_n_union_semi(spark: SparkSession, d: str) -> DataFrame:
    """Customers in the top 50 by order value or by balance."""
    c = table(spark, d, "customer")
    a = table(spark, d, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(50).select(F.col("o_custkey").alias("c_custkey"))
    b = c.orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(50).select("c_custkey")
    return c.join(a.union(b).distinct(), "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query("SELECT config, case_id, source, chunk_id, rank, count(*) AS copies, max(loaded_at) - max(retrieved_at) > INTERVAL 1 DAY AS late FROM hits GROUP BY ALL HAVING count(*) > 1")
def repeated_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits that were loaded more than once, and whether the last load was late."""
    g = table(spark, d, "hits").groupBy("config", "case_id", "source", "chunk_id", "rank").agg(F.count(F.lit(1)).alias("copies"), (F.max("loaded_at") - F.max("retrieved_at") > F.expr("interval 1 day")).alias("late"))
    return g.where("copies > 1")


# ------------------------------------------------------------------------------------------------- names, replies and filters
@query(
    r"""SELECT strategy, CASE WHEN contains(s, 'contextual') THEN 'contextual' WHEN contains(s, 'sentence') THEN 'sentence' WHEN contains(s, 'fixed') THEN 'fixed' WHEN contains(s, 'paragraph') THEN 'paragraph'
    WHEN contains(s, 'structured_agent') THEN 'structured_agent' WHEN contains(s, 'agent') THEN 'agent' ELSE 'other' END AS kind,
    coalesce(try_cast(nullif(regexp_extract(s, '[ct](\d+)', 1), '') AS INT), CASE WHEN contains(s, 'contextual') THEN 1024 WHEN contains(s, 'sentence') THEN 512 WHEN contains(s, 'fixed') THEN 512 WHEN contains(s, 'paragraph') THEN 768 ELSE 512 END) AS size,
    coalesce(try_cast(nullif(regexp_extract(s, '_o(\d+)', 1), '') AS INT), 0) AS overlap, count(*) AS chunks FROM (SELECT strategy, lower(strategy) AS s FROM chunks) GROUP BY strategy, s"""
)
def method_parse(spark: SparkSession, d: str) -> DataFrame:
    """Kind, size and overlap read from the strategy names."""
    c = F.col("strategy")
    return table(spark, d, "chunks").groupBy("strategy").agg(F.count(F.lit(1)).alias("chunks")).select("strategy", parse.method_type(c).alias("kind"), parse.method_size(c).alias("size"), parse.method_overlap(c).alias("overlap"), "chunks")


@query(
    r"""SELECT config, case_id, loaded_at, CASE WHEN x IN ('ED', 'GP', 'HOME') THEN x ELSE 'UNKNOWN' END AS exact, CASE WHEN contains(t, 'triage decision: ed') OR contains(t, 'triage decision:ed') THEN 'ED'
    WHEN contains(t, 'triage decision: gp') OR contains(t, 'triage decision:gp') THEN 'GP' WHEN contains(t, 'triage decision: home') OR contains(t, 'triage decision:home') THEN 'HOME' WHEN contains(t, 'emergency') OR contains(t, ' ed ') THEN 'ED'
    WHEN contains(t, 'gp') OR contains(t, 'doctor') THEN 'GP' WHEN contains(t, 'home') OR contains(t, 'rest') THEN 'HOME' ELSE 'UNKNOWN' END AS spaced
    FROM (SELECT *, upper(regexp_extract(response, '(?i)Triage Decision:\s*([A-Z]+)', 1)) AS x, lower(trim(response)) AS t FROM case_results)"""
)
def reply_labels(spark: SparkSession, d: str) -> DataFrame:
    """The two other label dialects."""
    return table(spark, d, "case_results").select("config", "case_id", "loaded_at", parse.triage_exact(F.col("response")).alias("exact"), parse.triage_spaced(F.col("response")).alias("spaced"))


def _named_sql(labels_: list[str], end: str) -> str:
    found = [f"nullif(regexp_replace(regexp_extract(response, '(?is){x}:\\s*(.+?){end}', 1), '^\\s+|\\s+$', '', 'g'), '')" for x in labels_]
    return ", ".join(found)


def _lines_sql(marks: list[str]) -> str:
    return f"list_transform(list_filter(string_split(response, chr(10)), lambda x: regexp_matches(lower(x), '{'|'.join(marks)}')), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))"


@query(
    f"""SELECT config, case_id, loaded_at, coalesce({_named_sql(parse.STEP_LABELS, parse.STEP_END)}, nullif({_lines_sql(parse.STEP_MARKS)}[1], ''), left(response, 200)) AS next_step,
    coalesce({_named_sql(parse.REASON_LABELS, parse.REASON_END)}, nullif(array_to_string({_lines_sql(parse.REASON_MARKS)}, ' '), ''), left(response, 200)) AS reasoning,
    coalesce(try_cast(nullif(regexp_extract(response, 'Quality Score:\\s*(\\d+(?:\\.\\d+)?)/100', 1), '') AS DOUBLE), 50.0) AS score,
    coalesce(nullif(regexp_replace(regexp_extract(response, '(?s)Quality (?:Score )?Rationale:\\s*(.+?)(?:\\n\\n|\\*\\*|$)', 1), '^\\s+|\\s+$', '', 'g'), ''), 'Could not parse evaluation response') AS rationale FROM case_results"""
)
def reply_parts(spark: SparkSession, d: str) -> DataFrame:
    """Next step, reasoning, score and rationale read from each reply."""
    r = F.col("response")
    return table(spark, d, "case_results").select("config", "case_id", "loaded_at", parse.next_step(r).alias("next_step"), parse.reasoning(r).alias("reasoning"), parse.score_of(r, "Quality Score").alias("score"), parse.rationale(r, "Quality Score").alias("rationale"))


@query(
    r"""WITH s AS (SELECT config, case_id, loaded_at, list_transform(string_split_regex(response, '\n\s*'), lambda x: x) AS l FROM case_results)
    SELECT config, case_id, loaded_at, nullif(trim(regexp_extract(list_filter(l, lambda x: regexp_matches(x, '(?i)^\s*Next Step\s*:'))[1], '(?i)^\s*Next Step\s*:\s*(.*)$', 1)), '') AS next_step FROM s"""
)
def reply_sections(spark: SparkSession, d: str) -> DataFrame:
    """The section under a header of each reply, up to the next header."""
    return table(spark, d, "case_results").select("config", "case_id", "loaded_at", parse.section(F.col("response"), "Next Step").alias("next_step"))


_NAME_SQL = r"""regexp_replace(regexp_replace(source_document, '\.txt$', ''), '(_diagnosis_treatment|_treatment|_diagnosis|_\(overview\)|_overview)$', '')"""


@query(
    rf"""WITH a AS (SELECT {_NAME_SQL} AS n FROM chunks), b AS (SELECT CASE WHEN starts_with(n, 'What_is_') AND len(string_split(n, '-')) = 2 THEN string_split(n, '-')[2] ELSE n END AS n FROM a),
    c AS (SELECT regexp_replace(replace(regexp_replace(n, '^(Overview-)?(Symptoms-)?', ''), '_', ' '), '\s*\([^)]*\)\s*$', '') AS n FROM b), d AS (SELECT lower(trim(regexp_replace(n, '\s+', ' ', 'g'))) AS n FROM c),
    e AS (SELECT array_to_string(list_transform(regexp_extract_all(n, '\p{{L}}+|[^\p{{L}}]+'), lambda w: upper(w[1]) || substr(w, 2)), '') AS condition FROM d)
    SELECT condition, count(*) AS chunks FROM e WHERE length(condition) > 1 GROUP BY condition"""
)
def document_conditions(spark: SparkSession, d: str) -> DataFrame:
    """Condition names from the documents' file names; names of one character are dropped."""
    name = parse.without_native_terms(parse.condition_of_file(F.regexp_replace("source_document", r"\.txt$", "")))
    return table(spark, d, "chunks").select(name.alias("condition")).where(F.length("condition") > 1).groupBy("condition").agg(F.count(F.lit(1)).alias("chunks"))


@query("SELECT chunk_id FROM chunks WHERE contains(lower(text), 'water') ORDER BY chunk_id LIMIT 20")
def like_search(spark: SparkSession, d: str) -> DataFrame:
    """Substring fallback search; the limit is its feature."""
    return table(spark, d, "chunks").where(F.contains(F.lower("text"), F.lit("water"))).orderBy("chunk_id").limit(20).select("chunk_id")


@query(
    """WITH p AS (SELECT config, avg(is_correct::INT) FILTER (success) AS acc, avg(inference_time) FILTER (success) AS sec FROM (SELECT *, row_number() OVER (PARTITION BY config, case_id ORDER BY loaded_at DESC) AS rn FROM case_results) WHERE rn = 1 GROUP BY config),
    v AS (SELECT *, max((acc > 0)::INT) OVER () AS any_valid FROM p) SELECT config, round(acc, 6) AS accuracy, round(sec, 6) AS seconds, coalesce(acc > 0.6 AND sec < 1, false) AS production FROM v WHERE acc > 0 OR any_valid = 0"""
)
def production_gate(spark: SparkSession, d: str) -> DataFrame:
    """valid configurations (all, if none is) with the gate on quality and time."""
    from pyspark.sql import Window as W

    ok = F.col("success")
    p = _results(spark, d).groupBy("config").agg(F.avg(F.when(ok, F.col("is_correct").cast("int"))).alias("acc"), F.avg(F.when(ok, F.col("inference_time"))).alias("sec"))
    v = p.withColumn("_any", F.max((F.col("acc") > 0).cast("int")).over(W.partitionBy(F.lit(1)))).where("acc > 0 or _any = 0")
    return v.select("config", r6("acc").alias("accuracy"), r6("sec").alias("seconds"), F.coalesce((F.col("acc") > 0.6) & (F.col("sec") < 1), F.lit(False)).alias("production"))


@query("SELECT date_trunc('hour', ts)::VARCHAR AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """V1, V4: hourly windows by type; the same operator runs on a stream with a watermark."""
    w = windowed_counts(table(spark, d, "events"), "ts", "event_type", "value")
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))
