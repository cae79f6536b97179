"""Registered tables over configurations, results, names and chunks that the analysis scripts make."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import labels, parse
from quern.functions.text import source_key, strip_case
from quern.operators import analytics, chunking, curate, evaluate, ordering
from quern.plans.registry import query, r6
from quern.plans.search import SRC
from quern.session import table

RESULTS = "res AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY config, case_id ORDER BY loaded_at DESC) AS rn FROM case_results) WHERE rn = 1)"


def results(spark: SparkSession, d: str) -> DataFrame:
    """The last load of each case of a configuration."""
    return evaluate.latest(table(spark, d, "case_results"), ["config", "case_id"], "loaded_at")


# ------------------------------------------------------------------------------------------------------------ configurations
@query(
    r"""SELECT config, regexp_extract(config, '^(.*)_(semantic|hybrid|bm25)_(.*)$', 1) AS chunking, regexp_extract(config, '^(.*)_(semantic|hybrid|bm25)_(.*)$', 2) AS retrieval, regexp_extract(config, '^(.*)_(semantic|hybrid|bm25)_(.*)$', 3) AS profile, hits FROM
    (SELECT config, count(*) AS hits FROM hits WHERE contains(config, 'sentence') AND contains(config, 'balanced') GROUP BY config) ORDER BY config LIMIT 10"""
)
def chosen_configs(spark: SparkSession, d: str) -> DataFrame:
    """F2, F16, T5: configurations whose method and profile contain given texts, the first ten by name; the limit is the feature."""
    p = r"^(.*)_(semantic|hybrid|bm25)_(.*)$"
    c = table(spark, d, "hits").where(F.col("config").contains("sentence") & F.col("config").contains("balanced")).groupBy("config").agg(F.count(F.lit(1)).alias("hits"))
    return c.orderBy("config").limit(10).select("config", *(F.regexp_extract("config", p, i).alias(n) for i, n in ((1, "chunking"), (2, "retrieval"), (3, "profile"))), "hits")


@query(
    f"""WITH {RESULTS}, g AS (SELECT config, avg(is_correct::INT) FILTER (success) AS acc, avg(rag_time) FILTER (success) * 1000 AS ms FROM res GROUP BY config)
    SELECT config, round(acc, 6) AS quality, round(ms, 6) AS ms, coalesce(acc > 0.6 AND ms < 50, false) AS production FROM g"""
)
def release_gate(spark: SparkSession, d: str) -> DataFrame:
    """configurations good and fast enough: quality above a limit (accuracy here, the share found where hits are judged) and below 50 ms of retrieval."""
    ok = F.col("success")
    g = results(spark, d).groupBy("config").agg(F.avg(F.when(ok, F.col("is_correct").cast("int"))).alias("q"), (F.avg(F.when(ok, F.col("rag_time"))) * 1000).alias("ms"))
    return g.select("config", r6("q").alias("quality"), r6("ms").alias("ms"), evaluate.production_gate(F.col("q"), F.col("ms"), 0.6, 50).alias("production"))


@query(
    f"""WITH {RESULTS}, a AS (SELECT config, avg(is_correct::INT) FILTER (success) AS acc FROM res GROUP BY config), t AS (SELECT config, row_number() OVER (ORDER BY round(acc, 9) DESC NULLS LAST, config) AS place FROM a)
    SELECT place, config, case_id, n FROM (SELECT place, res.config, case_id, row_number() OVER (PARTITION BY res.config ORDER BY case_id) AS n FROM res JOIN t ON t.config = res.config WHERE place <= 5) WHERE n <= 10"""
)
def top_config_details(spark: SparkSession, d: str) -> DataFrame:
    """The five best configurations with the first ten cases of each."""
    r = results(spark, d)
    a = r.groupBy("config").agg(F.round(F.avg(F.when(F.col("success"), F.col("is_correct").cast("int"))), 9).alias("acc"))
    top = a.orderBy(F.col("acc").desc_nulls_last(), "config").limit(5).withColumn("place", F.row_number().over(W.orderBy(F.col("acc").desc_nulls_last(), "config")))  # five rows
    return curate.first_n(r.join(F.broadcast(top.select("config", "place")), "config"), ["config"], [F.col("case_id")], 10, "n").select("place", "config", "case_id", "n")


@query(
    f"""WITH {RESULTS}, g AS (SELECT config, count(*) AS cases, avg(is_correct::INT) FILTER (success) AS acc, count(*) FILTER (success AND predicted_triage = 'UNKNOWN') AS unknown, max(inference_time) - min(inference_time) AS spread, max(context_length) - min(context_length) AS context_range FROM res GROUP BY config)
    SELECT config, round(1 - unknown / cases, 6) AS extraction_rate, round(0.7 * acc + 0.3 * (1 - unknown / cases), 6) AS reliability, round(spread, 6) AS time_range, context_range, round((1 - unknown / cases) - acc, 6) AS gap, round(acc / nullif(1 - unknown / cases, 0), 6) AS ratio FROM g"""
)
def composites(spark: SparkSession, d: str) -> DataFrame:
    """Reliability (.7 accuracy, .3 extraction), gap, ratio, and ranges of time and memory-like columns."""
    g = results(spark, d).groupBy("config").agg(
        F.avg(F.when(F.col("success"), F.col("is_correct").cast("int"))).alias("acc"),
        (1 - F.count_if(F.col("success") & (F.col("predicted_triage") == "UNKNOWN")) / F.count(F.lit(1))).alias("ext"),
        (F.max("inference_time") - F.min("inference_time")).alias("spread"),
        (F.max("context_length") - F.min("context_length")).alias("context_range"),
    )
    return g.select("config", r6("ext").alias("extraction_rate"), r6(0.7 * F.col("acc") + 0.3 * F.col("ext")).alias("reliability"), r6("spread").alias("time_range"), "context_range", r6(F.col("ext") - F.col("acc")).alias("gap"), r6(F.try_divide("acc", "ext")).alias("ratio"))


@query(
    f"""SELECT config, src, hits, total, round(100.0 * hits / total, 6) AS pct FROM (SELECT *, (sum(hits) OVER (PARTITION BY config))::BIGINT AS total FROM (SELECT config, coalesce({SRC}, 'none') AS src, count(*) AS hits FROM hits GROUP BY ALL))"""
)
def source_percentages(spark: SparkSession, d: str) -> DataFrame:
    """A configuration's sources as a map of counts, its sum, and the map in percent, flattened again."""
    n = table(spark, d, "hits").groupBy("config", F.coalesce(source_key(F.col("source")), F.lit("none")).alias("src")).agg(F.count(F.lit(1)).alias("hits"))
    m = n.groupBy("config").agg(F.map_from_entries(F.collect_list(F.struct("src", "hits"))).alias("counts"))  # a map entry a source
    m = m.select("config", "counts", F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), analytics.map_shares(F.col("counts")).alias("pct"))
    flat = m.select("config", "total", "pct", F.explode("counts").alias("src", "hits"))
    return flat.select("config", "src", "hits", "total", r6(F.col("pct")[F.col("src")]).alias("pct"))


# ---------------------------------------------------------------------------------------------------------------- evaluation
@query(
    f"""WITH {RESULTS} SELECT case_id, config, CASE WHEN success THEN coalesce(predicted_triage, 'UNKNOWN') ELSE 'ERROR' END AS predicted, coalesce(success AND predicted_triage = expected_triage, false) AS is_correct, CASE WHEN success THEN inference_time ELSE 0 END AS inference_time,
    CASE WHEN success THEN context_length ELSE 0 END AS context_length, CASE WHEN success THEN NULL ELSE coalesce(error, 'unknown error') END AS error FROM res"""
)
def case_records(spark: SparkSession, d: str) -> DataFrame:
    """Case records with the error branch: label ERROR, zeros and the message where a case failed."""
    return evaluate.case_record(results(spark, d)).select("case_id", "config", "predicted", "is_correct", "inference_time", "context_length", "error")


@query(
    f"""WITH {RESULTS}, j AS (SELECT config, case_id, avg(score) AS a, max(score) AS b FROM hits WHERE score IS NOT NULL GROUP BY ALL), x AS (SELECT res.config, j.case_id IS NOT NULL AS ok, coalesce(0.6 * a + 0.4 * b, 50.0) AS s FROM res LEFT JOIN j ON j.config = res.config AND j.case_id = res.case_id)
    SELECT config, count(*) AS cases, count(*) FILTER (ok) AS judged, round(avg(s), 6) AS legacy_mean, round(avg(s) FILTER (ok), 6) AS mean, round(stddev_pop(s) FILTER (ok), 6) AS pop_std, round(min(s) FILTER (ok), 6) AS least, round(max(s) FILTER (ok), 6) AS most FROM x GROUP BY config"""
)
def judge_scores(spark: SparkSession, d: str) -> DataFrame:
    """Cases with their judge's scores (two scores a case, weighted .6 and .4), 50 where there is none; statistics of those judged, and the mean with defaults."""
    j = table(spark, d, "hits").where("score is not null").groupBy("config", "case_id").agg(F.avg("score").alias("a"), F.max("score").alias("b"), F.lit(True).alias("ok"))
    x = results(spark, d).select("config", "case_id").join(j, ["config", "case_id"], "left").withColumn("s", F.coalesce(parse.overall_score(F.col("a"), F.col("b")), F.lit(50.0)))
    s = F.when(F.col("ok"), F.col("s"))
    return x.groupBy("config").agg(
        F.count(F.lit(1)).alias("cases"), F.count("ok").alias("judged"), r6(F.avg("s")).alias("legacy_mean"), r6(F.avg(s)).alias("mean"), r6(F.stddev_pop(s)).alias("pop_std"), r6(F.min(s)).alias("least"), r6(F.max(s)).alias("most")
    )


_CM = f"""{RESULTS}, lab AS (SELECT *, CASE WHEN expected_triage IN ('ED', 'GP', 'HOME') THEN expected_triage ELSE 'GP' END AS t, CASE WHEN predicted_triage IN ('ED', 'GP', 'HOME') THEN predicted_triage ELSE 'UNKNOWN' END AS p FROM res WHERE success),
    pr AS (SELECT config, l AS label, count(*) FILTER (t = l AND p = l) AS tp, count(*) FILTER (t = l) AS support, count(*) FILTER (p = l) AS predicted FROM lab CROSS JOIN (SELECT unnest(['ED', 'GP', 'HOME', 'UNKNOWN']) AS l) GROUP BY config, l),
    f AS (SELECT config, label, coalesce(2.0 * tp / nullif(support + predicted, 0), 0) AS f1 FROM pr)"""


@query(f"WITH {_CM} SELECT label, count(*) AS configs, round(avg(f1), 6) AS mean_f1, round(stddev_samp(f1), 6) AS std_f1 FROM f GROUP BY label")
def class_f1_spread(spark: SparkSession, d: str) -> DataFrame:
    """Mean and sample deviation of each class's F1 over configurations."""
    cells = evaluate.confusion(results(spark, d).where("success"), ["config"], "expected_triage", "predicted_triage")
    r = evaluate.class_report(cells, ["config"])
    return r.groupBy("label").agg(F.count(F.lit(1)).alias("configs"), r6(F.avg("f1")).alias("mean_f1"), r6(F.stddev_samp("f1")).alias("std_f1"))


@query(
    """WITH n AS (SELECT case_id, predicted_triage AS l, count(*) AS n FROM case_results WHERE predicted_triage IS NOT NULL GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY case_id) AS p FROM n),
    h AS (SELECT case_id, abs(sum(p * ln(p + 1e-10))) AS h FROM p GROUP BY case_id) SELECT count(*) AS cases, round(avg(h), 6) AS mean_entropy, round(avg((h > 0.3)::INT), 6) AS high_rate FROM h"""
)
def uncertainty_rate(spark: SparkSession, d: str) -> DataFrame:
    """Mean entropy of the votes over all cases and the share of uncertain ones."""
    v = evaluate.vote_uncertainty(table(spark, d, "case_results"), ["case_id"], "predicted_triage")
    return v.agg(F.count(F.lit(1)).alias("cases"), r6(F.avg("entropy")).alias("mean_entropy"), r6(F.avg(F.col("uncertain").cast("int"))).alias("high_rate"))


@query(
    f"""WITH {RESULTS} SELECT config, count(*) FILTER (NOT success) AS errors, count(*) FILTER (success AND predicted_triage = 'UNKNOWN') AS unknown, count(*) FILTER (NOT success OR predicted_triage = 'UNKNOWN') AS total_failures,
    count(*) FILTER (success AND expected_triage = 'ED') AS ed_cases, count(*) FILTER (success AND expected_triage = 'ED' AND predicted_triage IS DISTINCT FROM 'ED') AS ed_missed FROM res GROUP BY config"""
)
def failure_counts(spark: SparkSession, d: str) -> DataFrame:
    """Errors, unknown decisions, both together, and missed emergencies by number."""
    ok, unknown = F.col("success"), F.coalesce(F.col("predicted_triage") == "UNKNOWN", F.lit(False))
    ed = ok & F.coalesce(F.col("expected_triage") == "ED", F.lit(False))
    return results(spark, d).groupBy("config").agg(
        F.count_if(~ok).alias("errors"), F.count_if(ok & unknown).alias("unknown"), F.count_if(~ok | unknown).alias("total_failures"),
        F.count_if(ed).alias("ed_cases"), F.count_if(ed & ~F.col("predicted_triage").eqNullSafe(F.lit("ED"))).alias("ed_missed"),
    )


@query(
    """SELECT case_id, string_agg(l || ':' || n, ',' ORDER BY l) AS distribution, sum(n)::BIGINT AS source_count, count(*) > 1 AS is_averaged FROM (SELECT case_id, predicted_triage AS l, count(*) AS n FROM case_results WHERE predicted_triage IS NOT NULL GROUP BY ALL) GROUP BY case_id"""
)
def label_distribution(spark: SparkSession, d: str) -> DataFrame:
    """The labels of a case as a map of counts (written out for comparison), with what it was averaged from."""
    n = table(spark, d, "case_results").where("predicted_triage is not null").groupBy("case_id", "predicted_triage").agg(F.count(F.lit(1)).alias("n"))
    m = n.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("predicted_triage", "n"))).alias("m"), F.sum("n").alias("source_count"), (F.count(F.lit(1)) > 1).alias("is_averaged"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return m.select("case_id", text.alias("distribution"), "source_count", "is_averaged")


@query(
    """WITH r AS (SELECT config, case_id, coalesce(error, 'no message') AS reason, count(*) OVER (PARTITION BY coalesce(error, 'no message')) AS n, row_number() OVER (PARTITION BY coalesce(error, 'no message') ORDER BY config, case_id, loaded_at) AS sample FROM case_results WHERE NOT success)
    SELECT reason, n, sample, config, case_id FROM r WHERE sample <= 20"""
)
def failure_samples(spark: SparkSession, d: str) -> DataFrame:
    """Failures by reason, each with its number and its first twenty cases."""
    t = table(spark, d, "case_results").where("not success").select("config", "case_id", "loaded_at", F.coalesce("error", F.lit("no message")).alias("reason"))
    first = curate.first_n(t, ["reason"], [F.col("config"), F.col("case_id"), F.col("loaded_at")], 20, "sample")
    return first.join(t.groupBy("reason").agg(F.count(F.lit(1)).alias("n")), "reason").select("reason", "n", "sample", "config", "case_id")


@query("SELECT round_even(avg(l_quantity), 4) AS quantity, round_even(avg(l_extendedprice), 4) AS price, round_even(avg(l_discount), 4) AS discount, round_even(avg(l_tax), 4) AS tax, round_even(avg(l_linenumber), 4) AS line, count(*) AS n FROM lineitem")
def global_means(spark: SparkSession, d: str) -> DataFrame:
    """The mean vector of a table without keys, rounded half to even."""
    m = lambda c, n: F.bround(F.avg(c), 4).alias(n)
    return table(spark, d, "lineitem").agg(m("l_quantity", "quantity"), m("l_extendedprice", "price"), m("l_discount", "discount"), m("l_tax", "tax"), m("l_linenumber", "line"), F.count(F.lit(1)).alias("n"))


@query(
    """SELECT strftime(to_timestamp(generation_timestamp)::TIMESTAMP, '%Y-%m-%d') AS day, count(*) AS dialogues, round(min(epoch(loaded_at) - generation_timestamp) / 3600, 3) AS least_hours, round(max(epoch(loaded_at) - generation_timestamp) / 3600, 3) AS most_hours
    FROM dialogues WHERE generation_timestamp IS NOT NULL AND loaded_at IS NOT NULL GROUP BY day"""
)
def load_delays(spark: SparkSession, d: str) -> DataFrame:
    """Dialogues by day of generation and the hours until they were loaded."""
    t = table(spark, d, "dialogues").where("generation_timestamp is not null and loaded_at is not null")
    made = F.timestamp_micros((F.col("generation_timestamp") * 1_000_000).cast("long"))
    hours = (F.unix_micros(F.col("loaded_at").cast("timestamp")) / 1e6 - F.col("generation_timestamp")) / 3600
    return t.groupBy(F.date_format(made, "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("dialogues"), F.round(F.min(hours), 3).alias("least_hours"), F.round(F.max(hours), 3).alias("most_hours"))


@query(
    """SELECT config, count(*) AS hits, count(c.chunk_id) AS with_chunk, round(avg(coalesce(h.score, 0)), 6) AS mean_score, round(stddev_pop(coalesce(h.score, 0)), 6) AS pop_std, min(h.score) AS least, max(h.score) AS most
    FROM hits h LEFT JOIN chunks c ON c.chunk_id = h.chunk_id GROUP BY config"""
)
def judge_join_stats(spark: SparkSession, d: str) -> DataFrame:
    """Q18, Q22: hits left-joined to their chunks with default fill, population deviation."""
    c = table(spark, d, "chunks").select("chunk_id", F.lit(1).alias("has"))
    s = F.coalesce("score", F.lit(0.0))
    return table(spark, d, "hits").join(c, "chunk_id", "left").groupBy("config").agg(
        F.count(F.lit(1)).alias("hits"), F.count("has").alias("with_chunk"), r6(F.avg(s)).alias("mean_score"), r6(F.stddev_pop(s)).alias("pop_std"), F.min("score").alias("least"), F.max("score").alias("most")
    )


_STEM = r"regexp_replace(symptom, '\s*\(Case\s+\d+\)$', '')"
_WORDS = f"list_filter(string_split_regex(lower(replace({_STEM}, '_', ' ')), '\\s+'), lambda x: len(x) > 2 AND x NOT IN ('the', 'and', 'for', 'with'))"
_OTHER = " ".join(f"WHEN contains(s, '{c}') THEN {' OR '.join(f"contains(d, '{n}')" for n in names)}" for c, names in evaluate.SYNONYMS.items())


@query(
    rf"""WITH x AS (SELECT config, lower({_STEM}) AS s, lower(source_document) AS d, {_WORDS} AS kw FROM hits LEFT JOIN (SELECT 'case-' || dialogue_id AS case_id, symptom FROM dialogues) USING (case_id) LEFT JOIN (SELECT chunk_id, source_document FROM chunks) USING (chunk_id))
    SELECT config, count(*) AS hits, count(*) FILTER (contains(lower(replace(d, '_', ' ')), lower(replace(s, '_', ' '))) OR (len(kw) > 0 AND len(list_filter(kw, lambda k: contains(lower(replace(d, '_', ' ')), k))) >= least(2, len(kw)))) AS by_name,
    count(*) FILTER (len(kw) > 0 AND len(list_filter(kw, lambda k: contains(d, k))) >= least(2, len(kw))) AS by_keywords, count(*) FILTER (CASE WHEN contains(d, s) THEN true {_OTHER} ELSE false END) AS by_synonym FROM x GROUP BY config"""
)
def relevance_rules(spark: SparkSession, d: str) -> DataFrame:
    """Hits that are relevant by each of the three rules: name or key words, key words in the raw name, synonyms."""
    cases = table(spark, d, "dialogues").select(F.concat(F.lit("case-"), "dialogue_id").alias("case_id"), "symptom")
    h = table(spark, d, "hits").join(cases, "case_id", "left").join(table(spark, d, "chunks").select("chunk_id", "source_document"), "chunk_id", "left")
    s, doc = F.col("symptom"), F.col("source_document")
    return h.groupBy("config").agg(
        F.count(F.lit(1)).alias("hits"), F.count_if(evaluate.relevant_by_name(s, doc)).alias("by_name"), F.count_if(evaluate.relevant_by_keywords(s, doc)).alias("by_keywords"), F.count_if(evaluate.relevant_by_synonym(s, doc)).alias("by_synonym")
    )


# ------------------------------------------------------------------------------------------------------------- names and lists
_DRUGS = r"dr AS (SELECT DISTINCT lower(m) AS m FROM (SELECT unnest(regexp_extract_all(text, 'mg of ([A-Z][a-z]+)', 1)) AS m FROM documents))"


@query(
    rf"""WITH {_DRUGS}, nm AS (SELECT title AS name FROM documents UNION ALL SELECT unnest(regexp_extract_all(text, 'mg of ([A-Z][a-z]+)', 1)) FROM documents),
    k AS (SELECT min(name) AS name, count(*) AS n FROM nm WHERE name IS NOT NULL GROUP BY lower(name)), cl AS (SELECT trim(regexp_replace(name, '[ \t\n\r\f]+', ' ', 'g'), ' ') AS name, n FROM k)
    SELECT name, n, CASE WHEN lower(name) IN (SELECT m FROM dr) THEN 'medication' WHEN lower(name) IN ({", ".join("'" + x.replace("'", "''") + "'" for x in curate.PROCEDURES)}) THEN 'procedure'
    WHEN lower(name) IN ({", ".join("'" + x.replace("'", "''") + "'" for x in curate.GENERIC)}) THEN 'generic' {" ".join(f"WHEN regexp_matches(lower(name), '^.*{e}$') THEN 'medication_pattern (.*{e}$)'" for e in curate.DRUG_ENDINGS)}
    WHEN length(replace(name, ' ', '')) < 3 THEN 'too_short' WHEN length(regexp_replace(name, '[a-zA-Z \t\n\r\f]', '', 'g')) > 0.3 * length(name) THEN 'too_many_special_chars' ELSE 'kept' END AS reason FROM cl"""
)
def vocab_filter_chain(spark: SparkSession, d: str) -> DataFrame:
    """Titles and the drugs named in texts, once each whatever their case, cleaned and sent through the ordered rules; the drugs are the vocabulary of medications."""
    docs = table(spark, d, "documents")
    drugs = docs.select(F.explode(F.regexp_extract_all("text", F.lit("mg of ([A-Z][a-z]+)"), 1)).alias("name"))
    names = docs.select(F.col("title").alias("name")).unionByName(drugs).where("name is not null")
    once = names.groupBy(F.lower("name").alias("k")).agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("n"))
    cleaned = once.select(parse.without_native_terms(F.col("name")).alias("name"), "n")
    return curate.vocabulary_reason(cleaned, "name", drugs.select(F.lower("name").alias("medication"))).select("name", "n", F.coalesce("reason", F.lit("kept")).alias("reason"))


@query(
    r"""WITH v AS (SELECT lower(condition) AS k FROM conditions), s AS (SELECT lower(trim(regexp_replace(regexp_replace(symptom, '\s*\(Case\s+\d+\)$', ''), '[\s_-]+', ' ', 'g'))) AS k, count(*) AS n FROM dialogues WHERE symptom IS NOT NULL GROUP BY k)
    SELECT k AS name, n FROM s WHERE k NOT IN (SELECT k FROM v)"""
)
def unknown_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of dialogues that the vocabulary does not hold, with their number."""
    names = table(spark, d, "dialogues").where("symptom is not null").groupBy(curate.name_key(strip_case(F.col("symptom"))).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return names.join(table(spark, d, "conditions").select(F.lower("condition").alias("name")), "name", "left_anti")


_KEYS = r"trim(regexp_replace(lower({0}), '[\s_-]+', ' ', 'g'))"


@query(
    rf"""WITH t AS (SELECT DISTINCT title FROM documents WHERE title IS NOT NULL), kn AS (SELECT {_KEYS.format("condition")} AS k, min(condition_id) AS condition_id FROM conditions GROUP BY 1),
    ex AS (SELECT title, condition_id, 'exact' AS how, 1.0 AS jaccard FROM t JOIN kn ON kn.k = {_KEYS.format("title")}),
    a AS (SELECT title, list_distinct(list_filter(string_split_regex(lower(title), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS t FROM t WHERE title NOT IN (SELECT title FROM ex)),
    b AS (SELECT condition_id, list_distinct(list_filter(string_split_regex(lower(condition), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS t FROM conditions),
    s AS (SELECT title, condition_id, len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) AS j FROM a, b),
    fz AS (SELECT title, condition_id, 'fuzzy' AS how, j AS jaccard FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY j DESC, condition_id) AS rn FROM s WHERE j >= 0.5) WHERE rn = 1)
    SELECT title, m.condition_id, how, round(jaccard, 6) AS jaccard, triage_level FROM (SELECT * FROM ex UNION ALL SELECT * FROM fz) m JOIN conditions c ON c.condition_id = m.condition_id"""
)
def condition_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct title looked up by its normalised name, else by token sets, with the level of what was found."""
    c = table(spark, d, "conditions")
    titles = table(spark, d, "documents").where("title is not null").select("title", F.col("title").alias("t")).distinct()
    m = curate.lookup(titles, "title", "t", c, "condition_id", "condition")
    return m.join(c.select("condition_id", "triage_level"), "condition_id").select("title", "condition_id", "how", r6("jaccard").alias("jaccard"), "triage_level")


@query(
    f"""WITH p AS (SELECT DISTINCT {SRC} AS src, condition_id FROM documents WHERE source IS NOT NULL AND condition_id IS NOT NULL), x AS (SELECT src, condition_id, generate_subscripts(symptoms, 1) AS pos, unnest(symptoms) AS s FROM p JOIN conditions USING (condition_id)),
    f AS (SELECT src, s, min(condition_id * 1000 + pos) AS place FROM x GROUP BY ALL) SELECT src, count(*) AS n, md5(string_agg(s, '|' ORDER BY place)) AS list_md5 FROM f GROUP BY src"""
)
def ordered_symptoms(spark: SparkSession, d: str) -> DataFrame:
    """The symptoms of all conditions that a source writes of, in the order of the conditions, first occurrences kept; the order is compared."""
    docs = table(spark, d, "documents").where("source is not null and condition_id is not null").select(source_key(F.col("source")).alias("src"), "condition_id").distinct()
    u = curate.ordered_union(docs.join(F.broadcast(table(spark, d, "conditions").select("condition_id", "symptoms")), "condition_id"), ["src"], "symptoms", "condition_id")
    return u.select("src", F.size("symptoms").cast("long").alias("n"), F.md5(F.array_join("symptoms", "|").cast("binary")).alias("list_md5"))


@query(
    """SELECT coalesce(len(triage_level) > 0 AND len(symptoms) > 0 AND len(next_steps) > 0, false) AS complete, count(*) AS documents, count(DISTINCT d.condition_id) AS conditions FROM documents d JOIN conditions c ON c.condition_id = d.condition_id GROUP BY complete"""
)
def structured_complete(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose condition's structured entry is complete."""
    c = table(spark, d, "conditions").select("condition_id", curate.complete_entry("triage_level", "symptoms", "next_steps").alias("complete"))
    return table(spark, d, "documents").join(F.broadcast(c), "condition_id").groupBy("complete").agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("condition_id").alias("conditions"))


@query(
    r"""WITH x AS (SELECT split, coalesce(length(trim(patient_query, ' ')) > 0 AND length(trim(clarifying_question, ' ')) > 0 AND length(trim(patient_response, ' ')) > 0 AND length(trim(reasoning_decision, ' ')) > 0 AND length(trim(next_step, ' ')) > 0, false)
        AND coalesce(CASE WHEN contains(u, 'ED') OR contains(u, 'EMERGENCY') THEN 'ED' WHEN contains(u, 'GP') OR contains(u, 'DOCTOR') THEN 'GP' WHEN contains(u, 'HOME') THEN 'HOME' ELSE u END = triage_level, false) AS valid
        FROM (SELECT *, upper(trim(final_triage_decision, ' ')) AS u, lower(trim(regexp_replace(regexp_replace(symptom, '\s*\(Case\s+\d+\)$', ''), '[\s_-]+', ' ', 'g'))) AS k FROM dialogues) LEFT JOIN (SELECT lower(condition) AS k, triage_level FROM conditions) USING (k))
    SELECT coalesce(split, 'none') AS split, count(*) AS dialogues, count(*) FILTER (valid) AS valid FROM x GROUP BY 1"""
)
def valid_dialogues(spark: SparkSession, d: str) -> DataFrame:
    """Dialogues with all sections filled whose label is that of their condition."""
    level = F.broadcast(table(spark, d, "conditions").select(F.lower("condition").alias("k"), "triage_level"))
    t = table(spark, d, "dialogues").withColumn("k", curate.name_key(strip_case(F.col("symptom")))).join(level, "k", "left")
    sections = [F.col(c) for c in ("patient_query", "clarifying_question", "patient_response", "reasoning_decision", "next_step")]
    ok = parse.complete_dialogue(*sections, label=labels.triage_normalised(F.col("final_triage_decision")), expected=F.col("triage_level"))
    return t.groupBy(F.coalesce("split", F.lit("none")).alias("split")).agg(F.count(F.lit(1)).alias("dialogues"), F.count_if(ok).alias("valid"))


@query(
    r"""SELECT strategy, CASE WHEN contains(strategy, 'fixed') THEN 'fixed' WHEN contains(strategy, 'sentence') THEN 'sentence' WHEN contains(strategy, 'paragraph') THEN 'paragraph' WHEN contains(strategy, 'contextual') THEN 'contextual' ELSE 'unknown' END AS kind,
    CASE WHEN contains(strategy, 'fixed_c') THEN coalesce(try_cast(nullif(regexp_extract(strategy, 'c(\d+)', 1), '') AS INT), 0) WHEN contains(strategy, 'sentence_t') THEN coalesce(try_cast(nullif(regexp_extract(strategy, 't(\d+)', 1), '') AS INT), 0)
        WHEN contains(strategy, 'paragraph_m') THEN coalesce(try_cast(nullif(regexp_extract(strategy, 'm(\d+)', 1), '') AS INT), 0) WHEN contains(strategy, 'contextual') THEN coalesce(try_cast(nullif(regexp_extract(strategy, 'c(\d+)', 1), '') AS INT), 1024) ELSE 0 END AS size,
    CASE WHEN contains(strategy, '_o') THEN coalesce(try_cast(nullif(regexp_extract(strategy, 'o(\d+)', 1), '') AS INT), 0) ELSE 0 END AS overlap, replace(replace(strategy, 'contextual_', 'ctx '), 'paragraph', 'para') AS short, count(*) AS chunks FROM chunks GROUP BY strategy"""
)
def method_parts(spark: SparkSession, d: str) -> DataFrame:
    """The other dialect of method names, and display names."""
    g = table(spark, d, "chunks").groupBy("strategy").agg(F.count(F.lit(1)).alias("chunks"))
    short = parse.short_name(F.col("strategy"), {"contextual_": "ctx ", "paragraph": "para"})
    return g.select("strategy", parse.method_parts(F.col("strategy")).alias("p"), short.alias("short"), "chunks").select("strategy", "p.*", "short", "chunks")


# --------------------------------------------------------------------------------------------------------------------- chunks
@query("SELECT strategy, count(*) AS chunks, count(*) FILTER (length(contextual_info) > 0) AS contextual, count(DISTINCT doc_id) AS documents FROM chunks GROUP BY strategy UNION ALL SELECT NULL, count(*), count(*) FILTER (length(contextual_info) > 0), count(DISTINCT doc_id) FROM chunks")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, contextual ones and documents of each strategy, and in all (null strategy)."""
    c = table(spark, d, "chunks")
    aggs = [F.count(F.lit(1)).alias("chunks"), F.count_if(F.coalesce(F.length("contextual_info") > 0, F.lit(False))).alias("contextual"), F.count_distinct("doc_id").alias("documents")]
    return c.groupBy("strategy").agg(*aggs).unionByName(c.agg(*aggs).select(F.lit(None).cast("string").alias("strategy"), "*"))


SIZES = [(256, 0), (512, 0), (768, 0), (256, 50), (384, 50), (384, 100), (448, 112), (512, 100), (512, 150), (640, 64), (768, 100), (768, 200), (1024, 150)]  # fixed values: sizes and overlaps of the fixed windows


@query(
    f"""WITH z AS (SELECT unnest({[s for s, _ in SIZES]}) AS size, unnest({[o for _, o in SIZES]}) AS overlap), s AS (SELECT size, overlap, length(text) AS n, unnest(generate_series(0, length(text) - 1, size - overlap)) AS start_ FROM documents CROSS JOIN z WHERE length(text) > 0)
    SELECT size, overlap, count(*) AS chunks, sum(least(size, n - start_))::BIGINT AS chars FROM s GROUP BY ALL"""
)
def chunk_grid(spark: SparkSession, d: str) -> DataFrame:
    """Windows of all documents under each of the thirteen sizes and overlaps, in one pass over the texts."""
    docs = table(spark, d, "documents").where("length(text) > 0").select("doc_id", F.length("text").alias("n"))
    grid = F.explode(F.array(*(F.struct(F.lit(s).alias("size"), F.lit(o).alias("overlap")) for s, o in SIZES)))
    t = docs.select("n", grid.alias("z")).select("n", "z.*")
    t = t.select("size", "overlap", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.col("size") - F.col("overlap"))).alias("at"))
    return t.groupBy("size", "overlap").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.least("size", F.col("n") - F.col("at"))).alias("chars"))


PACKS = [(384, 0), (512, 0), (768, 0), (384, 1), (384, 2), (512, 1), (512, 2), (512, 3), (768, 1), (768, 2), (768, 3), (1024, 2), (1024, 3)]  # fixed values: words and overlapping sentences of the packs


@query(
    rf"""WITH RECURSIVE s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') AS t FROM documents WHERE text IS NOT NULL AND NOT contains(text, chr(1))),
    z AS (SELECT unnest({[s for s, _ in PACKS]}) AS size, unnest({[o for _, o in PACKS]}) AS overlap), w AS (SELECT doc_id, size, overlap, list_transform(t, lambda x: len(string_split_regex(x, '[ \t\n\x0B\f\r]+'))) AS w FROM s CROSS JOIN z WHERE len(t) > 0),
    p AS (SELECT doc_id, size, overlap, 1 AS i, 0 AS no, 1 AS first, w[1] AS n FROM w UNION ALL
        SELECT p.doc_id, p.size, p.overlap, i + 1, CASE WHEN n + w[i + 1] <= p.size THEN no ELSE no + 1 END, CASE WHEN n + w[i + 1] <= p.size THEN first ELSE greatest(first, i + 1 - p.overlap) END,
        CASE WHEN n + w[i + 1] <= p.size THEN n + w[i + 1] ELSE list_sum(w[greatest(first, i + 1 - p.overlap):i + 1]) END FROM p JOIN w ON w.doc_id = p.doc_id AND w.size = p.size AND w.overlap = p.overlap WHERE i < len(w)),
    c AS (SELECT size, overlap, doc_id, no, max(i) - min(first) + 1 AS n FROM p GROUP BY ALL) SELECT size, overlap, count(*) AS chunks, sum(n)::BIGINT AS sentences FROM c GROUP BY ALL"""
)
def sentence_grid(spark: SparkSession, d: str) -> DataFrame:
    """Sentence packs of all documents under each of the thirteen budgets and overlaps; texts are split once."""
    docs = table(spark, d, "documents").where("text is not null").where(~F.contains("text", F.lit("\x01")))
    grid = F.array(*(F.struct(F.lit(s).alias("size"), F.lit(o).alias("overlap")) for s, o in PACKS))
    w = docs.select(chunking.sentence_lengths(F.col("text")).alias("w")).select("w", F.explode(grid).alias("z")).select("w", "z.*")
    p = w.select("size", "overlap", F.explode(chunking.packed(F.col("w"), F.col("size"), F.col("overlap"))).alias("p"))
    return p.groupBy("size", "overlap").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.col("p.last") - F.col("p.first") + 1).alias("sentences"))


@query(
    """WITH o AS (SELECT strategy, length(text) AS n, source_char_start < lag(source_char_end) OVER (PARTITION BY doc_id, strategy ORDER BY source_char_start, chunk_id) AS over FROM chunks),
    m AS (SELECT strategy || CASE WHEN coalesce(over, false) THEN '_o50' ELSE '_o0' END AS method, n FROM o),
    g AS (SELECT regexp_replace(method, '_o\\d+', '') AS base, avg(n) FILTER (NOT regexp_matches(method, '_o[1-9]')) AS without, avg(n) FILTER (regexp_matches(method, '_o[1-9]')) AS with_ FROM m GROUP BY base)
    SELECT base, round(without, 6) AS without, round(with_, 6) AS with_, round(with_ - without, 6) AS gain FROM g WHERE without IS NOT NULL AND with_ IS NOT NULL""".replace("\\\\", "\\")
)
def overlap_gain(spark: SparkSession, d: str) -> DataFrame:
    """Methods with overlap against the same base method without, by the mean length of their chunks."""
    before = F.lag("source_char_end").over(W.partitionBy("doc_id", "strategy").orderBy("source_char_start", "chunk_id"))
    c = table(spark, d, "chunks").withColumn("over", F.coalesce(F.col("source_char_start") < before, F.lit(False)))
    m = c.select(F.concat("strategy", F.when(F.col("over"), "_o50").otherwise("_o0")).alias("method"), F.length("text").alias("n"))
    return analytics.overlap_gain(m, "method", "n").select("base", *(r6(c).alias(c) for c in ("without", "with_", "gain")))


@query("SELECT chunk_id, row_number() OVER (ORDER BY chunk_id) AS id, (row_number() OVER (ORDER BY chunk_id) - 1) // 100 AS batch FROM chunks")
def numbered_chunks(spark: SparkSession, d: str) -> DataFrame:
    """An ordered scan of the chunks with sequential ids, in batches of a hundred."""
    return ordering.batches(table(spark, d, "chunks").select("chunk_id"), ["chunk_id"], 100).select("chunk_id", "id", "batch")


@query("SELECT name, row_number() OVER (ORDER BY name) AS place FROM (SELECT DISTINCT lower(title) AS name FROM documents WHERE title IS NOT NULL)")
def sorted_names(spark: SparkSession, d: str) -> DataFrame:
    """The sorted set of titles."""
    names = table(spark, d, "documents").where("title is not null").select(F.lower("title").alias("name")).distinct()
    return ordering.row_numbers(names, ["name"], "place")


@query("SELECT dialogue_id, md5('Query: ' || trim(concat_ws(' ', patient_query, patient_response), ' ')) AS text_md5 FROM dialogues WHERE patient_query IS NOT NULL OR patient_response IS NOT NULL")
def combined_queries(spark: SparkSession, d: str) -> DataFrame:
    """Query and response of a dialogue as one search text."""
    t = table(spark, d, "dialogues").where("patient_query is not null or patient_response is not null")
    return t.select("dialogue_id", F.md5(F.concat(F.lit("Query: "), F.trim(F.concat_ws(" ", "patient_query", "patient_response"))).cast("binary")).alias("text_md5"))


@query("SELECT term, src, df, postings FROM (SELECT u.term, src, count(DISTINCT chunk_id) AS df, count(*) AS postings FROM (SELECT " + SRC + " AS src, chunk_id, list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS t FROM chunks WHERE source IS NOT NULL), unnest(t) AS u(term) GROUP BY ALL) WHERE df > 1")
def term_postings(spark: SparkSession, d: str) -> DataFrame:
    """The table of terms that stands for a full-text index: documents and occurrences of each term of a source that more than one chunk holds."""
    c = table(spark, d, "chunks").where("source is not null").select(source_key(F.col("source")).alias("src"), "chunk_id", F.filter(F.split(F.lower("text"), r"[ \t\n\r\f]+"), lambda x: x != "").alias("t"))
    per = c.select("src", "chunk_id", F.explode("t").alias("term")).groupBy("src", "term", "chunk_id").agg(F.count(F.lit(1)).alias("tf"))
    return per.groupBy("term", "src").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("postings")).where("df > 1")




@query(
    r"""SELECT family, size, quantization, config, count(*) AS n FROM (SELECT string_split(m, '-')[1] AS family, regexp_extract(string_split(m, '-')[2], '^[^_]+') AS size, CASE WHEN contains(m, '4bit') THEN '4bit' ELSE '8bit' END AS quantization,
    m || CASE WHEN p_retailprice > 1000 THEN '_Tuned' ELSE '_Base' END || '_' || CASE WHEN p_size > 25 THEN p_type ELSE 'NoRAG' END AS config FROM (SELECT *, replace(p_brand, '-', '') || '-' || p_size || 'M_' || CASE WHEN p_partkey % 2 = 0 THEN '4bit' ELSE '8bit' END AS m FROM part)) GROUP BY ALL"""
)
def model_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of models taken apart, and of configurations put together (names are made of the parts' brands and sizes)."""
    p = table(spark, d, "part")
    model = F.concat(F.replace("p_brand", F.lit("-"), F.lit("")), F.lit("-"), F.col("p_size").cast("string"), F.lit("M_"), F.when(F.col("p_partkey") % 2 == 0, "4bit").otherwise("8bit"))
    name = parse.config_name(F.col("m"), F.col("p_retailprice") > 1000, F.when(F.col("p_size") > 25, F.col("p_type")))
    return p.withColumn("m", model).select(parse.model_parts(F.col("m")).alias("x"), name.alias("config")).groupBy("x.family", "x.size", "x.quantization", "config").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT config, case_id, rank, h.chunk_id, source_document FROM (SELECT DISTINCT config, case_id, rank, chunk_id FROM hits WHERE rank <= 3) h JOIN chunks c ON c.chunk_id = h.chunk_id")
def fetched_by_rank(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of the first three hits fetched by id, each with its rank, so that the order is kept."""
    top = table(spark, d, "hits").where("rank <= 3").select("config", "case_id", "rank", "chunk_id").distinct()
    return top.join(table(spark, d, "chunks").select("chunk_id", "source_document"), "chunk_id").select("config", "case_id", "rank", "chunk_id", "source_document")


@query(
    """SELECT field, source, count(*) AS texts, count(DISTINCT md5(t)) AS different FROM (SELECT 'query' AS field, 1 AS o, source, patient_query AS t FROM dialogues UNION ALL SELECT 'question', 2, source, clarifying_question FROM dialogues UNION ALL SELECT 'response', 3, source, patient_response FROM dialogues) WHERE t IS NOT NULL GROUP BY ALL"""
)
def united_texts(spark: SparkSession, d: str) -> DataFrame:
    """The text columns of dialogues under each other, repeats kept, counted by field and source."""
    t = table(spark, d, "dialogues")
    one = lambda name, c: t.select(F.lit(name).alias("field"), "source", F.col(c).alias("t"))
    both = one("query", "patient_query").unionByName(one("question", "clarifying_question")).unionByName(one("response", "patient_response"))
    return both.where("t is not null").groupBy("field", "source").agg(F.count(F.lit(1)).alias("texts"), F.count_distinct(F.md5(F.col("t").cast("binary"))).alias("different"))


@query(r"SELECT dialogue_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(patient_query, '\d{1,9}'), lambda x: x::INT))), ',') AS numbers FROM dialogues WHERE patient_query IS NOT NULL AND upper(trim(patient_query, ' ')) <> 'NONE'")
def number_lists(spark: SparkSession, d: str) -> DataFrame:
    """The distinct whole numbers of each query, sorted."""
    t = table(spark, d, "dialogues").where("patient_query is not null and upper(trim(patient_query)) <> 'NONE'")
    return t.select("dialogue_id", F.array_join(F.transform(parse.numbers(F.col("patient_query")), lambda x: x.cast("string")), ",").alias("numbers"))
