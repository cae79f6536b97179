"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import source_key
from quern.llm import answers, contamination, mixing, neardup, reading, sampling, splits, tokenizer
from quern.session import table, written


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """``entity`` (condition_id) and ``name``: conditions by their name and by each alias."""
    c = table(spark, d, "conditions")
    both = F.concat(F.array("condition"), F.coalesce("aliases", F.array().cast("array<string>")))
    return c.select(F.col("condition_id").alias("entity"), F.explode(both).alias("name"))


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return splits.entity_groups(table(spark, d, "dialogues").select("dialogue_id", "symptom"), "dialogue_id", "symptom", vocabulary(spark, d))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d).where("entity is not null").select("dialogue_id", F.col("entity").alias("condition_id"))


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(written(_groups(spark, d), "groups"), "dialogue_id", table(spark, d, "split_targets"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_report(p1_splits(spark, d), table(spark, d, "split_targets"))


def _overlaps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, d, "dialogues")
    named = written(splits.name_links(t.select("symptom"), "symptom", vocabulary(spark, d)).where("entity is not null"), "names")
    return contamination.cross_split_overlaps(t, "dialogue_id", splits.name_key(splits.name_words(F.col("symptom"))), named, "patient_query", "split")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return contamination.overlap_pairs(*_overlaps(spark, d), "dialogue_id").select("dialogue_id_a", "dialogue_id_b")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return contamination.overlap_report(table(spark, d, "dialogues"), *_overlaps(spark, d), "dialogue_id", "split", "source")


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cols = table(spark, d, "dialogues").select("dialogue_id", "patient_query", "reasoning_decision")
    return neardup.near_duplicates(cols, "dialogue_id", ["patient_query", "reasoning_decision"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.duplicate_pairs(*_near(spark, d), "dialogue_id")


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row a dialogue; one without either text is a group of its own."""
    own = F.col("dialogue_id")
    g = table(spark, d, "dialogues").select("dialogue_id").join(neardup.duplicate_groups(*_near(spark, d), "dialogue_id"), "dialogue_id", "left")
    return g.select(own, F.coalesce("rep", own).alias("rep"), F.coalesce("group", own).alias("group"), F.coalesce("links", F.lit(0)).alias("links"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return answers.defects(table(spark, d, "dialogues"), "dialogue_id", table(spark, d, "documents"))


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return p4_found(spark, d).groupBy("field", "defect").agg(F.count(F.lit(1)).alias("answers"))


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dialogues").select("dialogue_id", "final_triage_decision")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    cat = sampling.triage_category(F.col("final_triage_decision"))
    rows = sampling.availability(_decisions(spark, d), cat, table(spark, d, "sample_targets")).collect()  # the target rows
    return spark.createDataFrame(sampling.shortfalls(rows), "plan string, category string")


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    cat = sampling.triage_category(F.col("final_triage_decision"))
    return sampling.proportional_sample(_decisions(spark, d), "dialogue_id", cat, table(spark, d, "sample_targets"))[0]


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    cat = sampling.triage_category(F.col("final_triage_decision"))
    rows = sampling.availability(_decisions(spark, d), cat, table(spark, d, "sample_targets")).collect()
    return spark.createDataFrame(sampling.planned_counts(rows), sampling.PLANNED)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.token_ids(table(spark, d, "documents").select("doc_id", "text"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.round_trip(table(spark, d, "documents").select("doc_id", "text"))


def _counted(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.token_counts(table(spark, d, "documents").select("doc_id", "source", "text"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.short_sources(_counted(spark, d), source_key(F.col("source")), table(spark, d, "mix_targets"), source_key(F.col("source")))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mixed(written(_counted(spark, d), "counts"), "doc_id", source_key(F.col("source")), table(spark, d, "mix_targets"), source_key(F.col("source")))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.bands(p8_levels(spark, d))


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents by source and whole grade of their level."""
    levels = p8_levels(spark, d).join(table(spark, d, "documents").select("doc_id", source_key(F.col("source")).alias("source_key")), "doc_id")
    return levels.groupBy("source_key", F.floor("level").alias("level")).agg(F.count(F.lit(1)).alias("documents"), F.sum("n_words").alias("words"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_splits, p1_report, p2_found, p2_report, p3_found, p3_groups, p4_found, p4_counts, p5_found, p5_sample, p5_report, p6_ids, p6_round_trip, p7_found, p7_mix, p7_report, p8_found, p8_levels, p8_profile)}


_CATEGORY = r"""cat AS (SELECT CASE
    WHEN regexp_matches(t, '\b(error|err|exception|failed|failure|timeout|timed out|traceback|crash(ed)?)\b') THEN 'ERROR'
    WHEN regexp_matches(t, '\b(un|not |in)(known|decided|determined|clear|certain|sure|specified|stated|available|conclusive)\b|\bundetermined\b|\b(unkn?|na|n a|none|null|nil|nan|tbd|tbc|pending)\b') THEN 'UNKNOWN'
    WHEN regexp_matches(t, '\b(ed|er|ae|a&e|a & e|emergency|emergencies|ambulance|hospital|111|911|999)\b') THEN 'ED'
    WHEN regexp_matches(t, '\b(gp|gps|general pract\w*|practitioner|practice|family (doctor|physician)|doctors?|physician|clinic|primary care|medical cent(re|er))\b') THEN 'GP'
    WHEN regexp_matches(t, '\b(home|self ?care|selfcare|self manage\w*|self treat\w*|pharmacy|rest)\b') THEN 'HOME' ELSE 'UNKNOWN' END AS category
    FROM (SELECT regexp_replace(trim(regexp_replace(lower(coalesce(final_triage_decision, '')), '[^\p{L}\p{N}&]+', ' ', 'g')), '\b(e|g|a) (d|p|e)\b', '\1\2', 'g') AS t FROM dialogues))"""


_NEAR = r"""t AS (SELECT dialogue_id, 1 AS f, patient_query AS x FROM dialogues UNION ALL SELECT dialogue_id, 2, reasoning_decision FROM dialogues),
    l AS (SELECT dialogue_id, f, CASE WHEN regexp_matches(x, '[\p{L}\p{N}]') THEN regexp_extract_all(lower(x), '[\p{L}\p{N}]+') WHEN regexp_replace(x, '[\p{Z}\s\p{Cf}]+', '', 'g') <> '' THEN [trim(x)] END AS w FROM t),
    c AS (SELECT dialogue_id, f, w, count(*) AS n FROM (SELECT dialogue_id, f, unnest(w) AS w FROM l) GROUP BY ALL), s AS (SELECT dialogue_id, f, sum(n) AS n FROM c GROUP BY ALL),
    p AS (SELECT a.dialogue_id AS a, b.dialogue_id AS b, f, sum(least(a.n, b.n)) AS n FROM c a JOIN c b USING (f, w) WHERE a.dialogue_id < b.dialogue_id GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    """SQL where the whole operator can be said in it; the others are tested against brute force, round trips and held-out rows."""
    return {
        "p3_found": f"""WITH {_NEAR} SELECT a AS dialogue_id_a, b AS dialogue_id_b FROM p JOIN s x ON x.dialogue_id = a AND x.f = p.f JOIN s y ON y.dialogue_id = b AND y.f = p.f WHERE p.n >= 0.75 * greatest(x.n, y.n) GROUP BY a, b HAVING count(*) = 2""",
        # its cases do not hinge on the tokenizer, so characters stand for tokens
        "p7_found": r"""WITH d AS (SELECT regexp_replace(lower(source), '[\s _\-]+', '', 'g') AS k, length(coalesce(text, '')) AS n FROM documents), per AS (SELECT k, sum(n) AS n FROM d WHERE k IS NOT NULL GROUP BY k), total AS (SELECT sum(n) AS n FROM d)
            SELECT mix, t.source FROM (SELECT *, regexp_replace(lower(source), '[\s _\-]+', '', 'g') AS k FROM mix_targets) t LEFT JOIN per USING (k) CROSS JOIN total WHERE max_repeats * coalesce(per.n, 0) < weight * size_share * total.n""",
        "p5_found": f"""WITH {_CATEGORY}, n AS (SELECT category, count(*) AS n FROM cat GROUP BY category), total AS (SELECT count(*) AS rows_ FROM cat)
            SELECT plan, t.category FROM sample_targets t LEFT JOIN n USING (category) CROSS JOIN total
            WHERE coalesce(n, 0) < greatest(target_share, min_share)::DECIMAL(9, 6) * sample_share::DECIMAL(9, 6) * rows_"""
    }
