"""Reading and writing what the pipeline exchanges: chunks, cases, vocabularies, result files, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = (
    "chunk_id string, text string, original_text string, contextual_info string, source_document string, is_contextual boolean, source_char_start int, source_char_end int, "
    "is_structured boolean, structured_data struct<condition:string, symptoms:array<string>, triage_level:string, next_steps:array<string>>"
)
CASE = "id int, symptom string, patient_query string, query string, clarifying_question string, patient_response string, final_triage_decision string, next_step string, reasoning_question string, reasoning_decision string, reasoning string, generation_timestamp double"


def chunk_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON arrays of chunks named ``<source>_chunks_<strategy>.json``; missing fields get their defaults.

    ``original_text`` falls back to ``text``, and a chunk is contextual if it has a context. An empty folder match is an error of Spark.
    """
    raw = spark.read.schema(CHUNK).option("multiLine", True).json(path).withColumn("_f", F.col("_metadata.file_name"))
    name = r"^(.+?)_chunks_(.+)\.json$"
    return raw.select(
        F.regexp_extract("_f", name, 1).alias("source"),
        F.regexp_extract("_f", name, 2).alias("strategy"),
        "chunk_id",
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("original_text", "text").alias("original_text"),
        F.coalesce("contextual_info", F.lit("")).alias("contextual_info"),
        F.coalesce("source_document", F.lit("")).alias("source_document"),
        F.coalesce(F.length("contextual_info") > 0, F.lit(False)).alias("is_contextual"),
        "source_char_start",
        "source_char_end",
        F.coalesce("is_structured", F.lit(False)).alias("is_structured"),
        "structured_data",
    )


def complete_strategies(chunks: DataFrame, sources: int = 3) -> DataFrame:
    """``strategy`` of those present in at least ``sources`` sources."""
    return chunks.groupBy("strategy").agg(F.count_distinct("source").alias("n")).where(F.col("n") >= sources).select("strategy")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file matches ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first of several places that holds anything (a fallback chain), null if none does."""
    return next((p for p in paths if exists(spark, p)), None)


def combined_chunks(spark: SparkSession, folder: str, sources: list[str], strategy: str) -> DataFrame:
    """The chunks of one strategy over several sources, with ``source_ord``; a source whose file is missing is skipped, no source at all is an error."""
    found = [(i, s) for i, s in enumerate(sources) if exists(spark, f"{folder}/{s}_chunks_{strategy}.json")]
    if not found:
        raise FileNotFoundError(f"no chunks of {strategy} in {folder}")
    c = chunk_files(spark, [f"{folder}/{s}_chunks_{strategy}.json" for _, s in found])
    place = F.create_map(*(x for i, s in found for x in (F.lit(s), F.lit(i))))
    return c.withColumn("source_ord", place[F.col("source")])


def first_cases(cases: DataFrame, n: int, order: str = "id") -> DataFrame:
    """The first ``n`` test cases in ``order``; the cap is the feature."""
    return cases.orderBy(F.col(order).asc_nulls_last(), "symptom", "query").limit(n)


def quota_profiles(spark: SparkSession, path: str, suite: str) -> DataFrame:
    """``suite, profile, source, source_ord, quota`` from a nested JSON file ``{"profiles": {name: {source: quota}}}``; sources are ordered by name."""
    raw = spark.read.schema("profiles map<string, map<string, int>>").option("multiLine", True).json(path)
    p = raw.select(F.explode("profiles").alias("profile", "m")).select("profile", F.posexplode(F.array_sort(F.map_entries("m"))).alias("i", "e"))
    return p.select(F.lit(suite).alias("suite"), "profile", F.col("e.key").alias("source"), (F.col("i") + 1).alias("source_ord"), F.coalesce("e.value", F.lit(0)).alias("quota"))


def case_files(spark: SparkSession, path: str | list[str], fallback: str | None = None) -> DataFrame:
    """Test cases of both shapes as one: ``id, symptom, query, reasoning, final_triage_decision, next_step``; unreadable rows are left out.

    The dialogue form joins query and response; surrounding quotes go; missing ids stay null. ``fallback`` is read where nothing is
    at ``path``.
    """
    path = path if fallback is None or exists(spark, path) else fallback
    from quern.functions.text import strip_quotes

    raw = spark.read.schema(CASE + ", _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    raw = raw.where("_corrupt is null and (patient_query is not null or query is not null)")
    q = F.coalesce("query", F.concat_ws(" ", strip_quotes(F.col("patient_query")), strip_quotes(F.col("patient_response"))))
    return raw.select("id", "symptom", q.alias("query"), F.coalesce("reasoning", "reasoning_decision").alias("reasoning"), "final_triage_decision", "next_step")


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``name`` of each line such as ``  12. Name``; other lines are left out. Of several paths the first that exists is read."""
    if isinstance(path, list):
        path = first_existing(spark, path) or path[-1]
    return spark.read.text(path).select(F.trim(F.regexp_extract("value", r"^\s*\d+\.\s+(.+)", 1)).alias("name")).where("name <> ''")


def file_stems(spark: SparkSession, path: str) -> DataFrame:
    """``stem`` of each text file, without reading the files' contents into rows."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]+$", "").alias("stem"))


def latest_file(spark: SparkSession, path: str) -> str | None:
    """Path of the file last changed, null if none matches."""
    return spark.read.format("binaryFile").load(path).agg(F.max_by("path", "modificationTime")).first()[0]


def result_files(spark: SparkSession, path: str) -> DataFrame:
    """One row a configuration from summaries with a ``results`` array, flattened; maps stay maps."""
    item = "config struct<config_name:string, chunking_method:string, retrieval_type:string, bias_config:string>, pass_at_5 double, pass_at_10 double, avg_retrieval_time double, total_test_cases int, source_distribution map<string,bigint>"
    raw = spark.read.schema(f"timestamp string, results array<struct<{item.replace(' struct', ':struct').replace(' double', ':double').replace(' int', ':int').replace(' map', ':map')}>>").option("multiLine", True).json(path)
    return raw.select("timestamp", F.explode("results").alias("r")).select("timestamp", "r.config.*", *(F.col(f"r.{c}") for c in ("pass_at_5", "pass_at_10", "avg_retrieval_time", "total_test_cases", "source_distribution")))


def flat_results(spark: SparkSession, path: str) -> DataFrame:
    """One wide row a configuration from the other dialect, a flat JSON list; with memory and source maps turned into columns.

    ``peak_mb`` is the growth of memory, ``total`` the sum over sources, ``pct`` the map of sources in percent.
    """
    from quern.operators.analytics import map_shares

    item = "config_name string, chunking_method string, retrieval_type string, bias_config string, pass_at_1 double, pass_at_5 double, pass_at_10 double, pass_at_20 double, avg_retrieval_time double, total_test_cases int, memory_stats map<string,double>, source_distribution map<string,bigint>"
    raw = spark.read.schema(item).option("multiLine", True).json(path)
    total = F.aggregate(F.map_values("source_distribution"), F.lit(0).cast("long"), lambda s, x: s + x)
    peak = F.col("memory_stats")["peak_memory_mb"] - F.col("memory_stats")["start_memory_mb"]
    scalars = [c for c in raw.columns if c not in ("memory_stats", "source_distribution")]
    return raw.select(*(F.coalesce(c, F.lit(0.0)).alias(c) if c.startswith("pass") else F.col(c) for c in scalars), peak.alias("peak_mb"), total.alias("total"), map_shares(F.col("source_distribution")).alias("pct"))


def evaluation_files(spark: SparkSession, path: str) -> DataFrame:
    """One wide row an evaluated model configuration from files with a ``results`` array: parts of the model's name, class scores, rates.

    A missing retrieval configuration is ``NoRAG``; the extraction rate is one minus unknown decisions over cases.
    """
    from quern.functions.parse import model_parts

    score = "struct<precision:double,recall:double,`f1-score`:double>"
    config = "struct<model_name:string,adapter_path:string,rag_config:struct<name:string>,test_name:string>"
    schema = f"results array<struct<config:{config},triage_accuracy:double,f1_score:double,f2_score:double,cases_evaluated:int,unknown_triage_count:int,total_failures:int,avg_inference_time_per_case:double,classification_report:struct<ED:{score},GP:{score},HOME:{score}>>>"
    r = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("results").alias("r")).select("r.*")
    classes = [F.col(f"classification_report.{c}.`{m}`").alias(f"{c.lower()}_{n}") for c in ("ED", "GP", "HOME") for m, n in (("precision", "precision"), ("recall", "recall"), ("f1-score", "f1"))]
    unknown = F.coalesce("unknown_triage_count", F.lit(0))
    return r.select(
        F.col("config.model_name").alias("model_name"), model_parts(F.col("config.model_name")).alias("m"), F.coalesce("config.rag_config.name", F.lit("NoRAG")).alias("rag_config"), F.col("config.test_name").alias("test_name"),
        "triage_accuracy", "f1_score", "f2_score", unknown.alias("unknown"), F.coalesce("total_failures", F.lit(0)).alias("total_failures"), (1 - F.try_divide(unknown, F.col("cases_evaluated"))).alias("extraction_rate"),
        F.col("avg_inference_time_per_case").alias("seconds"), *classes,
    ).select("model_name", "m.*", *(c for c in ("rag_config", "test_name", "triage_accuracy", "f1_score", "f2_score", "unknown", "total_failures", "extraction_rate", "seconds")), *(f"{c}_{n}" for c in ("ed", "gp", "home") for n in ("precision", "recall", "f1")))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_documents(df: DataFrame, path: str) -> None:
    """Documents by source; the key of a document is the hash of its address, so no two names collide."""
    df.withColumn("doc_key", F.xxhash64("url")).write.mode("append").partitionBy("source").parquet(path)


def write_missing(df: DataFrame, path: str, keys: list[str], partition: str) -> DataFrame:
    """Appends the rows whose ``keys`` the table at ``path`` has not yet, and returns them; the first call writes all."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(*keys).distinct()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = None
    todo = df if done is None else df.join(done, keys, "left_anti")
    todo.write.mode("append").partitionBy(partition).parquet(path)
    return todo


def manifest(df: DataFrame, by: str) -> DataFrame:
    """``<by>, items`` and a row with null ``by`` for the total."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("items")).unionByName(df.agg(F.lit(None).cast("string").alias(by), F.count(F.lit(1)).alias("items")))
