"""Writing results: summaries, details, tables, reports, prompt files, indexes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_summaries(df: DataFrame, path: str) -> None:
    """One JSON object a configuration, nested columns as they are; replaces what is there."""
    df.write.mode("overwrite").json(path)


def append_snapshot(df: DataFrame, path: str, iteration: int) -> None:
    """The rows of one iteration of an evaluation, added to those of the iterations before; a repeated iteration replaces its own rows."""
    df.sparkSession.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    df.withColumn("iteration", F.lit(iteration)).write.mode("overwrite").partitionBy("iteration").parquet(path)


def write_details(results: DataFrame, cases: DataFrame, path: str, metric: str, config: str = "config", case: str = "case_id", top: int = 5, first: int = 10) -> None:
    """The first cases of the best configurations by ``metric``, as JSON by configuration; ties go by name."""
    from pyspark.sql import Window as W

    best = F.broadcast(results.orderBy(F.col(metric).desc_nulls_last(), config).limit(top).select(config))
    own = cases.join(best, config, "left_semi").withColumn("_n", F.row_number().over(W.partitionBy(config).orderBy(case)))
    own.where(F.col("_n") <= first).drop("_n").write.mode("overwrite").partitionBy(config).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV table with a header; maps and arrays become JSON text."""
    nested = [f.name for f in df.schema if f.dataType.typeName() in ("map", "array", "struct")]
    df.select(*(F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns)).write.mode("overwrite").option("header", True).csv(path)


def write_report(df: DataFrame, path: str, line: Callable[[dict], str], title: str, most: int = 1000) -> None:
    """A text report of a small table: a title, a rule, and a line a row; more than ``most`` rows are an error, as reports are read by people."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    lines = [title, "-" * len(title), *(line(r.asDict(recursive=True)) for r in rows)]
    df.sparkSession.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_prompts(df: DataFrame, path: str, prompt: str = "prompt", completion: str = "completion") -> None:
    """JSON lines with ``prompt`` and ``completion``; rows where either is null or empty are left out."""
    t = df.select(F.col(prompt).alias("prompt"), F.col(completion).alias("completion"))
    t.where("length(prompt) > 0 and length(completion) > 0").write.mode("overwrite").json(path)


def write_vectors(index: DataFrame, path: str) -> None:
    """A vector index (``key, part, vec``) by part; the key is in the row, so no second file can get out of step."""
    index.write.mode("overwrite").partitionBy("part").parquet(path)


def write_postings(index: DataFrame, path: str) -> None:
    """The postings of a lexical index (``key, part, terms``): ``term, key, tf, dl`` by part, sorted by term within files so that a term's rows lie together."""
    t = index.where("terms is not null").select("part", "key", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    p = t.groupBy("part", "key", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    p.sortWithinPartitions("part", "term", "key").write.mode("overwrite").partitionBy("part").parquet(path)
