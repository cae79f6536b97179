"""Session factory and the few run-time helpers that operators share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "quern", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with AQE, UTC and Arrow; ``conf`` overrides single settings (dots written as ``__``)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        base["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    base |= {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in base.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where set; without it a fresh local one, on a local master only (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quern-", dir=os.environ.get("TMPDIR"))
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


_stages: list[str] = []


def written(df: DataFrame, label: str = "stage") -> DataFrame:
    """Cut the lineage of ``df`` by writing it to the shared folder and reading it again.

    The copy survives the loss of any executor; a later read never recomputes ``df``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stages.append(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`written` that nothing will read again."""
    for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, root)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def sweep(spark: SparkSession) -> int:
    """Delete all stages that :func:`written` made so far, once no result that reads them is needed any more; returns how many."""
    n = len(_stages)
    while _stages:
        _delete(spark, _stages.pop())
    return n


def salted_lookup(left: DataFrame, right: DataFrame, key: str, spread: str, salts: int = 16, how: str = "left", few: int = 50_000) -> DataFrame:
    """Join ``right`` (one row per ``key``) to ``left``, where one key may hold a third of ``left``. Null keys find nothing.

    Up to ``few`` rows of ``right`` (counted first) are broadcast. Beyond that each key is spread over ``salts`` tasks: the column ``spread``
    (any column that differs between the rows of a key) salts it, and ``right`` is replicated ``salts`` times, never broadcast. ``few``
    of 0 spares the count.
    """
    if few and right.limit(few + 1).count() <= few:
        return left.join(F.broadcast(right), key, how)
    a = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b.hint("merge"), [key, "_salt"], how).drop("_salt")
