"""Incremental ingestion as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_pages(spark: SparkSession, path: str, schema: str, watermark: str = "7 days") -> DataFrame:
    """Stream of the pages whose address is seen for the first time within the watermark; needs ``url`` and ``crawled_at``.

    The state holds addresses only, and those older than the watermark leave it: a page seen again later comes again. Written through
    :func:`append_missing` with the key ``url`` no page comes twice however late, as the written table is the memory.
    """
    raw = spark.readStream.schema(schema).parquet(path).where("url is not null")
    return raw.withWatermark("crawled_at", watermark).dropDuplicatesWithinWatermark(["url"])


def windowed_counts(events: DataFrame, time: str, by: str, value: str, window: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """Count and sum of each window and ``by``; late rows within the watermark still count. Works on streams and tables."""
    t = events.withWatermark(time, watermark) if events.isStreaming else events
    g = t.groupBy(F.window(time, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), by, "n", "total")


def append_missing(stream: DataFrame, path: str, checkpoint: str, keys: list[str], once: bool = True) -> StreamingQuery:
    """Appends each micro-batch's rows that the table at ``path`` has not yet; restarted from ``checkpoint`` it repeats none."""
    from quern.sources.readers import write_missing

    def sink(batch: DataFrame, _: int) -> None:
        write_missing(batch.dropDuplicates(keys).withColumn("_part", F.lit(0)), path, keys, "_part")

    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
