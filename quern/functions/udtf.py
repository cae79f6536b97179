"""Chunking as a table function, for SQL users."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="chunk_no int, char_start int, char_end int, chunk string")
class FixedChunks:
    """``chunk(text, size, overlap)``: windows of ``size`` characters every ``size - overlap``; null and empty text give none."""

    def eval(self, text: str | None, size: int, overlap: int) -> Iterator[tuple[int, int, int, str]]:
        step = size - overlap
        if step <= 0:
            raise ValueError("the overlap must be smaller than the size")
        for i, at in enumerate(range(0, len(text or ""), step)):
            part = text[at : at + size]
            yield i, at, at + len(part), part


def register(spark: SparkSession) -> None:
    """Makes ``chunk`` callable in SQL: ``select d.doc_id, c.* from documents d, lateral chunk(d.text, 512, 100) c``."""
    spark.udtf.register("chunk", FixedChunks)
