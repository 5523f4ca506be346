"""New documents of a folder as a stream, each micro-batch through the same operators as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from segloom.operators import report, segments


def lines(spark: SparkSession, folder: str, schema: str = "doc_id long, text string, source string") -> DataFrame:
    """Segments of the documents (JSON lines) that come into a folder."""
    return segments.from_lines(spark.readStream.schema(schema).json(folder))


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run work on what has come so far, batch by batch, and remember how far it got."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def gated_counts(language: str, out: str) -> Callable[[DataFrame, int], None]:
    """A batch's counts of kept and gated segments, as Parquet under its number: a batch that runs again replaces its own."""

    def work(batch: DataFrame, number: int) -> None:
        rows = segments.gated(batch, language).selectExpr("text", "text as translation", "keep_reason as kept_reason")
        report.run_report(rows).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return work
