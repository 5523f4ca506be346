"""Segments: rows of text with a place in their document, gated, grouped in order and packed under a budget.

A segment has doc_id, pos (order within the document), id, text, context and group_key (null: group by context).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from segloom.functions import text as T
from segloom.operators.ordered import dealt, through

#: Characters (UTF-16 units) of a group beyond which a new one begins.
BUDGET = 2000


def from_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", context: str = "source") -> DataFrame:
    """One segment for each line of each document, grouped by document."""
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.col(context).alias("context"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "text"))
    return lines.select("doc_id", "pos", F.concat_ws("/", F.col("doc_id").cast("string"), F.col("pos").cast("string")).alias("id"), "text", "context", F.col("doc_id").cast("string").alias("group_key"))


def gated(segments: DataFrame, source_language: str) -> DataFrame:
    """segments with keep_reason: why a segment stays as it is; null for those to translate."""
    return segments.withColumn("keep_reason", T.keep_reason(source_language, F.col("text")))


def grouping_key() -> Column:
    return F.coalesce("group_key", "context")


def islands(segments: DataFrame) -> DataFrame:
    """segments with letters, and the number (from 0) of the run of equal grouping keys that each is in."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    kept = segments.where(T.has_letters(F.col("text"))).withColumn("key", grouping_key())
    changed = F.coalesce((~F.col("key").eqNullSafe(F.lag("key").over(order))).cast("int"), F.lit(0))
    first = F.when(F.row_number().over(order) == 1, F.lit(0)).otherwise(changed)
    return kept.withColumn("changed", first).withColumn("island", F.sum("changed").over(order).cast("int")).drop("changed")


def packed(segments: DataFrame, budget: int = BUDGET, keep: tuple[str, ...] | None = None) -> DataFrame:
    """segments with letters and their group_no (from 0) in their document, in one pass in order.

    A group ends where the grouping key changes or the next text would exceed the budget; a text beyond the budget is
    a group of its own. keep names the columns to take along beside doc_id, pos, key and units (None: all), so that
    texts that nobody reads aren't shuffled.
    """
    kept = segments.where(T.has_letters(F.col("text"))).withColumn("key", grouping_key()).withColumn("units", T.utf16_length(F.col("text")))
    if keep is not None:
        kept = kept.select(*dict.fromkeys(["doc_id", "pos", *keep, "key", "units"]))

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, key, held, group = object(), None, 0, -1
        for batch in batches:
            out = []
            for own_doc, own_key, units in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "units")), strict=True):
                if own_doc != doc:
                    doc, key, held, group = own_doc, own_key, 0, 0
                elif own_key != key or held + units > budget:
                    key, held, group = own_key, 0, group + 1
                held += units
                out.append(group)
            yield batch.append_column("group_no", pa.array(out, pa.int32()))

    return dealt(kept, ["doc_id"], ["pos"]).mapInArrow(number, StructType(list(kept.schema)).add("group_no", IntegerType()))


def group_contexts(grouped: DataFrame) -> DataFrame:
    """What each group is, for the prompt: its key and distinct contexts in order, or its only context."""
    roles = F.array_join(F.array_sort(F.collect_set("context")), ", ")
    named = F.when(F.coalesce(F.first("group_key"), F.lit("")) == "", F.min_by("context", "pos")).otherwise(F.concat(F.first("group_key"), F.lit(": "), roles))
    return grouped.groupBy("doc_id", "group_no").agg(named.alias("group_context"), F.count("*").alias("segments"), F.sum("units").alias("units"))


def duplicate_ids(segments: DataFrame) -> DataFrame:
    return segments.groupBy("doc_id", "id").agg(F.count("*").alias("n")).where("n > 1")


def with_unique_ids(segments: DataFrame) -> DataFrame:
    """segments, failing on the first id that a document has twice."""
    seen = F.count("*").over(Window.partitionBy("doc_id", "id"))
    fail = F.raise_error(F.concat(F.lit("segment id occurs twice: "), F.col("id")))
    return segments.withColumn("id", F.when(seen > 1, fail).otherwise(F.col("id")))


def suffixed_ids(rows: DataFrame) -> DataFrame:
    """rows (doc_id, pos, base) with id: the base, or the base with the first free number from 2 on."""

    def step(own: Iterator[dict]) -> Iterator[dict]:
        taken: set[str] = set()
        free: dict[str, int] = {}  # below these numbers, all are taken
        for row in own:
            base = found = row["base"]
            while found in taken:
                n = free.get(base, 2)
                found, free[base] = f"{base}-{n}", n + 1
            taken.add(found)
            yield row | {"id": found}

    return through(rows, ["doc_id"], ["pos"], step, StructType(list(rows.schema)).add("id", StringType()))


def first_usage(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each value of by."""
    return rows.withColumn("usage", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("usage = 1").drop("usage")


def extensions_resolved(paths: DataFrame, adapters: DataFrame) -> DataFrame:
    """paths (path) with adapter, and out_path beside the input; the longest suffix that fits wins.

    adapters (adapter, extension) is a list of formats, a handful of rows.
    """
    fits = paths.join(F.broadcast(adapters), F.lower("path").endswith(F.lower("extension")), "left")
    best = fits.groupBy("path").agg(F.max_by("adapter", F.struct(F.length("extension"), "extension")).alias("adapter"), F.max_by("extension", F.struct(F.length("extension"), "extension")).alias("found"))
    own = F.coalesce("found", F.regexp_extract("path", r"(?<=[^/])(\.[^./]*)$", 1))
    base = F.expr("substring(path, 1, length(path) - length(own))")
    return best.withColumn("own", own).select("path", "adapter", F.concat(base, F.lit("_translated"), "own").alias("out_path"))
