"""A whole run: segments through gate, groups, the ladder of calls, fitting and the report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.operators import exchange, layout, providers, report, segments
from segloom.plans.settled import settled


@dataclass
class Run:
    """What a run gives: every segment once, with its final text and size; the calls; totals by document."""

    rows: DataFrame
    calls: DataFrame
    report: DataFrame


def translate(source_segments: DataFrame, source: str, target: str, provider: Callable[[], Callable[[dict], dict]], name: str = "provider", measure: layout.HalfEm | None = None) -> Run:
    """source_segments: doc_id, pos, id, text, context, group_key, box_w, box_h, size_pt."""
    gated = segments.gated(segments.with_unique_ids(source_segments), source)
    packed = settled(segments.packed(gated.where("keep_reason is null")))
    contexts = segments.group_contexts(packed)
    calls: list[DataFrame] = []

    def answer(todo: DataFrame, stage: int) -> DataFrame:
        rows = todo.select("doc_id", "group_no", "id").join(packed, ["doc_id", "group_no", "id"])
        if stage == 3:  # a call for each segment: its place stands for the group
            single = rows.withColumn("old_no", F.col("group_no")).withColumn("group_no", F.col("pos"))
            asked = exchange.requests(single, contexts.join(single.select("doc_id", F.col("old_no").alias("group_no"), "pos").distinct(), ["doc_id", "group_no"]).withColumn("group_no", F.col("pos")).drop("pos"), source, target, exchange.STAGES[2])
            back = single.select("doc_id", F.col("group_no").alias("place"), "old_no").distinct()
        else:
            asked, back = exchange.requests(rows, contexts, source, target, exchange.STAGES[stage - 1]), None
        called = settled(providers.called(asked, name, provider))
        calls.append(called)
        found = called.select("doc_id", "group_no", F.explode(exchange.parsed(F.col("content"))).alias("t")).select("doc_id", "group_no", "t.id", "t.translation")
        if back is not None:
            found = found.join(back, (found["doc_id"] == back["doc_id"]) & (found["group_no"] == back["place"])).select(found["doc_id"], F.col("old_no").alias("group_no"), "id", "translation")
        return found

    outcome = exchange.resolved(exchange.ladder(packed, answer, source, target, settled))
    rows = layout.fitted(exchange.kept_originals(gated, outcome), measure)
    every = calls[0]
    for more in calls[1:]:
        every = every.unionByName(more)
    return Run(rows, every, report.run_report(rows, "doc_id"))
