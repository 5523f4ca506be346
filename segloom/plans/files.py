"""Translating a folder of files: slide decks or images in, the same kind of files out, and a report for each."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segloom.operators import report
from segloom.operators.layout import HalfEm
from segloom.plans.settled import settled
from segloom.plans.translate import translate
from segloom.sources import decks, documents, pictures


@dataclass
class FilesRun:
    """What became of the files: segments with their final texts, the report of each file, and files that couldn't be written (path, error)."""

    rows: DataFrame
    report: DataFrame
    failed: DataFrame


def translate_files(
    spark: SparkSession, kind: str, path: str, out: str, source: str, target: str, provider: Callable[[], Callable[[dict], dict]], engine: pictures.Engine,
    name: str = "provider", measure: HalfEm | None = None, draw: pictures.Draw | None = None,
) -> FilesRun:
    """Translate the decks (kind pptx) or images (kind image) under path into files of the same names in the folder out.

    A file that can't be read has a report of what was skipped and no output. Without draw, pictures get no new text, so
    their places would be blank: they are left as they are then.
    """
    phases, began = {}, time.perf_counter()

    def lap(phase: str) -> None:
        nonlocal began
        phases[phase], began = int((time.perf_counter() - began) * 1000), time.perf_counter()

    files = decks.files(spark, path) if kind == "pptx" else pictures.image_files(spark, path)
    read = pictures.of_decks if kind == "pptx" else pictures.of_images
    found = read(files, f"{name}-engine", engine, source, measure)
    segments, skipped = settled(found.segments), settled(found.skipped)
    lap("extract")
    run = translate(segments.withColumnRenamed("path", "doc_id"), source, target, provider, name, measure)
    lap("translate")
    rows = settled(run.rows.withColumnRenamed("doc_id", "path"))
    lap("fit")
    painted = rows if draw else rows.withColumn("final_text", F.when(F.col("image_id").isNull(), F.col("final_text")).otherwise(F.col("text")))
    if kind == "pptx":
        new = decks_new = settled(pictures.decks_written(files, found, painted, measure, draw))
        failed = decks_new.where("error is not null").select("path", "error")
    else:
        unread = skipped.where("id = path").select("path", F.col("reason").alias("error"))
        new = pictures.images_written(files, found, painted, measure, draw).join(unread, "path", "left_anti")
        failed = unread
    documents.save_files(new.where("content is not null").select(F.element_at(F.split("path", "/"), -1).alias("name"), "content"), out)
    lap("apply")
    calls = run.calls.withColumnRenamed("doc_id", "path")
    return FilesRun(rows, report.full(rows, skipped, calls, "path", name, phases), failed)
