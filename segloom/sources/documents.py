"""Segment documents as JSON, images, and writing files beside each other."""

from __future__ import annotations

import os
import uuid

from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The schema of the JSON format, and the formats that there are.
JSON = (
    "segments array<struct<id: string, text: string, box: struct<wPt: double, hPt: double>, "
    "font: struct<family: string, sizePt: double, bold: boolean, italic: boolean, colorHex: string>, context: string, groupKey: string, kind: string>>"
)
ADAPTERS = (("fake", ".fake.json"), ("pptx", ".pptx"), ("image", ".png"), ("image", ".jpg"), ("image", ".jpeg"))


def adapters(spark: SparkSession, with_images: bool = True) -> DataFrame:
    """The formats and their suffixes; images only where something can read text in them."""
    values = ", ".join(f"('{a}', '{e}')" for a, e in ADAPTERS if with_images or a != "image")
    return spark.sql(f"select * from values {values} as t(adapter, extension)")


def json_segments(spark: SparkSession, path: str) -> DataFrame:
    """One row for each segment of each JSON document, in order."""
    docs = spark.read.schema(JSON).json(path, multiLine=True).select(F.input_file_name().alias("doc_id"), F.posexplode("segments").alias("pos", "s"))
    return docs.select(
        "doc_id", "pos", "s.id", "s.text", F.col("s.box.wPt").alias("box_w"), F.col("s.box.hPt").alias("box_h"), F.col("s.font.family").alias("family"), F.col("s.font.sizePt").alias("size_pt"),
        F.col("s.font.bold").alias("bold"), F.col("s.font.italic").alias("italic"), "s.context", F.col("s.groupKey").alias("group_key"), "s.kind",
    )


def json_documents(fitted: DataFrame) -> DataFrame:
    """doc_id and the JSON text of each document of fitted segments, in their order."""
    one = F.struct(
        "pos", "id", "text", F.struct(F.col("box_w").alias("wPt"), F.col("box_h").alias("hPt")).alias("box"), F.struct("family", F.col("size_pt").alias("sizePt"), "bold", "italic").alias("font"),
        "context", F.col("group_key").alias("groupKey"), "kind", F.col("final_text").alias("translation"), F.col("fitted_size_pt").alias("fittedSizePt"), F.col("fitted_lines").alias("fittedLines"),
    )
    ordered = F.transform(F.array_sort(F.collect_list(one)), lambda s: s.dropFields("pos"))
    return fitted.groupBy("doc_id").agg(F.to_json(F.struct(ordered.alias("segments"))).alias("content"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images: image_id (the path), height, width, nChannels, data."""
    return spark.read.format("image").load(path).select(F.col("image.origin").alias("image_id"), "image.height", "image.width", "image.nChannels", "image.data")


def save_files(rows: DataFrame, folder: str) -> None:
    """Write name and content (text or binary) as files of a shared folder, each whole or not at all.

    folder is a path or a URI of any file system that all executors reach. A task that runs again writes the same files.
    """
    folder = folder.replace("s3a://", "s3://") if "://" in folder or folder.startswith("file:") else os.path.abspath(folder)

    def save(part) -> None:
        system, root = FileSystem.from_uri(folder)
        for row in part:
            data = row["content"].encode() if isinstance(row["content"], str) else bytes(row["content"])
            held, name = f"{root}/.{uuid.uuid4().hex}", f"{root}/{row['name']}"
            with system.open_output_stream(held) as f:
                f.write(data)
            system.move(held, name)

    system, root = FileSystem.from_uri(folder)
    system.create_dir(root)
    rows.select("name", "content").foreachPartition(save)
