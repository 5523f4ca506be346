"""Text in pictures, from files to files: image files and the pictures of slide decks, read into segments and painted back.

A picture's bytes go to files of the shared folder, once, as Spark's image source decodes files only; the recognition
engine is called once for each picture, and what it finds is written before it is used twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segloom.operators import imagetext, providers, regions
from segloom.operators.jpeg import jpeg
from segloom.operators.layout import HalfEm
from segloom.operators.ordered import out_batches, rows_of
from segloom.operators.pixels import line_places, painted, pixels_of, png
from segloom.shared import shared_dir
from segloom.shipping import ship
from segloom.sources import decks as D
from segloom.sources import documents

Engine = Callable[[], Callable[[bytes], list[dict]]]
Draw = Callable[[np.ndarray, list[dict]], np.ndarray]

#: Columns of a segment of a file: those of a deck's texts, and for regions their picture and place.
SEGMENT = (
    "path", "pos", "id", "text", "box_w", "box_h", "family", "size_pt", "bold", "italic", "context", "group_key", "kind",
    "part_path", "drawing_path", "image_id", "box", "ink_height", "rotation",
)
_PLACE = {"image_id": "string", "box": "struct<x: double, y: double, w: double, h: double>", "ink_height": "double", "rotation": "int"}


@dataclass
class Found:
    """segments (SEGMENT), skipped (path, id, reason), and the decoded pictures (path, part, image_id, jpeg, and the image source's columns)."""

    segments: DataFrame
    skipped: DataFrame
    pixels: DataFrame


def _written_once(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def _read(pictures: DataFrame, base: Column, name: str, engine: Engine, source: str, measure: HalfEm | None, context: str) -> Found:
    """pictures: path, part, pos, group_key, content; base is what a region's id comes after."""
    spark = pictures.sparkSession
    own = pictures.withColumn("image_id", F.sha2(F.concat_ws("\n", "path", "part"), 256))
    folder = f"{shared_dir(spark)}/segloom/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    documents.save_files(own.select("content", F.concat("image_id", F.lit(".img")).alias("name")), folder)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(folder)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    known = _written_once(own.select("path", "part", "pos", "group_key", "image_id", base.alias("base"), (F.substring("content", 1, 3) == F.unhex(F.lit("FFD8FF"))).alias("jpeg")))
    key = lambda c: F.regexp_extract(c, r"([0-9a-f]{64})\.img$", 1)
    decoded = documents.images(spark, folder).withColumn("image_id", key("image_id")).where("height > 0")
    sizes = _written_once(decoded.select("image_id", F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height")))
    files = spark.read.format("binaryFile").load(folder).select(key("path").alias("image_id"), "content")
    raw = _written_once(providers.detected(files.join(sizes.select("image_id"), "image_id", "left_semi"), name, engine))
    failed = raw.where("error is not null").select("image_id").union(known.join(sizes, "image_id", "left_anti").select("image_id")).distinct()
    valid = _written_once(regions.validated(raw.where("box is not null").drop("points", "error"), sizes).join(known.select("image_id", "group_key"), "image_id"))
    place = known.select("image_id", "path", "part", F.col("pos").alias("part_pos"), "base")
    unique = Window.partitionBy("path", "raw_id").orderBy("part_pos")
    times = F.row_number().over(unique)
    found = (
        imagetext.segments(valid, source, measure, context).withColumnRenamed("pos", "order").join(place, "image_id")
        .withColumn("raw_id", F.concat("base", "id")).withColumn("times", times)
        .withColumn("id", F.when(F.col("times") > 1, F.concat_ws("-", "raw_id", "times")).otherwise(F.col("raw_id")))
        .withColumn("pos", (F.row_number().over(Window.partitionBy("path").orderBy("part_pos", "order")) - 1).cast("int"))
        .withColumns({"bold": F.lit(False), "italic": F.lit(False), "part_path": F.col("part"), "drawing_path": F.lit(None).cast("string"), "rotation": F.col("rotation").cast("int")})
    )
    skipped = imagetext.skipped(valid, source).join(place, "image_id").select("path", F.concat("base", "id").alias("id"), "reason")
    unread = failed.join(place, "image_id").select("path", F.col("part").alias("id"), F.lit(D.UNREADABLE).alias("reason"))
    return Found(found.select(*SEGMENT), skipped.union(unread), decoded.join(known.select("image_id", "path", "part", "jpeg"), "image_id"))


def of_decks(decks: DataFrame, name: str, engine: Engine, source: str, measure: HalfEm | None = None) -> Found:
    """decks (path, content): the segments of their texts, then those of their pictures, each picture at its first use.

    A picture that can't be read is skipped and stays as it is, as does one without a format that can be read; a deck
    that can't be read is one row of skipped.
    """
    parts = _written_once(D.media(decks))
    raster = parts.where("reason is null").select("path", F.col("media_path").alias("part"), "pos", F.concat(F.lit("slide"), "slide_no").alias("group_key"), "content")
    base = F.concat(F.lit("media/"), F.element_at(F.split("part", "/"), -1), F.lit("#"))
    media = _read(raster, base, name, engine, source, measure, imagetext.EMBEDDED)
    texts = D.segments(decks).select("*", *[F.lit(None).cast(t).alias(c) for c, t in _PLACE.items()])
    both = texts.withColumn("picture", F.lit(0)).unionByName(media.segments.withColumn("picture", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("path").orderBy("picture", "pos")) - 1
    left_out = parts.where("reason is not null").select("path", F.col("media_path").alias("id"), "reason")
    return Found(both.withColumn("pos", place.cast("int")).select(*SEGMENT), D.skipped(decks).union(left_out).union(media.skipped), media.pixels)


def of_images(files: DataFrame, name: str, engine: Engine, source: str, measure: HalfEm | None = None) -> Found:
    """files (path, content), each an image: its regions as segments r1, r2 and so on, in one group by its name."""
    title = F.element_at(F.split("path", "/"), -1)
    own = files.select("path", F.lit("").alias("part"), F.lit(0).alias("pos"), title.alias("group_key"), "content")
    found = _read(own, F.lit(""), name, engine, source, measure, imagetext.IN_IMAGE)
    return Found(found.segments, found.skipped.withColumn("id", F.when(F.col("id") == "", F.col("path")).otherwise(F.col("id"))), found.pixels)


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of the images under a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg,PNG,JPG,JPEG}").load(path).select("path", "content")


def repainted(found: Found, fitted: DataFrame, measure: HalfEm | None = None, draw: Draw | None = None) -> DataFrame:
    """path, part, content and lines of the pictures in which a text has changed, in the format they came in.

    fitted: segments with final_text, fitted_lines and fitted_size_pt. The places are filled with what surrounds them.
    draw puts the lines (text, x, y, size, angle, colour) there: it takes and gives pixels. Without it, only lines says
    where they belong, and the pictures have empty places.
    """
    ship(fitted.sparkSession)
    wanted = imagetext.paints(fitted.where("image_id is not null"), measure)
    line = pa.struct([("pos", pa.int32()), ("text", pa.string()), ("x", pa.float64()), ("y", pa.float64()), ("size", pa.float64()), ("angle", pa.int32()), ("colour", pa.string())])
    schema = pa.schema([("path", pa.string()), ("part", pa.string()), ("content", pa.binary()), ("lines", pa.list_(line))])

    def one(row: dict) -> dict:
        paints = row["paints"]
        pixels, colours = painted(pixels_of(row), [p["box"] for p in paints])
        lines = [where | {"pos": p["pos"], "colour": "#" + "".join(f"{int(v):02x}" for v in np.clip(np.floor(c + 0.5), 0, 255))} for p, c in zip(paints, colours, strict=True) for where in line_places(p, pixels.shape)]
        if draw:
            pixels = draw(pixels, lines)
        return {"path": row["path"], "part": row["part"], "content": jpeg(pixels) if row["jpeg"] else png(pixels), "lines": lines}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a picture at a time
                yield from out_batches(map(one, rows_of([batch.slice(k, 1)])), schema)

    return found.pixels.join(wanted, "image_id").mapInArrow(run, "path string, part string, content binary, lines array<struct<pos: int, text: string, x: double, y: double, size: double, angle: int, colour: string>>")


def decks_written(decks: DataFrame, found: Found, fitted: DataFrame, measure: HalfEm | None = None, draw: Draw | None = None) -> DataFrame:
    """path, content and error: decks with translated texts and repainted pictures. fitted: path, final_text and what repainted takes."""
    texts = fitted.where("image_id is null").select("path", "id", F.col("final_text").alias("translation"), "fitted_size_pt")
    return D.written(decks, texts, repainted(found, fitted, measure, draw))


def images_written(files: DataFrame, found: Found, fitted: DataFrame, measure: HalfEm | None = None, draw: Draw | None = None) -> DataFrame:
    """path and content: images with repainted places; those without a changed text are the same bytes as before."""
    new = repainted(found, fitted, measure, draw).select("path", F.col("content").alias("new"))
    return files.join(new, "path", "left").select("path", F.coalesce("new", "content").alias("content"))
