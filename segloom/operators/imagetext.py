"""Text regions of images as segments to translate, and what a painter needs to put them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from segloom.functions import boxes as B
from segloom.functions import text as T
from segloom.operators import layout, regions

# What regions are to the prompt, and the height of a line.
IN_IMAGE, EMBEDDED, KIND, LINE = "image text region", "embedded image text", "image-region", 1.2


def gated(validated: DataFrame, source_language: str) -> DataFrame:
    """Regions in the script of the source language, with the reason why one can't be painted."""
    own = validated.where(T.in_source_language(source_language, F.col("text")))
    return own.withColumn("skip_reason", regions.skip_reason(F.col("confidence"), F.col("rotated"), F.col("rotation")))


def segments(validated: DataFrame, source_language: str, measure: layout.HalfEm | None = None, context: str = IN_IMAGE) -> DataFrame:
    """validated regions (image_id, id, order, and group_key where there is one) as segments with boxes and fonts.

    The size is that at which the text's ink is as high as the region's; the box is as wide as the region, and high
    enough for one line of that size. Of a turned region width and height change places.
    """
    own = measure or layout.HalfEm()
    kept = gated(validated, source_language).where("skip_reason is null").withColumn("axes", B.sizing_axes(F.col("box"), F.col("ink"), F.col("rotation")))
    group = F.col("group_key") if "group_key" in validated.columns else F.element_at(F.split("image_id", "/"), -1)
    rows = kept.select("image_id", (F.col("order") - 1).alias("pos"), "id", "text", "box", "ink", "rotation", F.col("axes.ink_height").cast("double").alias("ink_height"), F.col("axes.fit_width").cast("double").alias("box_w"), F.col("axes.fit_height_floor").cast("double").alias("floor"), T.font_family(F.col("text")).alias("family"), group.alias("group_key"))
    sized = layout._with(rows, [("size_pt", DoubleType())], lambda r: {"size_pt": layout.ink_matched(r["text"], r["ink_height"], own)})
    return sized.withColumns({"box_h": F.greatest("floor", F.col("size_pt") * LINE), "context": F.lit(context), "kind": F.lit(KIND)}).drop("floor")


def skipped(validated: DataFrame, source_language: str) -> DataFrame:
    return gated(validated, source_language).where("skip_reason is not null").select("image_id", "id", F.col("skip_reason").alias("reason"))


def paints(fitted: DataFrame, measure: layout.HalfEm | None = None) -> DataFrame:
    """What to paint where, by image: boxes whose text has changed, their lines and sizes. A picture's regions are few."""
    changed = fitted.where(F.col("final_text") != F.col("text"))
    wanted = changed.select("image_id", "pos", "box", "rotation", F.col("fitted_lines").alias("lines"), F.col("text").alias("source_text"), "fitted_size_pt", "ink_height", F.col("box_w").alias("fit_width"))
    one = F.struct("pos", "box", "lines", F.col("paint_size").alias("size"), "rotation")
    return layout.paint_sizes(wanted, measure).groupBy("image_id").agg(F.array_sort(F.collect_list(one)).alias("paints"))
