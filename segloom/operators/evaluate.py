"""How well detections match labelled regions: one-to-one matching, coverage, and averages over all images."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segloom.functions import boxes as B
from segloom.functions import text as T
from segloom.operators.ordered import through

# The thresholds of the metrics.
STRICT, RELAXED, COVERED = 0.5, 0.4, 0.7


def pairs(truth: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """Labelled and detected regions of an image that overlap enough: image_id, truth_pos, found_pos, iou and both texts."""
    t = truth.select("image_id", F.col("pos").alias("truth_pos"), F.col("box").alias("truth_box"), F.col("text").alias("truth_text"))
    d = found.select(F.col("image_id").alias("found_image"), F.col("pos").alias("found_pos"), F.col("box").alias("found_box"), F.col("text").alias("found_text"))
    iou = B.iou(F.col("truth_box"), F.col("found_box"))
    return t.join(d, (F.col("image_id") == F.col("found_image")) & (iou >= least)).select("image_id", "truth_pos", "found_pos", iou.alias("iou"), "truth_text", "found_text")


def matched(overlaps: DataFrame) -> DataFrame:
    """Pairs taken greedily, the largest overlap first, each region once; equal ones in the order of the regions."""

    def step(rows: Iterator[dict]) -> Iterator[dict]:
        truths, founds = set(), set()
        for r in rows:
            if r["truth_pos"] not in truths and r["found_pos"] not in founds:
                truths.add(r["truth_pos"])
                founds.add(r["found_pos"])
                yield {k: v for k, v in r.items() if k != "last"}

    ordered = overlaps.withColumn("last", -F.col("iou"))
    return through(ordered, ["image_id"], ["last", "truth_pos", "found_pos"], step, overlaps.schema)


def clipped(truth: Column, found: Column) -> Column:
    """What of found lies in truth; null where they don't meet."""
    x, y = F.greatest(truth["x"], found["x"]), F.greatest(truth["y"], found["y"])
    w, h = F.least(truth["x"] + truth["w"], found["x"] + found["w"]) - x, F.least(truth["y"] + truth["h"], found["y"] + found["h"]) - y
    return F.when(truth.isNotNull() & found.isNotNull() & (w > 0) & (h > 0), B.box(x, y, w, h))


def union_area(rects: Column) -> Column:
    """The area that an array of boxes covers together, over the grid of their edges."""
    edges = lambda at, size: F.array_sort(F.array_distinct(F.flatten(F.transform(rects, lambda r: F.array(r[at], r[at] + r[size])))))
    xs, ys = edges("x", "w"), edges("y", "h")
    steps = lambda e: F.transform(F.slice(e, 1, F.greatest(F.size(e) - 1, F.lit(0))), lambda v, i: F.struct(v.alias("a"), F.get(e, i + 1).alias("b")))
    covers = lambda c, r: (r["x"] <= c["xa"]) & (r["x"] + r["w"] >= c["xb"]) & (r["y"] <= c["ya"]) & (r["y"] + r["h"] >= c["yb"])
    cells = F.flatten(F.transform(steps(xs), lambda sx: F.transform(steps(ys), lambda sy: F.struct(sx["a"].alias("xa"), sx["b"].alias("xb"), sy["a"].alias("ya"), sy["b"].alias("yb")))))
    hit = F.filter(cells, lambda c: F.exists(rects, lambda r: covers(c, r)))
    return F.aggregate(hit, F.lit(0.0), lambda s, c: s + ((c["xb"] - c["xa"]) * (c["yb"] - c["ya"])).cast("double"))


def coverage(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Each labelled region with the share of its area that detections cover together."""
    t = truth.select("image_id", "pos", "box")
    d = found.select(F.col("image_id").alias("found_image"), F.col("box").alias("found_box"))
    meets = B.intersection(F.col("box"), F.col("found_box")) > 0
    parts = t.join(d, (F.col("image_id") == F.col("found_image")) & meets, "left").groupBy("image_id", "pos").agg(F.first("box").alias("box"), F.collect_list(clipped(F.col("box"), F.col("found_box"))).alias("rects"))
    share = F.when(B.area(F.col("box")) > 0, union_area(F.col("rects")) / B.area(F.col("box"))).otherwise(F.lit(0.0))
    return parts.select("image_id", "pos", share.alias("share"), (share >= COVERED).alias("covered"))


def per_image(truth: DataFrame, found: DataFrame, matches: DataFrame) -> DataFrame:
    """Counts and sums by image; ratios follow from them. Text accuracy is one less the share of edits."""
    t, d = truth.groupBy("image_id").agg(F.count("*").alias("truths")), found.groupBy("image_id").agg(F.count("*").alias("founds"))
    m = matches.groupBy("image_id").agg(F.count("*").alias("matched"), F.sum("iou").alias("iou_sum"), F.sum(T.text_accuracy(F.col("truth_text"), F.col("found_text"))).alias("accuracy_sum"))
    both = t.join(d, "image_id", "full_outer").join(m, "image_id", "left")
    return both.na.fill(0, ["truths", "founds", "matched"]).na.fill(0.0, ["iou_sum", "accuracy_sum"])


def averages(rows: DataFrame, *by: str) -> DataFrame:
    """Recall, precision and means over all matches of all images (not means of the images' means); null over nothing."""
    total = lambda c: F.sum(c)
    return rows.groupBy(*by).agg(
        total("truths").alias("truths"), total("founds").alias("founds"), total("matched").alias("matched"),
        F.try_divide(total("matched"), total("truths")).alias("recall"), F.try_divide(total("matched"), total("founds")).alias("precision"),
        F.try_divide(total("iou_sum"), total("matched")).alias("mean_iou"), F.try_divide(total("accuracy_sum"), total("matched")).alias("mean_text_accuracy"),
    )


def replayed(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled regions as detections, for images (image_id, content) whose bytes have the label's digest.

    labels: digest (sha256, hex), pos, box, text.
    """
    return images.withColumn("digest", F.sha2("content", 256)).drop("content").join(labels, "digest").drop("digest").withColumn("confidence", F.lit(1.0))
