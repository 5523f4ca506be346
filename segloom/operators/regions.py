"""Text regions of images: validation, merging, reading order, rotated passes, duplicate readings.

A region has image_id, pos (order within the image), box, ink (box or null), text, confidence, rotated, rotation.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from segloom.functions import boxes as B
from segloom.functions import text as T
from segloom.functions.text import stripped
from segloom.operators.ordered import through

# Limits that results depend on.
LEAST_WIDTH, LEAST_HEIGHT, LEAST_CHARACTERS = 8, 4, 2
CONFIDENCE_FLOOR, DILATION = 0.6, 2
MERGE_IOU, MERGE_CONTAINMENT = 0.5, 0.8
ROTATION_IOU, SWALLOWED, CONTAINED, CROSSED, ORPHAN_ASPECT, AMBIGUOUS = 0.3, 0.5, 0.6, 3, 2.0, 0.1


def filtered(regions: DataFrame) -> DataFrame:
    """Regions large enough, with trimmed text of at least two letters or digits."""
    sized = regions.where((F.col("box.w") > 0) & (F.col("box.h") > 0) & (F.col("box.w") >= LEAST_WIDTH) & (F.col("box.h") >= LEAST_HEIGHT))
    return sized.withColumn("text", T.trimmed(F.col("text"))).where((F.col("text") != "") & (T.letters_and_digits(F.col("text")) >= LEAST_CHARACTERS))


def skip_reason(confidence: Column, rotated: Column, rotation: Column) -> Column:
    """Why a region can't be painted; null if it can."""
    unsure = F.when(confidence < CONFIDENCE_FLOOR, F.lit("low-confidence region"))
    return unsure.when(F.coalesce(rotated, F.lit(False)) & F.coalesce(rotation, F.lit(0)).eqNullSafe(0), F.lit("rotated region"))


class Rect:
    """A box in plain code, for the operators whose result depends on the order of their steps."""

    __slots__ = ("x", "y", "w", "h")

    def __init__(self, b: dict):
        self.x, self.y, self.w, self.h = b["x"], b["y"], b["w"], b["h"]

    def size(self) -> float:
        return max(0, self.w) * max(0, self.h)

    def shared(self, o: Rect) -> float:
        return max(0, min(self.x + self.w, o.x + o.w) - max(self.x, o.x)) * max(0, min(self.y + self.h, o.y + o.h) - max(self.y, o.y))

    def iou(self, o: Rect) -> float:
        shared = self.shared(o)
        joint = self.size() + o.size() - shared
        return shared / joint if shared > 0 and joint > 0 else 0.0

    def covered(self, o: Rect) -> float:
        smaller = min(self.size(), o.size())
        return self.shared(o) / smaller if smaller > 0 else 0.0

    def same_spot(self, o: Rect, iou: float, share: float) -> bool:
        return self.iou(o) > iou or self.covered(o) >= share

    def around(self, o: Rect) -> Rect:
        x, y = min(self.x, o.x), min(self.y, o.y)
        return Rect({"x": x, "y": y, "w": max(self.x + self.w, o.x + o.w) - x, "h": max(self.y + self.h, o.y + o.h) - y})

    def before(self, o: Rect) -> bool:
        band = self.y < o.y + o.h and o.y < self.y + self.h
        return self.x <= o.x if band else self.y <= o.y

    def row(self) -> dict:
        return {"x": self.x, "y": self.y, "w": self.w, "h": self.h}


def _joined(a: dict, b: dict) -> dict:
    one, two = Rect(a["box"]), Rect(b["box"])
    first, second = (a, b) if one.before(two) else (b, a)
    agree = (a["rotation"], bool(a["rotated"])) == (b["rotation"], bool(b["rotated"]))
    larger = a if one.size() >= two.size() else b
    ink = Rect(a["ink"] or a["box"]).around(Rect(b["ink"] or b["box"])).row() if a["ink"] or b["ink"] else None
    return first | {
        "box": one.around(two).row(), "ink": ink, "text": f"{first['text']} {second['text']}", "confidence": min(a["confidence"], b["confidence"]),
        "rotated": (True if a["rotated"] else a["rotated"]) if agree else larger["rotated"], "rotation": a["rotation"] if agree else larger["rotation"],
    }


def merged_rows(rows: list[dict]) -> list[dict]:
    """Merge the first pair that overlaps enough, in place of its first row, until no pair does.

    A pair whose rows haven't changed since they were compared isn't compared again.
    """
    rows, apart = list(rows), set()
    tags = list(range(len(rows)))
    fresh = len(rows)
    while True:
        found = None
        for i in range(len(rows)):
            for j in range(i + 1, len(rows)):
                if (tags[i], tags[j]) in apart:
                    continue
                if Rect(rows[i]["box"]).same_spot(Rect(rows[j]["box"]), MERGE_IOU, MERGE_CONTAINMENT):
                    found = i, j
                    break
                apart.add((tags[i], tags[j]))
            if found:
                break
        if not found:
            return rows
        i, j = found
        rows[i], tags[i] = _joined(rows[i], rows[j]), fresh
        fresh += 1
        del rows[j], tags[j]


def merged(regions: DataFrame) -> DataFrame:
    """Regions merged within each image; pos numbers what is left from 0, in the old order."""

    def step(rows: Iterator[dict]) -> Iterator[dict]:
        for k, row in enumerate(merged_rows(list(rows))):
            yield row | {"pos": k}

    return through(regions, ["image_id"], ["pos"], step, StructType(list(regions.schema)))


def in_reading_order(regions: DataFrame) -> DataFrame:
    """regions with band and order (both from 1): bands from top to bottom, left to right within a band.

    A band goes on while a region begins above the lowest edge that the band has reached.
    """
    down = Window.partitionBy("image_id").orderBy("box.y", "pos")
    reach = F.max(F.col("box.y") + F.col("box.h")).over(down.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.coalesce(F.col("box.y") >= reach, F.lit(True)), 1).otherwise(0)
    banded = regions.withColumn("begins", begins).withColumn("band", F.sum("begins").over(down).cast("int")).drop("begins")
    return banded.withColumn("order", F.row_number().over(Window.partitionBy("image_id").orderBy("band", "box.x", "box.y", "pos")))


def validated(regions: DataFrame, images: DataFrame) -> DataFrame:
    """Filtered, merged and ordered regions, grown by two pixels within their image and numbered r1, r2 and so on.

    images: image_id, width, height. The ink box stays what it was, or is the box before it grew.
    """
    ordered = in_reading_order(merged(filtered(regions))).join(images, "image_id")
    grown = ordered.withColumns({"ink": F.coalesce("ink", "box"), "box": B.dilated(F.col("box"), F.col("width"), F.col("height"), DILATION)}).where("box.w > 0 and box.h > 0")
    return grown.withColumn("id", F.concat(F.lit("r"), F.row_number().over(Window.partitionBy("image_id").orderBy("order")).cast("string")))


def _beside(candidates: DataFrame, normals: DataFrame) -> DataFrame:
    """Candidates with the normal regions of their image that they touch."""
    n = normals.select(F.col("image_id").alias("normal_image"), F.col("box").alias("normal"), F.col("text").alias("normal_text"), F.col("pos").alias("normal_pos"))
    return candidates.join(n, (F.col("image_id") == F.col("normal_image")) & (B.intersection(F.col("box"), F.col("normal")) > 0)).drop("normal_image")


def rotation_kept(candidates: DataFrame, clean: DataFrame, flagged: DataFrame) -> DataFrame:
    """Regions of turned passes that no upright region speaks against.

    Killed by an overlap with a clean one (IoU, or a share of either), or by crossing several. One that touches no
    clean region needs a flagged one below it, or a long shape.
    """
    shared = B.intersection(F.col("box"), F.col("normal"))
    area = lambda b: F.greatest(F.lit(1), b["w"] * b["h"])
    against = _beside(candidates, clean).groupBy("image_id", "pos").agg(
        F.max(B.iou(F.col("box"), F.col("normal"))).alias("iou"), F.max(shared / area(F.col("normal"))).alias("swallowed"),
        F.max(shared / area(F.col("box"))).alias("contained"), F.count("*").alias("crossed"),
    )
    backed = _beside(candidates, flagged).select("image_id", "pos", F.lit(True).alias("backed")).distinct()
    both = candidates.join(against, ["image_id", "pos"], "left").join(backed, ["image_id", "pos"], "left")
    spared = (F.col("iou") <= ROTATION_IOU) & (F.col("swallowed") < SWALLOWED) & (F.col("contained") < CONTAINED) & (F.col("crossed") < CROSSED)
    lone = F.coalesce("backed", F.lit(False)) | (B.aspect(F.col("box")) >= ORPHAN_ASPECT)
    return both.where(F.when(F.col("crossed").isNull(), lone).otherwise(spared)).select(*candidates.columns)


def rotated_rows(rows: list[dict]) -> list[dict]:
    """Of the first pair that overlaps, drop the one of lower confidence, or both where the texts differ and neither is surer; again until none does."""
    rows, i = list(rows), 0
    while i < len(rows):
        j = next((j for j in range(i + 1, len(rows)) if Rect(rows[i]["box"]).iou(Rect(rows[j]["box"])) > ROTATION_IOU), None)
        if j is None:
            i += 1
            continue
        a, b = rows[i], rows[j]
        unsure = stripped(a["text"]) != stripped(b["text"]) and abs(a["confidence"] - b["confidence"]) < AMBIGUOUS
        gone = {i, j} if unsure else {j if a["confidence"] >= b["confidence"] else i}
        rows = [r for k, r in enumerate(rows) if k not in gone]
        # Rows before i are apart from all that are left, so nothing before i can be found now.
    return rows


def rotated_dedup(regions: DataFrame) -> DataFrame:
    return through(regions, ["image_id"], ["pos"], lambda rows: rotated_rows(list(rows)), StructType(list(regions.schema)))


def voted_rows(rows: list[dict]) -> list[dict]:
    """Of two readings of one spot, the surer stays; a dropped row drops no others."""
    gone: set[int] = set()
    spots = [Rect(r["ink"] or r["box"]) for r in rows]
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            if i in gone:
                break
            if j not in gone and spots[i].same_spot(spots[j], MERGE_IOU, MERGE_CONTAINMENT):
                gone.add(j if rows[i]["confidence"] >= rows[j]["confidence"] else i)
    return [r for k, r in enumerate(rows) if k not in gone]


def double_votes_resolved(regions: DataFrame) -> DataFrame:
    return through(regions, ["image_id"], ["pos"], lambda rows: voted_rows(list(rows)), StructType(list(regions.schema)))


def with_rotation_passes(normal: DataFrame, clockwise: DataFrame, counterclockwise: DataFrame, images: DataFrame) -> DataFrame:
    """Clean regions, then flagged ones that nothing replaces, then what the turned passes add.

    clockwise and counterclockwise hold boxes of the turned images; images: image_id, width, height.
    """
    from_turned = []
    for k, (found, angle) in enumerate(((clockwise, -90), (counterclockwise, 90))):
        back = (lambda b: B.from_clockwise(b, F.col("height"))) if angle < 0 else (lambda b: B.from_counterclockwise(b, F.col("width")))
        own = found.join(images, "image_id").withColumns({"box": back(F.col("box")), "ink": F.when(F.col("ink").isNotNull(), back(F.col("ink"))), "rotation": F.lit(angle), "rotated": F.lit(None).cast("boolean")})
        from_turned.append(own.withColumn("pos", F.col("pos") + F.lit(k) * F.lit(1 << 30)).select(*normal.columns))
    candidates = from_turned[0].unionByName(from_turned[1])
    is_flagged = F.coalesce("rotated", F.lit(False))
    clean, flagged = normal.where(~is_flagged), normal.where(is_flagged)
    survivors = rotated_dedup(rotation_kept(candidates, clean, flagged))
    over = _beside(survivors, flagged).where(B.iou(F.col("box"), F.col("normal")) > ROTATION_IOU)
    vetoed = over.where(T.trimmed(F.col("normal_text")) == T.trimmed(F.col("text"))).select("image_id", "pos")
    survivors = survivors.join(vetoed, ["image_id", "pos"], "left_anti")
    replaced = over.join(vetoed, ["image_id", "pos"], "left_anti").select("image_id", F.col("normal_pos").alias("pos"))
    left = flagged.join(replaced, ["image_id", "pos"], "left_anti")
    parts = [p.withColumn("part", F.lit(k)) for k, p in enumerate((clean, left, survivors))]
    every = parts[0].unionByName(parts[1].select(*parts[0].columns)).unionByName(parts[2].select(*parts[0].columns))
    return every.withColumn("pos", F.row_number().over(Window.partitionBy("image_id").orderBy("part", "pos")) - 1).drop("part")
