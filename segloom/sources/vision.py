"""Regions out of the answers of vision models, which keep to no one format.

Answers are JSON, maybe in a code fence: regions or a bare list, boxes as objects or corners, texts under several names,
on a scale of 0 to 1000.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from segloom.operators.ordered import out_batches, rows_of
from segloom.operators.regions import Rect
from segloom.shipping import ship

# Names under which models give boxes and texts, and the scale.
BOX_NAMES, TEXT_NAMES, SCALE = ("bbox", "bbox_2d", "box"), ("text", "text_content", "content", "label"), 1000


def _number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def answered(content: str) -> list[dict]:
    """box and text of each region; ValueError where there are none to be found."""
    fence = re.search(r"```(?:json)?\s*(.*?)\s*```", content, re.DOTALL)
    data = json.loads(fence[1] if fence else content)
    items = data if isinstance(data, list) else data.get("regions") if isinstance(data, dict) else None
    if not isinstance(items, list):
        raise ValueError("no list of regions in the answer")
    out = []
    for k, item in enumerate(items):
        box = next((item[n] for n in BOX_NAMES if item.get(n) is not None), None)
        text = next((item[n] for n in TEXT_NAMES if item.get(n) is not None), None)
        if isinstance(box, list) and len(box) == 4 and all(map(_number, box)):
            box = {"x": box[0], "y": box[1], "w": box[2] - box[0], "h": box[3] - box[1]}
        if not isinstance(box, dict) or not all(_number(box.get(n)) for n in "xywh"):
            raise ValueError(f"region {k} has no box")
        if not isinstance(text, str):
            raise ValueError(f"region {k} has no text")
        out.append({"box": {n: float(box[n]) for n in "xywh"}, "text": text})
    return out


def crowding(regions: list[dict]) -> float:
    """How much regions overlap, over all pairs of one image's."""
    boxes = [Rect(r["box"]) for r in regions]
    return sum(a.iou(b) for k, a in enumerate(boxes) for b in boxes[k + 1 :])


def settled_boxes(regions: list[dict]) -> list[dict]:
    """Boxes whose width and height are in truth the far corner, where that reading holds and overlaps less."""
    if len(regions) < 2:
        return regions
    corners = [r | {"box": r["box"] | {"w": r["box"]["w"] - r["box"]["x"], "h": r["box"]["h"] - r["box"]["y"]}} for r in regions]
    sound = all(r["box"]["w"] > 0 and r["box"]["h"] > 0 for r in corners)
    return corners if sound and crowding(corners) < crowding(regions) else regions


def regions(answers: DataFrame) -> DataFrame:
    """answers (image_id, width, height, content) as regions in pixels; an answer that can't be read is a row with error."""
    ship(answers.sparkSession)
    box = pa.struct([(n, pa.float64()) for n in "xywh"])
    schema = pa.schema([("image_id", pa.string()), ("pos", pa.int32()), ("box", box), ("text", pa.string()), ("confidence", pa.float64()), ("error", pa.string())])

    def of(row: dict) -> Iterator[dict]:
        try:
            found = settled_boxes(answered(row["content"] or ""))
        except (ValueError, AttributeError) as e:
            yield {"image_id": row["image_id"], "error": str(e)}
            return
        for k, r in enumerate(found):
            b, w, h = r["box"], row["width"] / SCALE, row["height"] / SCALE
            yield {"image_id": row["image_id"], "pos": k, "box": {"x": b["x"] * w, "y": b["y"] * h, "w": b["w"] * w, "h": b["h"] * h}, "text": r["text"], "confidence": 1.0}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from out_batches((r for row in rows_of(batches) for r in of(row)), schema)

    kind = "image_id string, pos int, box struct<x: double, y: double, w: double, h: double>, text string, confidence double, error string"
    return answers.select("image_id", "width", "height", "content").mapInArrow(run, kind)
