"""Rectangle expressions over columns. A box is a struct of x, y, w, h."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from segloom.functions.text import WHITE_SPACE


def box(x, y, w, h) -> Column:
    return F.struct(*[F.col(c).alias(n) if isinstance(c, str) else c.alias(n) for n, c in zip("xywh", (x, y, w, h), strict=True)])


def area(b: Column) -> Column:
    return F.greatest(F.lit(0), b["w"]) * F.greatest(F.lit(0), b["h"])


def _overlap(a: Column, b: Column, at: str, size: str) -> Column:
    return F.greatest(F.lit(0), F.least(a[at] + a[size], b[at] + b[size]) - F.greatest(a[at], b[at]))


def intersection(a: Column, b: Column) -> Column:
    return _overlap(a, b, "x", "w") * _overlap(a, b, "y", "h")


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where either is 0."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """The share of the smaller box that the other covers."""
    smaller = F.least(area(a), area(b))
    return F.when(smaller > 0, intersection(a, b) / smaller).otherwise(F.lit(0.0))


def should_merge(a: Column, b: Column) -> Column:
    return (iou(a, b) > 0.5) | (containment(a, b) >= 0.8)


def union(a: Column, b: Column) -> Column:
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    return box(x, y, F.greatest(a["x"] + a["w"], b["x"] + b["w"]) - x, F.greatest(a["y"] + a["h"], b["y"] + b["h"]) - y)


def reads_before(a: Column, b: Column) -> Column:
    """Left to right within a band, else top to bottom."""
    together = (a["y"] < b["y"] + b["h"]) & (b["y"] < a["y"] + a["h"])
    return F.when(together, a["x"] <= b["x"]).otherwise(a["y"] <= b["y"])


def dilated(b: Column, width: Column, height: Column, by: int = 2) -> Column:
    """Grown on all sides and cut to the image; w or h is 0 or less where nothing is left."""
    x, y = F.greatest(F.lit(0), b["x"] - by), F.greatest(F.lit(0), b["y"] - by)
    return box(x, y, F.least(width, b["x"] + b["w"] + by) - x, F.least(height, b["y"] + b["h"] + by) - y)


def from_clockwise(b: Column, height: Column) -> Column:
    """A box found in the image turned clockwise, in the original."""
    return box(b["y"], height - b["x"] - b["w"], b["h"], b["w"])


def from_counterclockwise(b: Column, width: Column) -> Column:
    return box(width - b["y"] - b["h"], b["x"], b["h"], b["w"])


def aspect(b: Column) -> Column:
    return F.greatest(b["w"], b["h"]) / F.greatest(F.lit(1), F.least(b["w"], b["h"]))


def skewed(points: Column, degrees: float = 5.0) -> Column:
    """Whether the first edge of a polygon leans more than so many degrees."""
    dx, dy = points[1]["x"] - points[0]["x"], points[1]["y"] - points[0]["y"]
    return F.degrees(F.atan2(F.abs(dy), F.abs(dx))) > degrees


def bounding(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    x, y = F.array_min(xs), F.array_min(ys)
    return box(x, y, F.array_max(xs) - x, F.array_max(ys) - y)


def vertical_shape(b: Column, text: Column) -> Column:
    """At least three characters in a box half as high again as wide."""
    return (F.length(F.regexp_replace(text, f"[{WHITE_SPACE}]", "")) >= 3) & (b["h"] / F.greatest(F.lit(1), b["w"]) >= 1.5)


def sizing_axes(b: Column, ink: Column, rotation: Column) -> Column:
    """Ink height, and the width and height to fit into; turned by a quarter, width and height change places."""
    ink, turned = F.coalesce(ink, b), F.abs(F.coalesce(rotation, F.lit(0))) == 90
    pick = lambda a, c: F.when(turned, a).otherwise(c)
    return F.struct(pick(ink["w"], ink["h"]).alias("ink_height"), pick(b["h"], b["w"]).alias("fit_width"), pick(b["w"], b["h"]).alias("fit_height_floor"))


def whole_pixels(b: Column, width: Column, height: Column) -> Column:
    """The whole pixels that a box touches within the image."""
    x, y = F.greatest(F.lit(0), F.floor(b["x"])), F.greatest(F.lit(0), F.floor(b["y"]))
    return box(x, y, F.greatest(F.lit(0), F.least(width, F.ceil(b["x"] + b["w"])) - x), F.greatest(F.lit(0), F.least(height, F.ceil(b["y"] + b["h"])) - y))
