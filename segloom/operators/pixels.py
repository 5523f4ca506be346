"""Pixels of text regions: ink profiles, gridlines, bands, splitting of cells, colours, painting, and PNG output.

Pixels are numpy arrays of height, width and channels (red, green, blue). Images go through Spark as rows of the
image data source (origin, height, width, nChannels, data as BGR).
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from segloom.functions.text import split_at_space, stripped
from segloom.operators.layout import HalfEm, dealt_tokens, ink_matched
from segloom.operators.ordered import out_batches, rows_of
from segloom.operators.regions import voted_rows
from segloom.shipping import ship

# Limits that results depend on.
INK, GRID_COVERAGE, GRID_EDGE, GRID_RUN = 50, 0.85, 0.1, 4
VALLEY, VALLEY_HEIGHTS, GRID_VALLEY, GRID_VALLEY_HEIGHTS, EMPTY = 14, 2, 6, 0.5, 0.06
SPLIT_ASPECT, ROW_EMPTY, BAND_GAP, BAND_LEAST, BAND_SHARE = 2, 0.01, 2, 4, 0.7
SEARCH, SEARCH_MOST, DROP_SPANS, DROP_WIDTH, CANNOT_FIT = 0.75, 14, 3, 8, 2
RING, COLOUR_FLOOR, LIGHT, COLOUR_STEPS = 3, 40, 140, 10
LINE_HEIGHT = 1.2
WEIGHTS = np.array([0.299, 0.587, 0.114])


def luminance(pixels: np.ndarray) -> np.ndarray:
    return pixels[..., :3] @ WEIGHTS


def background(light: np.ndarray) -> float:
    """The upper median along the border."""
    edge = np.concatenate([light[0], light[-1], light[1:-1, 0], light[1:-1, -1]]) if light.size else np.zeros(0)
    return float(np.sort(edge)[len(edge) // 2]) if len(edge) else 255.0


def profile(light: np.ndarray, ground: float) -> tuple[np.ndarray, np.ndarray]:
    """Ink in each column, and which columns have ink at the top and at the bottom."""
    ink = np.abs(light - ground) > INK
    edge = max(1, int(len(light) * GRID_EDGE))
    return ink.sum(axis=0), ink[:edge].any(axis=0) & ink[-edge:].any(axis=0)


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of true values, as start and end."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], np.asarray(flags).astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def gridlines(counts: np.ndarray, through: np.ndarray, height: int) -> np.ndarray:
    """Columns of narrow lines from top to bottom."""
    out = np.zeros(len(counts), bool)
    for lo, hi in runs(through & (counts >= GRID_COVERAGE * height)):
        if hi - lo <= GRID_RUN:
            out[lo:hi] = True
    return out


def _rounded(x: float) -> int:
    return math.floor(x + 0.5)


def ink_spans(counts: np.ndarray, height: int, erased: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of ink, parted by valleys; a valley with an erased line may be narrower."""
    ink = counts > max(1, _rounded(height * EMPTY))
    if not ink.any():
        return []
    first, last = int(ink.argmax()), len(ink) - int(ink[::-1].argmax())
    out, start = [], first
    for lo, hi in runs(~ink):
        if lo < first or hi > last:
            continue
        least = max(GRID_VALLEY, height * GRID_VALLEY_HEIGHTS) if erased[lo:hi].any() else max(VALLEY, height * VALLEY_HEIGHTS)
        if hi - lo >= least:
            out.append((start, lo))
            start = hi
    return [*out, (start, last)]


def row_bands(counts: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Stretches of rows with ink, over gaps of two rows, with their ink."""
    bands: list[list[int]] = []
    for lo, hi in runs(counts > max(1, _rounded(width * ROW_EMPTY))):
        if bands and lo - bands[-1][1] <= BAND_GAP:
            bands[-1][1] = hi
        else:
            bands.append([lo, hi])
    return [(lo, hi, int(counts[lo:hi].sum())) for lo, hi in bands]


def dominant(bands: list[tuple[int, int, int]]) -> int | None:
    """The number of the only band, or of the one with most of the ink, if any has."""
    if len(bands) <= 1:
        return 0 if bands else None
    ink = [b[2] for b in bands]
    most = int(np.argmax(ink))
    return most if ink[most] >= sum(ink) * BAND_SHARE else None


def row_band(light: np.ndarray, ground: float) -> tuple[int, int] | None:
    """The rows with ink that count as the text's."""
    counts, through = profile(light.T, ground)
    bands = row_bands(np.where(gridlines(counts, through, light.shape[1]), 0, counts), light.shape[1])
    found = dominant(bands)
    return bands[found][:2] if found is not None else None


def of_profiles(profiles: DataFrame, size: int, kind: str) -> DataFrame:
    """profiles (image, counts, flags: an entry for each column or row) as the gridlines, spans or bands in them.

    size is the height that columns have, or the width of rows. flags are columns that go from top to bottom (gridlines)
    or were erased (spans). A profile is as long as its picture.
    """
    ship(profiles.sparkSession)
    schema = pa.schema([("image", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("ink", pa.int64()), ("dominant", pa.bool_())])

    def of(row: dict) -> Iterator[dict]:
        counts, flags = np.array(row["counts"], np.int64), np.array(row["flags"], bool)
        if kind == "gridlines":
            found = [(*r, None) for r in runs(gridlines(counts, flags, size))]
        elif kind == "spans":
            found = [(*r, None) for r in ink_spans(counts, size, flags)]
        else:
            bands = row_bands(counts, size)
            best = dominant(bands)
            found = [(lo, hi, k == best) for k, (lo, hi, _) in enumerate(bands)]
        for lo, hi, best in found:
            yield {"image": row["image"], "lo": lo, "hi": hi, "ink": int(counts[lo:hi].sum()), "dominant": best}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from out_batches((out for row in rows_of(batches) for out in of(row)), schema)

    return profiles.select(F.col("image").cast("long").alias("image"), "counts", "flags").mapInArrow(run, "image long, lo int, hi int, ink long, dominant boolean")


def _inside(b: dict, light: np.ndarray) -> tuple[int, int, int, int]:
    h, w = light.shape
    return max(0, math.floor(b["x"])), max(0, math.floor(b["y"])), min(w, math.ceil(b["x"] + b["w"])), min(h, math.ceil(b["y"] + b["h"]))


def tightened(region: dict, light: np.ndarray) -> tuple[dict, float | None]:
    """The region with the band of its ink, looked for somewhat above and below; its box only grows."""
    x0, y0, x1, y1 = _inside(region["box"], light)
    if x1 <= x0 or y1 <= y0:
        return region, None
    more = min(SEARCH_MOST, math.ceil((y1 - y0) * SEARCH) + 2)
    top, end = max(0, y0 - more), min(light.shape[0], y1 + more)
    part = light[top:end, x0:x1]
    ground = background(part)
    band = row_band(part, ground)
    if band is None or not BAND_LEAST <= band[1] - band[0] < end - top:
        return region, ground
    b, y, h = region["box"], top + band[0], band[1] - band[0]
    upper, lower = min(b["y"], y), max(b["y"] + b["h"], y + h)
    return region | {"box": b | {"y": upper, "h": lower - upper}, "ink": {"x": b["x"], "y": y, "w": b["w"], "h": h}}, ground


def cannot_fit(region: dict, measure: HalfEm) -> bool:
    """Whether the text, as high as its ink, is more than twice as wide as its box."""
    text = stripped(region["text"])
    height = (region["ink"] or region["box"])["h"]
    return bool(text) and measure.width(text) * ink_matched(text, height, measure) > region["box"]["w"] * CANNOT_FIT


def split(region: dict, light: np.ndarray, ground: float, measure: HalfEm) -> list[dict]:
    """A region of several cells, one for each stretch of ink; none where the tokens can't be dealt to many."""
    x0, y0, x1, y1 = _inside(region["box"], light)
    band = region["ink"]
    upper = max(y0, math.floor(band["y"])) if band else y0
    height = (min(y1, math.ceil(band["y"] + band["h"])) if band else y1) - upper
    tokens = split_at_space(region["text"])
    if y1 <= y0 or height <= 0 or x1 - x0 < SPLIT_ASPECT * height or len(tokens) < 2:
        return [region]
    counts, _ = profile(light[upper : upper + height, x0:x1], ground)
    erased = np.zeros(x1 - x0, bool)
    if not any(re.fullmatch(r"[1Iil|!()\[\]]+", t) for t in tokens):
        erased = gridlines(*profile(light[y0:y1, x0:x1], ground), y1 - y0)
    spans = ink_spans(np.where(erased, 0, counts), height, erased)
    if len(spans) < 2:
        return [region]
    dealt = dealt_tokens([measure.width(t) for t in tokens], measure.width(" "), [hi - lo for lo, hi in spans])
    if dealt is None:
        return [] if sum(hi - lo >= DROP_WIDTH for lo, hi in spans) >= DROP_SPANS else [region]
    out, at = [], 0
    for k, ((lo, hi), n) in enumerate(zip(spans, dealt, strict=True)):
        own = row_band(light[y0:y1, x0 + lo : x0 + hi], ground)
        ink = {"x": x0 + lo, "y": y0 + own[0], "w": hi - lo, "h": own[1] - own[0]} if own else {"x": x0 + lo, "y": band["y"], "w": hi - lo, "h": band["h"]} if band else None
        out.append(region | {"id": f"{region.get('id')}c{k + 1}", "box": region["box"] | {"x": x0 + lo, "w": hi - lo}, "text": " ".join(tokens[at : at + n]), "ink": ink})
        at += n
    return out


def cells(regions: list[dict], pixels: np.ndarray, measure: HalfEm | None = None) -> list[dict]:
    """Regions of one image, upright ones tightened, rid of readings that can't be there, and split into cells."""
    measure, light = measure or HalfEm(), luminance(pixels.astype(np.float64))
    turned = [r for r in regions if r.get("rotation") or r.get("rotated")]
    upright = [tightened(r, light) for r in regions if not (r.get("rotation") or r.get("rotated"))]
    upright = [(r, g) for r, g in upright if not cannot_fit(r, measure)]
    grounds = {id(r): g for r, g in upright}
    out = list(turned)
    for r in voted_rows([r for r, _ in upright]):
        out += split(r, light, grounds[id(r)], measure) if grounds[id(r)] is not None else [r]
    return out


def fill_colour(pixels: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    """The median colour of a ring around a box; grey where there is none."""
    x0, y0, x1, y1 = max(0, x - RING), max(0, y - RING), min(pixels.shape[1], x + w + RING), min(pixels.shape[0], y + h + RING)
    ring = np.ones((max(0, y1 - y0), max(0, x1 - x0)), bool)
    ring[max(0, y - y0) : max(0, y + h - y0), max(0, x - x0) : max(0, x + w - x0)] = False
    found = pixels[y0:y1, x0:x1][ring] if ring.size else np.zeros((0, 3))
    return np.median(found.astype(np.float64), axis=0) if len(found) else np.full(3, 128.0)


def text_colour(inside: np.ndarray, fill: np.ndarray) -> np.ndarray:
    """Of two clusters of colours, the one farther from the fill; black or white where nothing stands out."""
    away = np.sqrt(((inside - fill) ** 2).sum(axis=1))
    if not len(inside) or away.max() < COLOUR_FLOOR:
        return np.zeros(3) if fill @ WEIGHTS >= LIGHT else np.full(3, 255.0)
    near, far = fill.astype(np.float64), inside[int(away.argmax())].astype(np.float64)
    for _ in range(COLOUR_STEPS):
        own = ((inside - near) ** 2).sum(axis=1) <= ((inside - far) ** 2).sum(axis=1)
        now = inside[own].mean(axis=0) if own.any() else near, inside[~own].mean(axis=0) if (~own).any() else far
        rest = (now[0] == near).all() and (now[1] == far).all()
        near, far = now
        if rest:
            break
    return far if ((far - fill) ** 2).sum() >= ((near - fill) ** 2).sum() else near


def png(pixels: np.ndarray) -> bytes:
    """An RGB image as a PNG file."""
    h, w, _ = pixels.shape
    raw = np.zeros((h, 1 + 3 * w), np.uint8)
    raw[:, 1:] = pixels.reshape(h, 3 * w)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw.tobytes(), 6)) + part(b"IEND", b"")


def painted(pixels: np.ndarray, boxes: list[dict]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Pixels with the boxes filled by their surroundings, and the colour that text in each should have."""
    out, colours = pixels.copy(), []
    for b in boxes:
        x, y = max(0, math.floor(b["x"])), max(0, math.floor(b["y"]))
        w, h = max(0, min(pixels.shape[1], math.ceil(b["x"] + b["w"])) - x), max(0, min(pixels.shape[0], math.ceil(b["y"] + b["h"])) - y)
        fill = fill_colour(out, x, y, w, h)
        colours.append(text_colour(out[y : y + h, x : x + w].reshape(-1, 3).astype(np.float64), fill))
        out[y : y + h, x : x + w] = np.clip(np.floor(fill + 0.5), 0, 255)
    return out, colours


def line_places(paint: dict, shape: tuple[int, ...]) -> list[dict]:
    """Where each line's upper left corner is: lines stand in the middle of their box, from its left edge on.

    A turned text's box is turned about its centre, so its lines run along the height. Angles go clockwise.
    """
    b, size, lines, angle = paint["box"], paint["size"], paint["lines"], paint["rotation"] or 0
    left, top = max(0, math.floor(b["x"])), max(0, math.floor(b["y"]))
    w, h = min(shape[1], math.ceil(b["x"] + b["w"])) - left, min(shape[0], math.ceil(b["y"] + b["h"])) - top
    if w <= 0 or h <= 0:
        return []
    run = h if angle else w
    out = []
    for k, text in enumerate(lines):
        # from the centre of the box, along the text and across it
        along, across = -run / 2, (k - len(lines) / 2) * size * LINE_HEIGHT
        dx, dy = {0: (along, across), 90: (-across, along), -90: (across, -along)}[angle]
        out.append({"text": text, "x": left + w / 2 + dx, "y": top + h / 2 + dy, "size": size, "angle": angle})
    return out


def pixels_of(row: dict) -> np.ndarray:
    """Red, green and blue of a row of the image source."""
    channels = row["nChannels"]
    data = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], channels)
    return np.repeat(data, 3, axis=2) if channels == 1 else data[:, :, [2, 1, 0]]


def overlays(images: DataFrame) -> DataFrame:
    """images (image_id, height, width, nChannels, data, boxes) as image_id and png, with the boxes filled."""
    ship(images.sparkSession)
    schema = pa.schema([("image_id", pa.string()), ("png", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # few images in a batch at a time
            yield from out_batches(({"image_id": r["image_id"], "png": png(painted(pixels_of(r), r["boxes"] or [])[0])} for r in rows_of([batch])), schema)

    return images.mapInArrow(run, "image_id string, png binary")


def cell_rows(images: DataFrame, schema) -> DataFrame:
    """images (image_id, height, width, nChannels, data, regions) as one row for each cell that the regions split into."""
    ship(images.sparkSession)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from out_batches(({"image_id": r["image_id"], "pos": k} | c for r in rows_of(batches) for k, c in enumerate(cells(r["regions"] or [], pixels_of(r)))), arrow)

    return images.mapInArrow(run, schema)


def turned(pixels: np.ndarray, clockwise: bool) -> np.ndarray:
    """An image turned by a quarter."""
    return np.rot90(pixels, -1 if clockwise else 1)
