from __future__ import annotations

import io
import zipfile

import numpy as np
import pytest
from deck_builder import deck, picture, rels, shape, tree
from pyspark.sql import functions as F

from segloom.operators import layout
from segloom.operators.jpeg import jpeg
from segloom.operators.pixels import line_places, pixels_of, png
from segloom.sources import decks as D
from segloom.sources import documents as J
from segloom.sources import pictures as P


def drawn(h, w, x, y, bw, bh):
    """White, with a dark box."""
    out = np.full((h, w, 3), 255, np.uint8)
    out[y : y + bh, x : x + bw] = (20, 30, 120)
    return out


def engine_factory():
    """Functions made here travel to workers whole, as they can't import this module."""

    def factory():
        def around(x, y, w, h):
            return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]

        def engine(content):
            if b"engine fails" in content:
                raise RuntimeError("no")
            lines = [((10, 10, 60, 16), "Hello", 0.9), ((10, 60, 60, 16), "质量报告", 0.9), ((100, 60, 60, 16), "Unsure", 0.3), ((100, 10, 60, 16), "Kept", 0.9)]
            return [{"points": around(*box), "text": text, "confidence": sure} for box, text, sure in lines]

        return engine

    return factory


PNG, JPG = png(drawn(100, 200, 12, 12, 50, 12)), jpeg(drawn(100, 200, 12, 12, 50, 12))


def mixed() -> bytes:
    slide = tree(shape("S", ["Text"]) + "".join(picture(f"P{k}", f"rId{k}") for k in range(1, 8)))
    targets = ("a/pic.png", "b/pic.png", "a/photo.jpg", "a/broken.png", "a/vector.emf", "a/missing.png", "a/fails.png")
    parts = {"ppt/slides/slide1.xml": slide, "ppt/slides/_rels/slide1.xml.rels": rels(*[(f"rId{k + 1}", "image", f"../media/{t}") for k, t in enumerate(targets)])}
    data = {"a/pic.png": PNG, "b/pic.png": PNG, "a/photo.jpg": JPG, "a/broken.png": b"no image", "a/vector.emf": b"v", "a/fails.png": PNG + b"engine fails"}
    return deck(parts | {f"ppt/media/{n}": d for n, d in data.items()})


def translated(found):
    new = F.when(F.col("text") == "Kept", F.col("text")).otherwise(F.concat(F.lit("[x] "), "text"))
    return layout.fitted(found.segments.withColumn("final_text", new))


def test_a_deck_comes_back_with_painted_pictures(spark, tmp_path):
    (tmp_path / "a.pptx").write_bytes(mixed())
    (tmp_path / "bad.pptx").write_bytes(b"no archive")
    decks = D.files(spark, str(tmp_path))
    found = P.of_decks(decks, "pictures", engine_factory(), "English")
    rows = found.segments.orderBy("pos").collect()
    assert [r.id for r in rows] == [
        "slide1/shape[name=S]/tb", "media/pic.png#r1", "media/pic.png#r2", "media/pic.png#r1-2", "media/pic.png#r2-2", "media/photo.jpg#r1", "media/photo.jpg#r2",
    ]
    assert [r.pos for r in rows] == list(range(7)) and {r.group_key for r in rows} == {"slide1"}
    assert {(r.kind, r.context) for r in rows[1:]} == {("image-region", "embedded image text")}
    reasons = sorted((r.path.rsplit("/", 1)[-1], r.id, r.reason) for r in found.skipped.collect())
    assert [r for r in reasons if r[0] == "a.pptx"] == [
        ("a.pptx", "media/photo.jpg#r4", "low-confidence region"), ("a.pptx", "media/pic.png#r4", "low-confidence region"), ("a.pptx", "media/pic.png#r4", "low-confidence region"),
        ("a.pptx", "ppt/media/a/broken.png", "media part unreadable"), ("a.pptx", "ppt/media/a/fails.png", "media part unreadable"),
        ("a.pptx", "ppt/media/a/missing.png", "media part unreadable"), ("a.pptx", "ppt/media/a/vector.emf", "vector metafile image"),
    ]
    assert [r[2] for r in reasons if r[0] == "bad.pptx"] == ["unreadable deck: not a slide deck: the file is no zip archive"]

    out = {r.path.rsplit("/", 1)[-1]: r for r in P.decks_written(decks, found, translated(found)).collect()}
    assert out["bad.pptx"].content is None and "no zip archive" in out["bad.pptx"].error
    with zipfile.ZipFile(io.BytesIO(out["a.pptx"].content)) as z, zipfile.ZipFile(io.BytesIO(mixed())) as before:
        changed = {n for n in z.namelist() if z.read(n) != before.read(n)}
        assert changed == {"ppt/slides/slide1.xml", "ppt/media/a/pic.png", "ppt/media/b/pic.png", "ppt/media/a/photo.jpg"}
        assert z.read("ppt/media/a/photo.jpg")[:3] == b"\xff\xd8\xff" and z.read("ppt/media/a/pic.png")[:4] == b"\x89PNG"
        (tmp_path / "out").mkdir()
        for name in ("pic.png", "photo.jpg"):
            (tmp_path / "out" / name).write_bytes(z.read(f"ppt/media/a/{name}"))
    for row in J.images(spark, str(tmp_path / "out")).collect():
        assert pixels_of(row.asDict()).min() > 200  # the dark box is gone


def test_image_files(spark, tmp_path):
    for name, data in (("a.png", PNG), ("b.jpg", JPG), ("c.png", b"nothing")):
        (tmp_path / name).write_bytes(data)
    files = P.image_files(spark, str(tmp_path))
    found = P.of_images(files, "pictures", engine_factory(), "English")
    rows = found.segments.orderBy("path", "pos").collect()
    assert [(r.group_key, r.id, r.text, r.context) for r in rows] == [(n, i, t, "image text region") for n in ("a.png", "b.jpg") for i, t in (("r1", "Hello"), ("r2", "Kept"))]
    assert sorted((r.path[-5:], r.id[-5:], r.reason) for r in found.skipped.collect()) == [("a.png", "r4", "low-confidence region"), ("b.jpg", "r4", "low-confidence region"), ("c.png", "c.png", "media part unreadable")]

    def draw(pixels, lines):
        assert [line["text"] for line in lines] == ["[x] Hello"] and lines[0]["colour"].startswith("#")
        pixels[int(lines[0]["y"]) + 2, int(lines[0]["x"]) + 2] = (1, 2, 3)
        return pixels

    out = {r.path[-5:]: r.content for r in P.images_written(files, found, translated(found), draw=draw).collect()}
    assert out["c.png"] == b"nothing" and out["a.png"] != PNG and out["b.jpg"][:3] == b"\xff\xd8\xff"
    kept = P.images_written(files, found, layout.fitted(found.segments.withColumn("final_text", F.col("text")))).collect()
    assert {r.path[-5:]: bytes(r.content) for r in kept} == {"a.png": PNG, "b.jpg": JPG, "c.png": b"nothing"}


def test_no_pictures_at_all(spark):
    found = P.of_images(spark.createDataFrame([], "path string, content binary"), "pictures", engine_factory(), "English")
    assert found.segments.count() == 0 and found.skipped.count() == 0


def test_places_of_lines():
    paint = {"box": {"x": 10.0, "y": 20.0, "w": 40.0, "h": 100.0}, "lines": ["a", "b"], "size": 10.0, "rotation": None}
    assert [(p["x"], p["y"], p["angle"]) for p in line_places(paint, (500, 500))] == [(10, 58, 0), (10, 70, 0)]
    assert [(p["x"], p["y"]) for p in line_places(paint | {"rotation": 90}, (500, 500))] == [(42, 20), (30, 20)]
    assert [(p["x"], p["y"]) for p in line_places(paint | {"rotation": -90}, (500, 500))] == [(18, 120), (30, 120)]
    assert line_places(paint, (10, 10)) == []


@pytest.mark.parametrize("shape_", [(1, 1), (8, 8), (9, 17), (120, 75)])
def test_jpeg_round_trip(spark, tmp_path, shape_):
    h, w = shape_
    y, x = np.mgrid[0:h, 0:w]
    image = np.stack([x * 200 // w, y * 200 // h, (x + y) * 100 // (h + w)], -1).astype(np.uint8)
    (tmp_path / "x.jpg").write_bytes(jpeg(image))
    got = pixels_of(J.images(spark, str(tmp_path)).first().asDict())
    assert got.shape == image.shape and np.abs(got.astype(int) - image).mean() < 4
