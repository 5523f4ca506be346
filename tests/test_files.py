from __future__ import annotations

import os

from test_pictures import JPG, PNG, drawn, engine_factory, mixed

from segloom.operators import report
from segloom.operators.pixels import pixels_of, png
from segloom.operators.providers import echo_factory
from segloom.plans.files import translate_files
from segloom.sources import decks as D
from segloom.sources import documents as J


def drawing():
    """Made here, so that it travels to workers whole."""

    def own(pixels, lines):
        for line in lines:
            pixels[int(line["y"]) : int(line["y"]) + 3, int(line["x"]) : int(line["x"]) + 3] = (0, 200, 0)
        return pixels

    return own


def test_decks_from_folder_to_folder(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.pptx").write_bytes(mixed())
    (source / "bad.pptx").write_bytes(b"no archive")
    run = translate_files(spark, "pptx", str(source), str(out), "English", "German", echo_factory("German"), engine_factory(), "files", draw=drawing())
    assert os.listdir(out) == ["a.pptx"] and "no zip archive" in run.failed.first().error
    assert [r.text for r in D.segments(D.files(spark, str(out))).collect()] == ["[German] Text"]
    full = {r.path.rsplit("/", 1)[-1]: r for r in run.report.collect()}
    good, bad = full["a.pptx"], full["bad.pptx"]
    assert (good.total, good.translated, good.kept, len(good.skipped), good.groups, good.calls) == (7, 7, 0, 7, 1, 1)
    assert (bad.total, len(bad.skipped), bad.calls, bad.kept_original) == (0, 1, 0, [])
    assert good.duration_ms == sum(good.phase_ms.values()) and good.model_ms > good.eval_ms > 0
    text = {r.path.rsplit("/", 1)[-1]: r.report for r in report.lines(run.report, "path").collect()}["a.pptx"]
    assert "  Skipped          7\n" in text and "Groups/calls     1 groups, 1 model calls, 0 retries, 0 per-segment fallbacks" in text and "Processing stats" in text


def test_images_without_drawing_stay(spark, tmp_path):
    source, out, drawn_out = tmp_path / "in", tmp_path / "out", tmp_path / "drawn"
    source.mkdir()
    for name, data in (("a.png", PNG), ("b.jpg", JPG), ("c.png", b"nothing")):
        (source / name).write_bytes(data)
    ask = (spark, "image", str(source))
    rest = ("English", "German", echo_factory("German"), engine_factory(), "images")
    run = translate_files(*ask, str(out), *rest)
    assert {f: (out / f).read_bytes() for f in sorted(os.listdir(out))} == {"a.png": PNG, "b.jpg": JPG}
    assert [(r.path[-5:], r.error) for r in run.failed.collect()] == [("c.png", "media part unreadable")]
    translate_files(*ask, str(drawn_out), *rest, draw=drawing())
    for row in J.images(spark, str(drawn_out)).collect():
        got = pixels_of(row.asDict()).astype(int)
        assert got.shape == drawn(100, 200, 0, 0, 0, 0).shape and (got[..., 1] - got[..., 0] > 100).sum() >= 9
    assert (drawn_out / "a.png").read_bytes()[:8] == png(drawn(1, 1, 0, 0, 0, 0))[:8]


def test_report_lists_what_was_kept_and_overflowed(spark):
    rows = spark.createDataFrame(
        [("f", 0, "a", "One", "eins", None, True, 11.5), ("f", 1, "b" * 30, "Two", None, "echo", False, 12.0), ("g", 0, "c", "质量", None, "not-source-language", False, 12.0)],
        "path string, pos int, id string, text string, translation string, kept_reason string, overflowed boolean, fitted_size_pt double",
    )
    skipped = spark.createDataFrame([("f", "x", "chart")], "path string, id string, reason string")
    calls = spark.createDataFrame([("f", 0, "initial", "{}", 5, 10, 500.0)], "path string, group_no int, stage string, content string, prompt_tokens int, completion_tokens int, eval_ms double")
    full = report.full(rows, skipped, calls, "path", "m", {"extract": 500, "translate": 1500})
    text = {r.path: r.report for r in report.lines(full, "path").collect()}
    f = text["f"].split("\n")
    for line in ("  Overflowed       1", "  Skipped          1", "  Duration         2000 ms", "    " + "b" * 30 + " echo", "    a" + " " * 27 + " 11.5", "  Phases           extract 500 ms, connect 0 ms, translate 1.50 s, fit 0 ms, apply 0 ms", "  Tokens           5 prompt, 10 completion, 20.0 tok/s", "  Throughput       30.0 segments/min"):
        assert line in f, line
    assert "WARNING" in text["g"] and "WARNING" not in text["f"] and "Tokens" not in text["g"]
