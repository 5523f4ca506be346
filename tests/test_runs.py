from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from segloom.functions import boxes
from segloom.operators import imagetext, layout, providers, report
from segloom.operators import regions as G
from segloom.operators.pixels import turned
from segloom.plans.translate import translate
from segloom.sources import vision


def test_a_run_with_faults_reconciles(spark):
    rows = [(1, 0, "a", "Hello"), (1, 1, "b", "World"), (1, 2, "c", "42"), (1, 3, "d", "质量报告"), (1, 4, "e", "Stuck"), (2, 0, "f", "Other")]
    table = spark.createDataFrame([(*r, "body", "g", 100.0, 50.0, 12.0) for r in rows], "doc_id long, pos int, id string, text string, context string, group_key string, box_w double, box_h double, size_pt double")

    def factory():
        def answer(row):
            if row["stage"] == "initial" and '"f"' in row["user"]:
                raise RuntimeError("no connection")
            asked, out = json.loads(row["user"]), []
            for s in asked:
                if s["id"] == "e" or s["id"] == "b" and row["stage"] != "fallback":
                    out.append({"id": s["id"], "translation": s["text"].upper()})
                else:
                    out.append({"id": s["id"], "translation": f"<{row['stage']}> {s['text']}"})
            return {"content": "<think>hm</think>" + json.dumps({"translations": out}), "prompt_tokens": 10, "completion_tokens": 5, "eval_ms": 1.0}

        return answer

    run = translate(table, "English", "German", factory, "faulty")
    got = {r.id: (r.final_text, r.kept_reason) for r in run.rows.collect()}
    assert got == {
        "a": ("<initial> Hello", None), "b": ("<fallback> World", None), "c": ("42", "skipped-untranslatable"), "d": ("质量报告", "not-source-language"), "e": ("Stuck", "echo"), "f": ("<retry> Other", None),
    }
    assert sorted((r.doc_id, r.stage, r.error is None) for r in run.calls.collect()) == [(1, "fallback", True), (1, "fallback", True), (1, "initial", True), (1, "retry", True), (2, "initial", False), (2, "retry", True)]
    totals = {r.doc_id: (r.total, r.translated, r.kept) for r in run.report.collect()}
    assert totals == {1: (5, 2, 3), 2: (1, 1, 0)}
    assert "Translated       2" in report.lines(run.report, "doc_id").where("doc_id = 1").first().report


def test_the_echo_provider_equals_its_expression(spark):
    row = {"user": json.dumps([{"id": "1", "text": "Ü\n\"x\""}])}
    content = json.loads(providers.echo_factory("German")()(row)["content"])
    expression = spark.createDataFrame([("Ü\n\"x\"",)], "t string").select(providers.prefixed("German", F.col("t"))).first()[0]
    assert content["translations"] == [{"id": "1", "translation": expression}]


@pytest.mark.parametrize(
    "content",
    [
        '{"regions":[{"bbox":{"x":100,"y":100,"w":200,"h":100},"text":"a"}]}', '```json\n[{"bbox_2d":[100,100,300,200],"label":"a"}]\n```', 'Sure:\n```\n{"regions":[{"box":[100,100,300,200],"content":"a"}]}\n```',
    ],
)
def test_answers_of_vision_models(spark, content):
    answers = spark.createDataFrame([("i", 500, 200, content)], "image_id string, width int, height int, content string")
    r = vision.regions(answers).first()
    assert (tuple(r.box), r.text, r.error) == ((50.0, 20.0, 100.0, 20.0), "a", None)


def test_corners_and_nonsense(spark):
    corner = [{"box": {"x": 0.0, "y": 10.0 * k, "w": 100.0, "h": 10.0 * k + 8}, "text": "t"} for k in range(4)]
    assert [r["box"]["h"] for r in vision.settled_boxes(corner)] == [8.0] * 4
    literal = [{"box": {"x": 50.0 * k, "y": 5.0, "w": 40.0, "h": 20.0}, "text": "t"} for k in range(2)]
    assert vision.settled_boxes(literal) == literal
    bad = ["nothing", "[1]", '{"regions":[{"bbox":[1,2],"text":"a"}]}', '{"regions":[{"bbox":[1,2,3,4]}]}', "7"]
    answers = spark.createDataFrame([(str(k), 9, 9, c) for k, c in enumerate(bad)], "image_id string, width int, height int, content string")
    assert all(r.error and r.pos is None for r in vision.regions(answers).collect())


def test_paint_sizes(spark):
    rows = [(1, 0, ["Hello"], "Hello", 9.0, 20.0, 500.0), (1, 1, ["Bello"], "Bello", 9.0, 21.0, 500.0), (1, 2, ["a", "b"], "ab", 12.0, 40.0, 60.0), (1, 3, ["Wide line here"], "W", 9.0, 99.0, 70.0)]
    table = spark.createDataFrame(rows, "image_id int, pos int, lines array<string>, source_text string, fitted_size_pt double, ink_height double, fit_width double")
    got = {r.pos: r.paint_size for r in layout.paint_sizes(table).collect()}
    assert got[0] == got[1] and abs(0.72 * got[0] - 21) < 0.5 and got[3] == got[2] <= layout.width_capped("Wide line here", 70.0, layout.HalfEm())


def test_capabilities(spark):
    parsed = spark.sql("select from_json('{\"a\":{\"structuredWithThinkOff\":true},\"b\":{},\"c\":{\"structuredWithThinkOff\":\"x\"}}', 'map<string, struct<structuredWithThinkOff: boolean>>') as m")
    assert parsed.select(providers.sane_capabilities(parsed["m"])).first()[0].keys() == {"a"}


def test_an_engine_finds_regions(spark):
    def factory():
        def engine(content):
            if content == b"bad":
                raise RuntimeError("no image")
            straight, leaning, tall = [(0, 0), (50, 0), (50, 10), (0, 10)], [(0, 0), (50, 20), (45, 30), (0, 10)], [(0, 0), (10, 0), (10, 60), (0, 60)]
            return [{"points": p, "text": "Some text", "confidence": 0.9} for p in (straight, None, leaning, tall)]

        return engine

    images = spark.createDataFrame([("a", bytearray(b"good")), ("b", bytearray(b"bad"))], "image_id string, content binary")
    rows = sorted(providers.detected(images, "engine", factory).collect(), key=lambda r: (r.image_id, r.pos or 0))
    assert [(r.image_id, r.pos, r.rotated, r.error) for r in rows] == [("a", 0, None, None), ("a", 1, True, None), ("a", 2, True, None), ("b", None, None, "no image")]
    assert tuple(rows[1].box) == (0.0, 0.0, 50.0, 30.0)


def test_turned_images_and_boxes_agree(spark):
    image = np.zeros((30, 50, 3), np.uint8)
    image[5:9, 20:40] = 255  # a box of 20 by 4 at x 20, y 5
    for clockwise in (True, False):
        ys, xs = np.nonzero(turned(image, clockwise)[:, :, 0])
        found = boxes.box(*[F.lit(int(v)) for v in (xs.min(), ys.min(), xs.max() - xs.min() + 1, ys.max() - ys.min() + 1)])
        back = boxes.from_clockwise(found, F.lit(30)) if clockwise else boxes.from_counterclockwise(found, F.lit(50))
        assert tuple(spark.range(1).select(back.alias("b")).first().b) == (20, 5, 20, 4)
    assert tuple(spark.range(1).select(boxes.whole_pixels(boxes.box(F.lit(-1.5), F.lit(2.2), F.lit(9.0), F.lit(4.0)), F.lit(5), F.lit(100)).alias("b")).first().b) == (0, 2, 5, 5)


def test_regions_become_segments_and_paints(spark):
    box = "struct<x: double, y: double, w: double, h: double>"
    schema = f"image_id string, pos int, box {box}, ink {box}, text string, confidence double, rotated boolean, rotation int"
    rows = [
        ("d/a.png", 0, (10.0, 10.0, 100.0, 20.0), None, "Hello", 0.9, None, None), ("d/a.png", 1, (10.0, 50.0, 20.0, 90.0), None, "Turned", 0.9, None, -90), ("d/a.png", 2, (60.0, 50.0, 50.0, 20.0), None, "Unsure", 0.5, None, None),
        ("d/a.png", 3, (120.0, 50.0, 50.0, 20.0), None, "Leaning", 0.9, True, None), ("d/a.png", 4, (120.0, 150.0, 50.0, 20.0), None, "质量报告", 0.9, None, None),
    ]
    images = spark.createDataFrame([("d/a.png", 300.0, 300.0)], "image_id string, width double, height double")
    valid = G.validated(spark.createDataFrame(rows, schema), images)
    got = {r.text: r for r in imagetext.segments(valid, "English").collect()}
    assert set(got) == {"Hello", "Turned"} and got["Hello"].group_key == "a.png" and got["Hello"].family == "Noto Sans"
    assert abs(got["Hello"].size_pt * 0.72 - 20) <= 0.25 and (got["Hello"].box_w, got["Turned"].box_w) == (104.0, 94.0)
    assert got["Hello"].box_h == max(24.0, got["Hello"].size_pt * 1.2)
    assert sorted((r.id, r.reason) for r in imagetext.skipped(valid, "English").collect()) == [("r3", "low-confidence region"), ("r4", "rotated region")]
    fitted = layout.fitted(imagetext.segments(valid, "English").withColumn("final_text", F.when(F.col("text") == "Hello", F.lit("Hallo")).otherwise(F.col("text"))))
    paint = imagetext.paints(fitted).first().paints
    assert [(p.lines, p.rotation) for p in paint] == [(["Hallo"], None)] and paint[0].size > 0
