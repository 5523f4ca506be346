from __future__ import annotations

import random

import pytest

from segloom.operators import evaluate as E
from segloom.operators import regions as G

BOX = "struct<x: double, y: double, w: double, h: double>"
SCHEMA = f"image_id int, pos int, box {BOX}, ink {BOX}, text string, confidence double, rotated boolean, rotation int"


def region(image, pos, box, text="ab", confidence=0.9, rotated=None, rotation=None, ink=None):
    return image, pos, tuple(map(float, box)), ink, text, confidence, rotated, rotation


def some(seed, images=12, n=7):
    r = random.Random(seed)
    return [region(i, p, (r.randint(0, 60), r.randint(0, 40), r.randint(1, 40), r.randint(1, 25)), r.choice(["ab", "cd", "ef"]), r.choice([0.5, 0.7, 0.75, 0.9])) for i in range(images) for p in range(n)]


def box_of(r):
    return r["box"]["x"], r["box"]["y"], r["box"]["w"], r["box"]["h"]


def overlap(a, b):
    return max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))


def ratio(a, b):
    i = overlap(a, b)
    return i / (a[2] * a[3] + b[2] * b[3] - i) if i else 0


def test_merging_equals_a_restarting_loop(spark):
    rows = some(3)
    got: dict = {}
    for r in G.merged(spark.createDataFrame(rows, SCHEMA)).orderBy("image_id", "pos").collect():
        got.setdefault(r.image_id, []).append((tuple(r.box), r.text))
    for image in range(12):
        boxes = [(r[2], r[4]) for r in rows if r[0] == image]
        again = True
        while again:
            again = False
            for i in range(len(boxes)):
                for j in range(i + 1, len(boxes)):
                    (a, s), (b, t) = boxes[i], boxes[j]
                    small = min(a[2] * a[3], b[2] * b[3])
                    if not again and (ratio(a, b) > 0.5 or overlap(a, b) / small >= 0.8):
                        band = a[1] < b[1] + b[3] and b[1] < a[1] + a[3]
                        first = a[0] <= b[0] if band else a[1] <= b[1]
                        x, y = min(a[0], b[0]), min(a[1], b[1])
                        new = (x, y, max(a[0] + a[2], b[0] + b[2]) - x, max(a[1] + a[3], b[1] + b[3]) - y)
                        boxes[i] = (new, f"{s} {t}" if first else f"{t} {s}")
                        del boxes[j]
                        again = True
                        break
                if again:
                    break
        assert got[image] == boxes


def test_a_sliver_does_not_turn_what_it_joins(spark):
    rows = [region(1, 0, (0, 0, 400, 20)), region(1, 1, (10, 2, 20, 15), rotation=-90, confidence=0.6)]
    r = G.merged(spark.createDataFrame(rows, SCHEMA)).first()
    assert (r.rotation, r.rotated, r.confidence, r.text) == (None, None, 0.6, "ab ab")


def test_reading_order_equals_a_sweep(spark):
    rows = some(5)
    got: dict = {}
    for r in G.in_reading_order(spark.createDataFrame(rows, SCHEMA)).orderBy("image_id", "order").collect():
        got.setdefault(r.image_id, []).append(r.pos)
    for image in range(12):
        bands, reach = [], None
        for r in sorted((r for r in rows if r[0] == image), key=lambda r: (r[2][1], r[1])):
            if reach is None or r[2][1] >= reach:
                bands.append([])
                reach = r[2][1]
            bands[-1].append(r)
            reach = max(reach, r[2][1] + r[2][3])
        assert got[image] == [r[1] for band in bands for r in sorted(band, key=lambda r: (r[2][0], r[2][1], r[1]))]


def test_validation(spark):
    images = spark.createDataFrame([(1, 100.0, 50.0)], "image_id int, width double, height double")
    rows = [
        region(1, 0, (50, 1, 20, 10), " right "), region(1, 1, (1, 0, 20, 10), "left"), region(1, 2, (1, 30, 7, 10), "thin"), region(1, 3, (1, 30, 9, 3), "flat"),
        region(1, 4, (30, 30, 9, 9), "@!"), region(1, 5, (30, 30, 9, 9), "　"), region(1, 6, (90, 40, 30, 20), "edge"),
    ]
    got = [(r.id, r.text, tuple(r.box), tuple(r.ink)) for r in G.validated(spark.createDataFrame(rows, SCHEMA), images).orderBy("order").collect()]
    assert got == [
        ("r1", "left", (0, 0, 23, 12), (1, 0, 20, 10)), ("r2", "right", (48, 0, 24, 13), (50, 1, 20, 10)), ("r3", "edge", (88, 38, 12, 12), (90, 40, 30, 20)),
    ]


@pytest.mark.parametrize(
    ("candidate", "clean", "flagged", "kept"),
    [
        ((0, 0, 10, 40), [], [], True), ((0, 0, 10, 15), [], [], False), ((0, 0, 10, 15), [], [(5, 5, 3, 3)], True), ((0, 0, 10, 40), [(0, 0, 10, 40)], [], False),
        ((0, 0, 10, 40), [(0, 0, 5, 5)], [], False), ((10, 10, 10, 10), [(0, 0, 100, 100)], [], False), ((0, 0, 10, 90), [(8, 0, 40, 9)], [], True),
        ((0, 0, 10, 90), [(8, 0, 40, 9), (8, 20, 40, 9), (8, 40, 40, 9)], [], False),
    ],
)
def test_what_speaks_against_a_turned_region(spark, candidate, clean, flagged, kept):
    make = lambda boxes: spark.createDataFrame([region(1, k, b) for k, b in enumerate(boxes)], SCHEMA)
    assert (G.rotation_kept(make([candidate]), make(clean), make(flagged)).count() == 1) is kept


def test_turned_readings_of_one_spot(spark):
    rows = [region(1, 0, (0, 0, 10, 10), "x", 0.8), region(1, 1, (0, 0, 10, 10), "y", 0.75), region(1, 2, (0, 50, 10, 10), "x", 0.8), region(1, 3, (0, 50, 10, 10), "x", 0.75), region(1, 4, (50, 0, 10, 10), "x", 0.6), region(1, 5, (50, 0, 10, 10), "y", 0.9)]
    assert sorted(r.pos for r in G.rotated_dedup(spark.createDataFrame(rows, SCHEMA)).collect()) == [2, 5]


def test_a_dropped_reading_drops_no_other(spark):
    rows = [region(1, 0, (0, 0, 10, 10), "a", 0.7), region(1, 1, (2, 0, 10, 10), "b", 0.9), region(1, 2, (0, 0, 8, 10), "c", 0.6)]
    assert sorted(r.pos for r in G.double_votes_resolved(spark.createDataFrame(rows, SCHEMA)).collect()) == [1, 2]
    assert [r["pos"] for r in G.voted_rows([{"pos": p, "box": dict(zip("xywh", b, strict=True)), "ink": None, "confidence": c} for p, b, c in ((0, (0, 0, 10, 10), 0.7), (1, (0, 0, 10, 10), 0.9), (2, (30, 0, 8, 10), 0.6))])] == [1, 2]


def test_all_passes(spark):
    images = spark.createDataFrame([(1, 200.0, 100.0)], "image_id int, width double, height double")
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    normal = make([region(1, 0, (0, 0, 50, 10), "clean"), region(1, 1, (150, 10, 12, 60), "flag", rotated=True), region(1, 2, (100, 80, 10, 15), "left", rotated=True)])
    # The clockwise image is 100 wide; what lies at x 20, y 150 there is at x 150, y 100 - 20 - 60 here.
    clockwise = make([region(1, 0, (20, 150, 60, 12), "Title")])
    none = make([region(2, 0, (0, 0, 9, 9))])
    got = G.with_rotation_passes(normal, clockwise, none.where("image_id = 1"), images).orderBy("pos").collect()
    assert [(r.pos, r.text, r.rotation) for r in got] == [(0, "clean", None), (1, "left", None), (2, "Title", -90)]
    assert tuple(got[2].box) == (150.0, 20.0, 12.0, 60.0)


def test_replaying_labels_scores_everything(spark):
    truth = spark.createDataFrame([region(1, 0, (0, 0, 20, 10), "one"), region(1, 1, (0, 20, 20, 10), "two")], SCHEMA)
    images = spark.createDataFrame([(1, bytearray(b"pixels")), (2, bytearray(b"others"))], "image_id int, content binary")
    import hashlib

    labels = truth.selectExpr(f"'{hashlib.sha256(b'pixels').hexdigest()}' as digest", "pos", "box", "text")
    found = E.replayed(images, labels)
    r = E.averages(E.per_image(truth, found, E.matched(E.pairs(truth, found, E.STRICT)))).first()
    assert (r.recall, r.precision, r.mean_iou, r.mean_text_accuracy) == (1.0, 1.0, 1.0, 1.0)
    assert all(c.covered for c in E.coverage(truth, found).collect())


def test_matching_takes_the_largest_first_and_coverage_adds_up(spark):
    truth = spark.createDataFrame([region(1, 0, (0, 0, 10, 10), "a"), region(1, 1, (2, 0, 10, 10), "b")], SCHEMA)
    found = spark.createDataFrame([region(1, 0, (2, 0, 10, 10), "b"), region(1, 1, (60, 0, 9, 9), "x")], SCHEMA)
    assert [(r.truth_pos, r.found_pos) for r in E.matched(E.pairs(truth, found, 0.4)).collect()] == [(1, 0)]
    halves = spark.createDataFrame([region(1, 0, (0, 0, 5, 10)), region(1, 1, (4, 0, 4, 10)), region(1, 2, (0, 0, 5, 10))], SCHEMA)
    got = {r.pos: (round(r.share, 6), r.covered) for r in E.coverage(truth, halves).collect()}
    assert got == {0: (0.8, True), 1: (0.6, False)}
    r = E.averages(E.per_image(truth, found.limit(0), E.matched(E.pairs(truth, found, 0.4)).limit(0))).first()
    assert (r.recall, r.precision, r.mean_iou) == (0.0, None, None)
