from __future__ import annotations

import itertools
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from segloom.operators import layout as L
from segloom.operators import pixels as X

M = L.HalfEm()
TEXTS = ["A short title", "A long paragraph that has to wrap " * 6, "质量报告管理系统", "One\nTwo three\n\nFour", "Unbreakable" * 12]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("box", [(200, 40), (60, 60), (400, 12)])
@pytest.mark.parametrize("size", [9.0, 24.0, 7.5])
def test_what_fits_and_one_step_larger_does_not(text, box, size):
    found, lines, over = L.fit(text, *box, size, M)
    assert found <= size
    if not over:
        assert max(M.width(x) for x in lines) * found <= box[0] and len(lines) * found * 1.2 <= box[1] + 1e-9
    larger = found + 1 if found >= 6 else found + 0.5
    if found < size and larger <= size and not 5 < found < 6:
        wider = L.wrapped(text, box[0] / larger, M)
        assert max(M.width(x) for x in wider) * larger > box[0] or len(wider) * larger * 1.2 > box[1]


def test_wrapping():
    assert L.wrapped("aa bb  cc", 2.3, M) == ["aa bb", "cc"]
    assert L.wrapped("aaaaa b", 1.0, M) == ["aa", "aa", "a", "b"]
    assert L.wrapped("", 5, M) == [""] and L.wrapped("a\n\nb", 5, M) == ["a", "", "b"]
    assert L.wrapped("质量a b", 2, M) == ["质量", "a b"]
    assert L.wrapped("质", 0.1, M) == ["质"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([0.5, 1.0, 2.0, 3.5]), min_size=1, max_size=7), st.lists(st.sampled_from([10.0, 20.0, 45.0]), min_size=1, max_size=3))
def test_dealing_tokens_is_the_best_division(widths, spans):
    got = L.dealt_tokens(widths, 0.25, spans)
    if len(widths) < len(spans):
        assert got is None
        return
    wide = lambda part: sum(part) + 0.25 * max(0, len(part) - 1)
    total = wide(widths)
    options = []
    for cuts in itertools.combinations(range(1, len(widths)), len(spans) - 1):
        parts = [widths[a:b] for a, b in itertools.pairwise([0, *cuts, len(widths)])]
        options.append((sum((wide(p) / total - s / sum(spans)) ** 2 for p, s in zip(parts, spans, strict=True)), parts))
    least, parts = min(options, key=lambda o: o[0])
    if got is None:
        shares = [(wide(p) / total, s / sum(spans)) for p, s in zip(parts, spans, strict=True)]
        assert any(abs(a - b) > 0.45 or max(a, b) > 4 * min(a, b) for a, b in shares) or len([o for o in options if abs(o[0] - least) < 1e-12]) > 1
    else:
        cut = [widths[a:b] for a, b in itertools.pairwise(np.cumsum([0, *got]).tolist())]
        assert sum((wide(p) / total - s / sum(spans)) ** 2 for p, s in zip(cut, spans, strict=True)) == pytest.approx(least)


def test_ink_and_width_sizes():
    size = L.ink_matched("Hello", 20, M)
    assert abs(M.ink("Hello") * size - 20) <= 0.25 and L.ink_matched("x", 0, M) == 0.5
    assert L.width_capped("ab", 30, M) == 30.0


class Ink(L.HalfEm):
    def __init__(self, high):
        self.high = high

    def ink(self, text):
        return self.high


@settings(max_examples=300, deadline=None)
@given(st.floats(0.01, 5000), st.floats(0.05, 3))
def test_ink_sizes_are_those_of_halving_a_bracket(height, ink):
    low, high = 0.5, max(1.2 * height, 1.0)
    while ink * high < height and high < 2000:
        low, high = high, min(2 * high, 2000)
    while high - low > 0.25:
        middle = (low + high) / 2
        low, high = (middle, high) if ink * middle < height else (low, middle)
    found = L.ink_matched("x", height, Ink(ink))
    on_border = abs(height / ink - low) < 1e-9 * height or abs(height / ink - high) < 1e-9 * height
    assert found == pytest.approx((low + high) / 2, rel=1e-12) or on_border


def test_many_tokens_are_dealt_in_columns(monkeypatch):
    widths = [1.0 + k % 5 for k in range(700)]
    whole = L.dealt_tokens(widths, 0.25, [30.0, 30.0, 40.0])
    monkeypatch.setattr(L, "_COLUMNS", 1 << 20)
    assert whole == L.dealt_tokens(widths, 0.25, [30.0, 30.0, 40.0]) and sum(whole) == 700


def test_clusters_do_not_chain(spark):
    rows = spark.createDataFrame([("a", k, float(z), 99.0 if k else 9.5) for k, z in enumerate([10, 11, 12, 13, 14, 30])], "g string, k int, z double, top double")
    got = [(r.cluster, r.snapped) for r in L.clustered(rows, "g", "z", "top", "k").orderBy("k").collect()]
    assert got == [(0, 9.5), (0, 9.5), (0, 9.5), (1, 14.0), (1, 14.0), (2, 30.0)]


def test_a_font_file():
    path = "/usr/share/fonts/truetype/dejavu/DejaVuSans.ttf"
    if not os.path.exists(path):
        pytest.skip("no such font here")
    font = L.TrueType(path)
    assert font.width("W") > font.width("i") > 0 and font.width("ab") == pytest.approx(font.width("a") + font.width("b"))


def page():
    """A row of three cells between gridlines, dark on white."""
    p = np.full((40, 300, 3), 255, np.uint8)
    for x in (5, 100, 200, 295):
        p[:, x : x + 2] = 0
    for x, w in ((20, 50), (120, 40), (220, 60)):
        for k in range(x, x + w, 4):
            p[12:28, k : k + 2] = 10
    return p


def test_profiles_bands_and_spans():
    light = X.luminance(page().astype(float))
    assert X.background(light) == pytest.approx(255)
    counts, through = X.profile(light, 255)
    lines = X.gridlines(counts, through, 40)
    assert X.runs(lines) == [(5, 7), (100, 102), (200, 202), (295, 297)]
    assert X.row_band(light[:, 10:95], 255) == (12, 28)
    spans = X.ink_spans(np.where(lines, 0, counts), 40, lines)
    assert spans == [(20, 70), (120, 158), (220, 278)]
    assert X.ink_spans(np.zeros(9, int), 10, np.zeros(9, bool)) == []


def test_cells_are_split_and_hopeless_readings_dropped():
    box = lambda x, y, w, h: {"x": x, "y": y, "w": w, "h": h}
    base = {"ink": None, "confidence": 0.9, "rotated": None, "rotation": None}
    row = base | {"id": "r", "box": box(2, 4, 296, 32), "text": "Alpha Beta Gammas"}
    got = X.cells([row, base | {"id": "v", "box": box(0, 0, 5, 30), "text": "turned", "rotation": 90}], page())
    assert [(c["id"], c["text"]) for c in got] == [("v", "turned"), ("rc1", "Alpha"), ("rc2", "Beta"), ("rc3", "Gammas")]
    assert got[1]["ink"]["y"] == 12 and got[1]["ink"]["h"] == 16
    assert X.cells([base | {"id": "x", "box": box(20, 10, 50, 20), "text": "far too many words for such a place" * 9}], page()) == []


def test_painting(spark, tmp_path):
    p = page()
    out, colours = X.painted(p, [{"x": 15.5, "y": 10, "w": 60, "h": 20}])
    assert (out[11:29, 16:70] == 255).all() and (colours[0] < 60).all() and (out[:, 100] == p[:, 100]).all()
    assert X.text_colour(np.zeros((0, 3)), np.full(3, 200.0)).tolist() == [0, 0, 0]
    (tmp_path / "a.png").write_bytes(X.png(p))
    from segloom.sources.documents import images

    row = images(spark, str(tmp_path)).first().asDict()
    assert (X.pixels_of(row) == p).all()
    boxes = images(spark, str(tmp_path)).selectExpr("*", "array(named_struct('x', 15.5D, 'y', 10D, 'w', 60D, 'h', 20D)) as boxes")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "b.png").write_bytes(bytes(X.overlays(boxes).first().png))
    assert (X.pixels_of(images(spark, str(tmp_path / "b")).first().asDict()) == out).all()
