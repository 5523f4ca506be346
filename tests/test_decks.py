from __future__ import annotations

import io
import os
import zipfile
from xml.dom import minidom

import pytest
from deck_builder import deck, sample, shape, tree

from segloom.sources import decks as D

DECK = sample()


def parts(content):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        assert z.testzip() is None
        return {n: z.read(n) for n in z.namelist()}


def test_segments_in_order_with_boxes_and_fonts():
    rows = {r["id"]: r for r in D.rows("x", DECK)}
    assert list(rows) == [
        "slide2/shape[name=Title 1]/tb", "slide2/shape[name=Body]/tb", "slide2/shape[name=Body]/tb-2", "slide2/shape[name=Snug]/tb", "slide2/group[name=G_1_]/shape[name=Inner]/tb",
        "slide2/table[gf-name=T]/r1c1", "slide2/table[gf-name=T]/r2c2", "slide2/smartart[gf-name=S]/pt{0}", "slide2/smartart[gf-name=S]/pt{1}", "slide2/smartart[gf-name=S]/pt{2}", "slide2/notes", "slide10/shape[name=Last]/tb",
    ]
    title, body = rows["slide2/shape[name=Title 1]/tb"], rows["slide2/shape[name=Body]/tb"]
    inset = (2 * 91440 / 12700, 2 * 45720 / 12700)
    assert (title["size_pt"], title["context"], title["bold"]) == (44.0, "slide title", False)
    assert (title["box_w"], title["box_h"]) == pytest.approx(((400 - inset[0]) * 0.96, 90 - inset[1]))
    assert (body["text"], body["size_pt"], body["bold"], body["context"], body["family"]) == ("One\nTwo\nThree", 20.0, True, "text box", "Calibri")
    inner = rows["slide2/group[name=G_1_]/shape[name=Inner]/tb"]
    assert (inner["box_w"], inner["box_h"]) == pytest.approx(((100 - inset[0]) * 2 * 0.96, (50 - inset[1]) * 4))
    assert rows["slide2/table[gf-name=T]/r1c1"]["box_w"] == pytest.approx((100 - inset[0]) * 0.96)
    assert rows["slide2/notes"]["group_key"] == "slide2-notes" and rows["slide2/notes"]["box_w"] == 1e6


def test_what_is_left_out():
    assert D.Scan(D.Archive(DECK)).run().skips == [
        ("slide2/shape[name=Art]", "WordArt"), ("slide2/table[gf-name=T]/r1c2", "merge-continuation cell with unexpected text (anchor-only extraction is intentional)"),
        ("slide2/graphicFrame[name=C]", "chart"), ("slide2/pic[name=Film]", "video"),
    ]


def test_untouched_parts_stay_byte_for_byte():
    before, same = parts(DECK), parts(D.write(DECK, {}))
    assert before == same
    after = parts(D.write(DECK, {"slide2/notes": {"translation": "Denk dran", "fitted_size_pt": 3.0}}))
    assert {n for n in before if before[n] != after[n]} == {"ppt/notesSlides/notesSlide1.xml"}
    for name, data in after.items():
        if name.endswith(".xml"):
            minidom.parseString(data)


def test_lines_go_into_the_runs_there_are():
    write = lambda text: next(r["text"] for r in D.rows("x", D.write(DECK, {"slide2/shape[name=Body]/tb": {"translation": text, "fitted_size_pt": 20.0}})) if r["id"] == "slide2/shape[name=Body]/tb")
    for text in ("Eins", "Eins\nZwei", "a\nb\nc", "a\nb\nc\nd\n e "):
        assert write(text) == text
    assert D.rows("x", D.write(DECK, {"slide2/shape[name=Body]/tb": {"translation": "a\nb\nc\nd", "fitted_size_pt": 11.9}}))[1]["size_pt"] == 11.75
    changed = parts(D.write(DECK, {"slide2/shape[name=Body]/tb": {"translation": "kurz", "fitted_size_pt": 11.9}}))["ppt/slides/slide2.xml"].decode()
    assert "<a:normAutofit/>" in changed and 'sz="1175"' in changed


def test_the_cached_drawing_follows_where_it_can():
    ids = [f"slide2/smartart[gf-name=S]/pt{{{k}}}" for k in range(3)]
    rows = {i: {"translation": t, "fitted_size_pt": None} for i, t in zip(ids, ["Schritt", "Stufe", "Ziel"], strict=True)}
    drawing = parts(D.write(DECK, rows))["ppt/diagrams/drawing1.xml"].decode()
    assert "Ziel" in drawing and ">Step<" in drawing
    rows[ids[1]]["translation"] = "Schritt"
    assert "Schritt" in parts(D.write(DECK, rows))["ppt/diagrams/drawing1.xml"].decode()


def test_other_prefixes_and_missing_runs():
    own = tree(shape("S", ["Text"])).replace("xmlns:a=", "xmlns:d=").replace("<a:", "<d:").replace("</a:", "</d:")
    out = parts(D.write(deck({"ppt/slides/slide1.xml": own}), {"slide1/shape[name=S]/tb": {"translation": "x\ny", "fitted_size_pt": 9.0}}))
    assert "<a:" not in out["ppt/slides/slide1.xml"].decode() and D.rows("x", deck(out))[0]["text"] == "x\ny"


def test_errors():
    with pytest.raises(ValueError, match="no zip archive"):
        D.rows("x", b"nothing")
    with pytest.raises(ValueError, match="doesn't have"):
        D.write(DECK, {"slide9/shape": {"translation": "x"}})
    with pytest.raises(ValueError, match="slide1.xml"):
        D.rows("x", deck({"ppt/slides/slide1.xml": "<broken"}))


def test_through_spark(spark, tmp_path):
    (tmp_path / "a.pptx").write_bytes(DECK)
    (tmp_path / "b.pptx").write_bytes(deck({"ppt/slides/slide1.xml": tree(shape("S", ["Text"]))}))
    files = D.files(spark, str(tmp_path))
    rows = D.segments(files)
    assert rows.count() == 13 and D.skipped(files).count() == 4
    assert [(r.media_path, r.slide_no, r.reason) for r in D.media(files).orderBy("pos").collect()] == [("ppt/media/image1.png", 2, None), ("ppt/media/image2.emf", 2, "vector metafile image")]
    out = D.written(files, rows.selectExpr("path", "id", "concat('[x] ', text) as translation", "size_pt as fitted_size_pt"))
    again = D.segments(out)
    assert again.where("not startswith(text, '[x] ')").count() == 0 and again.count() == 13


def test_reading_alone_gives_what_the_dom_gives():
    found = [D.Scan(D.Archive(DECK, editable)).run() for editable in (True, False)]
    assert found[0].skips == found[1].skips and found[0].media == found[1].media
    plain = lambda s: (s.id, s.text, s.box, s.font, s.context, s.kind, s.part_path, s.drawing_path, s.snug)
    assert [plain(s) for s in found[0].sites] == [plain(s) for s in found[1].sites]
    text = b'<!DOCTYPE a [<!ENTITY e "x">]><a xmlns:n="u" n:k="1">&lt;&e;<![CDATA[<]]><n:b k="2"/></a>'
    a = D.parsed(text).childNodes[0]
    assert ("".join(c.data for c in a.childNodes[:-1]), a.getAttributeNS("u", "k"), a.getAttribute("k")) == ("<x<", "1", "")
    assert [(c.namespaceURI, c.getAttribute("k")) for c in D.parsed(text).getElementsByTagNameNS("*", "b")] == [("u", "2")]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the tables aren't here")
def test_decks_of_a_small_table_are_dealt_over_all_cores(spark):
    from segloom.plans.decks import customer_decks

    assert customer_decks(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_written_decks_go_on_some_at_a_time(spark):
    decks = spark.createDataFrame([(str(k), DECK if k % 9 else b"none") for k in range(600)], "path string, content binary").coalesce(1)
    new = spark.createDataFrame([(str(k), "slide2/notes", f"[{k}]", None) for k in range(600)], "path string, id string, translation string, fitted_size_pt double")
    out = {r.path: r for r in D.written(decks, new).coalesce(1).collect()}
    assert len(out) == 600 and all((r.content is None) == (int(k) % 9 == 0) == (r.error is not None) for k, r in out.items())
    assert all(any(x["text"] == f"[{k}]" for x in D.rows("x", out[k].content)) for k in ("1", "299", "598"))
