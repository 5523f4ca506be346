from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from segloom.operators import segments as S
from segloom.sources import documents as D

SCHEMA = "doc_id long, pos int, id string, text string, context string, group_key string"


def table(spark, rows):
    return spark.createDataFrame([(1, k, f"s{k}", *r) for k, r in enumerate(rows)], SCHEMA)


def simple(rows, budget):
    out, number, key, held = {}, -1, object(), 0
    for k, (text, context, group) in enumerate(rows):
        if not any(c.isalpha() for c in text):
            continue
        own = group if group is not None else context
        if own != key or held + len(text) > budget:
            number, held = number + 1, 0
        key, held = own, held + len(text)
        out[f"s{k}"] = number
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["abc", "a" * 7, "12", "x" * 30, "ab cd"]), st.sampled_from(["c", "d"]), st.sampled_from([None, "g", "h"])), min_size=1, max_size=14))
def test_packing_equals_a_plain_loop(spark, rows):
    assert {r.id: r.group_no for r in S.packed(table(spark, rows), 10).collect()} == simple(rows, 10)


def test_packing_counts_utf16_units_and_lets_one_text_be_too_long(spark):
    rows = [("a😀", "c", None), ("bb", "c", None), ("c" * 9, "c", None), ("d", "c", None)]
    assert [r.group_no for r in S.packed(table(spark, rows), 5).orderBy("pos").collect()] == [0, 0, 1, 2]


def test_group_contexts(spark):
    rows = [("a", "title", "slide1"), ("b", "body", "slide1"), ("c", "body", "slide1"), ("d", "label", None)]
    found = {r.group_no: r.group_context for r in S.group_contexts(S.packed(table(spark, rows))).collect()}
    assert found == {0: "slide1: body, title", 1: "label"}


def test_islands_restart_when_a_key_returns(spark):
    rows = [("a", "x", None), ("1", "y", None), ("b", "x", None), ("c", "y", None), ("d", "x", None)]
    assert [r.island for r in S.islands(table(spark, rows)).orderBy("pos").collect()] == [0, 0, 1, 2]


def test_suffixes_skip_names_that_are_taken(spark):
    rows = spark.createDataFrame([(1, k, b) for k, b in enumerate(["a", "a-2", "a", "a", "b"])], "doc_id long, pos int, base string")
    assert [r.id for r in S.suffixed_ids(rows).orderBy("pos").collect()] == ["a", "a-2", "a-3", "a-4", "b"]


def test_a_repeated_id_fails(spark):
    rows = table(spark, [("a", "c", None), ("b", "c", None)])
    assert S.with_unique_ids(rows).count() == 2
    with pytest.raises(Exception, match="twice"):
        S.with_unique_ids(rows.unionByName(rows)).collect()


def test_the_longest_suffix_wins(spark):
    paths = spark.createDataFrame([(p,) for p in ("a/b.FAKE.json", "c.pptx", "d.x.gz", "e.jpeg")], "path string")
    found = {r.path: (r.adapter, r.out_path) for r in S.extensions_resolved(paths, D.adapters(spark)).collect()}
    assert found == {
        "a/b.FAKE.json": ("fake", "a/b_translated.fake.json"), "c.pptx": ("pptx", "c_translated.pptx"), "d.x.gz": (None, "d.x_translated.gz"), "e.jpeg": ("image", "e_translated.jpeg"),
    }
    assert S.extensions_resolved(paths, D.adapters(spark, with_images=False)).where("adapter = 'image'").count() == 0


def test_json_documents_come_back(spark, tmp_path):
    (tmp_path / "a.fake.json").write_text('{"segments": [{"id": "1", "text": "T\\u00e9xt", "box": {"wPt": 10, "hPt": 5}, "font": {"family": "F", "sizePt": 12}, "context": "c", "kind": "shape"}]}')
    rows = D.json_segments(spark, str(tmp_path)).collect()
    assert [(r.pos, r.id, r.text, r.box_w, r.size_pt, r.group_key) for r in rows] == [(0, "1", "Téxt", 10.0, 12.0, None)]
    fitted = D.json_segments(spark, str(tmp_path)).selectExpr("*", "text as final_text", "size_pt as fitted_size_pt", "array(text) as fitted_lines")
    D.save_files(D.json_documents(fitted).selectExpr("'out.json' as name", "content"), str(tmp_path / "out"))
    assert '"translation":"Téxt"' in (tmp_path / "out" / "out.json").read_text()
