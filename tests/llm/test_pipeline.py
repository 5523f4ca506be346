from __future__ import annotations

import os
import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_sets import groups, shingles

from segloom.llm.queries import QUERIES
from segloom.llm.tables import settle, table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")


def test_stages_take_effect_and_keep_the_columns(spark):
    docs = table(spark, DATA, "documents")
    before, columns = docs, docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = settle(stage(spark, before, DATA))
        assert after.columns == columns, name
        counts.append(after.count())
        if name == "near_dedup":
            sets = {r.doc_id: shingles(r.text) for r in before.collect()}
            want = groups(list(sets), lambda a, b: bool(sets[a]) and bool(sets[b]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
            assert sorted(r.doc_id for r in after.collect()) == sorted(k for k, c in want.items() if k == c)
        before = after
    assert counts[1] == counts[0] and counts[2] <= counts[1] and counts[3] <= counts[2]
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows) and {r.doc_id for r in rows} == {r.doc_id for r in before.collect()}


def test_stages_stand_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, aside_0 string, score double, h int"
    rows = [(1, None, None, None, None, "a", 1.0, 1), (2, "", "en", None, 0, "a", 1.0, 1), (3, "12 !", "en", "s", 4, None, None, None), (4, "Some words are written here.", "en", "s", 28, "b", 2.0, 2), (4, "Some words are written here.", "en", "s", 28, "b", 2.0, 2), (None, "Other words stand in here.", "en", "t", 26, "c", 3.0, 3)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DATA)
            assert name == "best_fit_packing" or out.columns == docs.columns
            out.collect()
    kept = corpus_pipeline.STAGES[0][1](spark, spark.createDataFrame(rows, schema), DATA).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 4, 4] and {r.aside_0 for r in kept} == {"b", "c"}


def test_the_language_stage_rejects_and_labels(spark):
    docs = table(spark, DATA, "documents")
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    r = random.Random(3)
    foreign = [(10**6 + k, "".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(200)), None, "s", 200) for k in range(5)]
    own = docs.where("lang = 'en'").orderBy("doc_id").select("text").first()[0]
    more = [(10**6 + 10, own, None, "s", len(own)), (10**6 + 11, "Kurz.", None, "s", 5), (10**6 + 12, "123 -- 456", "en", "s", 10)]
    both = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(foreign + more, columns))
    kept = {x.doc_id: x.lang for x in corpus_pipeline.STAGES[0][1](spark, both, DATA).collect()}
    assert {k for k in kept if k >= 10**6} == {10**6 + 10, 10**6 + 11} and kept[10**6 + 10] == "en" and kept[10**6 + 11] is not None
    assert len(kept) == docs.count() + 2
    unknown = both.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.STAGES[0][1](spark, unknown, DATA).count() == docs.count() + 7


@pytest.mark.parametrize("name", ["op1_language_id", "op5_toxicity", "op6_best_fit_packing", "op8_sharding", "op9_mixing"])
def test_queries_cover_all_documents(spark, name):
    docs = table(spark, DATA, "documents")
    assert QUERIES[name](spark, DATA).select("doc_id").distinct().count() == docs.count()
