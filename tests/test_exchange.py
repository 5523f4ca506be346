from __future__ import annotations

import json

from pyspark.sql import functions as F

from segloom.operators import exchange as X
from segloom.operators import report
from segloom.operators import segments as S
from segloom.plans.settled import settled


def test_answers_that_break_the_schema_are_null(spark):
    texts = ['{"translations":[{"id":"a","translation":"x"}]}', "<think>no</think>{\"translations\":[]}", "nonsense", '{"translations":[{"id":"a"}]}', '{"other":1}', None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, c string")
    got = [r[0] for r in df.orderBy("k").select(X.parsed(F.col("c"))).collect()]
    assert [None if g is None else [(t.id, t.translation) for t in g] for g in got] == [[("a", "x")], [], None, None, None, None]


def test_validation_order_and_unknown_ids(spark):
    asked = spark.createDataFrame([(1, "a", "Hello"), (1, "b", "World"), (1, "c", "12"), (1, "d", "Four"), (1, "e", "Five")], "g int, id string, text string")
    answers = spark.createDataFrame([(1, "a", " hello"), (1, "b", "　"), (1, "c", "12"), (1, "d", "x"), (1, "d", "x"), (1, "z", "?")], "g int, id string, translation string")
    got = {r.id: (r.translation, r.reason, r.requested) for r in X.validated(asked, answers, "English", "German", ["g"]).collect()}
    assert got == {
        "a": (None, "echo", True), "b": (None, "empty", True), "c": ("12", None, True), "d": (None, "id-mismatch", True), "e": (None, "id-mismatch", True), "z": (None, "id-mismatch", False),
    }


def test_the_ladder_keeps_first_successes_and_last_reasons(spark):
    rows = spark.createDataFrame([(1, 0, 0, "a", "One"), (1, 0, 1, "b", "Two"), (1, 0, 2, "c", "Three"), (1, 1, 3, "d", "Four")], "doc_id long, group_no int, pos int, id string, text string")
    seen = []

    def answer(todo, stage):
        seen.append((stage, sorted(r.id for r in todo.select("id").collect())))
        # a is good at once; b at the second stage; c never, in another way each time; d at once.
        text = F.when(F.col("id") == "a", F.lit(f"first{stage}")).when(F.col("id") == "b", F.lit("Two" if stage == 1 else "zwei")).when(F.col("id") == "c", F.lit({1: "Three", 2: " ", 3: "three"}[stage])).otherwise(F.lit("vier"))
        return todo.select("doc_id", "group_no", "id", text.alias("translation"))

    got = {r.id: (r.translation, r.reason, r.stages) for r in X.resolved(X.ladder(rows, answer, "English", "German", settled)).collect()}
    assert got == {"a": ("first1", None, 2), "b": ("zwei", None, 2), "c": (None, "echo", 3), "d": ("vier", None, 1)}
    assert [s for s in seen if s[0] > 1] == [(2, ["a", "b", "c"]), (3, ["c"])]


def test_prompts(spark):
    rows = spark.createDataFrame([(1, 0, "1/0", 'Ünï "x"\n', "c", "g"), (1, 1, "1/1", "b", "d", "g")], "doc_id long, pos int, id string, text string, context string, group_key string")
    packed = S.packed(rows)
    asked = X.requests(packed, S.group_contexts(packed), "English", "German", "retry").first()
    assert asked.user == json.dumps([{"id": "1/0", "text": 'Ünï "x"\n'}, {"id": "1/1", "text": "b"}], ensure_ascii=False, separators=(",", ":"))
    assert "glossary (must-use): (none).\nDocument context: g: c, d Do not return" in asked.system and "from English to German" in asked.system
    glossary = spark.range(1).select(X.glossary_text(F.create_map(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d"))), X.glossary_text(F.lit(None).cast("map<string,string>"))).first()
    assert tuple(glossary) == ("a -> b; c -> d", "(none)")


def test_usage_and_rates(spark):
    calls = spark.createDataFrame([("initial", "x", 5, 10, 500.0), ("retry", None, 7, 9, 9.0), ("fallback", "y", None, 10, 500.0)], "stage string, content string, prompt_tokens int, completion_tokens int, eval_ms double")
    got = X.usage_totals(calls).first()
    assert (got.calls, got.retries, got.per_segment_fallbacks, got.prompt_tokens, got.completion_tokens, got.eval_ms) == (2, 1, 1, 5, 20, 1000.0)
    assert tuple(spark.range(1).select(*report.throughput(F.lit(20), F.lit(1000.0), F.lit(3), F.lit(0.0))).first()) == (20.0, 0.0)


def test_report_reconciles(spark):
    rows = spark.createDataFrame([("a", "1", "one", None), ("b", "2", None, "echo"), ("c", "3", None, "skipped-untranslatable")], "id string, text string, translation string, kept_reason string")
    got = report.run_report(rows).first()
    assert got.total == got.translated + got.kept == 3 and (got.chars_source, got.chars_translated) == (3, 3)
    failed = report.outcome(rows.where("translation is null")).first()
    assert failed.failed and not failed.all_gated
    assert not report.outcome(rows.where("id = 'c'")).first().failed


def test_ambiguous_cache_texts_stay(spark):
    runs = spark.createDataFrame([(1, "d", "x"), (1, "d", "y")], "doc_id int, drawing string, text string")
    given = spark.createDataFrame([(1, "d", "x", "1"), (1, "d", "x", "2"), (1, "d", "y", "3"), (1, "d", "y", "3")], "doc_id int, drawing string, text string, translation string")
    assert [(r.text, r.translation) for r in X.synced_cache(runs, given).collect()] == [("y", "3")]
