"""The exchange with a translation model: prompts, answers, their validation, and the ladder of attempts.

A provider is a function from requests (group, stage, system, user, ids, texts) to answers (group, stage, content and
usage counters; content null where the call failed). Providers may be costly or non-deterministic, so what they
return is written before anything reads it twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segloom.functions import text as T

# The answer's schema, the stages and the wording of the prompts.
ANSWER = "translations array<struct<id: string, translation: string>>"
STAGES = ("initial", "retry", "fallback")
SYSTEM = (
    "You are a professional translator for internal business documents.\n"
    "Translate each segment from {source} to {target}.\n"
    "Rules: return ONLY the JSON demanded by the schema; translate every segment independently; preserve line breaks inside segments; do not translate numbers, codes, or proper nouns that have no {target} equivalent; glossary (must-use): {glossary}.\n"
    "Document context: {context}"
)
RETRY = " Do not return any segment's source text unchanged: short labels, codes, and other terse alphanumeric segments must still be translated into {target} wherever they contain translatable words."
FALLBACK = (
    "\nAnti-echo rule: returning a segment's source text unchanged is a failure, not a safe fallback. This applies even to short labels, codes, and technical fragments - they must still be rendered in {target}: translate every translatable word, and keep only genuinely untranslatable tokens (product codes like \"HTHH-1\", proper-noun brand names) exactly as they appear in the source.\n"
    "Worked example: given the label \"2-10 Batch User-3 MPX\", a correct {target} translation renders \"Batch\" and \"User\" in {target} while keeping the code \"2-10\" and the brand acronym \"MPX\" unchanged, producing a mixed string rather than a verbatim copy of the source label. An ordinary dictionary word is still translatable even when written in capital letters."
)


def _filled(template: str, **values: Column) -> Column:
    """A template's parts joined with column values."""
    parts, rest = [], template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            parts.append(F.lit(head))
        name, _, rest = tail.partition("}") if brace else ("", "", "")
        if name:
            parts.append(values[name])
    return F.concat(*parts)


def glossary_text(glossary: Column) -> Column:
    """A map of terms as `term -> translation; ...`, or (none)."""
    terms = F.array_join(F.transform(F.map_entries(glossary), lambda e: F.concat(e["key"], F.lit(" -> "), e["value"])), "; ")
    return F.when(F.coalesce(F.size(glossary), F.lit(0)) <= 0, F.lit("(none)")).otherwise(terms)


def system_prompt(source: str, target: str, context: Column, stage: str | Column = "initial", glossary: Column | None = None) -> Column:
    own = F.lit("(none)") if glossary is None else glossary_text(glossary)
    base = _filled(SYSTEM, source=F.lit(source), target=F.lit(target), glossary=own, context=context)
    more = {"initial": F.lit(""), "retry": _filled(RETRY, target=F.lit(target)), "fallback": _filled(FALLBACK, target=F.lit(target))}
    if isinstance(stage, str):
        return F.concat(base, more[stage])
    return F.concat(base, F.when(stage == "retry", more["retry"]).when(stage == "fallback", more["fallback"]).otherwise(more["initial"]))


def user_prompt(segments: Column) -> Column:
    """An array of id and text as compact JSON."""
    return F.to_json(F.transform(segments, lambda s: F.struct(s["id"].alias("id"), s["text"].alias("text"))))


def transcript(system: Column, user: Column) -> Column:
    return F.concat(F.lit("System: "), system, F.lit("\nUser: "), user)


def requests(packed: DataFrame, contexts: DataFrame, source: str, target: str, stage: str) -> DataFrame:
    """One row for each group (doc_id, group_no), with its prompts. A group's size is bounded by the packing budget."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "id", "text")))
    grouped = packed.groupBy("doc_id", "group_no").agg(parts.alias("segments")).join(contexts.select("doc_id", "group_no", "group_context"), ["doc_id", "group_no"])
    return grouped.select("doc_id", "group_no", F.lit(stage).alias("stage"), system_prompt(source, target, F.col("group_context"), stage).alias("system"), user_prompt(F.col("segments")).alias("user"), "segments")


def parsed(content: Column) -> Column:
    """translations of an answer; null where it isn't what the schema demands, in any part."""
    answer = F.from_json(T.without_thoughts(content), ANSWER)["translations"]
    broken = answer.isNull() | F.exists(answer, lambda t: t["id"].isNull() | t["translation"].isNull())
    return F.when(~F.coalesce(broken, F.lit(True)), answer)


def validated(asked: DataFrame, answers: DataFrame, source: str, target: str, by: list[str]) -> DataFrame:
    """What became of each id: translation where it is good, else reason; ids nobody asked for come as id-mismatch too.

    asked: by, id, text. answers: by, id, translation. The order of the checks is missing or repeated, empty, echo.
    """
    per = answers.groupBy(*by, "id").agg(F.count("*").alias("times"), F.first("translation").alias("translation"))
    both = asked.join(per, [*by, "id"], "full_outer")
    reason = (
        F.when(F.col("text").isNull() | F.col("times").isNull() | (F.col("times") > 1), F.lit("id-mismatch"))
        .when(T.is_blank(F.col("translation")), F.lit("empty"))
        .when(T.is_echo(F.col("text"), F.col("translation"), source, target), F.lit("echo"))
    )
    checked = both.withColumn("reason", reason)
    return checked.select(*by, "id", F.when(F.col("reason").isNull(), F.col("translation")).alias("translation"), "reason", F.col("text").isNotNull().alias("requested"))


def resolved(attempts: DataFrame) -> DataFrame:
    """One row for each requested id: its first good translation, or the reason of its last failure.

    attempts: doc_id, id, stage_no, translation, reason.
    """
    good = F.col("translation").isNotNull()
    first = F.min_by("translation", F.when(good, F.col("stage_no")))
    last = F.max_by(F.coalesce("reason", F.lit("error")), F.when(~good, F.col("stage_no")))
    both = attempts.groupBy("doc_id", "id").agg(first.alias("translation"), last.alias("last"), F.max("stage_no").alias("stages"))
    return both.select("doc_id", "id", "translation", F.when(F.col("translation").isNull(), F.col("last")).alias("reason"), "stages")


def ladder(segments: DataFrame, answer: Callable[[DataFrame, int], DataFrame], source: str, target: str, settle: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All attempts: the whole group, the whole group again if anything in it is unresolved, then single segments.

    segments: doc_id, group_no, pos, id, text. answer: from segments and the number of the stage (1 to 3) to answers
    (doc_id, group_no, id, translation; at stage 3 each segment is a call of its own). settle writes a table and reads it.
    """
    by = ["doc_id", "group_no"]
    asked = segments.select(*by, "id", "text")
    done = None
    for stage in (1, 2, 3):
        if done is None:
            todo = asked
        else:
            good = done.where("translation is not null").select(*by, "id")
            left = asked.join(good, [*by, "id"], "left_anti")
            todo = left if stage == 3 else asked.join(left.select(*by).distinct(), by, "left_semi")
        checked = validated(todo, answer(todo, stage), source, target, by).where("requested")
        rows = settle(checked.select(*by, "id", F.lit(stage).alias("stage_no"), "translation", "reason"))
        done = rows if done is None else done.unionByName(rows)
    return done


def usage_totals(calls: DataFrame, *by: str) -> DataFrame:
    """Sums of the counters, and the number of groups (first calls); a failed call (content null) adds nothing but its retry or fallback.

    calls: by, stage, content, and the counters of each call in milliseconds and tokens; model_ms (with loading) may be left out.
    """
    if "model_ms" not in calls.columns:
        calls = calls.withColumn("model_ms", F.col("eval_ms"))
    came = F.col("content").isNotNull()
    add = lambda c: F.coalesce(F.sum(F.when(came, F.coalesce(c, F.lit(0)))), F.lit(0))
    return calls.groupBy(*by).agg(
        F.count_if(F.col("stage") == "initial").alias("groups"), F.count_if(came).alias("calls"), F.count_if(F.col("stage") == "retry").alias("retries"), F.count_if(F.col("stage") == "fallback").alias("per_segment_fallbacks"),
        add("prompt_tokens").alias("prompt_tokens"), add("completion_tokens").alias("completion_tokens"), add("model_ms").alias("model_ms"), add("eval_ms").alias("eval_ms"),
    )


def rate(amount: Column, per: Column) -> Column:
    return F.when(per > 0, amount / per).otherwise(F.lit(0.0))


def kept_originals(segments: DataFrame, outcome: DataFrame) -> DataFrame:
    """Each segment with its final text, and the reason where that is the original one.

    segments: with keep_reason. outcome: doc_id, id, translation, reason.
    """
    own = segments.join(outcome.select("doc_id", "id", "translation", F.col("reason").alias("failure")), ["doc_id", "id"], "left")
    reason = F.when(F.col("translation").isNull(), F.coalesce("keep_reason", "failure", F.lit(T.NO_TRANSLATION)))
    return own.select(*segments.columns, "translation", F.coalesce("translation", "text").alias("final_text"), reason.alias("kept_reason"))


def changed(rows: DataFrame) -> DataFrame:
    """What a writer has to touch: rows whose final text differs."""
    return rows.where(F.col("final_text") != F.col("text"))


def synced_cache(runs: DataFrame, translations: DataFrame) -> DataFrame:
    """Cached drawing runs with the translation of their exact text; texts with several translations are left alone.

    runs: doc_id, drawing, text. translations: doc_id, drawing, text, translation.
    """
    sure = translations.groupBy("doc_id", "drawing", "text").agg(F.count_distinct("translation").alias("n"), F.min("translation").alias("translation")).where("n = 1").drop("n")
    return runs.join(sure, ["doc_id", "drawing", "text"])
