"""Reports over finished segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segloom.functions import text as T
from segloom.operators.exchange import rate, usage_totals

#: Reasons that are no failure.
LEGITIMATE = (T.NOT_SOURCE_LANGUAGE, T.UNTRANSLATABLE)


def run_report(rows: DataFrame, *by: str) -> DataFrame:
    """Totals for each value of by: every segment is translated or kept, and characters count in UTF-16 units.

    rows: text, translation, kept_reason.
    """
    kept = F.col("kept_reason").isNotNull()
    return rows.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(~kept).alias("translated"), F.count_if(kept).alias("kept"),
        F.count_if(F.col("kept_reason") == T.NOT_SOURCE_LANGUAGE).alias("not_source_language"), F.count_if(F.col("kept_reason") == T.UNTRANSLATABLE).alias("untranslatable"),
        F.coalesce(F.sum(T.utf16_length(F.col("text"))), F.lit(0)).alias("chars_source"), F.coalesce(F.sum(T.utf16_length(F.col("translation"))), F.lit(0)).alias("chars_translated"),
    )


def kept_by_reason(rows: DataFrame, *by: str) -> DataFrame:
    return rows.where("kept_reason is not null").groupBy(*by, "kept_reason").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def outcome(rows: DataFrame, *by: str) -> DataFrame:
    """Whether a run failed (nothing translated, and something kept for no legitimate reason) and whether all of it was gated."""
    reasons = F.col("kept_reason")
    return rows.groupBy(*by).agg(
        ((F.count_if(reasons.isNull()) == 0) & (F.count("*") > 0) & (F.count_if(reasons.isNotNull() & ~reasons.isin(*LEGITIMATE)) > 0)).alias("failed"),
        ((F.count_if(reasons == T.NOT_SOURCE_LANGUAGE) == F.count("*")) & (F.count("*") > 0)).alias("all_gated"),
    )


def throughput(completion_tokens: Column, eval_ms: Column, translated: Column, duration_ms: Column) -> list[Column]:
    return [rate(completion_tokens, eval_ms / 1000.0).alias("tokens_per_sec"), rate(translated, duration_ms / 60000.0).alias("segments_per_min")]


def full(rows: DataFrame, skipped: DataFrame, calls: DataFrame, by: str, model: str, phases: dict[str, int], connect_ms: int = 0) -> DataFrame:
    """One row for each file (by): totals, what was kept, overflowed or skipped, and what the model's calls took.

    rows: by, pos, id, text, translation, kept_reason, overflowed, fitted_size_pt. skipped: by, id, reason. calls: by,
    group_no, stage, content and the counters. phases: milliseconds of the run's steps, which all files share. The lists
    are as long as a file's own; a file all of whose content was skipped has a row too.
    """
    listed = lambda test, *own: F.array_sort(F.collect_list(F.when(test, F.struct("pos", "id", *own))))
    lists = rows.groupBy(by).agg(
        listed(F.col("kept_reason").isNotNull(), F.col("kept_reason").alias("reason")).alias("kept_original"), listed(F.col("overflowed"), F.col("fitted_size_pt").alias("size_pt")).alias("overflowed")
    )
    left_out = skipped.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("id", "reason"))).alias("skipped"))
    out = run_report(rows, by).join(lists, by).join(left_out, by, "full_outer").join(usage_totals(calls, by), by, "left")
    numbers = [c for c in out.columns if c != by and c not in ("kept_original", "overflowed", "skipped")]
    out = out.fillna(0, numbers).withColumns({c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("kept_original", "overflowed", "skipped")})
    spent = {"extract": 0, "connect": connect_ms, "translate": 0, "fit": 0, "apply": 0} | phases
    duration = sum(spent.values())
    told = {"model": F.lit(model), "duration_ms": F.lit(duration).cast("long"), "phase_ms": F.create_map(*[F.lit(x).cast(t) for k, v in spent.items() for x, t in ((k, "string"), (v, "long"))])}
    return out.withColumns(told).select("*", *throughput(F.col("completion_tokens"), F.col("eval_ms"), F.col("translated"), F.lit(duration)))


def _time(ms: Column) -> Column:
    return F.when(ms < 1000, F.format_string("%d ms", ms)).otherwise(F.format_string("%.2f s", ms / 1000))


def _entries(title: str, found: Column, value) -> Column:
    """A heading and a line for each entry; null without entries."""
    id_ = lambda e: F.when(F.length(e["id"]) < 28, F.rpad(e["id"], 28, " ")).otherwise(e["id"])
    listed = F.array_join(F.transform(found, lambda e: F.concat(F.lit("    "), id_(e), F.lit(" "), value(e))), "\n")
    return F.when(F.size(found) > 0, F.concat(F.lit(f"\n  {title}\n"), listed))


def lines(report: DataFrame, name: str) -> DataFrame:
    """The report as text, one string for each row; name is the column that tells the runs apart. Of full, all of it."""
    rule = F.lit("-" * 60)
    parts = [
        F.format_string("Translation report: %s", F.col(name).cast("string")), rule, F.format_string("  Total segments   %d", "total"), F.format_string("  Translated       %d", "translated"),
        F.format_string("  Kept original    %d", "kept"),
    ]
    chars = F.format_string("  Chars            %d source -> %d translated", "chars_source", "chars_translated")
    warning = F.when((F.col("total") > 0) & (F.col("not_source_language") == F.col("total")), F.lit("  WARNING: every segment was kept because its text is not in the declared source language."))
    if "phase_ms" not in report.columns:
        return report.select(name, F.concat_ws("\n", *parts, chars, warning).alias("report"))
    parts += [F.format_string("  Overflowed       %d", F.size("overflowed")), F.format_string("  Skipped          %d", F.size("skipped")), F.concat(F.lit("  Duration         "), F.col("duration_ms").cast("string"), F.lit(" ms"))]
    size = lambda e: F.regexp_replace(e["size_pt"].cast("string"), r"\.0$", "")
    parts += [_entries("Kept original (id -> reason)", F.col("kept_original"), lambda e: e["reason"]), warning, _entries("Overflowed (id -> font size pt)", F.col("overflowed"), size)]
    phases = F.concat_ws(", ", *[F.concat(F.lit(f"{p} "), _time(F.col("phase_ms")[p])) for p in ("extract", "connect", "translate", "fit", "apply")])
    tokens = F.format_string("  Tokens           %d prompt, %d completion, %.1f tok/s", "prompt_tokens", "completion_tokens", "tokens_per_sec")
    parts += [
        F.lit("\nProcessing stats"), rule, F.format_string("  Model            %s", "model"), F.concat(F.lit("  Phases           "), phases),
        F.format_string("  Groups/calls     %d groups, %d model calls, %d retries, %d per-segment fallbacks", "groups", "calls", "retries", "per_segment_fallbacks"),
        F.when((F.col("prompt_tokens") > 0) | (F.col("completion_tokens") > 0), tokens), chars, F.format_string("  Throughput       %.1f segments/min", "segments_per_min"),
    ]
    return report.select(name, F.concat_ws("\n", *parts).alias("report"))


def fit_table(fitted: DataFrame) -> DataFrame:
    """Lines and the share of the box height that they take, by segment. fitted: id, lines, size_pt, height."""
    used = F.round(F.size("lines") * F.col("size_pt") * 1.2 / F.col("height") * 100).cast("int")
    return fitted.select("id", F.size("lines").alias("n_lines"), "size_pt", used.alias("percent"))
