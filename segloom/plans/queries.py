"""Queries over the driver's tables, by name, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segloom.functions import boxes as B
from segloom.functions import text as T
from segloom.operators import evaluate as E
from segloom.operators import exchange as X
from segloom.operators import imagetext, pixels
from segloom.operators import layout as L
from segloom.operators import regions as G
from segloom.operators import report
from segloom.operators import segments as S
from segloom.operators.ordered import spread
from segloom.operators.providers import echo_factory
from segloom.plans import decks
from segloom.plans.inputs import REGIONS, SEGMENTS_SQL, SOURCE, TARGET, lines, read, regions
from segloom.plans.settled import settled
from segloom.plans.translate import translate
from segloom.sources import decks as Z
from segloom.sources import documents as D
from segloom.sources import vision

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SMALL, LARGE = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
CJK = r"[\x{3000}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]"
#: Documents with CJK, blank and numeric variants, which the tables don't have.
VARIANTS = "case doc_id % 7 when 0 then '质量报告 管理' || left(text, 3) when 1 then text || ' 质量' when 2 then '3500 / 48.5%' when 3 then '  ' || chr(12288) || chr(160) || ' ' else text end"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def trimmed_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{WS}+', ''), '{WS}+$', '')"


def ratio_sql(c: str) -> str:
    shown = f"regexp_replace({c}, '{WS}', '', 'g')"
    return f"case when length({shown}) = 0 then 0.0 else cast(len(regexp_extract_all({shown}, '{CJK}')) as double) / length({shown}) end"


def gate_sql(c: str) -> str:
    return f"case when ({ratio_sql(c)}) >= 0.3 then 'not-source-language' when not regexp_matches({c}, '\\p{{L}}') then 'skipped-untranslatable' end"


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = VARIANTS.replace("chr(12288)", "'　'").replace("chr(160)", "' '").replace("'　'", "decode(unhex('E38080'), 'UTF-8')").replace("' '", "decode(unhex('C2A0'), 'UTF-8')")
    return spread(read(spark, sf_dir, "documents").select("doc_id", "source", "text")).selectExpr("doc_id", "source", f"{sql} as text")


# Scans, identity and filters


@query(f"with {SEGMENTS_SQL} select doc_id, pos, id, text, context, group_key from seg")
def extract_segments(spark, sf_dir):
    return lines(spark, sf_dir)


@query("""with p as (select distinct url as path, page_id % 5 as k, page_id from pages), q as (select 'run/' || page_id || case k when 0 then '.pptx' when 1 then '.FAKE.JSON' when 2 then '.jpeg' when 3 then '.json' else '.tar.gz' end as path from p),
a(adapter, extension) as (values ('fake', '.fake.json'), ('pptx', '.pptx'), ('image', '.png'), ('image', '.jpg'), ('image', '.jpeg')),
m as (select path, max_by(adapter, length(extension)) as adapter, max_by(extension, length(extension)) as extension from q left join a on ends_with(lower(path), extension) group by path),
n as (select path, adapter, coalesce(extension, regexp_extract(path, '[^/](\\.[^./]*)$', 1)) as own from m)
select path, adapter, left(path, length(path) - length(own)) || '_translated' || own as out_path from n""")
def adapter_resolution(spark, sf_dir):
    tail = F.element_at(F.array(*[F.lit(x) for x in (".pptx", ".FAKE.JSON", ".jpeg", ".json", ".tar.gz")]), (F.col("page_id") % 5 + 1).cast("int"))
    paths = read(spark, sf_dir, "pages").select(F.concat(F.lit("run/"), F.col("page_id").cast("string"), tail).alias("path"))
    return S.extensions_resolved(paths, D.adapters(spark))


@query(f"with {SEGMENTS_SQL} select id, text from seg where regexp_matches(text, '\\p{{L}}')")
def translatable_filter(spark, sf_dir):
    return lines(spark, sf_dir).where(T.has_letters(F.col("text"))).select("id", "text")


@query(f"with v as (select doc_id, {VARIANTS} as text from documents) select doc_id, {gate_sql('text')} as keep_reason, round({ratio_sql('text')}, 9) as ratio, regexp_matches(text, '{CJK}') as cjk from v")
def language_gate_reason(spark, sf_dir):
    return variants(spark, sf_dir).select("doc_id", T.keep_reason(SOURCE, F.col("text")).alias("keep_reason"), F.round(T.cjk_ratio(F.col("text")), 9).alias("ratio"), T.contains_cjk(F.col("text")).alias("cjk"))


@query(f"with v as (select doc_id, {VARIANTS} as text from documents) select doc_id, {trimmed_sql('text')} as text from v where {trimmed_sql('text')} <> ''")
def blank_filter_js_trim(spark, sf_dir):
    return variants(spark, sf_dir).where(~T.is_blank(F.col("text"))).select("doc_id", T.trimmed(F.col("text")).alias("text"))


@query(f"with {SEGMENTS_SQL} select doc_id, id, count(*) as n from (select doc_id, doc_id || '/' || (pos % 7) as id from seg) group by all having count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return S.duplicate_ids(lines(spark, sf_dir).withColumn("id", F.concat_ws("/", "doc_id", F.col("pos") % 7)))


@query(f"with {SEGMENTS_SQL}, b as (select doc_id, pos, 's' || (pos % 4) as base from seg) select doc_id, pos, base, case when row_number() over w = 1 then base else base || '-' || row_number() over w end as id from b window w as (partition by doc_id, base order by pos)")
def unique_ids(spark, sf_dir):
    return S.suffixed_ids(lines(spark, sf_dir).select("doc_id", "pos", F.concat(F.lit("s"), (F.col("pos") % 4).cast("string")).alias("base")))


@query("select user_id, event_type, event_id, ts from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as k from events) where k = 1")
def first_usage(spark, sf_dir):
    return S.first_usage(read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"])


# Grouping


@query("""with t as (select conv_id, cast(turn as integer) as pos, role as key, text, case when row_number() over w > 1 and role is distinct from lag(role) over w then 1 else 0 end as c from conversations where regexp_matches(text, '\\p{L}') window w as (partition by conv_id order by turn))
select conv_id as doc_id, pos, key, cast(sum(c) over (partition by conv_id order by pos) as integer) as island from t""")
def segment_islands(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("pos"), "text", F.col("role").alias("context"), F.lit(None).cast("string").alias("group_key"))
    return S.islands(turns).select("doc_id", "pos", "key", "island")


PACKED_SQL = f"""with recursive {SEGMENTS_SQL}, kept as (select *, length(text) as units, row_number() over (partition by doc_id order by pos) as k from seg where regexp_matches(text, '\\p{{L}}')),
packed as (select doc_id, k, units, units as held, 0 as group_no from kept where k = 1
  union all select n.doc_id, n.k, n.units, case when p.held + n.units > 2000 then n.units else p.held + n.units end, case when p.held + n.units > 2000 then p.group_no + 1 else p.group_no end
  from packed p join kept n on n.doc_id = p.doc_id and n.k = p.k + 1)"""


@query(f"{PACKED_SQL} select id, p.group_no, p.units from packed p join kept using (doc_id, k)")
def pack_groups_2000(spark, sf_dir):
    return S.packed(lines(spark, sf_dir), keep=("id",)).select("id", "group_no", "units")


@query(f"{PACKED_SQL} select doc_id, group_no, any_value(group_key) || ': ' || string_agg(distinct context, ', ' order by context) as group_context, count(*) as segments, cast(sum(p.units) as bigint) as units from packed p join kept using (doc_id, k) group by doc_id, group_no")
def group_context(spark, sf_dir):
    return S.group_contexts(S.packed(lines(spark, sf_dir), keep=("context", "group_key")))


SYSTEM_SQL = "'" + X.SYSTEM.replace("'", "''").replace("{source}", SOURCE).replace("{target}", TARGET).replace("{glossary}", "(none)").replace("{context}", "' || source || '") + "'"


@query(f"select doc_id, {SYSTEM_SQL} as initial, md5({SYSTEM_SQL} || '{X.RETRY.replace(chr(39), chr(39) * 2).replace('{target}', TARGET)}') as retry, md5({SYSTEM_SQL} || '{X.FALLBACK.replace(chr(39), chr(39) * 2).replace('{target}', TARGET)}') as fallback from documents")
def prompt_system(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    prompt = lambda stage: X.system_prompt(SOURCE, TARGET, F.col("source"), stage)
    return docs.select("doc_id", prompt("initial").alias("initial"), F.md5(prompt("retry")).alias("retry"), F.md5(prompt("fallback")).alias("fallback"))


@query()
def prompt_requests(spark, sf_dir):
    """Requests of all groups with their JSON, which engines escape differently: held against plain code in the tests."""
    packed = S.packed(lines(spark, sf_dir))
    asked = X.requests(packed, S.group_contexts(packed), SOURCE, TARGET, "initial")
    return asked.select("doc_id", "group_no", "user", F.md5(X.transcript(F.col("system"), F.col("user"))).alias("transcript"))


# Answers: the provider repeats the text after the language, with faults by doc_id and position

FAULT = "(doc_id * 31 + pos) % 11"
ANSWER_SQL = f"""select doc_id, pos, id, case {FAULT} when 3 then ' ' || chr(9) when 4 then translate(text, '{SMALL}', '{LARGE}') || ' ' else '[German] ' || text end as translation from seg where {FAULT} <> 1
union all select doc_id, pos, id, 'again' from seg where {FAULT} = 2 union all select doc_id, pos, id || '?', 'who' from seg where {FAULT} = 5"""
CHECKED_SQL = f"""with {SEGMENTS_SQL}, answers as ({ANSWER_SQL}), per as (select doc_id, id, count(*) as times, any_value(translation) as translation from answers group by all),
both_ as (select coalesce(s.doc_id, p.doc_id) as doc_id, coalesce(s.id, p.id) as id, s.text, p.times, p.translation, s.text is not null as requested from seg s full join per p on s.doc_id = p.doc_id and s.id = p.id),
checked as (select *, case when not requested or times is null or times > 1 then 'id-mismatch' when {trimmed_sql('translation')} = '' then 'empty'
  when regexp_matches(text, '\\p{{L}}') and lower({trimmed_sql('text')}) = lower({trimmed_sql('translation')}) then 'echo' end as reason from both_)"""


def answers(rows: DataFrame, stage: int = 1) -> DataFrame:
    """Answers with faults; at later stages only the places that are divisible by the stage fail again."""
    fault = F.expr(FAULT) if stage == 1 else F.when(F.expr(f"(doc_id + pos) % {stage + 1} = 0"), F.expr(FAULT)).otherwise(F.lit(0))
    text = F.when(fault == 3, F.lit(" \t")).when(fault == 4, F.concat(F.translate("text", SMALL, LARGE), F.lit(" "))).otherwise(F.concat(F.lit("[German] "), "text"))
    one = lambda i, t: F.struct(i.alias("id"), t.alias("translation"))
    given, none = one(F.col("id"), text), F.array().cast("array<struct<id: string, translation: string>>")
    more = F.when(fault == 1, none).when(fault == 2, F.array(given, one(F.col("id"), F.lit("again")))).when(fault == 5, F.array(given, one(F.concat("id", F.lit("?")), F.lit("who")))).otherwise(F.array(given))
    return rows.select(*[c for c in rows.columns if c not in ("id", "text", "pos")], F.inline(more))


@query(f"{CHECKED_SQL} select id, case when reason is null then translation end as translation, reason, requested from checked")
def validate_batch(spark, sf_dir):
    rows = lines(spark, sf_dir)
    return X.validated(rows.select("doc_id", "id", "text"), answers(rows).select("doc_id", "id", "translation"), SOURCE, TARGET, ["doc_id"]).drop("doc_id")


def stage_sql(k: int) -> str:
    """Outcomes of a later stage: the reason where the fault stays, else null."""
    fault = f"case when (doc_id + pos) % {k + 1} = 0 then {FAULT} else 0 end"
    return f"case {fault} when 1 then 'id-mismatch' when 2 then 'id-mismatch' when 3 then 'empty' when 4 then case when letters then 'echo' end end"


LADDER_SQL = f"""{PACKED_SQL}, base as (select k.doc_id, k.pos, k.id, k.text, p.group_no, true as letters from packed p join kept k using (doc_id, k)),
one as (select *, case {FAULT} when 1 then 'id-mismatch' when 2 then 'id-mismatch' when 3 then 'empty' when 4 then 'echo' end as r1 from base),
two as (select *, bool_or(r1 is not null) over (partition by doc_id, group_no) as again, {stage_sql(2)} as f2 from one),
three as (select *, r1 is null or (again and f2 is null) as good2, {stage_sql(3)} as f3 from two)
"""


def attempts(spark, sf_dir) -> DataFrame:
    rows = S.packed(lines(spark, sf_dir)).select("doc_id", "group_no", "pos", "id", "text")
    places = settled(rows)

    def answer(todo: DataFrame, stage: int) -> DataFrame:
        return answers(todo.join(places.select("doc_id", "id", "pos"), ["doc_id", "id"]), stage).select("doc_id", "group_no", "id", "translation")

    return X.ladder(places, answer, SOURCE, TARGET, settled)


@query(f"""{LADDER_SQL} select id, case when r1 is null or good2 or f3 is null then case when r1 is null and {FAULT} = 4 then translate(text, '{SMALL}', '{LARGE}') || ' '
  when r1 is null and {FAULT} = 3 then ' ' || chr(9) else '[German] ' || text end end as translation,
  case when not good2 then f3 end as reason, case when not again then 1 when good2 then 2 else 3 end as stages from three""")
def ladder_resolution(spark, sf_dir):
    return X.resolved(attempts(spark, sf_dir)).select("id", "translation", "reason", "stages")


@query("""with c as (select user_id % 50 as run, case event_id % 6 when 0 then 'retry' when 1 then 'fallback' else 'initial' end as stage, event_id % 9 <> 0 as came, user_id % 97 as p, event_id % 53 as q, cast(event_id % 1000 as double) as ms from events)
select run, count(*) filter (stage = 'initial') as groups, count(*) filter (came) as calls, count(*) filter (stage = 'retry') as retries, count(*) filter (stage = 'fallback') as per_segment_fallbacks, cast(coalesce(sum(p) filter (came), 0) as bigint) as prompt_tokens,
  cast(coalesce(sum(q) filter (came), 0) as bigint) as completion_tokens, coalesce(sum(ms) filter (came), 0.0) as eval_ms, coalesce(sum(ms + 5) filter (came), 0.0) as model_ms, round(case when coalesce(sum(ms) filter (came), 0) > 0 then coalesce(sum(q) filter (came), 0) / (sum(ms) filter (came) / 1000) else 0.0 end, 6) as tokens_per_sec from c group by run""")
def ladder_usage(spark, sf_dir):
    e = F.col("event_id")
    calls = read(spark, sf_dir, "events").select(
        (F.col("user_id") % 50).alias("run"), F.when(e % 6 == 0, "retry").when(e % 6 == 1, "fallback").otherwise("initial").alias("stage"), F.when(e % 9 != 0, F.lit("{}")).alias("content"),
        (F.col("user_id") % 97).alias("prompt_tokens"), (e % 53).alias("completion_tokens"), (e % 1000).cast("double").alias("eval_ms"), (e % 1000 + 5).cast("double").alias("model_ms"),
    )
    return X.usage_totals(calls, "run").withColumn("tokens_per_sec", F.round(X.rate(F.col("completion_tokens"), F.col("eval_ms") / 1000.0), 6))


KEPT_SQL = f"""{CHECKED_SQL}, kept as (select s.*, case when {gate_sql('s.text')} is null and c.reason is null then c.translation end as translation,
  coalesce({gate_sql('s.text')}, c.reason) as kept_reason from seg s join checked c on c.doc_id = s.doc_id and c.id = s.id)"""


def finished(spark, sf_dir) -> DataFrame:
    """Every segment through gate, one call and validation."""
    gated = S.gated(lines(spark, sf_dir), SOURCE)
    todo = gated.where("keep_reason is null")
    checked = X.validated(todo.select("doc_id", "id", "text"), answers(todo).select("doc_id", "id", "translation"), SOURCE, TARGET, ["doc_id"])
    return X.kept_originals(gated, checked.where("requested"))


@query(f"{KEPT_SQL} select id, coalesce(translation, text) as final_text, kept_reason from kept where coalesce(translation, text) <> text or kept_reason is not null")
def resolve_or_keep(spark, sf_dir):
    rows = finished(spark, sf_dir)
    return rows.where((F.col("final_text") != F.col("text")) | F.col("kept_reason").isNotNull()).select("id", "final_text", "kept_reason")


@query(f"""{KEPT_SQL} select context, count(*) as total, count(*) filter (kept_reason is null) as translated, count(kept_reason) as kept, count(*) filter (kept_reason = 'not-source-language') as not_source_language,
  count(*) filter (kept_reason = 'skipped-untranslatable') as untranslatable, cast(sum(length(text)) as bigint) as chars_source, cast(coalesce(sum(length(translation)), 0) as bigint) as chars_translated from kept group by context""")
def run_report(spark, sf_dir):
    return report.run_report(finished(spark, sf_dir), "context")


@query(f"{KEPT_SQL} select context, kept_reason, count(*) as n, min(id) as first_id from kept where kept_reason is not null group by all")
def kept_by_reason(spark, sf_dir):
    return report.kept_by_reason(finished(spark, sf_dir), "context")


@query(f"{KEPT_SQL} select doc_id, count(*) filter (kept_reason is null) = 0 and count(*) filter (kept_reason not in ('not-source-language', 'skipped-untranslatable')) > 0 as failed, count(*) filter (kept_reason = 'not-source-language') = count(*) as all_gated from kept group by doc_id")
def failed_run_flag(spark, sf_dir):
    return report.outcome(finished(spark, sf_dir), "doc_id")


@query(f"""with {SEGMENTS_SQL}, t as (select doc_id, pos % 3 as drawing, text, case when pos % 5 = 0 then translate(text, '{SMALL}', '{LARGE}') else '[German] ' || text end as translation from seg),
sure as (select doc_id, drawing, text, min(translation) as translation from t group by all having count(distinct translation) = 1)
select s.id, s.text, sure.translation from (select *, (pos + 1) % 3 as drawing from seg) s join sure using (doc_id, drawing, text)""")
def smartart_sync(spark, sf_dir):
    rows = lines(spark, sf_dir)
    given = rows.select("doc_id", (F.col("pos") % 3).alias("drawing"), "text", F.when(F.col("pos") % 5 == 0, F.translate("text", SMALL, LARGE)).otherwise(F.concat(F.lit("[German] "), "text")).alias("translation"))
    return X.synced_cache(rows.withColumn("drawing", (F.col("pos") + 1) % 3), given).select("id", "text", "translation")


@query(decks.INHERIT_SQL)
def placeholder_inherit(spark, sf_dir):
    """A placeholder's box is its own, else its layout's, else its master's, for the same role and index."""
    role = F.when(F.col("context") == "slide title", "title").when(F.col("context") == "body", "body").otherwise("dt")
    return decks.texts(spark, sf_dir).where("startswith(id, 'slide2/shape[name=P_')").select("path", role.alias("role"), "box_w")


@query(decks.SEGMENTS_SQL)
def deck_segments(spark, sf_dir):
    return decks.texts(spark, sf_dir)


@query(decks.SKIPS_SQL)
def deck_skips(spark, sf_dir):
    return Z.skipped(decks.customer_decks(spark, sf_dir))


@query(decks.MEDIA_SQL)
def deck_media(spark, sf_dir):
    return Z.media(decks.customer_decks(spark, sf_dir)).select("path", "media_path", "slide_no", F.length("content").alias("bytes"), "reason")


@query(decks.WRITTEN_SQL)
def deck_written(spark, sf_dir):
    return decks.written(spark, sf_dir)


# Regions

AREA = "greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y))"
INTER = AREA.format(a="a", b="b")
IOU_SQL = f"(case when {INTER} > 0 then cast({INTER} as double) / (a.w * a.h + b.w * b.h - {INTER}) else 0.0 end)"
TEXT_OK = f"length({trimmed_sql('text')}) > 0 and len(regexp_extract_all({trimmed_sql('text')}, '[\\p{{L}}\\p{{N}}]')) >= 2"


def flat(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in ("box", "ink", "rotated", "rotation")], "box.x", "box.y", "box.w", "box.h")


@query(f"with r as ({REGIONS}) select image_id, pos, {trimmed_sql('text')} as text, x, y, w, h, confidence, part, case when confidence < 0.6 then 'low-confidence region' end as skip from r where w >= 8 and h >= 4 and {TEXT_OK}")
def region_filters(spark, sf_dir):
    kept = G.filtered(regions(spark, sf_dir))
    return flat(kept.withColumn("skip", G.skip_reason(F.col("confidence"), F.col("rotated"), F.col("rotation"))))


@query(f"""with r as ({REGIONS}) select a.image_id, a.pos as a_pos, b.pos as b_pos, round({IOU_SQL}, 9) as iou, round(cast({INTER} as double) / least(a.w * a.h, b.w * b.h), 9) as containment,
  {IOU_SQL} > 0.5 or cast({INTER} as double) / least(a.w * a.h, b.w * b.h) >= 0.8 as merge, least(a.x, b.x) as x, greatest(a.y + a.h, b.y + b.h) - least(a.y, b.y) as h
from r a join r b on a.image_id = b.image_id and a.pos < b.pos and {INTER} > 0""")
def region_pairs_iou(spark, sf_dir):
    rows = regions(spark, sf_dir)
    a, b = rows.select("image_id", F.col("pos").alias("a_pos"), F.col("box").alias("a")), rows.select("image_id", F.col("pos").alias("b_pos"), F.col("box").alias("b"))
    x, y = F.col("a"), F.col("b")
    both = a.join(b, "image_id").where((F.col("a_pos") < F.col("b_pos")) & (B.intersection(x, y) > 0))
    return both.select("image_id", "a_pos", "b_pos", F.round(B.iou(x, y), 9).alias("iou"), F.round(B.containment(x, y), 9).alias("containment"), B.should_merge(x, y).alias("merge"), B.union(x, y)["x"].alias("x"), B.union(x, y)["h"].alias("h"))


@query()
def region_merge(spark, sf_dir):
    """Merging to a fixpoint in order has no plain SQL form; the tests hold it against simple code."""
    return flat(G.merged(regions(spark, sf_dir)))


@query(f"""with r as ({REGIONS}), m as (select *, max(y + h) over (partition by image_id order by y, pos rows between unbounded preceding and 1 preceding) as reach from r),
b as (select *, cast(sum(case when reach is null or y >= reach then 1 else 0 end) over (partition by image_id order by y, pos) as integer) as band from m)
select image_id, pos, band, cast(row_number() over (partition by image_id order by band, x, y, pos) as integer) as "order" from b""")
def reading_order(spark, sf_dir):
    return G.in_reading_order(regions(spark, sf_dir)).select("image_id", "pos", "band", "order")


@query(f"""with r as ({REGIONS}), d as (select image_id, pos, greatest(0, x - 2) as x2, greatest(0, y - 2) as y2, least(200, x + w + 2) as right_, least(100, y + h + 2) as bottom_ from r)
select image_id, pos, x2 as x, y2 as y, right_ - x2 as w, bottom_ - y2 as h from d where right_ > x2 and bottom_ > y2""")
def dilate_clamp(spark, sf_dir):
    grown = regions(spark, sf_dir).withColumn("box", B.dilated(F.col("box"), F.lit(200), F.lit(100))).where("box.w > 0 and box.h > 0")
    return flat(grown.select("image_id", "pos", "box"))


@query(f"""with r as ({REGIONS}), c as (select * from r where part = 1),
s as (select a.image_id, a.pos, max({IOU_SQL}) as iou, max({INTER} * 1.0 / greatest(1, b.w * b.h)) as swallowed, max({INTER} * 1.0 / greatest(1, a.w * a.h)) as contained, count(*) as crossed
  from c a join r b on a.image_id = b.image_id and b.part = 0 and {INTER} > 0 group by all),
f as (select distinct a.image_id, a.pos from c a join r b on a.image_id = b.image_id and b.part = 2 and {INTER} > 0)
select c.image_id, c.pos from c left join s on s.image_id = c.image_id and s.pos = c.pos left join f on f.image_id = c.image_id and f.pos = c.pos
where case when s.crossed is null then f.pos is not null or greatest(c.w, c.h) * 1.0 / greatest(1, least(c.w, c.h)) >= 2 else s.iou <= 0.3 and s.swallowed < 0.5 and s.contained < 0.6 and s.crossed < 3 end""")
def rotation_kills(spark, sf_dir):
    rows = regions(spark, sf_dir)
    return G.rotation_kept(rows.where("part = 1"), rows.where("part = 0"), rows.where("part = 2")).select("image_id", "pos")


@query()
def rotated_dedup(spark, sf_dir):
    return flat(G.rotated_dedup(regions(spark, sf_dir)))


@query()
def double_votes(spark, sf_dir):
    return flat(G.double_votes_resolved(regions(spark, sf_dir)))


@query()
def rotation_passes(spark, sf_dir):
    """All three passes together: clean, flagged and turned regions of each image."""
    rows = regions(spark, sf_dir).drop("part").withColumn("k", F.col("pos") % 4)
    pass_ = lambda k: rows.where(F.col("k") == k).drop("k")
    upright = rows.where("k < 2").withColumn("rotated", F.col("k") == 1).drop("k")
    images = rows.select("image_id", F.lit(200).cast("long").alias("height"), F.lit(200).cast("long").alias("width")).distinct()
    return flat(G.with_rotation_passes(upright, pass_(2), pass_(3), images)).drop("part")


@query()
def validated_regions(spark, sf_dir):
    rows = regions(spark, sf_dir).drop("part")
    images = rows.select("image_id", F.lit(200).cast("long").alias("width"), F.lit(100).cast("long").alias("height")).distinct()
    return G.validated(rows, images).select("image_id", "id", "text", "confidence", "box.x", "box.y", "box.w", "box.h", F.col("ink.h").alias("ink_h"))


@query(f"""with r as ({REGIONS}) select image_id, pos, case when pos % 3 = 0 then w else h end as ink_height, case when pos % 3 = 0 then h else w end as fit_width, case when pos % 3 = 0 then w else h end as fit_height_floor from r""")
def sizing_axes(spark, sf_dir):
    turned = F.when(F.col("pos") % 3 == 0, F.lit(90)).otherwise(F.lit(0))
    return regions(spark, sf_dir).select("image_id", "pos", B.sizing_axes(F.col("box"), F.col("ink"), turned).alias("s")).select("image_id", "pos", "s.*")


# Evaluation

FOUND_SQL = f"r as ({REGIONS}), t as (select * from r where part <> 2), d as (select image_id, pos, x + 3 as x, y + 2 as y, w, h, text from r where part <> 1 or pos % 2 = 0)"


def truth_and_found(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = regions(spark, sf_dir)
    moved = rows.where("part <> 1 or pos % 2 = 0").withColumn("box", B.box(F.col("box.x") + 3, F.col("box.y") + 2, F.col("box.w"), F.col("box.h")))
    return rows.where("part <> 2"), moved


@query(f"with {FOUND_SQL} select a.image_id, a.pos as truth_pos, b.pos as found_pos, round({IOU_SQL}, 9) as iou from t a join d b on a.image_id = b.image_id and {IOU_SQL} >= 0.4")
def truth_pairs(spark, sf_dir):
    return E.pairs(*truth_and_found(spark, sf_dir), E.RELAXED).select("image_id", "truth_pos", "found_pos", F.round("iou", 9).alias("iou"))


@query()
def greedy_match(spark, sf_dir):
    return E.matched(E.pairs(*truth_and_found(spark, sf_dir), E.STRICT))


@query(f"""with {FOUND_SQL}, p as (select a.image_id, a.pos, a.w * a.h as area, greatest(a.x, b.x) as x1, greatest(a.y, b.y) as y1, least(a.x + a.w, b.x + b.w) as x2, least(a.y + a.h, b.y + b.h) as y2 from t a join d b on a.image_id = b.image_id and {INTER} > 0),
xs as (select distinct image_id, pos, unnest([x1, x2]) as e from p), ys as (select distinct image_id, pos, unnest([y1, y2]) as e from p),
xc as (select *, lead(e) over (partition by image_id, pos order by e) as n from xs), yc as (select *, lead(e) over (partition by image_id, pos order by e) as n from ys),
cells as (select distinct p.image_id, p.pos, xc.e as xa, xc.n as xb, yc.e as ya, yc.n as yb from p join xc on xc.image_id = p.image_id and xc.pos = p.pos and xc.n is not null and xc.e >= x1 and xc.n <= x2
  join yc on yc.image_id = p.image_id and yc.pos = p.pos and yc.n is not null and yc.e >= y1 and yc.n <= y2),
u as (select image_id, pos, sum((xb - xa) * (yb - ya)) as covered from cells group by all)
select t.image_id, t.pos, round(coalesce(cast(u.covered as double) / (t.w * t.h), 0.0), 9) as share, coalesce(cast(u.covered as double) / (t.w * t.h), 0.0) >= 0.7 as covered from t left join u on u.image_id = t.image_id and u.pos = t.pos""")
def union_area_coverage(spark, sf_dir):
    return E.coverage(*truth_and_found(spark, sf_dir)).select("image_id", "pos", F.round("share", 9).alias("share"), "covered")


@query(f"""with {FOUND_SQL}, i as (select distinct image_id from r), tc as (select image_id, count(*) as truths from t group by all), dc as (select image_id, count(*) as founds from d group by all),
m as (select a.image_id, count(*) as matched, sum({IOU_SQL}) as iou_sum, sum(1 - cast(levenshtein(a.text, b.text) as double) / greatest(length(a.text), length(b.text), 1)) as accuracy_sum from t a join d b on a.image_id = b.image_id and a.pos = b.pos and {IOU_SQL} >= 0.5 group by all),
e as (select image_id % 10 as bucket, coalesce(truths, 0) as truths, coalesce(founds, 0) as founds, coalesce(matched, 0) as matched, coalesce(iou_sum, 0.0) as iou_sum, coalesce(accuracy_sum, 0.0) as accuracy_sum from i left join tc using (image_id) left join dc using (image_id) left join m using (image_id))
select bucket, cast(sum(truths) as bigint) as truths, cast(sum(founds) as bigint) as founds, cast(sum(matched) as bigint) as matched, round(sum(matched) / sum(truths), 9) as recall, round(sum(matched) / sum(founds), 9) as "precision",
  round(sum(iou_sum) / sum(matched), 6) as mean_iou, round(sum(accuracy_sum) / sum(matched), 6) as mean_text_accuracy from e group by grouping sets ((bucket), ())""")
def eval_micro_average(spark, sf_dir):
    """Averages for ten parts of the images and for all; a region here matches its own detection, if that is near enough."""
    truth, found = truth_and_found(spark, sf_dir)
    own = E.pairs(truth, found, E.STRICT).where("truth_pos = found_pos")
    rows = E.per_image(truth, found, own).withColumn("bucket", F.col("image_id") % 10)
    every = E.averages(rows, "bucket").unionByName(E.averages(rows).withColumn("bucket", F.lit(None).cast("long")))
    return every.withColumns({c: F.round(c, n) for c, n in (("recall", 9), ("precision", 9), ("mean_iou", 6), ("mean_text_accuracy", 6))})


@query()
def eval_greedy_average(spark, sf_dir):
    truth, found = truth_and_found(spark, sf_dir)
    return E.averages(E.per_image(truth, found, E.matched(E.pairs(truth, found, E.STRICT))))


@query("""with b as (select item_id, regexp_replace(text, '[^ -~]', '', 'g') as text from benchmark) select a.item_id as a_id, b.item_id as b_id, round(1 - cast(levenshtein(a.text, b.text) as double) / greatest(length(a.text), length(b.text), 1), 9) as accuracy from b a join b b on b.item_id between a.item_id + 1 and a.item_id + 5""")
def text_accuracy(spark, sf_dir):
    rows = read(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", "[^ -~]", "").alias("text"))
    a = rows.select(F.col("item_id").alias("a_id"), F.col("text").alias("a")).withColumn("b_id", F.explode(F.sequence(F.col("a_id") + 1, F.col("a_id") + 5)))
    both = a.join(rows.select(F.col("item_id").alias("b_id"), F.col("text").alias("b")), "b_id")
    return both.select("a_id", "b_id", F.round(T.text_accuracy(F.col("a"), F.col("b")), 9).alias("accuracy"))


@query("select p.page_id, l.pos, l.text, 1.0::double as confidence from pages p join (select sha256(html) as digest, page_id % 3 as pos, url as text from pages where page_id % 2 = 0) l on sha256(p.html) = l.digest")
def label_replay(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    labels = pages.where("page_id % 2 = 0").select(F.sha2("html", 256).alias("digest"), (F.col("page_id") % 3).alias("pos"), F.col("url").alias("text"))
    return E.replayed(pages.select("page_id", F.col("html").alias("content")), labels)


# Layout


@query("select l_orderkey, l_linenumber, l_partkey, cast(floor(l_quantity * 3.7 * 100 / 25) * 25 as bigint) as sz, case when l_quantity * 40 < 1000 then cast(cast(l_quantity * 40 as bigint) as varchar) || ' ms' else printf('%.2f s', l_quantity * 40 / 1000.0) end as took, printf('%.1f%%', l_discount * 100.0) as share from lineitem")
def quarter_point_floor(spark, sf_dir):
    q = F.col("l_quantity")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.quarter_points(q * 3.7).alias("sz"), T.duration(q * 40).alias("took"), T.percent(F.col("l_discount")).alias("share"))


@query(f"with {SEGMENTS_SQL} select id, round(case when regexp_matches(text, '{CJK}') then 24 / 1.3 when regexp_matches(text, '[gjpqy]') then 24 / 1.28 when regexp_matches(text, '[A-Z0-9bdfhklt]') then 24.0 else 24 / 0.72 end, 9) as cap, regexp_matches(text, '^[1Iil|!()\\[\\]]+$') as narrow from seg")
def cap_height(spark, sf_dir):
    text = F.col("text")
    return lines(spark, sf_dir).select("id", F.round(T.cap_height(text, F.lit(24.0)), 9).alias("cap"), T.is_narrow(text).alias("narrow"))


def fitting(spark, sf_dir) -> DataFrame:
    p = F.col("pos")
    return lines(spark, sf_dir).select("id", F.col("text").alias("final_text"), (F.lit(60.0) + p % 7 * 40).alias("box_w"), (F.lit(20.0) + p % 5 * 25).alias("box_h"), (F.lit(8.0) + p % 9 * 3).alias("size_pt"))


@query()
def fit_text(spark, sf_dir):
    """Shrinking to fit goes step by step; the tests check that what it gives fits and that one step larger doesn't."""
    return L.fitted(fitting(spark, sf_dir)).select("id", "fitted_size_pt", F.size("fitted_lines").alias("n_lines"), "overflowed", F.md5(F.array_join("fitted_lines", "\n")).alias("lines_md5"))


@query(f"""with recursive s as (select l_suppkey as g, row_number() over (partition by l_suppkey order by l_partkey % 97 + 6, l_orderkey, l_linenumber, l_partkey, l_extendedprice) as k, cast(l_partkey % 97 + 6 as bigint) as z, l_orderkey, l_linenumber from lineitem),
c as (select g, k, z, z as anchor, 0 as cluster from s where k = 1 union all select s.g, s.k, s.z, case when s.z * 5 > c.anchor * 6 then s.z else c.anchor end, case when s.z * 5 > c.anchor * 6 then c.cluster + 1 else c.cluster end from c join s on s.g = c.g and s.k = c.k + 1),
n as (select *, row_number() over (partition by g, cluster order by k) as r, count(*) over (partition by g, cluster) as n from c),
m as (select g, cluster, max(z) filter (r = n // 2 + 1) as middle from n group by all)
select g, cluster, any_value(n) as n, min(z) as smallest, any_value(case when n > 1 then least(middle, 90) else z end) as snapped from n join m using (g, cluster) group by g, cluster""")
def size_clusters(spark, sf_dir):
    order = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("z", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))
    rows = read(spark, sf_dir, "lineitem").withColumn("z", (F.col("l_partkey") % 97 + 6).cast("long"))
    sizes = rows.select(F.col("l_suppkey").alias("g"), order.alias("k"), "z", F.lit(90).cast("long").alias("ceiling"))
    clustered = L.clustered(sizes, "g", "z", "ceiling", "k")
    return clustered.groupBy("g", "cluster").agg(F.count("*").alias("n"), F.min("z").alias("smallest"), F.min("snapped").alias("snapped"))


@query()
def token_distribution(spark, sf_dir):
    """Tokens of each line dealt to two or three spans by a least-squares division; the tests try all divisions."""
    words = F.split(F.trim(T.trimmed(F.col("text"))), " +")
    widths = F.transform(words, lambda w: F.length(w) * 0.5)
    spans = F.when(F.col("pos") % 2 == 0, F.array(F.lit(40.0), F.lit(60.0))).otherwise(F.array(F.lit(30.0), F.lit(30.0), F.lit(40.0)))
    rows = lines(spark, sf_dir).where(F.length(T.trimmed(F.col("text"))) > 0)
    return L.distributed(rows.select("id", widths.alias("widths"), F.lit(0.25).alias("space"), spans.alias("spans"))).select("id", "counts")


PROFILE_SQL = "c as (select l_suppkey as image, cast(row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) as integer) - 1 as col, (l_partkey * 13 + l_linenumber) % 7 as ink from lineitem)"


def column_profile(spark, sf_dir) -> DataFrame:
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("image"), (F.row_number().over(order) - 1).alias("col"), ((F.col("l_partkey") * 13 + F.col("l_linenumber")) % 7).alias("ink"))


def profiles(columns: DataFrame, counts, flags) -> DataFrame:
    """Columns of each image in order, as arrays."""
    one = F.struct("col", counts.cast("int").alias("n"), flags.alias("f"))
    listed = columns.groupBy("image").agg(F.array_sort(F.collect_list(one)).alias("own"))
    return listed.select("image", F.col("own.n").alias("counts"), F.col("own.f").alias("flags"))


@query(f"""with {PROFILE_SQL}, i as (select *, col - row_number() over (partition by image order by col) as island from c where ink >= 4 and (image + col) % 11 > 0)
select image, cast(min(col) as integer) as lo, cast(max(col) + 1 as integer) as hi, cast(sum(ink) as bigint) as ink from i group by image, island having count(*) <= 4""")
def gridline_islands(spark, sf_dir):
    """Narrow stretches of columns that are nearly full and go from top to bottom, of images of 4 pixels' height."""
    through = (F.col("image") + F.col("col")) % 11 > 0
    return pixels.of_profiles(profiles(column_profile(spark, sf_dir), F.col("ink"), through), 4, "gridlines").select("image", "lo", "hi", "ink")


BANDS_SQL = f"""with {PROFILE_SQL}, g as (select *, case when col - lag(col) over w <= 3 then 0 else 1 end as starts from c where ink > 4 window w as (partition by image order by col)),
b as (select *, sum(starts) over (partition by image order by col) as band from g), r as (select image, band, min(col) as lo, max(col) + 1 as hi from b group by all),
s as (select r.image, lo, hi, sum(ink) as ink from r join c on c.image = r.image and col >= lo and col < hi group by all)"""


@query(f"{BANDS_SQL} select image, cast(lo as integer) as lo, cast(hi as integer) as hi, cast(ink as bigint) as ink, ink * 10 >= sum(ink) over (partition by image) * 7 as dominant from s")
def row_bands(spark, sf_dir):
    """Stretches of ink over gaps of up to two, and whether one has most of the ink, of images 400 pixels wide."""
    return pixels.of_profiles(profiles(column_profile(spark, sf_dir), F.col("ink"), F.lit(False)), 400, "bands")


VALLEY = "col % 40 < 4 + image % 13"


@query(f"""with {PROFILE_SQL}, z as (select image, col, case when {VALLEY} then 0 else ink end as ink, sum(case when col % 40 = 2 and col % 80 < 40 then 1 else 0 end) over (partition by image order by col) as erased from c),
g as (select *, case when lag(col) over w is null or col - lag(col) over w - 1 >= case when erased > lag(erased) over w then 6 else 14 end then 1 else 0 end as starts from z where ink > 1 window w as (partition by image order by col)),
b as (select *, sum(starts) over (partition by image order by col) as span from g) select image, cast(min(col) as integer) as lo, cast(max(col) + 1 as integer) as hi from b group by image, span""")
def ink_spans(spark, sf_dir):
    """Stretches of ink parted by valleys of 14 columns, or of 6 where a line was erased, of images of 7 pixels' height."""
    ink = F.when(F.expr(VALLEY), 0).otherwise(F.col("ink"))
    erased = (F.col("col") % 40 == 2) & (F.col("col") % 80 < 40)
    return pixels.of_profiles(profiles(column_profile(spark, sf_dir), ink, erased), 7, "spans").select("image", "lo", "hi")


@query(f"with {PROFILE_SQL}, n as (select image, ink, row_number() over (partition by image order by ink, col) as k, count(*) over (partition by image) as n from c) select image, max(ink) filter (k = n // 2 + 1) as upper_median, median(ink) as middle from n group by image")
def profile_medians(spark, sf_dir):
    """The two medians: the upper of two middles, and their mean."""
    return column_profile(spark, sf_dir).groupBy("image").agg(L.upper_median(F.collect_list("ink")).alias("upper_median"), F.median("ink").alias("middle"))


@query(f"with {SEGMENTS_SQL} select doc_id, count(*) as total, count(*) filter (regexp_matches(text, '\\p{{L}}')) as translated, cast(sum(length(text)) as bigint) as chars_source, cast(sum(case when regexp_matches(text, '\\p{{L}}') then length(text) + 9 else 0 end) as bigint) as chars_translated from seg group by doc_id")
def translate_run(spark, sf_dir):
    """The whole run with the provider that puts the language before each text."""
    rows = lines(spark, sf_dir).select("*", F.lit(400.0).alias("box_w"), F.lit(300.0).alias("box_h"), F.lit(12.0).alias("size_pt"))
    run = translate(rows, SOURCE, TARGET, echo_factory(TARGET), f"echo-{TARGET}")
    return run.report.select("doc_id", "total", "translated", "chars_source", "chars_translated")


@query()
def vision_regions(spark, sf_dir):
    """Regions out of answers in several formats: fenced, bare lists, corners; the tests hold them against what was meant."""
    rows = regions(spark, sf_dir)
    one = F.when(F.col("image_id") % 8 == 0, F.to_json(F.struct(F.array("box.x", "box.y", F.col("box.x") + F.col("box.w"), F.col("box.y") + F.col("box.h")).alias("bbox_2d"), F.col("text").alias("label"))))
    one = F.coalesce(one, F.to_json(F.struct(F.col("box").alias("bbox"), "text")))
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", one.alias("j")))), lambda s: s["j"]), ","), F.lit("]"))
    answers = rows.groupBy("image_id").agg(listed.alias("list"))
    content = F.when(F.col("image_id") % 3 == 0, F.concat(F.lit("Here:\n```json\n"), "list", F.lit("\n```"))).otherwise(F.concat(F.lit('{"regions":'), "list", F.lit("}")))
    return flat(vision.regions(answers.select(F.col("image_id").cast("string").alias("image_id"), F.lit(200).alias("width"), F.lit(100).alias("height"), content.alias("content"))))


@query(f"""{PACKED_SQL}, clean as (select k.doc_id, p.group_no, k.pos, k.id, regexp_replace(k.text, '["/\\\\[:cntrl:]]', '', 'g') as text from packed p join kept k using (doc_id, k))
select doc_id, group_no, '[' || string_agg('{{"id":"' || id || '","text":"' || text || '"}}', ',' order by pos) || ']' as user from clean group by doc_id, group_no""")
def prompt_user_json(spark, sf_dir):
    """What each group's prompt asks, for texts without characters that engines escape in their own ways."""
    packed = S.packed(lines(spark, sf_dir)).withColumn("text", F.regexp_replace("text", r'["/\\\p{Cntrl}]', ""))
    return X.requests(packed, S.group_contexts(packed), SOURCE, TARGET, "initial").select("doc_id", "group_no", "user")


@query("""with r as (select user_id % 50 as run, count(*) as total, count(*) filter (event_id % 7 <> 0) as translated, cast(sum(event_id % 53) as bigint) as completion_tokens, sum(cast(event_id % 1000 as double)) as eval_ms, sum(cast(event_id % 400 as double)) as duration_ms from events group by all)
select run, total, translated, round(case when eval_ms > 0 then completion_tokens / (eval_ms / 1000) else 0.0 end, 6) as tokens_per_sec, round(case when duration_ms > 0 then translated / (duration_ms / 60000) else 0.0 end, 6) as segments_per_min from r""")
def run_report_stats(spark, sf_dir):
    e = F.col("event_id")
    runs = read(spark, sf_dir, "events").groupBy((F.col("user_id") % 50).alias("run")).agg(
        F.count("*").alias("total"), F.count_if(e % 7 != 0).alias("translated"), F.sum(e % 53).alias("completion_tokens"), F.sum((e % 1000).cast("double")).alias("eval_ms"), F.sum((e % 400).cast("double")).alias("duration_ms"),
    )
    rates = report.throughput(F.col("completion_tokens"), F.col("eval_ms"), F.col("translated"), F.col("duration_ms"))
    return runs.select("run", "total", "translated", *rates).withColumns({c: F.round(c, 6) for c in ("tokens_per_sec", "segments_per_min")})


@query()
def image_segments(spark, sf_dir):
    """Validated regions as segments to translate: sizes follow from ink by bisection, which the tests check."""
    rows = regions(spark, sf_dir).drop("part").withColumn("image_id", F.col("image_id").cast("string"))
    images = rows.select("image_id", F.lit(200).cast("long").alias("width"), F.lit(100).cast("long").alias("height")).distinct()
    return imagetext.segments(G.validated(rows, images), SOURCE).select("image_id", "id", "text", "size_pt", "box_w", "box_h", "family", "group_key")
