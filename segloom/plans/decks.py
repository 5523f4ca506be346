"""Slide decks made of the driver's tables, one for each customer, and what reading and writing them must give."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segloom.operators.ordered import out_batches, rows_of, spread
from segloom.plans.inputs import read
from segloom.shipping import ship
from segloom.sources import decks as D

KINDS, IN_LAYOUT, IN_MASTER = ("ctrTitle", "subTitle", "body", "dt"), ("title", "body", "pic"), ("title", "body")
_NS = f'xmlns:a="{D.A}" xmlns:p="{D.P}" xmlns:r="{D.R}"'


def _body(text: str, attrs: str = "", run: str = "") -> str:
    lines = "<a:br/>".join(f"<a:r><a:rPr {run}/><a:t>{line}</a:t></a:r>" for line in text.split("\n"))
    return f"<a:bodyPr {attrs}/><a:p>{lines}</a:p>"


def _shape(name: str, body: str, ext: tuple[int, int] | None = None, ph: str = "") -> str:
    frame = f'<a:xfrm><a:ext cx="{ext[0]}" cy="{ext[1]}"/></a:xfrm>' if ext else ""
    return f'<p:sp><p:nvSpPr><p:cNvPr id="2" name="{name}"/><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:spPr>{frame}</p:spPr><p:txBody>{body}</p:txBody></p:sp>'


def _tree(inner: str, root: str = "sld") -> str:
    return f"<p:{root} {_NS}><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:{root}>"


def _rels(*items: tuple[str, str]) -> str:
    return "<Relationships>" + "".join(f'<Relationship Id="r{k}" Type="{D.R}/{kind}" Target="{target}"/>' for k, (kind, target) in enumerate(items)) + "</Relationships>"


def _ph(kind: str, idx: int) -> str:
    return f'<p:ph type="{kind}" idx="{idx}"/>'


def made(c: dict) -> bytes:
    """A customer's deck: two slides with a placeholder, a group, a table, a chart, pictures and notes, as the key decides."""
    k, n = c["c_custkey"], c["c_nationkey"]
    run = ('sz="2400" ' if k % 4 == 1 else "") + ('b="1"' if k % 2 else "")
    box = _shape("Box", _body(f"{c['c_mktsegment']}\n{n}", 'lIns="0"' if k % 5 == 0 else ""), (1000000, 400000))
    group = f'<p:grpSp><p:nvGrpSpPr><p:cNvPr id="3" name="G"/></p:nvGrpSpPr><p:grpSpPr><a:xfrm><a:ext cx="200" cy="300"/><a:chExt cx="100" cy="100"/></a:xfrm></p:grpSpPr>{box * (2 if k % 6 == 0 else 1)}</p:grpSp>'
    cell = lambda text, attrs="": f"<a:tc {attrs}><a:txBody>{_body(text)}</a:txBody></a:tc>"
    first = cell(c["c_name"], 'gridSpan="2"' if k % 2 == 0 else "") + cell("stray", 'hMerge="1"' if k % 2 == 0 else "")
    second = cell(" ") + cell(c["c_mktsegment"]) + (cell("extra") if k % 11 == 0 else "")
    frame = lambda name, uri, inner="": f'<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="4" name="{name}"/></p:nvGraphicFramePr><a:graphic><a:graphicData uri="{uri}">{inner}</a:graphicData></a:graphic></p:graphicFrame>'
    table = frame("T", "table", f'<a:tbl><a:tblGrid><a:gridCol w="{1000000 + n * 1000}"/><a:gridCol w="600000"/></a:tblGrid><a:tr h="300000">{first}</a:tr><a:tr h="400000">{second}</a:tr></a:tbl>')
    art = _shape("Art", f'<a:bodyPr><a:prstTxWarp prst="textArch"/></a:bodyPr><a:p><a:r><a:t>{k}</a:t></a:r></a:p>') if k % 7 == 0 else ""
    blip = lambda r: f'<p:pic><p:nvPicPr><p:cNvPr id="5" name="Pic"/><p:nvPr/></p:nvPicPr><p:blipFill><a:blip r:embed="r{r}"/></p:blipFill></p:pic>'
    slide = _shape(f"P[{k % 3}]", _body(c["c_name"], run=run), (1000000 + k * 1000, 300000 + k * 10) if k % 3 == 0 else None, _ph(KINDS[k % 4], n))
    slide += art + group + table + (frame("C", D.URI_CHART) if k % 9 == 0 else "") + blip(2) + blip(2) + (blip(3) if k % 2 else "") + (blip(4) if k % 13 == 0 else "")
    parts = {
        "ppt/slides/slide10.xml": _tree(_shape("Last", _body("End"), (1000000, 400000)) + blip(0)), "ppt/slides/slide2.xml": _tree(slide),
        "ppt/slides/_rels/slide10.xml.rels": _rels(("image", f"../media/image{k % 5}.png")),
        "ppt/slides/_rels/slide2.xml.rels": _rels(("slideLayout", "../slideLayouts/l.xml"), ("notesSlide", "/ppt/notesSlides/n.xml"), ("image", f"../media/image{k % 5}.png"), ("image", "../media/v.emf"), ("image", "../media/gone.jpg")),
        "ppt/slideLayouts/l.xml": _tree(_shape("L", _body(""), (2000000 + n * 1000, 500000), _ph(IN_LAYOUT[n % 3], n)) if n % 2 == 0 else "", "sldLayout"),
        "ppt/slideLayouts/_rels/l.xml.rels": _rels(("slideMaster", "../slideMasters/m.xml")),
        "ppt/slideMasters/m.xml": _tree(_shape("M", _body(""), (5000000 + n * 1000, 700000), _ph(IN_MASTER[n % 2], n)), "sldMaster"),
        "ppt/notesSlides/n.xml": _tree(_shape("N", _body(f"Note {c['c_mktsegment']}"), ph=_ph("body", 1)) + _shape("S", _body("12"), ph=_ph("sldNum", 2)), "notes"),
        f"ppt/media/image{k % 5}.png": "pixels" * (1 + k % 4), "ppt/media/v.emf": "v",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return b"no archive" if k % 97 == 96 else out.getvalue()


def customer_decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path (the customer's key) and content; each 97th file is broken."""
    ship(spark)
    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from out_batches(({"path": str(c["c_custkey"]), "content": made(c)} for c in rows_of(batches)), schema)

    rows = spread(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))
    return rows.mapInArrow(run, "path string, content binary")


#: The decks in SQL: their placeholders with the size that they inherit, and all pieces of text with their place in the deck.
PLACES_SQL = """c as (select c_custkey as k, c_nationkey as n, c_name as name, c_mktsegment as seg, cast(c_custkey as varchar) as path from customer where c_custkey % 97 <> 96),
ph as (select *, case k % 4 when 0 then 'title' when 3 then 'dt' else 'body' end as role, case n % 3 when 0 then 'title' when 1 then 'body' else 'pic' end as in_layout, case n % 2 when 0 then 'title' else 'body' end as in_master from c),
outer_ as (select *, case when k % 3 = 0 then 1000000 + k * 1000 when n % 2 = 0 and in_layout = role then 2000000 + n * 1000 when in_master = role then 5000000 + n * 1000 end as cx,
  case when k % 3 = 0 then 300000 + k * 10 when n % 2 = 0 and in_layout = role then 500000 when in_master = role then 700000 end as cy from ph)"""
TEXTS_SQL = f"""{PLACES_SQL}, t as (
  select path, k, 1 as ord, 'slide2/shape[name=P_' || k % 3 || '_]/tb' as id, name as text, coalesce((cx - 182880) / 12700.0 * 0.96, 1e6) as box_w, coalesce((cy - 91440) / 12700.0, 1e6) as box_h,
    case when k % 4 = 1 then 24.0 when role = 'title' then 44.0 else 18.0 end as size_pt, k % 2 = 1 as bold, case role when 'title' then 'slide title' when 'body' then 'body' else 'placeholder (dt)' end as context, 'slide2' as group_key, 'shape' as kind from outer_
  union all select path, k, 2 + i, 'slide2/group[name=G]/shape[name=Box]/tb' || case when i = 1 then '-2' else '' end, seg || chr(10) || n, (1000000 - case when k % 5 = 0 then 91440 else 182880 end) / 12700.0 * 2 * 0.96, (400000 - 91440) / 12700.0 * 3,
    18.0, false, 'text box', 'slide2', 'shape' from c cross join (select unnest([0, 1]) as i) where i = 0 or k % 6 = 0
  union all select path, k, 4, 'slide2/table[gf-name=T]/r1c1', name, (1000000 + n * 1000 + case when k % 2 = 0 then 600000 else 0 end - 182880) / 12700.0 * 0.96, (300000 - 91440) / 12700.0, 18.0, false, 'table cell', 'slide2', 'table-cell' from c
  union all select path, k, 5, 'slide2/table[gf-name=T]/r1c2', 'stray', (600000 - 182880) / 12700.0 * 0.96, (300000 - 91440) / 12700.0, 18.0, false, 'table cell', 'slide2', 'table-cell' from c where k % 2 = 1
  union all select path, k, 6, 'slide2/table[gf-name=T]/r2c2', seg, (600000 - 182880) / 12700.0 * 0.96, (400000 - 91440) / 12700.0, 18.0, false, 'table cell', 'slide2', 'table-cell' from c
  union all select path, k, 7, 'slide2/table[gf-name=T]/r2c3', 'extra', 1e6, 1e6, 18.0, false, 'table cell', 'slide2', 'table-cell' from c where k % 11 = 0
  union all select path, k, 8, 'slide2/notes', 'Note ' || seg, 1e6, 1e6, 18.0, false, 'notes', 'slide2-notes', 'notes' from c
  union all select path, k, 9, 'slide10/shape[name=Last]/tb', 'End', (1000000 - 182880) / 12700.0 * 0.96, (400000 - 91440) / 12700.0, 18.0, false, 'text box', 'slide10', 'shape' from c)"""
SEGMENTS_SQL = f"""with {TEXTS_SQL} select path, cast(row_number() over (partition by path order by ord) - 1 as integer) as pos, id, text, round(cast(box_w as double), 6) as box_w, round(cast(box_h as double), 6) as box_h,
  cast(size_pt as double) as size_pt, bold, context, group_key, kind from t"""
SKIPS_SQL = f"""with {PLACES_SQL} select path, 'slide2/shape[name=Art]' as id, 'WordArt' as reason from c where k % 7 = 0 union all select path, 'slide2/graphicFrame[name=C]', 'chart' from c where k % 9 = 0
union all select path, 'slide2/table[gf-name=T]/r1c2', 'merge-continuation cell with unexpected text (anchor-only extraction is intentional)' from c where k % 2 = 0
union all select path, 'slide2/table[gf-name=T]/r2c3', 'table cell (no matching grid column - size preserved)' from c where k % 11 = 0
union all select cast(c_custkey as varchar), cast(c_custkey as varchar), 'unreadable deck: not a slide deck: the file is no zip archive' from customer where c_custkey % 97 = 96"""
MEDIA_SQL = f"""with {PLACES_SQL} select path, 'ppt/media/image' || k % 5 || '.png' as media_path, 2 as slide_no, cast(6 * (1 + k % 4) as integer) as bytes, null as reason from c
union all select path, 'ppt/media/v.emf', 2, null, 'vector metafile image' from c where k % 2 = 1 union all select path, 'ppt/media/gone.jpg', 2, null, 'media part unreadable' from c where k % 13 = 0"""
#: After writing: sizes in quarter points on every run that is smaller now, notes but for their text as they were.
WRITTEN_SQL = f"""with {TEXTS_SQL} select path, id, '[German] ' || text as text, cast(case when kind = 'notes' or k % 2 = 1 then size_pt else floor((size_pt - 0.6) * 4) / 4 end as double) as size_pt, bold,
  round(cast(box_w as double), 6) as box_w from t"""
INHERIT_SQL = f"with {PLACES_SQL} select path, role, round(cast(coalesce((cx - 182880) / 12700.0 * 0.96, 1e6) as double), 6) as box_w from outer_"

_ROUNDED = {"box_w": F.round, "box_h": F.round}


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.segments(customer_decks(spark, sf_dir))
    return rows.withColumns({c: f(c, 6) for c, f in _ROUNDED.items()}).select("path", "pos", "id", "text", "box_w", "box_h", "size_pt", "bold", "context", "group_key", "kind")


def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of decks that were written with translations and, for every other deck, smaller sizes."""
    decks = customer_decks(spark, sf_dir)
    smaller = F.when(F.col("path").cast("long") % 2 == 0, F.col("size_pt") - 0.6).otherwise(F.col("size_pt"))
    new = D.segments(decks).select("path", "id", F.concat(F.lit("[German] "), "text").alias("translation"), smaller.alias("fitted_size_pt"))
    return D.segments(D.written(decks, new).where("error is null")).select("path", "id", "text", "size_pt", "bold", F.round("box_w", 6).alias("box_w"))
