"""Slide decks: zip archives of XML parts, read into segments and written back with translations.

Reading gives one row for each piece of text (title, box, cell, diagram point, notes), with its place, box and font,
and one row for each thing that is left out and why. Writing changes the parts that have translations and copies all
others byte for byte.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from xml.dom import minidom
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segloom.functions.text import stripped
from segloom.operators.layout import CJK_BREAK, HalfEm, wrapped
from segloom.operators.ordered import out_batches, rows_of
from segloom.shipping import ship

# Namespaces, relationship types, units and defaults of the format, and reasons.
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
P = "http://schemas.openxmlformats.org/presentationml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
DGM = "http://schemas.openxmlformats.org/drawingml/2006/diagram"
DSP = "http://schemas.microsoft.com/office/drawing/2008/diagram"
URI_CHART = "http://schemas.openxmlformats.org/drawingml/2006/chart"
URI_OLE = "http://schemas.openxmlformats.org/presentationml/2006/ole"
EMU, INSET_X, INSET_Y = 12700, 91440, 45720
FAMILY, SIZE, SIZE_BY_ROLE = "Calibri", 18.0, {"title": 44.0, "body": 18.0}
WRAP_SAFETY, ENDLESS, SNUG_HEIGHT = 0.96, 1e6, 1.2
ROLE_ALIAS = {"ctrTitle": "title", "subTitle": "body"}
#: Written decks that go on at once, and their bytes.
_DECKS, _BYTES = 256, 1 << 23
#: Parsed parts that are kept for other decks, and how large they may be.
_SAME, _SAME_BYTES = 256, 1 << 14
RASTER = ("png", "jpg", "jpeg")
UNREADABLE, VECTOR = "media part unreadable", "vector metafile image"

SEGMENT = (
    "path string, pos int, id string, text string, box_w double, box_h double, family string, size_pt double, bold boolean, italic boolean, "
    "context string, group_key string, kind string, part_path string, drawing_path string"
)
_ARROW = pa.schema(
    [("path", pa.string()), ("pos", pa.int32()), ("id", pa.string()), ("text", pa.string()), ("box_w", pa.float64()), ("box_h", pa.float64()), ("family", pa.string()), ("size_pt", pa.float64()), ("bold", pa.bool_()), ("italic", pa.bool_()), ("context", pa.string()), ("group_key", pa.string()), ("kind", pa.string()), ("part_path", pa.string()), ("drawing_path", pa.string())]
)


def children(node, ns: str, *names: str) -> list:
    return [c for c in node.childNodes if c.nodeType == c.ELEMENT_NODE and c.namespaceURI == ns and (not names or c.localName in names)] if node is not None else []


def child(node, ns: str, name: str):
    return next(iter(children(node, ns, name)), None)


def path_to(node, ns: str, *names: str):
    for name in names:
        node = child(node, ns, name)
    return node


def number(node, name: str, default: float) -> float:
    return float(node.getAttribute(name)) if node is not None and node.hasAttribute(name) else default


def run_text(run) -> str:
    t = child(run, A, "t")
    return "".join(c.data for c in t.childNodes if c.nodeType in (c.TEXT_NODE, c.CDATA_SECTION_NODE)) if t is not None else ""


def body_text(body) -> str:
    """Runs and fields joined, breaks and paragraphs as line feeds."""
    return "\n".join("".join("\n" if c.localName == "br" else run_text(c) for c in children(p, A, "br", "r", "fld")) for p in children(body, A, "p"))


class Element:
    """An element, or a whole document, that is only read: what reading needs of the DOM, in plain attributes."""

    __slots__ = ("nodeType", "namespaceURI", "localName", "own", "childNodes")
    ELEMENT_NODE, TEXT_NODE, CDATA_SECTION_NODE = 1, 3, 4

    def __init__(self, kind: int, name: str, own: dict[str, str]):
        self.nodeType, self.own, self.childNodes = kind, own, []
        space, _, local = name.partition(" ")
        self.namespaceURI, self.localName = (space, local.partition(" ")[0]) if local else (None, name)

    def getAttributeNS(self, ns: str, name: str) -> str:
        return next((v for k, v in self.own.items() if k == f"{ns} {name}" or k.startswith(f"{ns} {name} ")), "")

    def getAttribute(self, name: str) -> str:
        return self.own.get(name, "")

    def hasAttribute(self, name: str) -> bool:
        return name in self.own

    def getElementsByTagNameNS(self, ns: str, name: str) -> list[Element]:
        out, ahead = [], self.childNodes[::-1]
        while ahead:
            c = ahead.pop()
            if c.nodeType == 1:
                if c.localName == name and (ns == "*" or c.namespaceURI == ns):
                    out.append(c)
                ahead += c.childNodes[::-1]
        return out


class Text:
    """Characters between elements."""

    __slots__ = ("data",)
    nodeType, ELEMENT_NODE, TEXT_NODE, CDATA_SECTION_NODE = 3, 1, 3, 4

    def __init__(self, data: str):
        self.data = data


def parsed(data: bytes) -> Element:
    """A document for reading alone, several times as fast as one that can be changed."""
    root = Element(9, "", {})
    open_ = [root]
    parser = expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = True

    def start(name: str, own: dict[str, str]) -> None:
        node = Element(1, name, own)
        open_[-1].childNodes.append(node)
        open_.append(node)

    parser.StartElementHandler = start
    parser.EndElementHandler = lambda _: open_.pop()
    parser.CharacterDataHandler = lambda text: open_[-1].childNodes.append(Text(text))
    parser.Parse(data, True)
    return root


@lru_cache(_SAME)
def _parsed_once(data: bytes) -> Element:
    return parsed(data)


def read_only(data: bytes) -> Element:
    """parsed, once for small parts that come again: decks made from one template share layouts, masters and relations."""
    return _parsed_once(data) if len(data) <= _SAME_BYTES else parsed(data)


class Archive:
    """The parts of a deck, parsed when asked for, and what was changed. Parts of one that isn't editable are for reading alone."""

    def __init__(self, content: bytes, editable: bool = True):
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                self.infos = z.infolist()
                self.parts = {i.filename: z.read(i) for i in self.infos if not i.is_dir()}
        except zipfile.BadZipFile as e:
            raise ValueError("not a slide deck: the file is no zip archive") from e
        except Exception as e:  # parts that don't unpack
            raise ValueError(f"not a slide deck: {e}") from e
        self.editable = editable
        self.documents: dict[str, minidom.Document] = {}
        self.read_only: dict[str, Element] = {}
        self.related_parts: dict[str, list[dict]] = {}
        self.changed: set[str] = set()

    def xml(self, part: str, editable: bool = True) -> minidom.Document | Element:
        found, parse = (self.documents, minidom.parseString) if self.editable and editable else (self.read_only, read_only)
        if part not in found:
            if part not in self.parts:
                raise ValueError(f"part {part} is missing")
            try:
                found[part] = parse(self.parts[part])
            except Exception as e:
                raise ValueError(f"part {part} can't be parsed: {e}") from e
        return found[part]

    def numbered(self, pattern: str) -> list[str]:
        """Parts whose name fits, by their number."""
        found = [(int(m[1]), name) for name in self.parts if (m := re.fullmatch(pattern, name))]
        return [name for _, name in sorted(found)]

    def slides(self) -> list[str]:
        return self.numbered(r"ppt/slides/slide(\d+)\.xml")

    def relations(self, part: str) -> list[dict]:
        if part not in self.related_parts:
            self.related_parts[part] = self._relations(part)
        return self.related_parts[part]

    def _relations(self, part: str) -> list[dict]:
        folder, name = posixpath.split(part)
        rels = f"{folder}/_rels/{name}.rels"
        if rels not in self.parts:
            return []
        out = []
        for r in self.xml(rels, False).getElementsByTagNameNS("*", "Relationship"):
            target = r.getAttribute("Target")
            full = target[1:] if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            out.append({"id": r.getAttribute("Id"), "type": r.getAttribute("Type").rsplit("/", 1)[-1], "target": full, "external": r.getAttribute("TargetMode") == "External"})
        return out

    def related(self, part: str, kind: str) -> str | None:
        return next((r["target"] for r in self.relations(part) if r["type"] == kind), None)

    def by_id(self, part: str, rid: str) -> str | None:
        return next((r["target"] for r in self.relations(part) if r["id"] == rid), None)

    def saved(self) -> bytes:
        """The archive with the changed parts written anew and all others as they were."""
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for info in self.infos:
                data = self.parts.get(info.filename, b"")
                if info.filename in self.changed and info.filename in self.documents:
                    data = b'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\r\n' + self.documents[info.filename].documentElement.toxml().encode("utf-8")
                z.writestr(info, data, zipfile.ZIP_STORED if info.is_dir() else zipfile.ZIP_DEFLATED)
        return out.getvalue()

    def replaced(self, part: str, data: bytes) -> None:
        self.parts[part] = data
        for found in (self.documents, self.read_only):
            found.pop(part, None)
        self.related_parts.clear()


@dataclass
class Site:
    """A piece of text and where it is."""

    id: str
    text: str
    box: tuple[float, float]
    font: dict
    context: str
    group_key: str
    kind: str
    part_path: str
    body: object
    snug: bool = False
    drawing_path: str | None = None


@dataclass
class Scan:
    """Everything that a deck's text is read into."""

    archive: Archive
    measure: HalfEm = field(default_factory=HalfEm)
    sites: list[Site] = field(default_factory=list)
    skips: list[tuple[str, str]] = field(default_factory=list)
    media: list[tuple[str, str, int]] = field(default_factory=list)
    taken: set[str] = field(default_factory=set)

    def run(self) -> Scan:
        for slide in self.archive.slides():
            self.slide, self.n = slide, int(re.search(r"(\d+)\.xml$", slide)[1])
            layout = self.archive.related(slide, "slideLayout")
            master = self.archive.related(layout, "slideMaster") if layout else None
            self.above = [self.archive.xml(p, False) for p in (layout, master) if p]
            tree = next(iter(self.archive.xml(slide).getElementsByTagNameNS(P, "spTree")), None)
            if tree is not None:
                self.container(tree, (1.0, 1.0), "")
            self.notes()
            for blip in self.archive.xml(slide).getElementsByTagNameNS(A, "blip"):
                rel = next((r for r in self.archive.relations(slide) if r["id"] == blip.getAttributeNS(R, "embed")), None)
                if rel and not rel["external"]:
                    self.media.append((rel["target"], slide, self.n))
        return self

    def unique(self, base: str) -> str:
        found, k = base, 2
        while found in self.taken:
            found, k = f"{base}-{k}", k + 1
        self.taken.add(found)
        return found

    def add(self, raw_id: str, text: str, box, font: dict, context: str, kind: str, part: str, body, **more) -> None:
        self.sites.append(Site(self.unique(raw_id), text, box, font, context, more.pop("group_key", f"slide{self.n}"), kind, part, body, **more))

    def container(self, node, scale: tuple[float, float], prefix: str) -> None:
        for c in children(node, P):
            if c.localName == "sp":
                self.shape(c, scale, prefix)
            elif c.localName == "pic":
                props = path_to(c, P, "nvPicPr", "nvPr")
                if props is not None and (props.getElementsByTagNameNS(A, "videoFile") or props.getElementsByTagNameNS(P, "videoFile")):
                    self.skips.append((f"slide{self.n}/{prefix}pic[name={escaped(name_of(c))}]", "video"))
            elif c.localName == "graphicFrame":
                self.frame(c, scale, prefix)
            elif c.localName == "grpSp":
                own = group_scale(c)
                self.container(c, (scale[0] * own[0], scale[1] * own[1]), f"{prefix}group[name={escaped(name_of(c))}]/")

    def shape(self, shape, scale, prefix: str) -> None:
        body = child(shape, P, "txBody")
        if body is None:
            return
        raw = f"slide{self.n}/{prefix}shape[name={escaped(name_of(shape))}]"
        props = child(body, A, "bodyPr")
        warp = child(props, A, "prstTxWarp")
        if warp is not None and warp.getAttribute("prst") != "none":
            self.skips.append((raw, "WordArt"))
            return
        text = body_text(body)
        if not stripped(text):
            return
        place = placeholder(shape)
        role = ROLE_ALIAS.get(place[0], place[0]) if place else None
        font = font_of(body) | {"size_pt": explicit_size(body) or SIZE_BY_ROLE.get(role, SIZE)}
        outer = self.outer_box(shape, place)
        room = usable(outer, props, scale)
        snug = child(props, A, "spAutoFit") is not None
        if snug:
            endless = props is not None and props.getAttribute("wrap") == "none"
            lines = wrapped(text, room[0] / font["size_pt"], self.measure) if room and not endless else text.split("\n")
            width = room[0] if room and not endless else max(map(self.measure.width, lines)) * font["size_pt"]
            box = (width * WRAP_SAFETY, len(lines) * font["size_pt"] * SNUG_HEIGHT)
        else:
            box = (room[0] * WRAP_SAFETY, room[1]) if room else (ENDLESS, ENDLESS)
        context = "text box" if place is None else {"title": "slide title", "body": "body"}.get(role, f"placeholder ({place[0]})")
        self.add(f"{raw}/tb", text, box, font, context, "shape", self.slide, body, snug=snug and room is None)

    def outer_box(self, shape, place) -> tuple[float, float] | None:
        """The size of a shape, its own or that of the placeholder it follows in layout and master."""
        own = extent(shape)
        if own or not place:
            return own
        wanted = ROLE_ALIAS.get(place[0], place[0]), place[1]
        for doc in self.above:
            for sp in doc.getElementsByTagNameNS(P, "sp"):
                other = placeholder(sp)
                if other and (ROLE_ALIAS.get(other[0], other[0]), other[1]) == wanted and (found := extent(sp)):
                    return found
        return None

    def frame(self, frame, scale, prefix: str) -> None:
        name = escaped(name_of(frame))
        table = next(iter(frame.getElementsByTagNameNS(A, "tbl")), None)
        if table is not None:
            self.table(table, scale, f"slide{self.n}/{prefix}table[gf-name={name}]")
            return
        data = path_to(frame, A, "graphic", "graphicData")
        uri = data.getAttribute("uri") if data is not None else ""
        raw = f"slide{self.n}/{prefix}graphicFrame[name={name}]"
        if uri == DGM:
            self.diagram(frame, data, scale, f"slide{self.n}/{prefix}smartart[gf-name={name}]")
        elif uri:
            self.skips.append((raw, {URI_CHART: "chart", URI_OLE: "OLE object"}.get(uri, f"graphic frame ({uri})")))

    def table(self, table, scale, raw: str) -> None:
        widths = [number(c, "w", 0) for c in children(child(table, A, "tblGrid"), A, "gridCol")]
        rows = children(table, A, "tr")
        heights, cells = [number(r, "h", 0) for r in rows], [children(r, A, "tc") for r in rows]
        for r, row in enumerate(cells):
            for c, cell in enumerate(row):
                body = child(cell, A, "txBody")
                text = body_text(body) if body is not None else ""
                own = f"{raw}/r{r + 1}c{c + 1}"
                if cell.hasAttribute("hMerge") or cell.hasAttribute("vMerge"):
                    if stripped(text):
                        self.skips.append((own, "merge-continuation cell with unexpected text (anchor-only extraction is intentional)"))
                    continue
                if not stripped(text):
                    continue
                box = (ENDLESS, ENDLESS)
                if c < len(widths):
                    props = child(cell, A, "tcPr")
                    spans = [max(1, int(number(cell, k, 1))) for k in ("gridSpan", "rowSpan")]
                    w = max(0, sum(widths[c : c + spans[0]]) - number(props, "marL", INSET_X) - number(props, "marR", INSET_X)) / EMU
                    h = max(0, sum(heights[r : r + spans[1]]) - number(props, "marT", INSET_Y) - number(props, "marB", INSET_Y)) / EMU
                    box = (w * scale[0] * WRAP_SAFETY, h * scale[1])
                else:
                    self.skips.append((own, "table cell (no matching grid column - size preserved)"))
                self.add(own, text, box, font_of(body) | {"size_pt": explicit_size(body) or SIZE}, "table cell", "table-cell", self.slide, body)

    def diagram(self, frame, data, scale, raw: str) -> None:
        ids = next(iter(data.getElementsByTagNameNS(DGM, "relIds")), None)
        rid = ids.getAttributeNS(R, "dm") if ids is not None else ""
        if not rid:
            self.skips.append((raw, "SmartArt (no data relationship)"))
            return
        part = self.archive.by_id(self.slide, rid)
        if part is None:
            self.skips.append((raw, "SmartArt (data part unresolved)"))
            return
        try:
            model = self.archive.xml(part)
        except ValueError:
            self.skips.append((raw, "SmartArt (data part unreadable)"))
            return
        room = usable(extent(frame), None, scale)
        box = (room[0] * WRAP_SAFETY, room[1]) if room else (ENDLESS, ENDLESS)
        cached = next((e.getAttribute("relId") for e in model.getElementsByTagNameNS(DSP, "dataModelExt") if e.getAttribute("relId")), None)
        drawing = (self.archive.by_id(part, cached) or self.archive.by_id(self.slide, cached)) if cached else None
        for point in model.getElementsByTagNameNS(DGM, "pt"):
            body = child(point, DGM, "t")
            text = body_text(body) if body is not None else ""
            if stripped(text):
                own = f"{raw}/pt{escaped(point.getAttribute('modelId') or 'unknown')}"
                self.add(own, text, box, font_of(body) | {"size_pt": explicit_size(body) or SIZE}, "smartart", "shape", part, body, drawing_path=drawing)

    def notes(self) -> None:
        part = self.archive.related(self.slide, "notesSlide")
        if part is None:
            return
        try:
            tree = next(iter(self.archive.xml(part).getElementsByTagNameNS(P, "spTree")), None)
        except ValueError:
            return
        for sp in children(tree, P, "sp"):
            place, body = placeholder(sp), child(sp, P, "txBody")
            text = body_text(body) if body is not None else ""
            if place and place[0] == "body" and stripped(text):
                font = font_of(body) | {"size_pt": explicit_size(body) or SIZE}
                self.add(f"slide{self.n}/notes", text, (ENDLESS, ENDLESS), font, "notes", "notes", part, body, group_key=f"slide{self.n}-notes")


def escaped(name: str) -> str:
    return name.translate(str.maketrans("[]/", "___"))


def name_of(shape) -> str:
    own = {"sp": "nvSpPr", "pic": "nvPicPr", "grpSp": "nvGrpSpPr", "graphicFrame": "nvGraphicFramePr"}
    props = path_to(shape, P, own.get(shape.localName, "nvSpPr"), "cNvPr")
    name = stripped(props.getAttribute("name")) if props is not None else ""
    number_ = props.getAttribute("id") if props is not None else ""
    return name or (f"Shape {number_}" if number_ else "Shape")


def placeholder(shape) -> tuple[str, int] | None:
    ph = path_to(shape, P, "nvSpPr", "nvPr", "ph") if shape.localName == "sp" else None
    return (ph.getAttribute("type") or "obj", int(number(ph, "idx", 0))) if ph is not None else None


def extent(shape) -> tuple[float, float] | None:
    frame = child(shape, P, "xfrm") if shape.localName == "graphicFrame" else path_to(shape, P, "grpSpPr" if shape.localName == "grpSp" else "spPr")
    if shape.localName != "graphicFrame":
        frame = child(frame, A, "xfrm")
    ext = child(frame, A, "ext")
    return (number(ext, "cx", 0), number(ext, "cy", 0)) if ext is not None else None


def usable(outer, props, scale) -> tuple[float, float] | None:
    """Points inside the insets; frames without a body have the default ones."""
    if outer is None:
        return None
    x = number(props, "lIns", INSET_X) + number(props, "rIns", INSET_X)
    y = number(props, "tIns", INSET_Y) + number(props, "bIns", INSET_Y)
    return max(0.0, outer[0] - x) / EMU * scale[0], max(0.0, outer[1] - y) / EMU * scale[1]


def group_scale(group) -> tuple[float, float]:
    frame = child(child(group, P, "grpSpPr"), A, "xfrm")
    ext, inner = child(frame, A, "ext"), child(frame, A, "chExt")
    if ext is None or inner is None or not number(inner, "cx", 0) or not number(inner, "cy", 0):
        return 1.0, 1.0
    return number(ext, "cx", 0) / number(inner, "cx", 0), number(ext, "cy", 0) / number(inner, "cy", 0)


def explicit_size(body) -> float | None:
    for run in body.getElementsByTagNameNS(A, "r"):
        props = child(run, A, "rPr")
        if props is not None and props.hasAttribute("sz"):
            return float(props.getAttribute("sz")) / 100
    return None


def font_of(body) -> dict:
    """Family and style of the first run that shows something."""
    for run in body.getElementsByTagNameNS(A, "r"):
        text = run_text(run)
        if stripped(text):
            props = child(run, A, "rPr")
            latin, east = (f.getAttribute("typeface") if (f := child(props, A, k)) is not None else "" for k in ("latin", "ea"))
            cjk = CJK_BREAK.search(text) or any("가" <= c <= "힯" for c in text)
            style = {k: props is not None and props.getAttribute(a) == "1" for k, a in (("bold", "b"), ("italic", "i"))}
            return {"family": ((east or latin) if cjk else (latin or east)) or FAMILY} | style
    return {"family": FAMILY, "bold": False, "italic": False}


def _tag(node, name: str) -> str:
    """A drawing element's name under the prefix that is in scope."""
    at = node
    while at is not None and at.nodeType == at.ELEMENT_NODE:
        for k in range(at.attributes.length):
            a = at.attributes.item(k)
            if a.value == A and (a.name == "xmlns" or a.name.startswith("xmlns:")):
                return name if a.name == "xmlns" else f"{a.name[6:]}:{name}"
        at = at.parentNode
    return f"a:{name}"


def _make(parent, name: str):
    return parent.ownerDocument.createElementNS(A, _tag(parent, name))


def set_text(run, text: str) -> None:
    t = child(run, A, "t")
    if t is None:
        t = run.appendChild(_make(run, "t"))
    while t.firstChild:
        t.removeChild(t.firstChild)
    t.appendChild(run.ownerDocument.createTextNode(text))
    if text != stripped(text):
        t.setAttribute("xml:space", "preserve")
    elif t.hasAttribute("xml:space"):
        t.removeAttribute("xml:space")


def write_text(body, text: str) -> None:
    """One line for each stretch between breaks; lines too many are added after the last, stretches too many go."""
    lines, paragraphs = text.split("\n"), children(body, A, "p")
    if not paragraphs:
        return
    last = paragraphs[0]
    for p in paragraphs:
        if not lines:
            body.removeChild(p)
            continue
        last = p
        stretches: list[tuple[object, list]] = [(None, [])]
        for c in children(p, A, "br", "r", "fld"):
            if c.localName == "br":
                stretches.append((c, []))
            else:
                stretches[-1][1].append(c)
        for before, runs in stretches:
            if not lines:
                for c in [before, *runs]:
                    if c is not None:
                        p.removeChild(c)
                continue
            line = lines.pop(0)
            if not runs and line:
                runs = [_new_run(p, before)]
            for k, run in enumerate(runs):
                set_text(run, line if k == 0 else "")
    for line in lines:
        last.appendChild(_make(last, "br"))
        like = child(child(last, A, "r"), A, "rPr")
        run = last.appendChild(_make(last, "r"))
        if like is not None:
            run.appendChild(like.cloneNode(True))
        set_text(run, line)


def _new_run(p, before):
    run, end = _make(p, "r"), child(p, A, "endParaRPr")
    if end is not None:
        props = run.appendChild(_make(p, "rPr"))
        for k in range(end.attributes.length):
            props.setAttribute(end.attributes.item(k).name, end.attributes.item(k).value)
        for c in end.childNodes:
            props.appendChild(c.cloneNode(True))
    anchor = before if before is not None else child(p, A, "pPr")
    p.insertBefore(run, anchor.nextSibling if anchor is not None else p.firstChild)
    return run


def write_size(body, size: float, keep_snug: bool) -> None:
    """The size in quarter points on every run that shows something, and shrinking on overflow."""
    for run in body.getElementsByTagNameNS(A, "r"):
        if stripped(run_text(run)):
            props = child(run, A, "rPr")
            if props is None:
                props = run.insertBefore(_make(run, "rPr"), run.firstChild)
            props.setAttribute("sz", str(int(size * 100 // 25 * 25)))
    props = child(body, A, "bodyPr")
    if keep_snug and child(props, A, "spAutoFit") is not None:
        return
    if props is None:
        props = body.insertBefore(_make(body, "bodyPr"), body.firstChild)
    for old in children(props, A, "noAutofit", "normAutofit", "spAutoFit"):
        props.removeChild(old)
    props.insertBefore(_make(props, "normAutofit"), next(iter(children(props, A, "scene3d", "sp3d", "flatTx", "extLst")), None))


def write(content: bytes, translations: dict[str, dict], images: dict[str, bytes] | None = None) -> bytes:
    """A deck with translations (by id: translation, fitted_size_pt) and replaced image parts."""
    scan = Scan(Archive(content)).run()
    unknown = set(translations) - {s.id for s in scan.sites}
    if unknown:
        raise ValueError(f"segments that the deck doesn't have: {sorted(unknown)[:3]}")
    cached: dict[str, dict[str, set[str]]] = {}
    for s in scan.sites:
        row = translations.get(s.id)
        if row is None or row["translation"] is None or row["translation"] == s.text:
            continue
        write_text(s.body, row["translation"])
        scan.archive.changed.add(s.part_path)
        if s.drawing_path:
            cached.setdefault(s.drawing_path, {}).setdefault(s.text, set()).add(row["translation"])
        if s.kind != "notes" and row.get("fitted_size_pt") is not None and row["fitted_size_pt"] != s.font["size_pt"]:
            write_size(s.body, row["fitted_size_pt"], s.snug)
    for part, texts in cached.items():
        try:
            drawing = scan.archive.xml(part)
        except ValueError:
            continue
        for run in drawing.getElementsByTagNameNS(A, "r"):
            found = texts.get(run_text(run), set()) if stripped(run_text(run)) else set()
            if len(found) == 1:
                set_text(run, next(iter(found)))
                scan.archive.changed.add(part)
    for part, data in (images or {}).items():
        scan.archive.replaced(part, data)
    return scan.archive.saved()


def rows(path: str, content: bytes) -> list[dict]:
    out = []
    for k, s in enumerate(Scan(Archive(content, False)).run().sites):
        out.append({"path": path, "pos": k, "id": s.id, "text": s.text, "box_w": s.box[0], "box_h": s.box[1], **s.font, "context": s.context, "group_key": s.group_key, "kind": s.kind, "part_path": s.part_path, "drawing_path": s.drawing_path})
    return out


def files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of the decks under a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pptx").load(path).select("path", "content")


def _tried(work: Callable[[], object]) -> tuple[object, str | None]:
    """What work gives, or what it raises as a text: a broken deck is a row, not a failed job."""
    try:
        return work(), None
    except Exception as e:
        return None, str(e) or type(e).__name__


def segments(decks: DataFrame) -> DataFrame:
    """decks (path, content) as segments; of one that can't be read there is a row in skipped only."""
    ship(decks.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from out_batches((row for d in rows_of(batches) for row in _tried(lambda d=d: rows(d["path"], d["content"]))[0] or []), _ARROW)

    return decks.select("path", "content").mapInArrow(run, SEGMENT)


def skipped(decks: DataFrame) -> DataFrame:
    """path, id and reason of what the decks have that isn't read; a deck that can't be read at all has its path as id."""
    ship(decks.sparkSession)
    schema = pa.schema([("path", pa.string()), ("id", pa.string()), ("reason", pa.string())])

    def of(d: dict) -> list[tuple[str, str]]:
        found, error = _tried(lambda: Scan(Archive(d["content"], False)).run().skips)
        return [(d["path"], f"unreadable deck: {error}")] if error else found

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from out_batches(({"path": d["path"], "id": i, "reason": r} for d in rows_of(batches) for i, r in of(d)), schema)

    return decks.select("path", "content").mapInArrow(run, "path string, id string, reason string")


def media(decks: DataFrame) -> DataFrame:
    """Raster images of the decks, each once at its first use: path, media_path, slide_no, content; others have a reason."""
    ship(decks.sparkSession)
    schema = pa.schema([("path", pa.string()), ("media_path", pa.string()), ("slide_no", pa.int32()), ("pos", pa.int32()), ("content", pa.binary()), ("reason", pa.string())])

    def uses(d: dict) -> Iterator[dict]:
        scan, seen = _tried(lambda: Scan(Archive(d["content"], False)).run())[0], set()
        for k, (part, _, n) in enumerate(scan.media if scan else []):
            if part in seen:
                continue
            seen.add(part)
            raster = part.rsplit(".", 1)[-1].lower() in RASTER
            data = scan.archive.parts.get(part)
            reason = None if raster and data is not None else UNREADABLE if raster else VECTOR
            yield {"path": d["path"], "media_path": part, "slide_no": n, "pos": k, "content": data if raster else None, "reason": reason}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from out_batches((u for d in rows_of(batches) for u in uses(d)), schema)

    return decks.select("path", "content").mapInArrow(run, "path string, media_path string, slide_no int, pos int, content binary, reason string")


def written(decks: DataFrame, translations: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """path, content and error: decks changed by translations (path, id, translation, fitted_size_pt) and images (path, part, content).

    A deck's rows are bounded by the deck. One that can't be written has no content but an error.
    """
    ship(decks.sparkSession)
    own = translations.groupBy("path").agg(F.collect_list(F.struct("id", "translation", "fitted_size_pt")).alias("rows"))
    all_ = decks.select("path", "content").join(own, "path", "left")
    if images is not None:
        all_ = all_.join(images.groupBy("path").agg(F.collect_list(F.struct("part", "content")).alias("images")), "path", "left")
    schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("error", pa.string())])

    def of(d: dict) -> dict:
        texts, parts = {r["id"]: r for r in d["rows"] or []}, {r["part"]: r["content"] for r in d.get("images") or []}
        content, error = _tried(lambda: write(d["content"], texts, parts))
        return {"path": d["path"], "content": content, "error": error}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):  # a deck at a time, as they may be large
                for d in rows_of([batch.slice(k, 1)]):
                    held.append(of(d))
                    size += len(held[-1]["content"] or b"")
                if size >= _BYTES or len(held) == _DECKS:
                    yield from out_batches(held, schema)
                    held, size = [], 0
        yield from out_batches(held, schema)

    return all_.mapInArrow(run, "path string, content binary, error string")
