"""Small slide decks for the tests."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

NS = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
TYPE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"
EMU = 12700


def paragraphs(texts, props="", runs=None):
    out = ""
    for t in texts:
        parts = t.split("\n")
        out += "<a:p>" + "<a:br/>".join(f'<a:r><a:rPr {props}/><a:t>{escape(x)}</a:t></a:r>' for x in parts) + "</a:p>"
    return out


def shape(name, texts, box=(100, 50), ph=None, body="", props='sz="2000" b="1"', ext=True):
    place = f"<p:ph {ph}/>" if ph else ""
    frame = f'<a:xfrm><a:off x="0" y="0"/><a:ext cx="{int(box[0] * EMU)}" cy="{int(box[1] * EMU)}"/></a:xfrm>' if ext else ""
    return f'<p:sp><p:nvSpPr><p:cNvPr id="7" name="{name}"/><p:cNvSpPr/><p:nvPr>{place}</p:nvPr></p:nvSpPr><p:spPr>{frame}</p:spPr><p:txBody>{body or "<a:bodyPr/>"}{paragraphs(texts, props)}</p:txBody></p:sp>'


def group(name, inner, scale):
    return f'<p:grpSp><p:nvGrpSpPr><p:cNvPr id="3" name="{name}"/></p:nvGrpSpPr><p:grpSpPr><a:xfrm><a:ext cx="{100 * scale}" cy="{200 * scale}"/><a:chExt cx="100" cy="100"/></a:xfrm></p:grpSpPr>{inner}</p:grpSp>'


def table(name, rows, widths, heights):
    cells = "".join(f'<a:tr h="{int(h * EMU)}">' + "".join(f"<a:tc {attrs}><a:txBody><a:bodyPr/>{paragraphs([t]) if t else '<a:p/>'}</a:txBody></a:tc>" for t, attrs in row) + "</a:tr>" for row, h in zip(rows, heights, strict=True))
    grid = "".join(f'<a:gridCol w="{int(w * EMU)}"/>' for w in widths)
    return f'<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="4" name="{name}"/></p:nvGraphicFramePr><a:graphic><a:graphicData uri="http://schemas.openxmlformats.org/drawingml/2006/table"><a:tbl><a:tblGrid>{grid}</a:tblGrid>{cells}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>'


def frame(name, uri, inner=""):
    return f'<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="5" name="{name}"/></p:nvGraphicFramePr><p:xfrm><a:ext cx="{200 * EMU}" cy="{100 * EMU}"/></p:xfrm><a:graphic><a:graphicData uri="{uri}">{inner}</a:graphicData></a:graphic></p:graphicFrame>'


def picture(name, embed="", video=False):
    return f'<p:pic><p:nvPicPr><p:cNvPr id="6" name="{name}"/><p:nvPr>{"<a:videoFile/>" if video else ""}</p:nvPr></p:nvPicPr><p:blipFill><a:blip r:embed="{embed}"/></p:blipFill></p:pic>'


def rels(*items):
    return "<Relationships xmlns=\"http://schemas.openxmlformats.org/package/2006/relationships\">" + "".join(f'<Relationship Id="{i}" Type="{TYPE}{t}" Target="{target}"/>' for i, t, target in items) + "</Relationships>"


def tree(inner, root="sld"):
    return f"<p:{root} {NS}><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:{root}>"


def deck(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def sample() -> bytes:
    dgm = "http://schemas.openxmlformats.org/drawingml/2006/diagram"
    points = "".join(f'<dgm:pt modelId="{{{k}}}"><dgm:t><a:bodyPr/>{paragraphs([t])}</dgm:t></dgm:pt>' for k, t in enumerate(["Step", "Step", "Goal"]))
    slide = tree(
        shape("Title 1", ["A title"], ph='type="ctrTitle"', props="", ext=False) + shape("Body", ["One\nTwo", "Three"]) + shape("Body", ["Again"]) + shape("Blank", [" "])
        + shape("Art", ["Curved"], body='<a:bodyPr><a:prstTxWarp prst="textArch"/></a:bodyPr>') + shape("Snug", ["Fits tight"], (80, 10), body="<a:bodyPr><a:spAutoFit/></a:bodyPr>")
        + group("G[1]", shape("Inner", ["Scaled"], (100, 50)), 2)
        + table("T", [[("Head", 'gridSpan="2"'), ("stray", 'hMerge="1"')], [("", ""), ("Cell", "")]], [60, 40], [20, 30])
        + frame("C", "http://schemas.openxmlformats.org/drawingml/2006/chart") + picture("Film", video=True) + picture("Photo", "rId5") + picture("Photo again", "rId5") + picture("Vector", "rId6")
        + frame("S", dgm, f'<dgm:relIds xmlns:dgm="{dgm}" r:dm="rId3"/>')
    )
    return deck({
        "[Content_Types].xml": "<Types/>",
        "ppt/slides/slide10.xml": tree(shape("Last", ["Tenth"])),
        "ppt/slides/slide2.xml": slide,
        "ppt/slides/_rels/slide2.xml.rels": rels(("rId1", "slideLayout", "../slideLayouts/slideLayout1.xml"), ("rId2", "notesSlide", "/ppt/notesSlides/notesSlide1.xml"), ("rId3", "diagramData", "../diagrams/data1.xml"), ("rId4", "diagramDrawing", "../diagrams/drawing1.xml"), ("rId5", "image", "../media/image1.png"), ("rId6", "image", "../media/image2.emf")),
        "ppt/slideLayouts/slideLayout1.xml": tree(shape("L", [""], ph='type="pic"'), "sldLayout"),
        "ppt/slideLayouts/_rels/slideLayout1.xml.rels": rels(("rId1", "slideMaster", "../slideMasters/slideMaster1.xml")),
        "ppt/slideMasters/slideMaster1.xml": tree(shape("M", [""], (400, 90), ph='type="title"'), "sldMaster"),
        "ppt/notesSlides/notesSlide1.xml": tree(shape("N", ["Remember"], ph='type="body" idx="1"') + shape("No", ["12"], ph='type="sldNum"'), "notes"),
        "ppt/diagrams/data1.xml": f'<dgm:dataModel xmlns:dgm="{dgm}" {NS}><dgm:ptLst>{points}</dgm:ptLst><dgm:extLst><a:ext uri="x"><dsp:dataModelExt xmlns:dsp="http://schemas.microsoft.com/office/drawing/2008/diagram" relId="rId4"/></a:ext></dgm:extLst></dgm:dataModel>',
        "ppt/diagrams/drawing1.xml": f'<dsp:drawing xmlns:dsp="http://schemas.microsoft.com/office/drawing/2008/diagram" {NS}>{paragraphs(["Step", "Goal"])}</dsp:drawing>',
        "ppt/media/image1.png": b"\x89PNG pixels", "ppt/media/image2.emf": b"vector",
    })
