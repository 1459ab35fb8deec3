"""Structure of office files made by hand."""

import io
import zipfile

from pyspark.sql import functions as F

from siltstone.operators import layout
from siltstone.sources import office

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def packed(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


def paragraph(text, style=None, listed=False):
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + ("<w:numPr/>" if listed else "")
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text[:3]}</w:t></w:r><w:r><w:t>{text[3:]}</w:t></w:r></w:p>"


CELL = lambda t: f"<w:tc>{paragraph(t)}</w:tc>"
DOCX = f"<w:document {W}><w:body>{paragraph('Handbook', 'Title')}{paragraph('Setting up', 'Heading1')}{paragraph('Read this.')}{paragraph('   ')}{paragraph('first', listed=True)}{paragraph('Tools', 'Heading2')}<w:tbl><w:tr>{CELL('name')}{CELL('size')}</w:tr><w:tr>{CELL('saw')}{CELL('7')}</w:tr></w:tbl>{paragraph('After', 'Heading1')}</w:body></w:document>"
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
BOOK = f'<workbook {S} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Prices" r:id="rId2"/><sheet name="Empty" r:id="rId9"/></sheets></workbook>'
RELS = '<Relationships xmlns="x"><Relationship Id="rId2" Target="worksheets/data.xml"/></Relationships>'
SHEET = f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="s"><v>1</v></c><c r="AB1"><v>3.5</v></c></row><row r="3"><c r="B3" t="inlineStr"><is><t>in line</t></is></c><c r="C3"/></row></sheetData></worksheet>'
STRINGS = f"<sst {S}><si><t>zero</t></si><si><r><t>on</t></r><r><t>e</t></r></si></sst>"
NS = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
SHAPE = lambda text, kind="": f"<p:sp><p:nvSpPr><p:nvPr>{kind}</p:nvPr></p:nvSpPr><p:txBody>{''.join(f'<a:p><a:r><a:t>{t}</a:t></a:r></a:p>' for t in text)}</p:txBody></p:sp>"
SLIDE = lambda *shapes: f"<p:sld {NS}>{''.join(shapes)}</p:sld>"

FILES = [
    ("a/hand.DOCX", packed(word__document_dot_xml=DOCX)),
    ("b.xlsx", packed(**{"xl__workbook_dot_xml": BOOK, "xl___rels__workbook_dot_xml_dot_rels": RELS, "xl__worksheets__data_dot_xml": SHEET, "xl__sharedStrings_dot_xml": STRINGS})),
    ("c.pptx", packed(ppt__slides__slide10_dot_xml=SLIDE(SHAPE(["last"])), ppt__slides__slide2_dot_xml=SLIDE(SHAPE(["Plan"], '<p:ph type="title"/>'), SHAPE(["one", "two"]), SHAPE([" "])), ppt__notesSlides__notesSlide1_dot_xml=SLIDE(SHAPE(["say hello"])))),
    ("broken.docx", b"no zip"),
    ("empty.docx", packed(other="x")),
    ("plain.txt", b"text"),
    ("null.docx", None),
]


def test_office_structure(spark):
    files = spark.createDataFrame(FILES, "path string, content binary").withColumns({"kind": F.lit("clash"), "position": F.lit(1)}).repartition(3)
    got = {}
    for r in office.office_structure(files).orderBy("path", "position").collect():
        got.setdefault(r["path"], []).append((r["part"], r["kind"], r["level"], r["row"], r["column"], r["text"]))
    assert got["a/hand.DOCX"] == [
        ("body", "title", 0, None, None, "Handbook"),
        ("body", "heading", 1, None, None, "Setting up"),
        ("body", "paragraph", 0, None, None, "Read this."),
        ("body", "list_item", 0, None, None, "first"),
        ("body", "heading", 2, None, None, "Tools"),
        ("body", "cell", 1, 0, 0, "name"),
        ("body", "cell", 1, 0, 1, "size"),
        ("body", "cell", 1, 1, 0, "saw"),
        ("body", "cell", 1, 1, 1, "7"),
        ("body", "heading", 1, None, None, "After"),
    ]
    assert got["b.xlsx"] == [("Prices", "sheet", 0, None, None, "Prices"), ("Prices", "cell", 0, 0, 0, "one"), ("Prices", "cell", 0, 0, 27, "3.5"), ("Prices", "cell", 0, 2, 1, "in line"), ("Empty", "sheet", 1, None, None, "Empty")]
    assert got["c.pptx"] == [("slide 2", "title", 2, None, None, "Plan"), ("slide 2", "shape", 2, None, None, "one\ntwo"), ("slide 10", "shape", 10, None, None, "last"), ("notes 1", "notes", 1, None, None, "say hello")]
    assert [k for _, k, *_ in got["broken.docx"]] == ["unreadable"] == [k for _, k, *_ in got["empty.docx"]]
    assert set(got) == {"a/hand.DOCX", "b.xlsx", "c.pptx", "broken.docx", "empty.docx"}
    assert office.office_structure(files.limit(0)).count() == 0


def test_contents_make_a_heading_tree(spark):
    files = spark.createDataFrame(FILES[:3], "path string, content binary")
    toc = office.contents(office.office_structure(files))
    tree = layout.heading_tree(toc.where("path = 'a/hand.DOCX' and level > 0"), key="path")
    assert [(r["text"], r["parent"], r["path"]) for r in tree.orderBy("position").collect()] == [("Setting up", None, ["Setting up"]), ("Tools", 1, ["Setting up", "Tools"]), ("After", None, ["After"])]
