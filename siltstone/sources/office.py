"""Structure of office files: headings, paragraphs, list items and tables of documents, cells of sheets, shapes and notes of slides.

Files are read as bytes by Spark's binary source; a worker opens one file's XML parts at a
time. Each element is a row in reading order.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SCHEMA = "path string, position int, part string, kind string, level int, row int, column int, text string"
#: Name spaces of the formats (fixed values).
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
Element = tuple[str, str, int | None, int | None, int | None, str]


def said(node: ET.Element, tag: str) -> str:
    return "".join(t.text or "" for t in node.iter(tag))


def document(files: zipfile.ZipFile) -> Iterator[Element]:
    """(part, kind, level, row, column, text) of a text document's body; cells of a table have its number as level."""
    body = ET.fromstring(files.read("word/document.xml")).find(f"{W}body")
    tables = 0
    for node in body if body is not None else ():
        if node.tag == f"{W}p":
            text = said(node, f"{W}t")
            style = node.find(f"{W}pPr/{W}pStyle")
            name = "" if style is None else style.get(f"{W}val", "")
            if "heading" in name.lower():
                number = re.search(r"\d+", name)
                yield "body", "heading", int(number[0]) if number else 1, None, None, text
            elif text.strip():
                listed = node.find(f"{W}pPr/{W}numPr") is not None
                yield "body", "title" if name.lower() == "title" else "list_item" if listed else "paragraph", 0, None, None, text
        elif node.tag == f"{W}tbl":
            tables += 1
            for r, line in enumerate(node.findall(f"{W}tr")):
                for c, cell in enumerate(line.findall(f"{W}tc")):
                    yield "body", "cell", tables, r, c, "\n".join(said(p, f"{W}t") for p in cell.iter(f"{W}p"))


def column_number(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def workbook(files: zipfile.ZipFile) -> Iterator[Element]:
    """A row a sheet (text: its name) and a row a cell that holds something, by rows and columns from 0."""
    names = set(files.namelist())
    shared = [said(i, f"{S}t") for i in ET.fromstring(files.read("xl/sharedStrings.xml")).iter(f"{S}si")] if "xl/sharedStrings.xml" in names else []
    targets = {}
    if "xl/_rels/workbook.xml.rels" in names:
        for r in ET.fromstring(files.read("xl/_rels/workbook.xml.rels")):
            targets[r.get("Id")] = "xl/" + r.get("Target", "").removeprefix("/xl/")
    for k, sheet in enumerate(ET.fromstring(files.read("xl/workbook.xml")).iter(f"{S}sheet")):
        name, path = sheet.get("name", ""), targets.get(sheet.get(f"{R}id"), f"xl/worksheets/sheet{k + 1}.xml")
        yield name, "sheet", k, None, None, name
        if path not in names:
            continue
        for cell in ET.fromstring(files.read(path)).iter(f"{S}c"):
            where, kind, value = cell.get("r", "A1"), cell.get("t"), cell.find(f"{S}v")
            text = said(cell, f"{S}t") if kind == "inlineStr" else "" if value is None else value.text or ""
            if kind == "s" and text.isdigit():
                text = shared[int(text)] if int(text) < len(shared) else ""
            if text:
                yield name, "cell", k, int(re.search(r"\d+", where)[0]) - 1, column_number(where), text


def slides(files: zipfile.ZipFile) -> Iterator[Element]:
    """Shapes with a text, slide by slide, then notes; a title's kind is ``title``, levels are numbers of slides."""
    number = lambda n: int(re.search(r"(\d+)\.xml$", n)[1])
    for kind, pattern in (("shape", r"ppt/slides/slide\d+\.xml"), ("notes", r"ppt/notesSlides/notesSlide\d+\.xml")):
        for name in sorted((n for n in files.namelist() if re.fullmatch(pattern, n)), key=number):
            root = ET.fromstring(files.read(name))
            if kind == "notes":
                if text := said(root, f"{A}t").strip():
                    yield f"notes {number(name)}", kind, number(name), None, None, text
                continue
            for shape in root.iter(f"{P}sp"):
                text = "\n".join(t for p in shape.iter(f"{A}p") if (t := said(p, f"{A}t"))).strip()
                place = shape.find(f".//{P}nvPr/{P}ph")
                title = place is not None and place.get("type") in ("title", "ctrTitle")
                if text:
                    yield f"slide {number(name)}", "title" if title else kind, number(name), None, None, text


READERS = {"docx": document, "xlsx": workbook, "pptx": slides}


def office_structure(files: DataFrame) -> DataFrame:
    """One row an element of each docx, xlsx and pptx file (path, content), in reading order.

    Other files have no rows; one that cannot be read has a row of kind ``unreadable`` with
    the reason. A null content has none, repeated rows give their rows again, an empty table
    gives an empty one. Narrow: files stay in their partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                path, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                read = READERS.get((path or "").rsplit(".", 1)[-1].lower())
                if read is None or content is None:
                    continue
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        found = list(read(z))
                except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
                    found = [("", "unreadable", None, None, None, f"{type(e).__name__}: {e}")]
                columns = list(zip(*found)) if found else [()] * 6
                kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array(range(len(found)), pa.int32()), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[c.split(" ")[0] for c in SCHEMA.split(", ")])

    return files.select(F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content")).mapInArrow(run, SCHEMA)


def contents(structure: DataFrame) -> DataFrame:
    """(path, position, level, text): the table of contents: headings of documents, sheets, and titles of slides."""
    return structure.where(F.col("kind").isin("heading", "sheet", "title")).select("path", "position", F.coalesce("level", F.lit(0)).alias("level"), "text")
