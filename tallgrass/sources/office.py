"""Office files (DOCX, PPTX, XLSX) to ordered blocks, and the text of their charts and diagrams.

The files are ZIP archives of XML and are read with the standard library inside
Arrow batches. A file that is null, no archive, or lacks the main part gives one
block of kind ``error``; an empty document gives none.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS = "path string, pos int, kind string, level int, page int, text string"
_TYPES = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]

Block = tuple[str, int, int, str]


def _local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _attribute(element: ElementTree.Element | None, name: str) -> str | None:
    if element is None:
        return None
    return next((v for k, v in element.attrib.items() if k.rpartition("}")[2] == name), None)


def _first(element: ElementTree.Element, name: str) -> ElementTree.Element | None:
    return next((e for e in element.iter() if _local(e) == name), None)


def _texts(element: ElementTree.Element, name: str = "t") -> str:
    return "".join(e.text or "" for e in element.iter() if _local(e) == name)


def _table(rows: list[list[str]]) -> str:
    return "\n".join(" | ".join(" ".join(cell.split()) for cell in row) for row in rows)


def _grid(table: ElementTree.Element, row: str, cell: str) -> list[list[str]]:
    """Cells of a table's own rows; paragraphs of a cell are joined by a space."""
    out = []
    for r in (e for e in table if _local(e) == row):
        cells = [e for e in r if _local(e) == cell]
        out.append([" ".join(filter(None, (_texts(p) for p in c.iter() if _local(p) == "p"))) for c in cells])
    return out


def _numbered(names: list[str], pattern: str) -> list[tuple[int, str]]:
    found = ((re.fullmatch(pattern, n), n) for n in names)
    return sorted((int(m[1]), n) for m, n in found if m)


def docx_blocks(archive: zipfile.ZipFile) -> Iterator[Block]:
    """Paragraphs, headings (by style name), list items (by numbering) and tables, in the order of the body."""
    body = _first(ElementTree.fromstring(archive.read("word/document.xml")), "body")
    for element in body if body is not None else ():
        if _local(element) == "tbl":
            yield "table", 0, 0, _table(_grid(element, "tr", "tc"))
        elif _local(element) == "p" and (text := _texts(element).strip()):
            style = _attribute(_first(element, "pStyle"), "val") or ""
            heading = re.fullmatch(r"(?i)heading\s*([1-9])", style)
            if heading or style.lower() == "title":
                yield "heading", int(heading[1]) if heading else 1, 0, text
            elif _first(element, "numPr") is not None:
                yield "list", int(_attribute(_first(element, "ilvl"), "val") or 0), 0, text
            else:
                yield "paragraph", 0, 0, text


def pptx_blocks(archive: zipfile.ZipFile) -> Iterator[Block]:
    """Slides in number order; a title placeholder is a heading, other paragraphs keep their indent level, the page is the slide's number."""
    for number, name in _numbered(archive.namelist(), r"ppt/slides/slide(\d+)\.xml"):
        root = ElementTree.fromstring(archive.read(name))
        for shape in (e for e in root.iter() if _local(e) in ("sp", "tbl")):
            if _local(shape) == "tbl":
                yield "table", 0, number, _table(_grid(shape, "tr", "tc"))
                continue
            title = _attribute(_first(shape, "ph"), "type") in ("title", "ctrTitle")
            for p in (e for e in shape.iter() if _local(e) == "p"):
                if text := _texts(p).strip():
                    yield ("heading", 1, number, text) if title else ("paragraph", int(_attribute(_first(p, "pPr"), "lvl") or 0), number, text)


def _column(reference: str) -> int:
    out = 0
    for letter in re.match(r"[A-Z]*", reference)[0]:
        out = out * 26 + ord(letter) - ord("A") + 1
    return out - 1


def xlsx_blocks(archive: zipfile.ZipFile) -> Iterator[Block]:
    """One table block a sheet; cells keep their columns, shared and inline strings are resolved. The page is the sheet's number."""
    names = archive.namelist()
    shared: list[str] = []
    if "xl/sharedStrings.xml" in names:
        shared = [_texts(e) for e in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")) if _local(e) == "si"]
    for number, name in _numbered(names, r"xl/worksheets/sheet(\d+)\.xml"):
        rows = []
        for row in (e for e in ElementTree.fromstring(archive.read(name)).iter() if _local(e) == "row"):
            cells: dict[int, str] = {}
            for c in (e for e in row if _local(e) == "c"):
                kind, raw = c.get("t"), _texts(c, "v")
                value = shared[int(raw)] if kind == "s" and raw else _texts(c) if kind == "inlineStr" else raw
                cells[max(0, _column(c.get("r") or "")) if c.get("r") else len(cells)] = value
            if any(cells.values()):
                rows.append([cells.get(i, "") for i in range(max(cells) + 1)])
        if rows:
            yield "table", 0, number, _table(rows)


#: Reader and main part of each format, by extension.
FORMATS: dict[str, tuple[Callable[[zipfile.ZipFile], Iterator[Block]], str]] = {
    "docx": (docx_blocks, "word/document.xml"),
    "pptx": (pptx_blocks, "ppt/presentation.xml"),
    "xlsx": (xlsx_blocks, "xl/workbook.xml"),
}


def parse_office(path: str, content: bytes | None) -> list[Block]:
    reader, main = FORMATS.get(path.rpartition(".")[2].lower(), (None, ""))
    if reader is None:
        return [("error", 0, 0, "unsupported format")]
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as archive:
            if main not in archive.namelist():
                return [("error", 0, 0, f"no part {main}")]
            return list(reader(archive))
    except (zipfile.BadZipFile, ElementTree.ParseError) as e:
        return [("error", 0, 0, type(e).__name__)]


def _parse_rows(batches):
    for batch in batches:
        files = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        out = [(path, pos, *block) for path, content in files for pos, block in enumerate(parse_office(path or "", content))]
        columns = list(zip(*out, strict=True)) if out else [[]] * len(_TYPES)
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, _TYPES, strict=True)], names=["path", "pos", "kind", "level", "page", "text"])


def blocks_of(files: DataFrame) -> DataFrame:
    """Blocks of files (path, content)."""
    return files.select("path", "content").mapInArrow(_parse_rows, BLOCKS)


def office_blocks(spark: SparkSession, root: str) -> DataFrame:
    """Blocks of every Office file below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{docx,pptx,xlsx}").load(root)
    return blocks_of(files)


def chart_series(xml: bytes | str) -> tuple[str, list[str], list[tuple[str, list[float | None]]]] | None:
    """(type, categories, [(name, values)]) of a chart part; values are dense by point index, gaps are None. None if it is no chart."""
    try:
        plot = _first(ElementTree.fromstring(xml), "plotArea")
    except ElementTree.ParseError:
        return None
    chart = next((e for e in plot if _local(e).endswith("Chart")), None) if plot is not None else None
    if chart is None:
        return None

    def points(parent: ElementTree.Element | None) -> list[str | None]:
        found = {int(p.get("idx")): _texts(p, "v") for p in parent.iter() if _local(p) == "pt"} if parent is not None else {}
        return [found.get(i) for i in range(max(found) + 1)] if found else []

    series, categories = [], []
    for one in (e for e in chart if _local(e) == "ser"):
        parts = {_local(e): e for e in one}
        categories = categories or [c or "" for c in points(parts.get("cat"))]
        name = _texts(parts["tx"], "v") if "tx" in parts else ""
        series.append((name, [None if v is None else float(v) for v in points(parts.get("val"))]))
    return _local(chart).removesuffix("Chart"), categories, series


def diagram_texts(xml: bytes | str) -> list[str] | None:
    """Node texts of a diagram part in document order, without empty ones. None if it has none."""
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return None
    return [t for e in root.iter() if _local(e) == "pt" and (t := " ".join(_texts(e).split()))] or None


def chart_sentence(kind, categories, names):
    """A fixed sentence from a chart's type, categories and series names (columns)."""
    return F.concat(F.initcap(kind), F.lit(" chart of "), F.array_join(names, ", "), F.lit(" by "), F.array_join(categories, ", "), F.lit("."))
