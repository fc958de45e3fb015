"""HTML pages to ordered blocks: headings, paragraphs, list items, code, tables and images."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.session import pieces

BLOCKS = "page_id long, pos int, kind string, level int, list_id int, anchor string, text string"
_HEADINGS = {f"h{i}": i for i in range(1, 7)}
_PARAGRAPHS = {"p", "div", "article", "section", "footer", "header", "main", "nav", "blockquote", "figcaption", "td", "th"}
_SKIPPED = {"script", "style", "head", "template"}


class BlockParser(HTMLParser):
    """Collects (kind, level, list_id, anchor, text). A table is one block, rows by line, cells by ' | '."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple] = []
        self.kind, self.level, self.anchor = "paragraph", 0, None
        self.parts: list[str] = []
        self.skip = self.depth = self.lists = self.pre = 0
        self.rows: list[list[str]] | None = None

    def flush(self):
        raw = "".join(self.parts)
        text = raw.strip("\n") if self.kind == "code" else " ".join(raw.split())
        self.parts = []
        if self.rows is not None:
            if self.rows and self.rows[-1] is not None and text:
                self.rows[-1].append(text)
            return
        if text:
            self.blocks.append((self.kind, self.level, self.lists if self.kind == "list" else None, self.anchor, text))
        self.anchor = None

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        if tag in _SKIPPED:
            self.skip += 1
        elif tag in _HEADINGS:
            self.flush()
            self.kind, self.level, self.anchor = "heading", _HEADINGS[tag], found.get("id")
        elif tag in ("ul", "ol"):
            self.flush()
            self.lists += self.depth == 0
            self.depth += 1
        elif tag == "li":
            self.flush()
            self.kind, self.level = "list", self.depth - 1
        elif tag == "pre":
            self.flush()
            self.kind, self.level, self.pre = "code", 0, self.pre + 1
        elif tag == "table":
            self.flush()
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.flush()
            self.rows.append([])
        elif tag in _PARAGRAPHS:
            self.flush()
            if self.kind != "list" or not self.depth:
                self.kind, self.level = "paragraph", 0
            self.anchor = found.get("id")
        elif tag == "br":
            self.parts.append("\n")
        elif tag == "img" and found.get("alt"):
            self.flush()
            self.blocks.append(("image", 0, None, None, found["alt"].strip()))

    def handle_endtag(self, tag):
        if tag in _SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in ("ul", "ol"):
            self.flush()
            self.depth = max(0, self.depth - 1)
            self.kind, self.level = ("list", self.depth - 1) if self.depth else ("paragraph", 0)
        elif tag == "table" and self.rows is not None:
            self.flush()
            rows, self.rows = self.rows, None
            if any(rows):
                self.blocks.append(("table", 0, None, None, "\n".join(" | ".join(r) for r in rows if r)))
        elif tag in _HEADINGS or tag in ("pre", "li") or tag in _PARAGRAPHS:
            self.flush()
            if tag != "li" and not (tag in _PARAGRAPHS and self.depth):
                self.kind, self.level = "paragraph", 0

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def parse_html(text: str | None) -> list[tuple]:
    parser = BlockParser()
    parser.feed(text or "")
    parser.close()
    parser.flush()
    return parser.blocks


def _parse_rows(batches):
    for batch in (piece for whole in batches for piece in pieces(whole)):
        out = [(page, pos, *block) for page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for pos, block in enumerate(parse_html(html))]
        columns = list(zip(*out, strict=True)) if out else [[]] * 7
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "pos", "kind", "level", "list_id", "anchor", "text"])


def html_blocks(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """One row a block, in page order (pos)."""
    return pages.select(F.col(id_column).cast("long"), F.col(html_column)).mapInArrow(_parse_rows, BLOCKS)
