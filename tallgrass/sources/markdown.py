"""Markdown to ordered blocks, and back."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = "doc_id long, pos int, kind string, level int, text string"
_HEADING = re.compile(r"(#{1,6})\s+(.*?)\s*#*$")
_ITEM = re.compile(r"(\s*)(?:[-*+]|\d+[.)])\s+(.*)")
_FENCE = re.compile(r"\s*(```+|~~~+)(.*)")


def parse_markdown(text: str | None) -> list[tuple[str, int, str]]:
    """(kind, level, text) of headings, list items, code, tables and paragraphs."""
    blocks: list[tuple[str, int, str]] = []
    lines = (text or "").split("\n")
    held: list[str] = []

    def flush():
        if held:
            table = all(line.lstrip().startswith("|") for line in held)
            blocks.append(("table" if table else "paragraph", 0, "\n".join(held)))
            held.clear()

    i = 0
    while i < len(lines):
        line = lines[i]
        if fence := _FENCE.fullmatch(line):
            flush()
            end = next((j for j in range(i + 1, len(lines)) if lines[j].strip().startswith(fence[1])), len(lines))
            blocks.append(("code", 0, "\n".join(lines[i + 1 : end])))
            i = end + 1
            continue
        if not line.strip():
            flush()
        elif heading := _HEADING.fullmatch(line.strip()):
            flush()
            blocks.append(("heading", len(heading[1]), heading[2]))
        elif held and re.fullmatch(r"\s*(=+|-+)\s*", line) and len(held) == 1 and not held[0].lstrip().startswith("|"):
            blocks.append(("heading", 1 if line.strip()[0] == "=" else 2, held.pop().strip()))
        elif item := _ITEM.fullmatch(line):
            flush()
            blocks.append(("list", len(item[1]) // 2, item[2].strip()))
        else:
            if held and held[0].lstrip().startswith("|") != line.lstrip().startswith("|"):
                flush()
            held.append(line.rstrip())
        i += 1
    flush()
    return blocks


def _parse_rows(batches):
    for batch in batches:
        out = [(doc, pos, *block) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for pos, block in enumerate(parse_markdown(text))]
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "pos", "kind", "level", "text"])


def markdown_blocks(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    return docs.select(F.col(id_column).cast("long"), F.col(text_column)).mapInArrow(_parse_rows, BLOCKS)


def rendered(kind: Column, level: Column, text: Column) -> Column:
    """One block as Markdown."""
    return (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text))
        .when(kind == "list", F.concat(F.repeat(F.lit("  "), level), F.lit("- "), text))
        .when(kind == "code", F.concat(F.lit("```\n"), text, F.lit("\n```")))
        .otherwise(text)
    )


def to_markdown(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, markdown): blocks in order, blank lines between."""
    each = blocks.select(doc, "pos", rendered(F.col("kind"), F.col("level"), F.col("text")).alias("t"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "t")))
    return each.groupBy(doc).agg(F.array_join(F.transform(ordered, lambda b: b["t"]), "\n\n").alias("markdown"))
