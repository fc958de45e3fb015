"""Blocks to sections to token-budgeted chunks."""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallgrass.session import pieces

# Token budgets and the share by which each kind may exceed the target.
TARGET, HARD_MAX, LEAST = 512, 1024, 64
FLEX = {"table": 0.50, "list": 0.35, "code": 0.35, "image": 0.25, "paragraph": 0.10, "heading": 0.0}
OVERLAP_SENTENCES = 2
CHUNKS = "doc_id long, chunk int, node_id string, text string, tokens int, sections int, overflow boolean"


def heading_paths(blocks: DataFrame, doc: str = "doc_id", levels: int = 6) -> DataFrame:
    """blocks with heading_path: the open heading of each level above, a heading closing its own level and deeper ones."""
    w = Window.partitionBy(doc).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = blocks
    for k in range(1, levels + 1):
        at = F.when((F.col("kind") == "heading") & (F.col("level") <= k), F.struct(F.col("level").alias("l"), F.col("text").alias("t")))
        out = out.withColumn(f"__h{k}", F.last(at, True).over(w))
    path = F.array_compact(F.array(*[F.when(F.col(f"__h{k}.l") == k, F.col(f"__h{k}.t")) for k in range(1, levels + 1)]))
    return out.withColumn("heading_path", path).drop(*[f"__h{k}" for k in range(1, levels + 1)])


def sections(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """blocks with section: a new one begins at a heading that follows content."""
    w = Window.partitionBy(doc).orderBy("pos")
    heading = F.col("kind") == "heading"
    begins = heading & ~F.coalesce(F.lag("kind").over(w) == "heading", F.lit(False))
    return blocks.withColumn("section", F.sum(begins.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def count_words(text: str) -> int:
    return len(text.split())


def span_pack(units: list[str], limit: int, overlap: int, joiner: str = " ") -> list[str]:
    """Parts of at most limit tokens; each begins overlap units before the last one's end and has a new unit at least."""
    parts, start = [], 0
    while start < len(units):
        end = start + 1
        while end < len(units) and count_words(joiner.join(units[start : end + 1])) <= limit:
            end += 1
        parts.append(joiner.join(units[start:end]))
        if end == len(units):
            break
        start = max(end - overlap, start + 1)
    return parts


def split_block(kind: str, text: str, limit: int) -> list[str]:
    """A block over its limit in parts: code and lists by line, tables by row under a repeated header, prose by sentence."""
    if kind in ("code", "list"):
        return span_pack(text.split("\n"), limit, 0, "\n")
    if kind == "table":
        header, *rows = text.split("\n")
        room = max(1, limit - count_words(header))
        return [f"{header}\n{part}" for part in span_pack(rows, room, 2, "\n")] or [text]
    units, held = [], ""
    for piece in text.replace("\n", " ").split(" "):
        held = f"{held} {piece}".strip()
        if piece.endswith((".", "!", "?", "…")):
            units.append(held)
            held = ""
    return span_pack(units + [held] * bool(held), limit, OVERLAP_SENTENCES)


def pack_document(blocks: list[tuple[str, str, str]], target: int = TARGET, hard_max: int = HARD_MAX, least: int = LEAST) -> list[tuple[str, int, int, bool]]:
    """(text, tokens, sections, overflow) of a document's chunks from (kind, breadcrumb, text) in order.

    What is measured is what is stored: every decision counts the tokens of the
    chunk's final text. Whole blocks are merged up to the target; a block over it
    may flex by its kind, else it is split; small chunks merge forward, then
    backward, if the hard limit allows, and split parts never merge.
    """
    chunks: list[list] = []  # parts, section names, split

    def text_of(parts):
        out, crumb = [], None
        for c, t in parts:
            if c and c != crumb:
                out.append(f"**{c}**")
            crumb = c
            out.append(t)
        return "\n\n".join(out)

    held: list[tuple[str, str]] = []
    for kind, crumb, text in blocks:
        limit = min(target + int(target * FLEX.get(kind, 0.0)), hard_max)
        if held and count_words(text_of([*held, (crumb, text)])) <= target:
            held.append((crumb, text))
            continue
        if held:
            chunks.append([held, False])
            held = []
        if count_words(text_of([(crumb, text)])) <= limit:
            held = [(crumb, text)]
        else:
            room = max(1, limit - count_words(crumb or ""))
            chunks += [[[(crumb, part)], True] for part in split_block(kind, text, room)]
    if held:
        chunks.append([held, False])
    merged: list[list] = []
    for parts, split in chunks:
        small = merged and not split and not merged[-1][1] and (count_words(text_of(merged[-1][0])) < least or count_words(text_of(parts)) < least)
        if small and count_words(text_of(merged[-1][0] + parts)) <= hard_max:
            merged[-1][0] = merged[-1][0] + parts
        else:
            merged.append([parts, split])
    return [(t := text_of(parts), n := count_words(t), len({c for c, _ in parts}), n > hard_max) for parts, _ in merged]


def _pack_rows(batches, **budget):
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]
    for batch in (piece for whole in batches for piece in pieces(whole)):
        out = []
        for doc_id, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for i, row in enumerate(pack_document([(b["kind"], b["crumb"], b["text"] or "") for b in items], **budget)):
                out.append((doc_id, i, f"{doc_id}::c{i}", *row))
        columns = list(zip(*out, strict=True)) if out else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "chunk", "node_id", "text", "tokens", "sections", "overflow"])


def chunks(blocks: DataFrame, doc: str = "doc_id", **budget) -> DataFrame:
    """Chunks of each document from blocks with pos, kind, heading_path and text. A document's blocks come together, which its length bounds."""
    ready = blocks.where("kind <> 'heading'").select(F.col(doc).alias("doc_id"), F.struct("pos", "kind", F.array_join("heading_path", " > ").alias("crumb"), "text").alias("b"))
    grouped = ready.groupBy("doc_id").agg(F.array_sort(F.collect_list("b")).alias("blocks"))
    return grouped.mapInArrow(partial(_pack_rows, **budget), CHUNKS)
