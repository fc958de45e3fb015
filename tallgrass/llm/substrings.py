"""Operator 4: exact substring dedup by suffix arrays and their common-prefix interval trees.

A byte is removed if it lies in a string of ``length`` bytes that also starts
earlier (smaller doc_id, or earlier in the same document).

1. Anchors. Every window of ``length`` bytes names an anchor, the k bytes of
   least hash in it (leftmost of equals): a choice by content alone, so equal
   windows name equal anchors at the same place in them. An anchor owns a run of
   windows, the bytes of which are its span.
2. Classes. Anchors are dealt out by hash. Occurrences with equal spans are one
   class: all but the first are repeats as a whole. Each batch of a task keeps
   only its first of a class and turns the others into removals at once, so a
   class reaches the shuffle at most once a batch, however often it occurs.
3. Suffix arrays. Where an anchor has several classes (a repeat begins or ends
   there), the spans of their first occurrences come together. All owned windows'
   suffixes are sorted into an enhanced suffix array; a stack scan finds the
   common-prefix intervals, those whose occurrences differ to the left are the
   maximal repeat groups, and in each group every occurrence but the first is
   removed over the group's length. A window that repeats has a maximal
   extension with the same occurrences, so nothing is missed.
4. Removals meet their document, intervals merge, and the digest is taken.

Everything is one plan; the shuffle of texts by document serves steps 3 and 4.

Defined cases: null or empty text is zero bytes; texts shorter than ``length``
lose nothing; a null doc_id comes before all others; rows that repeat both
doc_id and text are one document (each row gets its result), rows that repeat
only the doc_id are ordered by a hash of their texts; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallgrass.llm import textkernel as K
from tallgrass.llm.suffixes import enhanced_suffix_array, later_occurrences, maximal_repeats
from tallgrass.session import table

_U = np.uint64
LENGTH, GRAM = 100, 32
#: Stands for a null doc_id, before all others.
NO_ID = -(1 << 63)
#: Contexts whose suffix array is built at once; an anchor's contexts stay together.
BLOCK = 4_096
_POSITION = _U(K.PIECE - 1)
_ANCHORS = "kind int, ah long, ch long, dkey long, tk long, pos long, lo int, n int"
_ITEMS = "kind int, ah long, dkey long, tk long, start long, n int, ctx binary"
_MARKS = "dkey long, tk long, start long, stop long"


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(anchor hash, class hash, row, anchor position in row, bytes before it in its first window, owned windows) of a group of at most PIECE bytes."""
    counts = np.maximum(np.diff(offsets) - length + 1, 0)
    total = int(counts.sum())
    if not total:
        none = np.zeros(0, dtype=np.int64)
        return none.view(_U), none.view(_U), none, none, none, none
    prefix = K.prefix_hashes(data, K.EXACT)
    at = np.arange(len(data) - gram + 1)
    hashes = K.mix(K.substring_hashes(prefix, at, at + gram))
    least = _sliding_min((hashes & ~_POSITION) | at.astype(_U), length - gram + 1)
    windows = np.arange(total) + np.repeat(offsets[:-1] - (np.cumsum(counts) - counts), counts)
    named = (least[windows] & _POSITION).astype(np.int64)
    heads = np.concatenate(([0], np.flatnonzero(named[1:] != named[:-1]) + 1))
    tails = np.append(heads[1:], total) - 1
    first, last, anchor = windows[heads], windows[tails], named[heads]
    shape = ((anchor - first).astype(_U) << _U(32)) | (last - first).astype(_U)
    classes = K.mix(K.substring_hashes(prefix, first, last + length) ^ K.mix(shape))
    row = np.searchsorted(offsets, first, side="right") - 1
    return hashes[anchor], classes, row, anchor - offsets[row], anchor - first, last - first + 1


def _all_anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """anchors_of over rows of any length: longer rows go in pieces that together have every window once."""
    out = []
    for a, b in K.row_groups(offsets, K.PIECE):
        low, high = int(offsets[a]), int(offsets[b])
        if high - low <= K.PIECE:
            h, c, row, pos, lo, n = anchors_of(data[low:high], offsets[a : b + 1] - low, length, gram)
            out.append((h, c, row + a, pos, lo, n))
            continue
        step = K.PIECE - length + 1
        for begin in range(low, high - length + 1, step):
            end = min(begin + K.PIECE, high)
            h, c, row, pos, lo, n = anchors_of(data[begin:end], np.array([0, end - begin]), length, gram)
            out.append((h, c, row + a, pos + begin - low, lo, n))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else None


def _anchor_rows(length: int, gram: int):
    def work(batches):
        for batch in batches:
            data, offsets = K.string_buffer(batch.column(2))
            found = _all_anchors(data, offsets, length, gram)
            if found is None or not len(found[0]):
                continue
            h, c, row, pos, lo, n = found
            dkey, tk = batch.column(0).to_numpy()[row], batch.column(1).to_numpy()[row]
            order = np.lexsort((pos, tk, dkey, K.mix(h ^ c * _U(0x9E3779B97F4A7C15))))
            h, c, row, pos, lo, n, dkey, tk = (x[order] for x in (h, c, row, pos, lo, n, dkey, tk))
            head = np.ones(len(h), dtype=bool)
            head[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            of = np.flatnonzero(head)[np.cumsum(head) - 1]
            later = ~head & ((dkey != dkey[of]) | (tk != tk[of]) | (pos != pos[of]))
            rows, starts, stops = K.merge_intervals(row[later], (pos - lo)[later], (pos - lo + n - 1 + length)[later])
            ids, keys = batch.column(0).to_numpy()[rows], batch.column(1).to_numpy()[rows]
            spread = K.mix(keys.view(_U) + starts.astype(_U)).view(np.int64)
            join = lambda x, y, kind: pa.array(np.concatenate((x, y)), type=kind)
            yield pa.RecordBatch.from_arrays(
                [
                    join(np.zeros(int(head.sum()), dtype=np.int32), np.ones(len(rows), dtype=np.int32), pa.int32()),
                    join(h[head].view(np.int64), spread, pa.int64()),
                    join(c[head].view(np.int64), spread, pa.int64()),
                    join(dkey[head], ids, pa.int64()),
                    join(tk[head], keys, pa.int64()),
                    join(pos[head], starts, pa.int64()),
                    join(lo[head].astype(np.int32), np.zeros(len(rows), dtype=np.int32), pa.int32()),
                    join(n[head].astype(np.int32), (stops - starts).astype(np.int32), pa.int32()),
                ],
                names=["kind", "ah", "ch", "dkey", "tk", "pos", "lo", "n"],
            )

    return work


def _context_rows(length: int):
    """From (dkey, tk, text, items) to removals (kind 1, merged) and the spans of class firsts (kind 0)."""

    def work(batches):
        for batch in batches:
            data, offsets = K.string_buffer(batch.column(2))
            lists = batch.column(3)
            bounds, items = np.asarray(lists.offsets), lists.values
            low = int(bounds[0])
            kind, ah, pos, lo, n = (x.to_numpy(zero_copy_only=False) for x in items.flatten())
            row = np.repeat(np.arange(len(batch)), np.diff(bounds))
            part = slice(low, int(bounds[-1]))
            kind, ah, start, n = kind[part], ah[part], (pos - lo)[part], n[part]
            dkey, tk = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            gone = kind != 0
            stop = start + np.where(kind == 2, n - 1 + length, n)
            rows, starts, stops = K.merge_intervals(row[gone], start[gone], stop[gone])
            spread = K.mix(tk[rows].view(_U) + starts.astype(_U)).view(np.int64)
            yield _item_batch(np.ones(len(rows), dtype=np.int32), spread, dkey[rows], tk[rows], starts, (stops - starts).astype(np.int32), [None] * len(rows))
            own = np.flatnonzero(~gone)
            for at in range(0, len(own), 50_000):
                some = own[at : at + 50_000]
                r, s = row[some], start[some]
                begin = offsets[r] + s
                contexts = [data[a:b].tobytes() for a, b in zip(begin.tolist(), (begin + n[some] - 1 + length).tolist(), strict=True)]
                yield _item_batch(np.zeros(len(some), dtype=np.int32), ah[some], dkey[r], tk[r], s, n[some], contexts)

    return work


def _item_batch(kind, ah, dkey, tk, start, n, contexts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(kind, type=pa.int32()), pa.array(ah, type=pa.int64()), pa.array(dkey, type=pa.int64()), pa.array(tk, type=pa.int64()), pa.array(start, type=pa.int64()), pa.array(n, type=pa.int32()), pa.array(contexts, type=pa.binary())],
        names=["kind", "ah", "dkey", "tk", "start", "n", "ctx"],
    )


def _mark_batch(dkey, tk, start, stop) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in (dkey, tk, start, stop)], names=["dkey", "tk", "start", "stop"])


def repeat_groups_of(contexts: list[bytes], windows: np.ndarray, length: int):
    """Maximal repeat groups among the owned windows' suffixes of contexts: (Repeats, context of each suffix, offset of each suffix)."""
    sizes = np.array([len(x) for x in contexts], dtype=np.int64)
    base = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    which = np.repeat(np.arange(len(contexts)), windows)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = base[which] + offset
    left = np.where(offset > 0, data[starts - 1].astype(np.int64), -1)
    order, lcp = enhanced_suffix_array(data, starts, sizes[which] - offset)
    return maximal_repeats(order, lcp, left, length), which, offset


def _suffix_rows(length: int):
    """From items sorted by anchor to removals."""

    def solve(held: list[pa.RecordBatch]):
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        dkey, tk, start, n = (whole.column(i).to_numpy() for i in (2, 3, 4, 5))
        found, which, offset = repeat_groups_of(whole.column(6).to_pylist(), n.astype(np.int64), length)
        order = np.lexsort((start[which] + offset, tk[which], dkey[which]))
        d, t, s = dkey[which][order], tk[which][order], (start[which] + offset)[order]
        fresh = np.concatenate(([0], (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (s[1:] != s[:-1])))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.cumsum(fresh)
        suffix, lengths = later_occurrences(found, rank)
        owner, begin = which[suffix], start[which[suffix]] + offset[suffix]
        rows, starts, stops = K.merge_intervals(owner, begin, begin + lengths)
        return _mark_batch(dkey[rows], tk[rows], starts, stops)

    def work(batches):
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            kinds = batch.column(0).to_numpy()
            marks = batch.filter(pa.array(kinds == 1))
            if len(marks):
                start = marks.column(4).to_numpy()
                yield _mark_batch(marks.column(2).to_numpy(), marks.column(3).to_numpy(), start, start + marks.column(5).to_numpy())
            batch = batch.filter(pa.array(kinds == 0))
            keys = batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if size >= BLOCK and keys[a] != last:
                    yield solve(held)
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size += b - a
                last = keys[a]
        if held:
            yield solve(held)

    return work


def _digest_rows(batches):
    for batch in batches:
        data, offsets = K.string_buffer(batch.column(1))
        bounds = np.asarray(batch.column(2).offsets)
        starts, stops = (x.to_numpy(zero_copy_only=False) for x in batch.column(2).values.flatten())
        filled = np.diff(bounds)
        row = np.repeat(np.arange(len(batch)), filled)
        part = slice(int(bounds[0]), int(bounds[-1]))
        rows, first, last = K.merge_intervals(row, starts[part], stops[part])
        heads = np.searchsorted(rows, np.arange(len(batch) + 1))
        removed, spans, digests, runs = [], [], [], []
        for i in range(len(batch)):
            raw = data[offsets[i] : offsets[i + 1]]
            digest, at = hashlib.sha256(), 0
            own = list(zip(first[heads[i] : heads[i + 1]].tolist(), last[heads[i] : heads[i + 1]].tolist(), strict=True))
            for a, b in own:
                digest.update(raw[at:a])
                at = b
            digest.update(raw[at:])
            removed.append(sum(b - a for a, b in own))
            spans.append(len(own))
            digests.append(digest.hexdigest())
            runs.append([{"start": a, "stop": b} for a, b in own])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(offsets), type=pa.int64()), pa.array(removed, type=pa.int64()), pa.array(spans, type=pa.int64()), pa.array(digests, type=pa.string()), pa.array(runs, type=pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"],
        )


def find_repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed array<struct<start,stop>>) for each row; removed is in bytes."""
    if not 8 <= gram < length:
        raise ValueError("gram is 8 or more and less than length")
    id_long = F.col(id_column).cast("long")
    text = F.coalesce(F.col(text_column), F.lit(""))
    # both joins with the texts need the same three columns, so that they share one shuffle
    keyed = docs.select(F.coalesce(id_long, F.lit(NO_ID)).alias("dkey"), F.xxhash64(text).alias("tk"), text.alias("text"))
    anchors = keyed.select("dkey", "tk", "text").mapInArrow(_anchor_rows(length, gram), _ANCHORS)

    of_class = Window.partitionBy("ah", "ch").orderBy("dkey", "tk", "pos")
    of_anchor = Window.partitionBy("ah")
    dealt = anchors.repartition("ah")
    ranked = dealt.select("*", F.first(F.struct("dkey", "tk", "pos")).over(of_class).alias("head"), F.row_number().over(of_class).alias("turn"))
    ranked = ranked.select("*", (F.min("ch").over(of_anchor) < F.max("ch").over(of_anchor)).alias("many"))
    repeated = F.struct("dkey", "tk", "pos") != F.col("head")
    kind = F.when(F.col("kind") == 1, 1).when(repeated, 2).when((F.col("turn") == 1) & F.col("many"), 0)
    items = ranked.select(kind.alias("kind"), "ah", "dkey", "tk", "pos", "lo", "n").where("kind is not null")

    by_doc = items.groupBy("dkey", "tk").agg(F.collect_list(F.struct("kind", "ah", "pos", "lo", "n")).alias("items"))
    texts = keyed.join(by_doc, ["dkey", "tk"]).select("dkey", "tk", "text", "items")
    contexts = texts.mapInArrow(_context_rows(length), _ITEMS)
    marks = contexts.repartition("ah").sortWithinPartitions("ah").mapInArrow(_suffix_rows(length), _MARKS)
    merged = marks.groupBy("dkey", "tk").agg(F.collect_list(F.struct("start", "stop")).alias("marks"))
    empty = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    final = keyed.join(merged, ["dkey", "tk"], "left").select(F.nullif("dkey", F.lit(NO_ID)).alias("doc_id"), "text", F.coalesce("marks", empty).alias("marks"))
    return final.mapInArrow(_digest_rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,stop:long>>")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return find_repeats(table(spark, sf_dir, "documents")).drop("removed")
