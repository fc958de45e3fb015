"""Operator 3: benchmark decontamination by a broadcast hash set of test n-grams.

Every benchmark item gives windows of n consecutive normalised words (an item
of fewer words, but not none, is one window). Their hashes go to the workers as
a set; training texts are scanned window by window in numpy, each hash hit is
verified against the window's bytes, and hits become spans. Nothing shuffles.

The broadcast is bounded: the windows are dealt into blocks of at most
``block_windows`` by hash, and beyond one block the documents pass block after
block, each pass adding its hits to the rows (written to the shared folder in
between). Work grows with documents times blocks.

Defined cases: a null or empty text has no words, no hits and empty lists; null
or word-less benchmark texts give no window; items that repeat an id are one
item; repeated documents are judged alike, row by row; other columns pass
through, whatever their names (the added columns replace columns of their own
names).
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallgrass.llm import textkernel as K
from tallgrass.llm.common import shielded
from tallgrass.session import materialize, table

_SPAN = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
_ADDED = {"n_words": T.LongType(), "hit_words": _SPAN, "item_ids": T.ArrayType(T.StringType())}
_ARROW_SPAN = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _windows(items: list[tuple[str, str]], n: int) -> dict[int, dict[bytes, list[str]]]:
    """Window bytes to item ids, by window length in words."""
    out: dict[int, dict[bytes, list[str]]] = defaultdict(dict)
    for item_id, text in items:
        data = np.frombuffer((text or "").encode(), dtype=np.uint8)
        starts, ends, _, _ = K.word_hashes(data, np.array([0, len(data)]), K.ALNUM)
        raw = K._LOWER[data].tobytes() if len(data) else b""
        words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        size = min(n, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            ids = out[size].setdefault(b" ".join(words[i : i + size]), [])
            if item_id not in ids:
                ids.append(item_id)
    return out


def _hash_of(window: bytes) -> int:
    data = np.frombuffer(window, dtype=np.uint8)
    words = K.word_hashes(data, np.array([0, len(data)]), K.ALNUM)[2]
    return int(K.gram_hashes(words, len(words))[0])


class _Block:
    """One bounded part of the windows: sorted hashes, a bit table before them, and the windows for verification."""

    def __init__(self, windows: list[tuple[int, int, bytes, list[str]]]):
        self.by_size = {}
        for size in {w[0] for w in windows}:
            own = [w for w in windows if w[0] == size]
            hashes = np.unique(np.array([w[1] for w in own], dtype=np.uint64))
            bits = max(16, int(np.ceil(np.log2(len(hashes) + 1))) + 5)
            seen = np.zeros(1 << bits, dtype=bool)
            seen[(hashes >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.by_size[size] = (hashes, seen, np.uint64(64 - bits), {w[2]: w[3] for w in own})


def _blocks(benchmark: DataFrame, n: int, block_windows: int, id_column: str, text_column: str):
    """The benchmark's windows in blocks. Items stream to the driver one partition at a time; only one block is held."""
    items = benchmark.select(F.coalesce(F.col(id_column).cast("string"), F.lit("null")).alias("i"), F.col(text_column).alias("t"))
    held: list[tuple[int, int, bytes, list[str]]] = []
    for rows in _row_chunks(items.toLocalIterator()):
        for size, found in _windows(rows, n).items():
            held += [(size, _hash_of(w), w, ids) for w, ids in found.items()]
        while len(held) > block_windows:
            yield _Block(_joined(held[:block_windows]))
            held = held[block_windows:]
    if held:
        yield _Block(_joined(held))


def _joined(windows):
    """One entry a window: chunks of items may repeat windows of each other."""
    out: dict[tuple[int, bytes], tuple[int, int, bytes, list[str]]] = {}
    for size, h, w, ids in windows:
        entry = out.setdefault((size, w), (size, h, w, []))
        entry[3].extend(x for x in ids if x not in entry[3])
    return list(out.values())


def _row_chunks(rows, size: int = 20_000):
    chunk = []
    for row in rows:
        chunk.append((row["i"], row["t"]))
        if len(chunk) == size:
            yield chunk
            chunk = []
    if chunk:
        yield chunk


def _scan(block: _Block, data: np.ndarray, offsets: np.ndarray):
    """(words per row, {row: [(first, last)]}, {row: set of ids}) of a group of rows."""
    starts, ends, hashes, first = K.word_hashes(data, offsets, K.ALNUM)
    counts = np.diff(first)
    spans: dict[int, list] = defaultdict(list)
    ids: dict[int, set] = defaultdict(set)
    for size, (known, seen, shift, windows) in block.by_size.items():
        grams = K.gram_hashes(hashes, size)
        at = np.flatnonzero(seen[(grams >> shift).astype(np.int64)])
        at = at[np.isin(grams[at], known)]
        row = np.searchsorted(first, at, side="right") - 1
        at, row = (x[at + size <= first[row + 1]] for x in (at, row))
        for i, r in zip(at.tolist(), row.tolist(), strict=True):
            window = b" ".join(K._LOWER[data[a:b]].tobytes() for a, b in zip(starts[i : i + size].tolist(), ends[i : i + size].tolist(), strict=True))
            if found := windows.get(window):
                ids[r].update(found)
                k = i - int(first[r])
                spans[r].append((k, k + size))
    return counts, spans, ids


def _union(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"first": a, "last": b} for a, b in out]


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, n: int = 8, text_column: str = "text", item_id: str = "item_id", item_text: str = "text", block_windows: int = 1_000_000) -> DataFrame:
    """docs with n_words long, hit_words array<struct<first,last>> (half-open word ranges inside occurrences of windows) and item_ids array<string> (sorted)."""
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c.lower() not in _ADDED]
    out = docs.select(*[docs[f"`{c}`"] for c in kept])
    schema = T.StructType([*out.schema.fields, *[T.StructField(k, v) for k, v in _ADDED.items()]])
    blocks = _blocks(benchmark, n, block_windows, item_id, item_text)
    block, passes = next(blocks, _Block([])), 0
    while block is not None:
        shared = spark.sparkContext.broadcast(block)
        out = out.mapInArrow(K.returning(_scanner(shared, text_column, passes == 0)), schema)
        passes += 1
        block = next(blocks, None)
        if block is not None:
            out = materialize(out)
    return out


def _scanner(shared, text_column: str, is_first: bool):
    def scan(batches):
        for batch in batches:
            data, offsets = K.string_buffer(batch.column(text_column))
            n_words, hits, items = [], [], []
            for low, high in K.row_groups(offsets):
                counts, spans, ids = _scan(shared.value, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                n_words.append(counts)
                hits += [_union(spans[r]) if r in spans else [] for r in range(high - low)]
                items += [sorted(ids[r]) if r in ids else [] for r in range(high - low)]
            if not is_first:
                hits = [_union([(x["first"], x["last"]) for x in (*a, *b)]) if a or b else [] for a, b in zip(hits, batch.column("hit_words").to_pylist(), strict=True)]
                items = [sorted({*a, *b}) if a or b else [] for a, b in zip(items, batch.column("item_ids").to_pylist(), strict=True)]
            columns = [batch.column(c) for c in batch.schema.names if c not in _ADDED]
            names = [c for c in batch.schema.names if c not in _ADDED]
            added = [pa.array(np.concatenate(n_words) if n_words else [], type=pa.int64()), pa.array(hits, type=_ARROW_SPAN), pa.array(items, type=pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*columns, *added], names=[*names, *_ADDED])

    return scan


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, n: int = 8, min_words: int = 5, **kw) -> DataFrame:
    """docs without those that hold min_words consecutive hit words or more; the columns of docs only."""
    leaked = F.exists("hit_words", lambda s: s["last"] - s["first"] >= min_words)
    return shielded(docs, set(_ADDED), lambda d: find_contamination(d, benchmark, n=n, **kw).where(~leaked))


def cut_spans(text: str | None, hit_words: list) -> str | None:
    """text without the bytes of its hit words, for callers that drop spans and keep documents."""
    if not text or not hit_words:
        return text
    raw = text.encode()
    data = np.frombuffer(raw, dtype=np.uint8)
    starts, ends, _, _ = K.word_hashes(data, np.array([0, len(data)]), K.ALNUM)
    out, at = [], 0
    for span in hit_words:
        first, last = (span["first"], span["last"]) if isinstance(span, dict) else (span.first, span.last)
        out.append(raw[at : int(starts[first])])
        at = int(ends[last - 1])
    return b"".join([*out, raw[at:]]).decode()


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, text_column: str = "text", **kw) -> DataFrame:
    """docs with the hit spans cut out of the texts; the columns of docs only."""
    cut = F.pandas_udf(lambda t, s: t.combine(s, cut_spans), "string")
    column = F.when(F.size("hit_words") > 0, cut(F.col(text_column), F.col("hit_words"))).otherwise(F.col(text_column))
    return shielded(docs, set(_ADDED), lambda d: find_contamination(d, benchmark, text_column=text_column, **kw).withColumn(text_column, column))


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"])
    n_items = F.size("item_ids").cast("long")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), n_items.alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n_items >= 2).alias("contaminated"))


OP3_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), bw AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), bl AS (
  SELECT item_id, w, least(8, len(w)) AS n FROM bw WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl)
), dg AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw CROSS JOIN (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hits AS (
  SELECT DISTINCT doc_id, i, dg.n, item_id FROM dg JOIN win ON dg.n = win.n AND dg.g = win.g
), words AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
