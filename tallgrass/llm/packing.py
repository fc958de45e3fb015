"""Operator 2: variable-capacity best-fit packing.

Documents become pieces of at most the largest permitted length. Pieces are
placed by decreasing length: each goes to the open bin with the least room that
still holds it; where none does, a bin is opened with the permitted capacity of
least cost for each token it can be expected to hold, judged by filling the
capacity greedily from the lengths that are still to come. At the end each bin
is downsized to the least permitted capacity that holds its contents.

Packing is done in windows of about ``window_rows`` documents, which hold those of
equal hash of id and length: only ids and lengths are shuffled, memory is
bounded, a lost task is packed again alike, and the bins are the same however
the input is split. The price is at most a few part-filled bins a window. Bins
never mix windows: bin ids are "window.part.bin", part counting the pieces of a
window that holds more than twice window_rows documents (many rows of one id and
length).

Defined cases: null or empty text, or text without tokens, gives one row with 0
tokens and no bin; repeated rows are packed each on its own; longer texts than
the largest capacity are cut into pieces, none is dropped; extra columns are
ignored, the result has only its own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.llm import textkernel as K
from tallgrass.session import materialize, table

CAPACITIES = (512, 1024, 2048, 4096)
#: Tasks that pack at most; each takes one window after another.
MOST_TASKS = 100_000
SCHEMA = "doc_id long, piece int, first_token long, n_tokens long, bin_id string, bin_size int, bin_offset int"


def _expected_fill(room: int, counts: list[int], mask: int) -> int:
    """Tokens that the greedy filling of room takes from the remaining lengths."""
    filled = 0
    while room > 0:
        fits = mask & ((1 << (room + 1)) - 1)
        if not fits:
            break
        length = fits.bit_length() - 1
        some = min(counts[length], room // length)
        filled += some * length
        room -= some * length
        mask &= ~(1 << length)
    return filled


def pack_lengths(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, price: Callable[[int], float] = float) -> list[tuple[int, int, int]]:
    """(bin, its final capacity, offset in it) for each length; all lengths are 1 to the largest capacity. Deterministic: equal lengths are taken in order."""
    capacities = tuple(sorted(capacities))
    counts = [0] * (capacities[-1] + 1)
    for x in lengths:
        counts[x] += 1
    mask = sum(1 << x for x, n in enumerate(counts) if n)
    by_room: dict[int, list[int]] = {}
    rooms = 0
    used: list[int] = []
    room_of: list[int] = []
    placed: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        length = lengths[i]
        counts[length] -= 1
        if not counts[length]:
            mask &= ~(1 << length)
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            options = [c for c in capacities if c >= length]
            capacity = min(options, key=lambda c: (price(c) / (length + _expected_fill(c - length, counts, mask)), -c))
            chosen, room = len(used), capacity
            used.append(0)
            room_of.append(capacity)
        placed[i] = (chosen, used[chosen])
        used[chosen] += length
        room -= length
        if room:
            by_room.setdefault(room, []).append(chosen)
            rooms |= 1 << room
    final = [next(c for c in capacities if c >= u) for u in used]
    return [(b, final[b], offset) for b, offset in placed]


def run_counts(texts: pa.Array, is_word: np.ndarray) -> np.ndarray:
    """Runs of word bytes in each text."""
    data, offsets = K.string_buffer(texts)
    out = [np.zeros(0, dtype=np.int64)]
    for a, b in K.row_groups(offsets):
        part, bounds = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        inside = is_word[part]
        heads = inside.copy()
        heads[1:] &= ~inside[:-1]
        edges = bounds[:-1][bounds[:-1] < len(part)]
        heads[edges] = inside[edges]
        total = np.concatenate(([0], np.cumsum(heads)))
        out.append(total[bounds[1:]] - total[bounds[:-1]])
    return np.concatenate(out)


def word_counts(texts: pa.Array) -> np.ndarray:
    """Whitespace-separated words of each text."""
    return run_counts(texts, K.NON_SPACE)


@cache
def _tokenizer(path: str):
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    return model


def tokenizer_counts(path: str) -> Callable[[pa.Array], np.ndarray]:
    """A counter by the tokenizer file at path (a tokenizers JSON file or a sentencepiece model), loaded once a worker."""

    def count(texts: pa.Array) -> np.ndarray:
        values = [x or "" for x in texts.to_pylist()]
        if path.endswith(".model"):
            found = [len(x) for x in _tokenizer(path).encode(values, num_threads=1)]
        else:
            found = [len(x.ids) for x in _tokenizer(path).encode_batch(values, add_special_tokens=False)]
        return np.array(found, dtype=np.int64)

    return count


def _counter_rows(counter):
    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counter(batch.column(1)), type=pa.int64())], names=["doc_id", "n_tokens"])

    return count


def _packer(capacities: tuple[int, ...], price, window_rows: int):
    """From (doc_id, n_tokens, window) sorted by window, id and length to pieces and bins."""
    largest = max(capacities)

    def packed(ids: list, counts: list[int], window: int, part: int) -> pa.RecordBatch:
        rows = [(row, piece, first, min(largest, total - first)) for row, total in enumerate(counts) for piece, first in enumerate(range(0, total, largest))]
        bins = pack_lengths([r[3] for r in rows], capacities, price)
        empty = [i for i, total in enumerate(counts) if total == 0]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([ids[r[0]] for r in rows] + [ids[i] for i in empty], type=pa.int64()),
                pa.array([r[1] for r in rows] + [0] * len(empty), type=pa.int32()),
                pa.array([r[2] for r in rows] + [0] * len(empty), type=pa.int64()),
                pa.array([r[3] for r in rows] + [0] * len(empty), type=pa.int64()),
                pa.array([f"{window}.{part}.{b}" for b, _, _ in bins] + [None] * len(empty), type=pa.string()),
                pa.array([c for _, c, _ in bins] + [None] * len(empty), type=pa.int32()),
                pa.array([o for _, _, o in bins] + [None] * len(empty), type=pa.int32()),
            ],
            names=["doc_id", "piece", "first_token", "n_tokens", "bin_id", "bin_size", "bin_offset"],
        )

    def pack(batches):
        ids: list = []
        counts: list[int] = []
        window, part = None, 0
        for batch in batches:
            for doc, n, at in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if ids and (at != window or len(ids) >= 2 * window_rows):
                    yield packed(ids, counts, window, part)
                    ids, counts, part = [], [], part + 1 if at == window else 0
                elif at != window:
                    part = 0
                window = at
                ids.append(doc)
                counts.append(n)
        if ids:
            yield packed(ids, counts, window, part)

    return pack


def pack(docs: DataFrame, *, capacities: tuple[int, ...] = CAPACITIES, counter: Callable[[pa.Array], np.ndarray] = word_counts, price: Callable[[int], float] = float, window_rows: int = 16_384, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each piece of each document: its tokens [first_token, first_token + n_tokens) lie at bin_offset of bin_id, whose capacity is bin_size."""
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    counted = materialize(texts.mapInArrow(K.returning(_counter_rows(counter)), "doc_id long, n_tokens long"))
    windows = max(1, round(counted.count() / window_rows))
    dealt = counted.withColumn("window", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(windows)))
    # as many tasks as windows: lengths are few bytes, so that Spark would join them all into one
    dealt = dealt.repartition(min(windows, MOST_TASKS), "window").sortWithinPartitions("window", "doc_id", "n_tokens")
    return dealt.mapInArrow(_packer(tuple(capacities), price, window_rows), SCHEMA)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
