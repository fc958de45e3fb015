"""Operator 10: language-model scores from a log-frequency Bloom filter.

Training counts every word, every pair and every triple of neighbouring tokens
exactly, those seen once included. Counts leave a task as packed blocks, dealt
to buckets by the top bits of the n-gram's 64-bit hash; whoever holds a bucket
sums them and builds its part of the filter at once, so n-grams are shuffled
once and never written out. The filter stores quantised counts: an n-gram of
count c is inserted with the levels 1 .. 1 + floor(log2 c); looking up means
probing levels upwards until one is missing, and a level's middle count is the
estimate. All bits of a (key, level) lie in one 64-bit word of its bucket, and a
bucket has as many words as its keys need, so the filter grows with the corpus.

The buckets' parts are broadcast. Where they hold more than ``max_bits``
together, they are broadcast in turns, a range of buckets at a time: each turn
is a pass over the texts that finds the levels of the n-grams in its range, and
the scores, the same ones, are computed from all levels.

Each order is smoothed by the one below (a Dirichlet prior of ``prior`` tokens):
P(w | h) = (c(h w) + prior * P(w | h')) / (c(h) + prior), down to
P(w) = (c(w) + 1) / (N + V + 1). With exact counts these sum to 1 over all words
and the unknown one; quantised counts and false positives (some 7 % of the
probes of absent keys) make them estimates. A text's first token has the end of
a text before it, and no third order.

Base scores need exact counts. The most frequent words (at most about
``max_frequent``, a bounded broadcast) are looked up in the worker; the rest
leave as (row, word, times) and are joined with the word table.

Defined cases: null text is empty, its one token is the end; with no training
rows N = V = 0 and every token scores log10(1 / 1) = 0; repeated rows are scored
each; very long texts are scored whole; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.llm import textkernel as K
from tallgrass.llm.langid import remainder
from tallgrass.session import materialize, release, table

_U = np.uint64
#: The token that ends every text.
END = 0x5851F42D4C957F2D
BITS_A_KEY = 6
PROBES = 3
#: Bits of the filter that are broadcast at once.
MAX_BITS = 1 << 31
#: Bytes of the filter that come to the driver at once.
FETCH = 1 << 25
MAX_FREQUENT = 1 << 19
PRIOR = 2.0
#: Tokens gathered before counts leave a worker; n-grams, repeats included, of a bucket.
GATHER = 1 << 21
BUCKET = 1 << 21
#: Bits of an n-gram's hash that are kept below those of its bucket: two n-grams of a bucket become one once in half a million, at any size of the corpus.
KEY_BITS = 40
#: The count that a level stands for: the middle of those it covers.
ESTIMATE = np.concatenate(([0.0], 1.5 * 2.0 ** np.arange(64) - 0.5))


def _alone(tokens: np.ndarray) -> np.ndarray:
    return K.mix(tokens + _U(1))


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return K.mix(left * _U(0xFF51AFD7ED558CCD) + right + _U(2))


def _tokens(data: np.ndarray, offsets: np.ndarray):
    """(hashes with an end after each text's words, bounds of each text in them)."""
    _, _, words, first = K.word_hashes(data, offsets, K.NON_SPACE)
    bounds = first + np.arange(len(first))
    out = np.empty(len(words) + len(first) - 1, dtype=_U)
    out[np.arange(len(words)) + np.repeat(np.arange(len(first) - 1), np.diff(first))] = words
    out[bounds[1:] - 1] = _U(END)
    return out, bounds


def _grams(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys of each token with the one before it, keys of each token with both before it, where there are two): a text's first follows an end."""
    left = np.empty_like(tokens)
    left[1:] = tokens[:-1]
    left[bounds[:-1]] = _U(END)
    pairs = _pair(left, tokens)
    third = np.ones(len(tokens), dtype=bool)
    third[bounds[:-1]] = False
    third = np.flatnonzero(third)
    return pairs, _pair(pairs[third - 1], tokens[third]), third


def _spare(bits: int) -> np.uint64:
    """Low bits of a hash that are dropped where there are 2**bits buckets."""
    return _U(max(0, 64 - bits - KEY_BITS))


def _counted(keys: list[np.ndarray]) -> pa.RecordBatch:
    values, counts = np.unique(np.concatenate(keys), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts, type=pa.int64())], names=["h", "n"])


def _tokenised(batches):
    for batch in batches:
        data, offsets = K.string_buffer(batch.column(0))
        for a, b in K.row_groups(offsets, K.PIECE):
            yield _tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _count_words(batches):
    held, size = [], 0
    for tokens, _ in _tokenised(batches):
        held.append(tokens)
        size += len(tokens)
        if size >= GATHER:
            yield _counted(held)
            held, size = [], 0
    if held:
        yield _counted(held)


def _planes(x: np.ndarray) -> bytes:
    """The numbers of x byte by byte, all first bytes before all second ones: high bytes, mostly zero, compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _numbers(raw, size: int, kind) -> np.ndarray:
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(np.dtype(kind).itemsize, size)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _blocks(keys: list[np.ndarray], bits: int):
    """Rows (bucket, n, keys as differences, counts) of distinct keys, sorted."""
    spare = _spare(bits)
    values, counts = np.unique(np.concatenate(keys) >> spare, return_counts=True)
    edges = np.searchsorted(values, np.arange(1 << bits, dtype=_U) << _U(64 - bits - int(spare))).tolist() + [len(values)]
    rows = []
    for bucket, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if a < b:
            own, n = values[a:b], counts[a:b]
            rows.append((bucket, b - a, _planes(np.diff(own, prepend=_U(bucket << (64 - bits - int(spare))))), _planes(n.astype(np.uint8 if n.max() < 256 else np.uint32))))
    columns = zip(*rows, strict=True)
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "n", "keys", "counts"])


def _count_grams(bits: int):
    def work(batches):
        held, size = ([], [], []), 0
        for tokens, bounds in _tokenised(batches):
            pairs, triples, _ = _grams(tokens, bounds)
            for own, keys in zip(held, (_alone(tokens), pairs, triples), strict=True):
                own.append(keys)
            size += len(tokens)
            if size >= GATHER:
                yield from (_blocks(own, bits) for own in held if any(map(len, own)))
                held, size = ([], [], []), 0
        yield from (_blocks(own, bits) for own in held if any(map(len, own)))

    return work


def _place(keys: np.ndarray, level: int, words) -> tuple[np.ndarray, np.ndarray]:
    """(word of its bucket, bits in it) of each key at a level."""
    h = K.mix(keys + _U(level * 0x9E3779B97F4A7C15 % (1 << 64)))
    mask = _U(1) << (h & _U(63))
    for k in range(1, PROBES):
        mask |= _U(1) << ((h >> _U(6 * k)) & _U(63))
    return (((h >> _U(32)) * words) >> _U(32)).astype(np.int64), mask


def _filled(bucket: int, held: list, bits_a_key: int) -> pa.RecordBatch:
    keys = np.concatenate([k for k, _ in held])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    counts = np.add.reduceat(np.concatenate([n for _, n in held])[order], heads)
    keys, levels = keys[heads], np.frexp(counts.astype(np.float64))[1]
    words = max(1, -(-int(levels.sum()) * bits_a_key // 64))
    table = np.zeros(words, dtype=_U)
    for level in range(1, int(levels.max()) + 1):
        if level > 1:
            going = levels >= level
            keys, levels = keys[going], levels[going]
        at, mask = _place(keys, level, _U(words))
        np.bitwise_or.at(table, at, mask)
    return pa.RecordBatch.from_arrays([pa.array([bucket], type=pa.int32()), pa.array([words], type=pa.int64()), pa.array([table.tobytes()], type=pa.binary())], names=["bucket", "words", "bits"])


def _builder(bits: int, bits_a_key: int):
    """From packed counts sorted by bucket to the filter of each bucket."""

    def build(batches):
        bucket, held = None, []
        for batch in batches:
            for at, size, keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if at != bucket and held:
                    yield _filled(bucket, held, bits_a_key)
                    held = []
                bucket, raw = at, counts.as_buffer()
                own = _U(at << (64 - bits - int(_spare(bits)))) + np.cumsum(_numbers(keys.as_buffer(), size, _U), dtype=_U)
                held.append((own, _numbers(raw, size, np.uint8 if len(raw) == size else np.uint32).astype(np.int64)))
        if held:
            yield _filled(bucket, held, bits_a_key)

    return build


@dataclass
class Filter:
    """Buckets low to high (exclusive) of a filter of 2**bits buckets: bucket b is words[starts[b - low] : starts[b - low + 1]]."""

    words: np.ndarray
    starts: np.ndarray
    low: int
    high: int
    bits: int

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The highest level up to which each key is present; 0 for keys of other buckets."""
        out = np.zeros(len(keys), dtype=np.uint8)
        bucket = (keys >> _U(64 - self.bits)).astype(np.int64) - self.low
        alive = np.flatnonzero((bucket >= 0) & (bucket < self.high - self.low))
        keys = keys >> _spare(self.bits)
        if not len(self.words):
            return out
        base = self.starts[bucket[alive]]
        size = (self.starts[bucket[alive] + 1] - base).astype(_U)
        for level in range(1, 65):
            at, mask = _place(keys[alive], level, size)
            there = (size > 0) & (self.words[np.minimum(base + at, len(self.words) - 1)] & mask == mask)
            alive, base, size = alive[there], base[there], size[there]
            if not len(alive):
                break
            out[alive] = level
        return out


@dataclass
class Model:
    """What scoring needs: the buckets of the filter (built, with their sizes), the frequent words with exact counts, and totals. words: the table of the other words."""

    built: DataFrame
    sizes: np.ndarray
    bits: int
    max_bits: int
    frequent: np.ndarray
    frequent_counts: np.ndarray
    tokens: int
    distinct: int
    words: DataFrame

    @property
    def turns(self) -> list[tuple[int, int]]:
        """Ranges of buckets that are broadcast together."""
        out, low, total = [], 0, 0
        for bucket, size in enumerate(self.sizes.tolist()):
            if total and (total + size) * 64 > self.max_bits:
                out.append((low, bucket))
                low, total = bucket, 0
            total += size
        return [*out, (low, len(self.sizes))]

    def filter(self, low: int, high: int) -> Filter:
        """Fetch buckets low to high, a few at a time."""
        starts = np.concatenate(([0], np.cumsum(self.sizes[low:high])))
        words = np.zeros(int(starts[-1]), dtype=_U)
        a = low
        while a < high:
            b = max(a + 1, low + int(np.searchsorted(starts, starts[a - low] + FETCH // 8, side="right")) - 1)
            for batch in self.built.where(F.col("bucket").between(a, b - 1)).select("bucket", "bits").toArrow().to_batches():
                for bucket, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    words[starts[bucket - low] : starts[bucket - low + 1]] = np.frombuffer(raw.as_buffer(), dtype=_U)
            a = b
        return Filter(words, starts, low, high, self.bits)


def train(texts: DataFrame, *, text_column: str = "text", bits_a_key: int = BITS_A_KEY, max_bits: int = MAX_BITS, max_frequent: int = MAX_FREQUENT) -> Model:
    """Count texts and build the filter. max_bits: bits of it that are broadcast at once; max_frequent: words whose exact counts are, the others' being joined."""
    rows = texts.select(F.col(text_column))
    words = materialize(rows.mapInArrow(K.returning(_count_words), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    level = (F.floor(F.log2("n")) + 1).cast("int")
    by_level = {r["level"]: (r["words"], r["n"]) for r in words.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()}
    tokens, distinct = sum(n for _, n in by_level.values()), sum(w for w, _ in by_level.values())
    kept, least_level = 0, max(by_level, default=1) + 1
    for x in sorted(by_level, reverse=True):
        if kept + by_level[x][0] > max_frequent:
            break
        kept, least_level = kept + by_level[x][0], x
    least = 1 << (least_level - 1)
    found = words.where(F.col("n") >= least).toArrow()
    frequent = found["h"].to_numpy().view(_U)
    order = np.argsort(frequent)
    frequent, counts = frequent[order], found["n"].to_numpy()[order]
    bits = max(4, (3 * tokens // BUCKET).bit_length())
    packed = rows.mapInArrow(K.returning(_count_grams(bits)), "bucket int, n long, keys binary, counts binary")
    built = materialize(packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(K.returning(_builder(bits, bits_a_key)), "bucket int, words long, bits binary"))
    release(texts.sparkSession)
    sizes = np.zeros(1 << bits, dtype=np.int64)
    for r in built.select("bucket", "words").collect():
        sizes[r["bucket"]] = r["words"]
    return Model(built, sizes, bits, max_bits, frequent, counts, tokens, distinct, words.where(F.col("n") < least))


def combined(levels: np.ndarray, bounds: np.ndarray, total: int, distinct: int, prior: float) -> np.ndarray:
    """The score of each text from the levels (3 x tokens) of its words, pairs and triples."""
    heads = bounds[:-1]
    alone, together, three = ESTIMATE[levels]
    before = np.empty(len(alone))
    before[1:] = alone[:-1]
    before[heads] = alone[bounds[1:] - 1]  # the end of a text
    together = np.where((alone > 0) & (before > 0), np.minimum(together, before), 0.0)
    chance = (alone + 1) / float(total + distinct + 1)
    chance = (together + prior * chance) / (before + prior)
    context = np.zeros(len(alone))
    context[1:] = together[:-1]
    context[heads] = 0.0
    three = np.where((together > 0) & (context > 0), np.minimum(three, context), 0.0)
    return np.add.reduceat(np.log10((three + prior * chance) / (context + prior)), heads)


def _scorer(shared, prior: float, whole: bool):
    """Rows with scores, or (not whole) with the levels that the part of the filter gives."""

    def score_group(data, offsets):
        part, frequent, counts, total, distinct = shared.value
        tokens, bounds = _tokens(data, offsets)
        values, inverse = np.unique(tokens, return_inverse=True)
        at = np.minimum(np.searchsorted(frequent, values), max(0, len(frequent) - 1))
        known = frequent[at] == values if len(frequent) else np.zeros(len(values), dtype=bool)
        exact = np.where(known, counts[at] if len(counts) else 0, 0)
        base = np.where(known, np.log10((exact + 1) / float(total + distinct + 1)), 0.0)
        pairs, triples, third = _grams(tokens, bounds)
        levels = np.zeros((3, len(tokens)), dtype=np.uint8)
        levels[0] = part.levels(_alone(values))[inverse]
        levels[1] = part.levels(pairs)
        if whole:  # a triple is there only if both of its pairs are
            could = (levels[1][third] > 0) & (levels[1][third - 1] > 0)
            triples, third = triples[could], third[could]
        levels[2, third] = part.levels(triples)
        model = combined(levels, bounds, total, distinct, prior) if whole else [levels[:, a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        sums = [np.add.reduceat(x, bounds[:-1]) for x in (base[inverse], known[inverse].astype(np.int64))]
        rare = np.flatnonzero(~known[inverse])
        row = np.searchsorted(bounds, rare, side="right") - 1
        both, times = np.unique(row * len(values) + inverse[rare], return_counts=True)
        rows, words = np.divmod(both, len(values))
        edges = np.searchsorted(rows, np.arange(len(bounds)))
        return np.diff(bounds), sums, model, edges, values[words], times

    def score(batches):
        for batch in batches:
            data, offsets = K.string_buffer(batch.column(2))
            for a, b in K.row_groups(offsets, K.PIECE):
                n, (base, known), model, edges, words, times = score_group(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                rare = pa.ListArray.from_arrays(pa.array(edges, type=pa.int32()), pa.StructArray.from_arrays([pa.array(words.view(np.int64)), pa.array(times, type=pa.int64())], names=["h", "times"]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n, type=pa.int64()), pa.array(known, type=pa.int64()), pa.array(base), pa.array(model, type=pa.float64() if whole else pa.binary()), rare],
                    names=["doc_id", "held_out", "n_tokens", "known", "base", "score", "rare"],
                )

    return score


def _joined_levels(tokens: int, distinct: int, prior: float):
    """Scores from (row, levels of each turn)."""

    def work(batches):
        for batch in batches:
            scores = []
            for found in batch.column(1).to_pylist():
                levels = sum(np.frombuffer(x, dtype=np.uint8) for x in found).reshape(3, -1)
                scores.append(combined(levels, np.array([0, levels.shape[1]]), tokens, distinct, prior)[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, type=pa.float64())], names=["row", "score"])

    return work


def score(docs: DataFrame, model: Model, *, prior: float = PRIOR, id_column: str = "doc_id", held_out="false", text_column: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs."""
    spark = docs.sparkSession
    flag = F.expr(held_out) if isinstance(held_out, str) else held_out
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), flag.alias("held_out"), F.col(text_column).alias("text"))
    turns = model.turns
    whole = len(turns) == 1
    if not whole:  # several passes need the same rows in the same order
        rows = materialize(rows)
    schema = f"doc_id long, held_out boolean, n_tokens long, known long, base double, score {'double' if whole else 'binary'}, rare array<struct<h:long,times:long>>"
    passes = []
    for turn, (low, high) in enumerate(turns):
        shared = spark.sparkContext.broadcast((model.filter(low, high), model.frequent, model.frequent_counts, model.tokens, model.distinct))
        found = rows.mapInArrow(K.returning(_scorer(shared, prior, whole)), schema).withColumn("row", F.monotonically_increasing_id())
        passes.append(materialize(found if turn == 0 else found.select("row", "score")))
        shared.destroy()
    scored = passes[0]
    if not whole:
        levels = reduce(DataFrame.unionByName, [x.select("row", "score") for x in passes]).groupBy("row").agg(F.collect_list("score").alias("levels"))
        scored = scored.drop("score").join(levels.mapInArrow(_joined_levels(model.tokens, model.distinct, prior), "row long, score double"), "row")
    rare = scored.select("row", F.inline("rare"))
    width = float(model.tokens + model.distinct + 1)
    count = F.coalesce("n", F.lit(0))
    more = rare.join(model.words, "h", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10((count + 1) / F.lit(width))).alias("more_base"), F.sum(F.when(count > 0, F.col("times")).otherwise(0)).alias("more_known"))
    return scored.drop("rare").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score"
    )


def op10_lm_scores(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remainder("doc_id", 7) == 2
    return score(docs, train(docs.where(~out)), held_out=out)
