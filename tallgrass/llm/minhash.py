"""Operator 8: near-duplicate documents by SuperMinHash, banding, verification and union-find.

Each document's distinct word shingles (64-bit hashes) give a SuperMinHash
signature: an element visits the slots in the order of its own permutation, its
value in a slot being (rank in that order) + (a random fraction), and a slot
keeps the least value. Ranks of an element are all different, which is what
lowers the variance against independent hashes. Levels (ranks) are processed
one after another for all documents of a batch; a document stops as soon as all
its slots are filled, since later ranks are larger (the early stopping).

Documents with equal shingle sets are one class, and only its smallest doc_id
goes on (equal: the 128-bit digest of the whole sorted set, and its size). Bands of the signature are buckets. In each bucket members are paired
with its smallest member only, and verified links are grouped. In buckets that
then still hold several components, pairs of different components are compared
inside the task, by signature and by what sets them apart from a common
document; only links and the few undecided pairs leave it (see _bucket_pairs).
Buckets of more than BLOCK members are dealt to tasks in pairs of blocks.
So every pair that shares a bucket is either compared or already linked through
others, and a large group never gives all its pairs. The rows of a band follow
from ``percent``: as many as leave a pair at the threshold without a common
bucket less often than once in ten million (32 bands of 4 values at 80 and 85 %).
Inside buckets a pair is passed over if its signatures agree in fewer slots than
six standard deviations below the threshold (once in a thousand million for a
pair at the threshold).

Defined cases: null or empty text, or text without words, has an empty set and
no links; fewer words than n make one shingle of all of them; rows that share a
doc_id are one document for linking; a null doc_id takes no part in linking, has
a null component and is kept; a repeated row gives a repeated result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallgrass.llm import textkernel as K
from tallgrass.llm.common import connected_components
from tallgrass.session import materialize, release, table

SLOTS = 128
#: Members of a bucket that one task compares with as many others.
BLOCK = 1_024
_U = np.uint64


def bands_for(percent: int, slots: int = SLOTS) -> tuple[int, int]:
    """(bands, values in a band) of a signature of slots values, for pairs of percent similarity and more."""
    for rows in (16, 8, 4, 2, 1):
        if (1 - (percent / 100) ** rows) ** (slots // rows) < 1e-7:
            return slots // rows, rows
    raise ValueError(f"{slots} values do not serve a similarity of {percent} %")


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a group."""
    _, _, words, first = K.word_hashes(data, offsets, K.NON_SPACE)
    grams = K.gram_hashes(words, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            h = np.sort(grams[a : b - n + 1])
            keep = np.ones(len(h), dtype=bool)
            np.not_equal(h[1:], h[:-1], out=keep[1:])
            out.append(h[keep])
        else:
            out.append(K.gram_hashes(words[a:b], b - a) if b > a else np.zeros(0, dtype=_U))
    return out


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures (sets x m) of non-empty sets; m is a power of two, at most 256. Values hold the rank in their top bits."""
    bits = _U(m.bit_length() - 1)
    mask, half = _U(m - 1), _U(max(1, (m.bit_length() - 1) // 2))
    full = np.iinfo(np.uint64).max
    signatures = np.full((len(sets), m), full, dtype=_U)
    flat = signatures.reshape(-1)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    seed = K.mix(np.concatenate(sets) if sets else np.zeros(0, dtype=_U))
    for level in range(m):
        if not len(owner):
            break
        # the slot at this rank: two rounds of an affine map and a shift, each a bijection of the m slots
        x = (_U(level) * (seed | _U(1)) + (seed >> _U(8))) & mask
        x ^= x >> half
        x = (x * ((seed >> _U(16)) | _U(1)) + (seed >> _U(24))) & mask
        x ^= x >> half
        x = (x * ((seed >> _U(32)) | _U(1)) + (seed >> _U(40))) & mask
        value = (K.mix(seed + _U((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> _U(8)) | (_U(level) << _U(56))
        np.minimum.at(flat, owner * m + x.astype(np.int64), value)
        open_rows = (signatures == full).any(axis=1)
        if not open_rows.all():
            going = open_rows[owner]
            owner, seed = owner[going], seed[going]
    assert bits <= 8
    return signatures


def _sketch_rows(n: int, bands: int, rows: int, text_index: int = 1):
    def sketch(batches):
        for batch in batches:
            data, offsets = K.string_buffer(batch.column(text_index))
            sizes, high, low, keys, kept = [], [], [], [], []
            for a, b in K.row_groups(offsets, K.PIECE):
                sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                sizes += [len(s) for s in sets]
                digests = [np.frombuffer(hashlib.blake2b(s, digest_size=16).digest(), dtype=np.int64) for s in sets]
                high += [int(x[0]) for x in digests]
                low += [int(x[1]) for x in digests]
                full = [s for s in sets if len(s)]
                signatures = super_minhash(full, bands * rows)
                signed, short = iter(_bands(signatures, bands, rows)), iter((K.mix(signatures) >> _U(48)).astype(np.uint16))
                keys += [next(signed) if len(s) else None for s in sets]
                kept += [next(short).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, type=pa.int64()), pa.array(high, type=pa.int64()), pa.array(low, type=pa.int64()), pa.array(keys, type=pa.list_(pa.int64())), pa.array(kept, type=pa.binary())],
                names=["doc_id", "n_shingles", "d1", "d2", "bands", "signature"],
            )

    return sketch


def _bands(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    shaped = signatures.reshape(len(signatures), bands, rows)
    out = np.arange(bands, dtype=_U)[None, :] * _U(0x9E3779B97F4A7C15) + _U(rows)
    for k in range(rows):
        out = K.mix(out * _U(0xFF51AFD7ED558CCD) + shaped[:, :, k])
    return out.astype(np.int64)


def _set_rows(n: int):
    def sets(batches):
        for batch in batches:
            data, offsets = K.string_buffer(batch.column(1))
            for a, b in K.row_groups(offsets, K.PIECE):
                found = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([s.astype(np.int64) for s in found], type=pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    return sets


def _sets_of(texts: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(doc_id, shingles) of the documents in ids, each set built once."""
    return materialize(texts.join(ids, "doc_id", "left_semi").mapInArrow(K.returning(_set_rows(n)), "doc_id long, shingles array<long>"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()


def _compared(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked, near): whether the full shingle sets of each pair are similar enough, and whether they share half."""
    with_a = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = with_a.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("common"), (F.size("sa") + F.size("sb")).alias("total"))
    union = F.col("total") - F.col("common")
    return materialize(both.select("a", "b", (100 * F.col("common") >= percent * union).alias("linked"), (2 * F.col("common") >= union).alias("near")))


def _block_pairs(entries: DataFrame) -> DataFrame:
    """entries with (i, j, side): each bucket's members in blocks, each block once beside itself and every other of its bucket."""
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("doc_id")) - 1
    blocks = entries.withColumn("own", F.floor(place / BLOCK).cast("int")).withColumn("last", F.floor((F.count("*").over(Window.partitionBy("bucket")) - 1) / BLOCK).cast("int"))
    beside = blocks.withColumn("beside", F.explode(F.sequence(F.lit(0), "last")))
    return beside.select("*", F.least("own", "beside").alias("i"), F.greatest("own", "beside").alias("j"), (F.col("own") > F.col("beside")).cast("int").alias("side")).drop("own", "last", "beside")


def _bucket_pairs(slots: int, percent: int, block: int = BLOCK):
    """Pairs of different parts inside each pair of blocks, from rows sorted by it (task, doc_id, part, n, cluster, d, signature, side): of different sides where there are two.

    Pairs that agree in too few slots are passed over. Of the others, pairs of
    one cluster that both know what sets them apart from its first document
    (d) are decided here: |x ^ y| = |dx| + |dy| - 2 |dx & dy|. Only links and
    undecided pairs leave.
    """
    # six standard deviations below the threshold
    share = percent / 100
    least = (share - 6 * (share * (1 - share) / slots) ** 0.5) * slots
    c = (100 - percent) / (100 + percent)

    def decide(own):
        bucket, doc, part, n, cluster = (own.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        signatures = np.frombuffer(b"".join(own.column(6).to_pylist()), dtype=np.uint16).reshape(len(doc), slots)
        d = own.column(5).to_pylist()
        side = own.column(7).to_numpy()
        two = side.min() != side.max()
        a_out, b_out, sure_out = [], [], []
        for i in range(0, len(doc), block):
            for j in range(i, len(doc), block):
                x, y = slice(i, min(i + block, len(doc))), slice(j, min(j + block, len(doc)))
                possible = (part[x, None] != part[None, y]) & (doc[x, None] < doc[None, y]) if i == j else part[x, None] != part[None, y]
                if two:
                    possible &= side[x, None] != side[None, y]
                possible &= (100 * n[x, None] >= percent * n[None, y]) & (100 * n[None, y] >= percent * n[x, None])
                p, q = np.nonzero(possible)
                if not len(p):
                    continue
                agree = np.concatenate([(signatures[p[k : k + 65_536] + i] == signatures[q[k : k + 65_536] + j]).sum(axis=1) for k in range(0, len(p), 65_536)])
                going = agree >= least
                for r, t in zip((p[going] + i).tolist(), (q[going] + j).tolist(), strict=True):
                    known = d[r] is not None and d[t] is not None and cluster[r] == cluster[t]
                    if known:
                        if not isinstance(d[r], frozenset):
                            d[r] = frozenset(d[r])
                        if not isinstance(d[t], frozenset):
                            d[t] = frozenset(d[t])
                        if len(d[r]) + len(d[t]) - 2 * len(d[r] & d[t]) > c * (n[r] + n[t]) + 1e-9:
                            continue
                    a_out.append(min(doc[r], doc[t]))
                    b_out.append(max(doc[r], doc[t]))
                    sure_out.append(known)
        return pa.RecordBatch.from_arrays([pa.array(a_out, type=pa.int64()), pa.array(b_out, type=pa.int64()), pa.array(sure_out, type=pa.bool_())], names=["a", "b", "sure"])

    def work(batches):
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            keys = now.column(0).to_numpy()
            if not len(keys):
                continue
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a > 1:
                    yield decide(now.slice(a, b - a).combine_chunks())
            held = now.slice(cuts[-1]).combine_chunks().to_batches()[0]
        if held is not None and len(held) > 1:
            yield decide(pa.Table.from_batches([held]))

    return work


def _links_across(sketches: DataFrame, sets: DataFrame, stars: DataFrame, rest: DataFrame, percent: int, slots: int) -> DataFrame:
    """Links between different parts of one bucket. rest: (bucket, doc_id, part); stars: the compared pairs so far.

    Documents that share half of their shingles with hubs form clusters, the
    first document of a cluster being the one with most links. What sets a
    member apart from it is short for near copies, and decides their pairs
    exactly without their sets (see _bucket_pairs).
    """
    clusters = connected_components(stars.where("near").select("a", "b")).withColumnsRenamed({"node": "doc_id", "root": "cluster"})
    linked = stars.where("linked")
    degree = linked.select(F.col("a").alias("doc_id")).unionByName(linked.select(F.col("b").alias("doc_id"))).groupBy("doc_id").agg(F.count("*").alias("links"))
    first = materialize(clusters.join(degree, "doc_id", "left").groupBy("cluster").agg(F.max(F.struct(F.coalesce("links", F.lit(0)).alias("links"), (-F.col("doc_id")).alias("id"))).alias("m")).select("cluster", (-F.col("m.id")).alias("first")))
    own = rest.select("doc_id").distinct().join(sets, "doc_id").join(clusters, "doc_id", "left")
    of_first = materialize(first.join(sets, first["first"] == sets.doc_id).select("cluster", F.col("shingles").alias("s0")))
    apart = own.join(of_first, "cluster", "left").select("doc_id", "cluster", F.size("shingles").alias("n"), F.concat(F.array_except("shingles", "s0"), F.array_except("s0", "shingles")).alias("d"))
    apart = materialize(apart.select("doc_id", F.coalesce("cluster", "doc_id").alias("cluster"), "n", F.when(F.size("d") <= F.col("n"), F.col("d")).alias("d")))
    signed = materialize(apart.join(sketches.select("doc_id", "signature").where("signature is not null").dropDuplicates(["doc_id"]), "doc_id"))
    # where blocks meet others, i and j tell tasks and, with the bucket, groups apart
    grouped = _block_pairs(rest.select("bucket", "doc_id", "part").distinct())
    group = F.xxhash64("bucket", "i", "j").alias("task")
    entries = grouped.join(signed, "doc_id").select(group, "doc_id", "part", "n", "cluster", "d", "signature", "side")
    found = materialize(entries.repartition("task").sortWithinPartitions("task").mapInArrow(K.returning(_bucket_pairs(slots, percent)), "a long, b long, sure boolean").distinct())
    checked = _compared(sets, found.where("not sure").select("a", "b"), percent)
    return found.where("sure").select("a", "b").unionByName(checked.where("linked").select("a", "b"))


def near_duplicates(docs: DataFrame, *, n: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row: links where 100 * intersection >= percent * union of shingle sets."""
    bands, rows = bands_for(percent)
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    sketches = materialize(texts.mapInArrow(K.returning(_sketch_rows(n, bands, rows)), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, signature binary"))
    linked = sketches.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(linked.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")).where("size > 1").select("d1", "d2", F.col("n_shingles").alias("n"), "rep"))
    member = linked.join(classes, (linked.d1 == classes.d1) & (linked.d2 == classes.d2) & (linked.n_shingles == classes.n), "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"), F.when(F.coalesce("rep", "doc_id") == F.col("doc_id"), F.col("bands")).alias("bands"))
    member = materialize(member)
    entries = member.where("bands is not null").select("doc_id", F.explode("bands").alias("bucket"))
    hubs = materialize(entries.groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub < last").select("bucket", "hub"))
    crowded = materialize(entries.join(hubs, "bucket"))
    pairs = materialize(crowded.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct())
    same = member.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    sets = _sets_of(texts, _ends(pairs), n)
    stars = _compared(sets, pairs, percent)
    links = stars.where("linked").select("a", "b").unionByName(same)
    grouped = materialize(connected_components(links))

    # what is left: pairs of one bucket that lie in different components
    placed = materialize(crowded.join(grouped, crowded.doc_id == grouped.node, "left").select("bucket", "doc_id", F.coalesce("root", "doc_id").alias("part")))
    split = materialize(placed.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("bucket"))
    rest = materialize(placed.join(split, "bucket"))
    if not rest.isEmpty():
        links = materialize(links.unionByName(_links_across(sketches, sets, stars, rest, percent, bands * rows)))
        grouped = materialize(connected_components(links))

    own = sketches.select("doc_id", "n_shingles").join(grouped, sketches.doc_id == grouped.node, "left")
    own = own.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
    return own.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_of_each(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **kw) -> DataFrame:
    """docs with one document of each near-duplicate group, that of the smallest id; of rows that share id and text one stays. Rows without id all stay."""
    gone = near_duplicates(docs, id_column=id_column, text_column=text_column, **kw).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    key, text = F.col(f"`{id_column}`"), F.col(f"`{text_column}`")
    left = docs.join(gone, key.cast("long") == F.col("__gone"), "left_anti")
    if docs.groupBy(key).count().where("count > 1").isEmpty():
        return left
    turn = Window.partitionBy(key, F.sha2(text, 256)).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if c not in (id_column, text_column)]) if len(docs.columns) > 2 else F.lit(0))
    one = left.withColumn("__turn", F.row_number().over(turn)).where((F.col("__turn") == 1) | key.isNull())
    return one.select(*[f"`{c}`" for c in docs.columns])


def op8_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=85)


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(3, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), l AS (
  SELECT a, b FROM e UNION SELECT b, a FROM e
), r(d, m) AS (
  SELECT a, a FROM l UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.d
), comp AS (
  SELECT d, min(m) AS m FROM r GROUP BY d
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m, w.doc_id) AS component_id, w.doc_id = coalesce(m, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.d = w.doc_id
"""
