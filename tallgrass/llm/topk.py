"""Operator 5: exact top-k by inner product with MaxScore.

A query's terms are its dimensions. In a shard of vectors a term's contribution
lies between bounds from the shard's extremes in that dimension; less its lower
bound it is never negative, as in an inverted index. Terms are ordered by the
width of that range. The narrow ones whose widths together cannot lift a vector
over the k-th best score so far are non-essential: all vectors are scored on
the essential terms, then only those that still compete are probed on the
others, widest first, and dropped as soon as what is left cannot suffice.
Thresholds start from a bounded sample of real rows (valid lower bounds, since
those rows are candidates) and rise with each shard. Shards' bests are merged
by a ranked window, of which Spark keeps k rows a task before it shuffles.

Queries go in blocks of at most ``block_queries`` (a bounded broadcast), each
block against all rows; a block's results are written before the next begins.
Sums are exact: in floats while every one stays below 2**53, in 64-bit integers
below 2**63, and in Python's integers beyond, where scores end at the least and
greatest 64-bit number.

Defined cases: a vector that is null or holds a null or a non-finite component,
or a row without id, takes no part; vectors of different length are not
compared; rows that repeat an id are candidates each, rows with the query's id
are its own and none of its candidates, and the least vector of a repeated query
id asks; fewer than k candidates give all of them; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallgrass.session import materialize, table

SHARD = 8_192
SEED_ROWS = 4_096


def quantised(ids: pa.Array, vectors: pa.Array, scale: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: (ids, floor(scale * vectors)) of the rows that take part."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
        ids = ids.combine_chunks()
    offsets = np.asarray(vectors.offsets).astype(np.int64)
    lengths = np.diff(offsets)
    flat = vectors.values.cast(pa.float64())
    bad = np.asarray(flat.is_null()) if flat.null_count else np.zeros(len(flat), dtype=bool)
    values = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    bad = bad | ~np.isfinite(values)
    wrong = np.concatenate(([0], np.cumsum(bad)))
    fine = np.asarray(vectors.is_valid()) & np.asarray(ids.is_valid()) & (wrong[offsets[1:]] == wrong[offsets[:-1]]) & (lengths > 0)
    keys = ids.fill_null(0).to_numpy(zero_copy_only=False)
    out = {}
    for size in np.unique(lengths[fine]).tolist():
        rows = np.flatnonzero(fine & (lengths == size))
        at = offsets[rows][:, None] + np.arange(size)[None, :]
        out[size] = (keys[rows], np.floor(scale * values[at]))
    return out


def exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a and b as the cheapest kind of number in which all sums of their products are exact."""
    bound = 2.0 * a.shape[-1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if bound < 2**53:
        return a, b
    if bound < 2**62:
        return a.astype(np.int64), b.astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return whole(a), whole(b)


def _long(x: np.ndarray) -> np.ndarray:
    return np.array([max(-(1 << 63), min((1 << 63) - 1, int(v))) for v in x], dtype=np.int64)


class _Block:
    """Queries of one dimension with the best scores so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k

    def fresh(self):
        return [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))] * len(self.ids)

    def search(self, best: list, floor: np.ndarray, ids: np.ndarray, shard: np.ndarray) -> None:
        """Raise best (a list of (scores, ids) by query) by the vectors of shard. floor: least score of interest by query."""
        shard, queries = exact(shard, self.vectors)
        columns = np.ascontiguousarray(shard.T)
        high, low = columns.max(axis=1), columns.min(axis=1)
        for i, (own, q) in enumerate(zip(self.ids.tolist(), queries, strict=True)):
            scores, found = best[i]
            limit = max(floor[i], int(scores[-1])) if len(scores) == self.k else floor[i]
            if limit <= -(1 << 63):  # scores end there
                limit = -np.inf
            least, most = np.minimum(q * high, q * low), np.maximum(q * high, q * low)
            if most.sum() < limit:
                continue
            width = most - least
            order = np.argsort(-width, kind="stable")
            left = np.append(np.cumsum(width[order][::-1])[::-1], width[:1] * 0)  # what the terms from here on can add
            base = least.sum()
            essential = min(len(order), max(1, int(np.searchsorted(-(base + left), -limit, side="right")))) if limit > -np.inf else len(order)
            terms = order[:essential]
            partial = base + (q[terms] @ columns[terms] - least[terms].sum())
            alive = np.flatnonzero((partial + left[essential] >= limit) & (ids != own))
            partial = partial[alive]
            for at in range(essential, len(order), 8):
                if not len(alive):
                    break
                terms = order[at : at + 8]
                partial = partial + (q[terms] @ columns[np.ix_(terms, alive)] - least[terms].sum())
                going = partial + left[min(at + 8, len(order))] >= limit
                alive, partial = alive[going], partial[going]
            if len(alive):
                all_scores, all_ids = np.concatenate((scores, _long(partial))), np.concatenate((found, ids[alive]))
                top = np.lexsort((all_ids, ~all_scores))[: self.k]
                best[i] = (all_scores[top], all_ids[top])


def _shards(batches, scale: float):
    """Rows that take part, by dimension, gathered to SHARD rows."""
    held: dict[int, list] = {}
    for batch in batches:
        for size, (ids, vectors) in quantised(batch.column(0), batch.column(1), scale).items():
            own = held.setdefault(size, [])
            own.append((ids, vectors))
            if sum(len(x) for x, _ in own) >= SHARD:
                yield size, np.concatenate([x for x, _ in own]), np.concatenate([x for _, x in own])
                held[size] = []
    for size, own in held.items():
        if own:
            yield size, np.concatenate([x for x, _ in own]), np.concatenate([x for _, x in own])


def _searcher(shared, scale: float):
    def search(batches):
        blocks, floors = shared.value
        best = {size: block.fresh() for size, block in blocks.items()}
        for size, ids, vectors in _shards(batches, scale):
            if size in blocks:
                blocks[size].search(best[size], floors[size], ids, vectors)
        for size, block in blocks.items():
            kept = [(i, s, v) for i, (s, v) in enumerate(best[size]) if len(s)]
            if kept:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(block.ids[[i for i, _, _ in kept]], [len(s) for _, s, _ in kept]), type=pa.int64()),
                        pa.array(np.concatenate([v for _, _, v in kept]), type=pa.int64()),
                        pa.array(np.concatenate([s for _, s, _ in kept]), type=pa.int64()),
                    ],
                    names=["query_id", "vec_id", "score"],
                )

    return search


def _query_blocks(queries: DataFrame, scale: float, size: int):
    """Queries by dimension, size rows at a time."""

    def block(rows):
        return quantised(pa.array([r[0] for r in rows], type=pa.int64()), pa.array([r[1] for r in rows], type=pa.list_(pa.float64())), scale)

    rows = []
    for row in queries.toLocalIterator():
        rows.append(row)
        if len(rows) == size:
            yield block(rows)
            rows = []
    if rows:
        yield block(rows)


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 5, scale: float = 256.0, id_column: str = "vec_id", vector_column: str = "embedding", block_queries: int = 4_096) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows of vectors, ties to the smaller id."""
    spark = vectors.sparkSession
    pick = lambda df: df.select(F.col(id_column).cast("long"), F.col(vector_column).cast("array<double>"))
    rows, asked = pick(vectors), pick(queries)
    seeds = rows.limit(SEED_ROWS).toArrow()
    seed = quantised(seeds.column(0), seeds.column(1), scale) if len(seeds) else {}
    parts = []
    names = asked.columns
    fine = asked.where(F.col(names[0]).isNotNull() & F.col(names[1]).isNotNull() & ~F.exists(names[1], lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    once = fine.groupBy(names[0]).agg(F.min(names[1]).alias(names[1]))
    for found in _query_blocks(once, scale, block_queries):
        blocks = {size: _Block(ids, q, k) for size, (ids, q) in found.items()}
        floors = {}
        for size, block in blocks.items():
            floors[size] = [-np.inf] * len(block.ids)
            if size in seed:
                best = block.fresh()
                block.search(best, floors[size], *seed[size])
                floors[size] = [int(s[-1]) if len(s) == k else -np.inf for s, _ in best]
        if blocks:
            shared = spark.sparkContext.broadcast((blocks, floors))
            parts.append(materialize(rows.mapInArrow(_searcher(shared, scale), "query_id long, vec_id long, score long")))
            shared.destroy()
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    merged = reduce(DataFrame.unionByName, parts).withColumn("rank", ranked).where(F.col("rank") <= k)
    return merged.select("query_id", "rank", "vec_id", "score")


def op5_top_k(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 50 = 0"))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
