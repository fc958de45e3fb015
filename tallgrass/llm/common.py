"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.session import materialize


def shielded(docs: DataFrame, taken: set[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(docs) with the columns of docs whose names are in taken out of its way; the columns of docs, as they were, come back."""
    lowered = {x.lower() for x in taken}
    names = {c: f"__own_{i}_{c}" if c.lower() in lowered else c for i, c in enumerate(docs.columns)}
    moved = docs.select(*[F.col(f"`{c}`").alias(new) for c, new in names.items()])
    return work(moved).select(*[F.col(f"`{new}`").alias(c) for c, new in names.items()])


def _union_find(batches):
    """Each partition's links as a forest of stars: (node, root) with root < node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def stars():
        pairs = [(x, root(x)) for x in list(parent)]
        pairs = [p for p in pairs if p[0] != p[1]]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], type=pa.int64()), pa.array([p[1] for p in pairs], type=pa.int64())], names=["a", "b"])

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > 1_000_000:
            yield stars()
            parent.clear()
    yield stars()


#: Links of one task, and the least number of tasks that share them.
LINKS_A_TASK, LEAST_TASKS = 50_000, 8


def _gathered(links: DataFrame, count: int) -> DataFrame:
    """links in a number of partitions that grows with their count, without a shuffle."""
    return links.coalesce(max(LEAST_TASKS, -(-count // LINKS_A_TASK)))


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest id reachable from each node that has a link. edges: two long columns.

    Union-find inside each partition shortens the links to stars; alternating
    large-star and small-star rounds (each a grouped minimum and a join) join
    the stars across partitions in a logarithmic number of rounds. Every step
    runs in partitions sized by the count of links, however many wrote them,
    which lets union-find join more of them and writes fewer files. Nothing is collected; every round is
    written to the shared folder.
    """
    a, b = edges.columns[:2]
    clean = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    links = materialize(clean)
    count = links.count()
    stars = materialize(_gathered(_gathered(links, count).mapInArrow(_union_find, "a long, b long").distinct(), count))
    before = _fingerprint(stars)
    while before[0]:
        count = before[0]
        stars = _gathered(stars, count)
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _gathered(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")), count)
        large = materialize(_gathered(large.distinct(), count))
        least = materialize(_gathered(large.groupBy("a").agg(F.min("b").alias("m")), count))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        stars = materialize(_gathered(_gathered(small.where("a <> b"), count).distinct(), count))
        now = _fingerprint(stars)
        if now == before:
            break
        before = now
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
