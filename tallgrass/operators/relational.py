"""Filters, joins, aggregates, windows and set operations over document and fact tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallgrass.session import materialize

# ---- filters -----------------------------------------------------------------


def live_documents(registry: DataFrame) -> DataFrame:
    """Active (by default) and not deleted."""
    return registry.where(F.coalesce("is_active", F.lit(True)) & ~F.col("scan_status").eqNullSafe("DELETED"))


def junk_name(name: Column, *, names: list[str] = (), prefixes: list[str] = (), keywords: list[str] = ()) -> Column:
    tests = [F.lower(name).isin(list(names))] if names else []
    tests += [name.startswith(p) for p in prefixes] + [F.contains(F.upper(name), F.lit(k)) for k in keywords]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def conjunction(df: DataFrame, **equal) -> DataFrame:
    """Rows equal to every value given; a None is no condition."""
    return df.where(reduce(lambda a, b: a & b, [F.col(k) == v for k, v in equal.items() if v is not None], F.lit(True)))


def result_shape(count: Column, few: int = 5) -> Column:
    return F.when(count == 0, "zero").when(count == 1, "one").when(count <= few, "few").otherwise("many")


def derivative_status(scan_status: Column, exists: Column, recorded_hash: Column, current_hash: Column, behind: Column) -> Column:
    """First that holds, in this order: source_missing, source_changed, not_generated, stage_changed, fresh."""
    return F.when(scan_status == "DELETED", "source_missing").when(~recorded_hash.eqNullSafe(current_hash) & exists, "source_changed").when(~exists, "not_generated").when(behind, "stage_changed").otherwise("fresh")


# ---- joins -------------------------------------------------------------------


def fallback_join(now: DataFrame, before: DataFrame, key: str, second: str, value: str) -> DataFrame:
    """now with value of before by key, else by second (the first row of each second key)."""
    by_key = before.select(F.col(key), F.col(value).alias("__v1"))
    by_second = before.groupBy(second).agg(F.min_by(value, key).alias("__v2"))
    joined = now.join(by_key, key, "left").join(by_second, second, "left")
    return joined.withColumn(value, F.coalesce("__v1", "__v2")).drop("__v1", "__v2")


def best_ancestor(rows: DataFrame, nodes: DataFrame, levels: list[str], value: str) -> DataFrame:
    """rows with value of the deepest node whose path is a prefix of the row's; nodes leave lower levels null."""
    out, found = rows, []
    for depth in range(len(levels), 0, -1):
        at = nodes.where(reduce(lambda a, b: a & b, [F.col(c).isNull() for c in levels[depth:]], F.lit(True)) & F.col(levels[depth - 1]).isNotNull())
        at = at.select(*[F.col(c) for c in levels[:depth]], F.col(value).alias(f"__{depth}"))
        out = out.join(at, levels[:depth], "left")
        found.append(f"__{depth}")
    return out.withColumn(value, F.coalesce(*found)).drop(*found)


def descendants(edges: DataFrame, parent: str, child: str) -> DataFrame:
    """(ancestor, node, depth) for every node below every ancestor, by doubling joins: log2(depth) rounds.

    Each round is written to the shared folder, so plans stay short and a lost
    executor costs one round. Edges with a null end join nothing and are left
    out; repeated edges count once; depth is the shortest way; in a cycle a node
    is below itself; without edges there are no rows.
    """
    paths = materialize(edges.select(F.col(parent).alias("ancestor"), F.col(child).alias("node"), F.lit(1).alias("depth")).where("ancestor is not null and node is not null").distinct())
    known = (-1, -1)
    while True:
        now = paths.agg(F.count("*"), F.coalesce(F.sum("depth"), F.lit(0))).first()
        if tuple(now) == known:
            return paths
        known = tuple(now)
        a, b = paths.alias("a"), paths.alias("b")
        longer = a.join(b, F.col("a.node") == F.col("b.ancestor")).select(F.col("a.ancestor"), F.col("b.node"), (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        paths = materialize(paths.unionByName(longer).groupBy("ancestor", "node").agg(F.min("depth").alias("depth")))


def neighbours(rows: DataFrame, group: str, order: str, key: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn(f"prev_{key}", F.lag(key).over(w)).withColumn(f"next_{key}", F.lead(key).over(w))


def coverage_gap(grid: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Grid cells without a value."""
    return grid.join(values.select(*keys).distinct(), keys, "left_anti")


def range_join(points: DataFrame, spans: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Points inside spans, both ends included, as an equi-join on buckets with a check.

    A span goes to buckets of its own scale, width doubled until the span is no
    longer than a bucket, so it meets two at most, however long it is. Points go
    to one bucket a scale in use, of which there are as many as the logarithm of
    the spans' lengths; these few numbers are read by the driver. Ends may be
    infinite. Null points and ends, NaN and spans whose ends are in the wrong
    order meet nothing.
    """
    finite = lambda x: F.greatest(F.lit(-1e280), F.least(F.lit(1e280), F.col(x).cast("double")))
    sound = spans.where(F.col(low) <= F.col(high)).where(~F.isnan(F.col(high).cast("double")))
    length = (finite(high) - finite(low)) / width
    scaled = sound.withColumn("__s", F.when(length > 1, F.ceil(F.log2(length))).otherwise(0).cast("int"))
    scales = sorted(r[0] for r in scaled.select("__s").distinct().collect())
    bucket = lambda x, scale: F.floor(x / (F.lit(float(width)) * F.pow(F.lit(2.0), scale)))
    at = points.where(F.col(point).isNotNull()).withColumn("__s", F.explode(F.array(*map(F.lit, scales)).cast("array<int>"))).withColumn("__b", bucket(finite(point), F.col("__s")))
    over = scaled.withColumn("__b", F.explode(F.sequence(bucket(finite(low), F.col("__s")), bucket(finite(high), F.col("__s")))))
    return at.join(over, ["__s", "__b"]).where(F.col(point).between(F.col(low), F.col(high))).drop("__s", "__b")


def as_of_join(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left with the last value of right at or before each row's time: one sort over the union, no pairs."""
    both = left.withColumn("__v", F.lit(None).cast(right.schema[value].dataType)).withColumn("__left", F.lit(1)).unionByName(right.select(key, at, F.col(value).alias("__v")).withColumn("__left", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "__left").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("__v", True).over(w)).where("__left = 1").drop("__v", "__left")


# ---- aggregates --------------------------------------------------------------


def informative(df: DataFrame, group: list[str], value: str, least: int = 2, limit: int | None = None) -> DataFrame:
    """Groups with several distinct values, most first, ties by group."""
    out = df.where(F.col(value).isNotNull()).groupBy(*group).agg(F.countDistinct(value).alias("n_values")).where(F.col("n_values") >= least).orderBy(F.desc("n_values"), *group)
    return out.limit(limit) if limit else out


def stage_summary(runs: DataFrame, stages: DataFrame) -> DataFrame:
    """total, stale and last run of each stage; stages without runs count 0."""
    by = runs.groupBy("stage").agg(F.count("*").alias("total"), F.count_if("is_stale").alias("stale"), F.max("ran_at").alias("last_ran_at"))
    return stages.join(by, "stage", "left").fillna(0, ["total", "stale"])


def weighted_mean(value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.sum(weight)


def running_lines(lines: DataFrame, doc: str, page: str, line: str) -> DataFrame:
    """Lines on at least max(2, min(3, pages)) pages of their document."""
    pages = lines.groupBy(doc).agg(F.countDistinct(page).alias("pages"))
    on = lines.groupBy(doc, line).agg(F.countDistinct(page).alias("on_pages"))
    return on.join(pages, doc).where(F.col("on_pages") >= F.greatest(F.lit(2), F.least(F.lit(3), F.col("pages"))))


def containment(need: Column, have: Column) -> Column:
    """Share of the words of need, with multiplicity, that have holds; 1 for no words."""
    count = lambda a, w: F.size(F.filter(a, lambda x: x == w))
    held = F.aggregate(F.array_distinct(need), F.lit(0), lambda s, w: s + F.least(count(need, w), count(have, w)))
    return F.when(F.size(need) == 0, 1.0).otherwise(held / F.size(need))


# ---- windows -----------------------------------------------------------------


def latest(df: DataFrame, key: str | list[str], order: list) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def numbered_repeats(df: DataFrame, group: list[str], base: str, order: str, out: str) -> DataFrame:
    """The k-th repeat of base in its group gets the suffix -k."""
    k = F.row_number().over(Window.partitionBy(*group, base).orderBy(order)) - 1
    return df.withColumn(out, F.when(k > 0, F.concat_ws("-", base, k)).otherwise(F.col(base)))


def islands(df: DataFrame, group: str, order: str, starts: Column, out: str) -> DataFrame:
    """Number of the island of each row; starts is true where one begins."""
    return df.withColumn(out, F.sum(starts.cast("int")).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def clusters_1d(df: DataFrame, group: str, value: str, tolerance: float) -> DataFrame:
    """(group, cluster, mean, size): neighbours within tolerance are one cluster."""
    w = Window.partitionBy(group).orderBy(value)
    gap = F.col(value) - F.lag(value).over(w)
    marked = df.withColumn("__s", F.coalesce((gap > tolerance).cast("int"), F.lit(0)))
    numbered = marked.withColumn("cluster", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(group, "cluster").agg(F.avg(value).alias("mean"), F.count("*").alias("size"))


def covered_length(df: DataFrame, group: str, low: str, high: str) -> DataFrame:
    """Length of the union of each group's intervals."""
    w = Window.partitionBy(group).orderBy(low, high).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(high).over(w)
    new = df.withColumn("__n", F.greatest(F.lit(0), F.col(high) - F.greatest(F.col(low), F.coalesce(reach, F.col(low)))))
    return new.groupBy(group).agg(F.sum("__n").alias("covered"))


def memory_window(turns: DataFrame, key: str, order: str, keep: int) -> DataFrame:
    """The last keep turns of each conversation."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return turns.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= keep).drop("__n")


# ---- sets --------------------------------------------------------------------


def union_of(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, parts).distinct()


def override_union(base: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """Rows of over, and those of base whose key over does not have."""
    return over.unionByName(base.join(over.select(key).distinct(), key, "left_anti"))


def schema_difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows on one side only, with their side."""
    return expected.exceptAll(actual).withColumn("side", F.lit("missing")).unionByName(actual.exceptAll(expected).withColumn("side", F.lit("extra")))


def forget_evidence(facts: DataFrame, doc: Column) -> DataFrame:
    """facts without evidence of doc; facts left without any go, the primary source is the first that remains."""
    left = facts.withColumn("evidence", F.filter("evidence", lambda e: ~e["doc_id"].eqNullSafe(doc))).where(F.size("evidence") > 0)
    return left.withColumn("source_doc_id", F.col("evidence")[0]["doc_id"])
