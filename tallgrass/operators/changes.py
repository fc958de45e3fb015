"""Change detection between two states of a corpus, stage staleness and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def scan_diff(now: DataFrame, before: DataFrame) -> DataFrame:
    """(doc_id, rel_path, content_hash, scan_status): NEW, UNCHANGED, MODIFIED, MOVED or DELETED, by path and then by hash.

    now: rel_path, content_hash. before: doc_id, rel_path, content_hash, scan_status.
    A record keeps its doc_id when its file changes or moves; a deleted record
    stays deleted, and new records take a hash of their path.
    """
    alive = before.where("scan_status <> 'DELETED'")
    by_path = alive.select("rel_path", F.col("doc_id").alias("p_id"), F.col("content_hash").alias("p_hash"))
    gone = alive.join(now.select("rel_path"), "rel_path", "left_anti")
    by_hash = gone.groupBy("content_hash").agg(F.min_by("doc_id", "rel_path").alias("h_id"))
    joined = now.join(by_path, "rel_path", "left").join(by_hash, "content_hash", "left")
    # of several new files with one moved file's content, the first path has moved
    turn = F.row_number().over(Window.partitionBy("content_hash", F.col("p_id").isNull()).orderBy("rel_path"))
    moved = F.col("p_id").isNull() & F.col("h_id").isNotNull() & (turn == 1)
    status = F.when(F.col("p_hash") == F.col("content_hash"), "UNCHANGED").when(F.col("p_id").isNotNull(), "MODIFIED").when(moved, "MOVED").otherwise("NEW")
    current = joined.select(F.coalesce("p_id", F.when(moved, F.col("h_id")), F.substring(F.sha2("rel_path", 256), 1, 16)).alias("doc_id"), "rel_path", "content_hash", status.alias("scan_status"))
    rest = before.join(current.select("doc_id"), "doc_id", "left_anti").select("doc_id", "rel_path", "content_hash", F.lit("DELETED").alias("scan_status"))
    return current.unionByName(rest)


def forgettable(records: DataFrame) -> DataFrame:
    """Deleted or modified records that were not forgotten at this hash yet."""
    return records.where(F.col("scan_status").isin("DELETED", "MODIFIED") & ~F.col("forgotten_hash").eqNullSafe(F.col("content_hash")))


def incremental(records: DataFrame) -> DataFrame:
    return records.where(F.col("scan_status").isin("NEW", "MODIFIED"))


def needs_parse(records: DataFrame, version: str) -> DataFrame:
    stale = ~F.col("parsed_hash").eqNullSafe(F.col("content_hash"))
    outdated = (F.col("parse_status") != "SKIPPED") & ~F.col("parser_version").eqNullSafe(F.lit(version))
    return records.where(F.coalesce("is_active", F.lit(True)) & (stale | outdated))


def forget(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of gone documents."""
    ids = gone.select("doc_id").distinct()
    return {name: df.join(ids, "doc_id", "left_anti") for name, df in tables.items()}


def settle(work: DataFrame) -> DataFrame:
    """State of each document's pending work: done if all was attempted without error, error if any failed, orphaned if there is none."""
    by = work.groupBy("doc_id").agg(F.every(F.col("attempted")).alias("all_tried"), F.some(F.col("failed")).alias("any_failed"), F.count("product_code").alias("n"))
    return by.select("doc_id", F.when(F.col("n") == 0, "orphaned").when(F.col("any_failed"), "error").when(F.col("all_tried"), "done").otherwise("pending").alias("state"))
