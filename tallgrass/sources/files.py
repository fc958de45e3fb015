"""File scans and JSON sources with fixed schemas, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NODE = "struct<node_id:string,doc_id:string,tree_level:int,text:string,content_sha256:string,heading_path:array<string>,page_start:int,page_end:int>"
CHUNKS = f"generated_at string, documents map<string,struct<doc_id:string,nodes:array<{NODE}>>>"


def corpus_files(spark: SparkSession, root: str) -> DataFrame:
    """(rel_path, content_hash, size_bytes, last_modified) of every file below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace("path", f"^.*?/{root.rstrip('/').rpartition('/')[2]}/", "")
    return files.select(rel.alias("rel_path"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("content_hash"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("last_modified"))


def chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of a chunks file, the last of each node_id, without those that lack id or text."""
    rows = spark.read.schema(CHUNKS).option("multiLine", "true").json(path)
    docs = rows.select(F.posexplode(F.map_values("documents"))).toDF("d", "doc")
    nodes = docs.select("d", F.posexplode("doc.nodes")).toDF("d", "n", "node").where("node.node_id is not null and node.text is not null")
    last = F.row_number().over(Window.partitionBy("node.node_id").orderBy(F.desc("d"), F.desc("n")))
    return nodes.withColumn("k", last).where("k = 1").select("node.*")


def golden_set(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines and lines that begin with # are skipped, a bad line fails."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("x")).select("x.*")


def turn_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; bad lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_partitions(df: DataFrame, path: str, key: str) -> None:
    """Replace only the partitions that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
