"""The corpus pipeline: five of the training-data operators in sequence, each stage written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallgrass.llm.decontaminate import remove_contaminated
from tallgrass.llm.langid import keep_identified
from tallgrass.llm.minhash import keep_one_of_each
from tallgrass.llm.packing import pack
from tallgrass.llm.secrets import redact_secrets
from tallgrass.session import scratch_path, table

#: Rows in an Arrow batch: whole texts are long, so fewer than Spark's default.
BATCH_ROWS = 2_048
BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: The session's own setting, while the stages from language ID to secret scan run.
_before: dict[str, str] = {}


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those whose language stays unclear (operator 7)."""
    _before.setdefault(BATCHES, spark.conf.get(BATCHES))
    spark.conf.set(BATCHES, BATCH_ROWS)
    return keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group: five words, similarity 0.8 (operator 8)."""
    return keep_one_of_each(docs, n=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold benchmark passages (operator 3)."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts (operator 9)."""
    return redact_secrets(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of several lengths (operator 2). The texts are read at once; then the session has its own setting again."""
    packed = pack(docs)
    if BATCHES in _before:
        spark.conf.set(BATCHES, _before.pop(BATCHES))
    return packed


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("packing", pack_sequences),
]

#: SQL cannot express packing; tests hold run() against a brute-force version of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            where = scratch_path(spark, f"pipeline-{k}-{name}")
            docs.write.parquet(where)
            docs = spark.read.parquet(where)
    return docs
