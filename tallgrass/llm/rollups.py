"""Operator 6: token-count rollups maintained by signed deltas.

Changes to documents are inserts, deletes and revised counts. A batch of them is
summed to one signed delta for each (source, lang, tokenizer_version) before
anything shuffles beyond that key; the delta is what is stored. Totals are the
sum of the stored deltas, so they never need the documents again.

Commits are idempotent: a batch is staged, then renamed to the folder of its id
in one atomic step that refuses to replace; a batch id that is there already is
not applied again. A job that dies before the rename leaves only staged files
that nobody reads.

Defined cases: null source, lang or version are groups of their own; null token
counts are 0; an empty batch is a commit; repeated changes count each; groups
whose documents and tokens are back at 0 vanish from the totals.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallgrass.llm import textkernel as K
from tallgrass.llm.packing import run_counts, word_counts
from tallgrass.session import materialize, scratch_path, table

KEYS = ("source", "lang", "tokenizer_version")
DELTA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


def alnum_counts(texts: pa.Array) -> np.ndarray:
    """Runs of letters, digits and non-ASCII characters in each text."""
    return run_counts(texts, K.ALNUM)


#: Counters by tokenizer version; packing.tokenizer_counts(path) makes one from a tokenizer file.
COUNTERS: dict[str, Callable[[pa.Array], np.ndarray]] = {"words-1": word_counts, "alnum-1": alnum_counts}


def count_tokens(docs: DataFrame, counters: dict[str, Callable[[pa.Array], np.ndarray]] | None = None, *, text_column: str = "text") -> DataFrame:
    """docs without the text, with token_counts array<long> in the order of counters."""
    counters = counters or COUNTERS
    kept = [c for c in docs.columns if c not in (text_column, "token_counts")]
    base = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_column}`").alias("__text"))
    schema = T.StructType([*base.drop("__text").schema.fields, T.StructField("token_counts", T.ArrayType(T.LongType()))])
    functions = list(counters.values())

    def count(batches):
        for batch in batches:
            texts = batch.column("__text")
            counts = np.column_stack([f(texts) for f in functions]) if len(texts) else np.zeros((0, len(functions)), dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, counts.size + 1, len(functions)), type=pa.int32()), pa.array(counts.reshape(-1), type=pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*batch.schema.names[:-1], "token_counts"])

    return base.mapInArrow(count, schema)


def delta(changes: DataFrame) -> DataFrame:
    """The signed sum of changes (op insert | delete | revise, source, lang, tokenizer_version, n_tokens, old_tokens): one row a group."""
    old = F.coalesce(F.col("old_tokens"), F.lit(0)) if "old_tokens" in changes.columns else F.lit(0)
    new = F.coalesce(F.col("n_tokens"), F.lit(0))
    docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0)
    tokens = F.when(F.col("op") == "insert", new).when(F.col("op") == "delete", -new).when(F.col("op") == "revise", new - old)
    checked = F.when(docs.isNull(), F.raise_error(F.lit("op is insert, delete or revise"))).otherwise(docs)
    return changes.groupBy(*KEYS).agg(F.sum(checked).cast("long").alias("n_docs"), F.sum(tokens).cast("long").alias("n_tokens"))


class RollupStore:
    """Additive totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _folder(self, batch_id: str) -> str:
        return f"{self.path}/batch={quote(batch_id, safe='')}"

    def committed(self, batch_id: str) -> bool:
        where = self._path(self._folder(batch_id))
        return where.getFileSystem(self._conf).exists(where)

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply changes under batch_id; False if that id was applied before, by this or another writer."""
        if self.committed(batch_id):
            return False
        staged = scratch_path(self.spark, "staged-rollup")
        delta(changes).coalesce(1).write.parquet(staged)
        source, target = self._path(staged), self._path(self._folder(batch_id))
        source.getFileSystem(self._conf).mkdirs(target.getParent())
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.getFileSystem(self._conf).getUri(), self._conf)
        try:
            context.rename(source, target, options)
        except Exception:
            if not self.committed(batch_id):
                raise
            source.getFileSystem(self._conf).delete(source, True)
            return False
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer_version, n_docs, n_tokens) over all committed batches."""
        root = self._path(self.path)
        files = root.getFileSystem(self._conf)
        if not files.exists(root):
            return self.spark.createDataFrame([], DELTA)
        rows = self.spark.read.schema(DELTA).option("recursiveFileLookup", "true").parquet(self.path)
        summed = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return summed.where("n_docs <> 0 or n_tokens <> 0")


def op6_token_rollups(spark, sf_dir: str) -> DataFrame:
    """Load every document with counts estimated from n_chars, revise them to real counts, delete documents under 20 words, and replay the revision (no effect)."""
    docs = table(spark, sf_dir, "documents").select("source", "lang", "n_chars", "text")
    counted = materialize(count_tokens(docs))
    each = F.inline(F.arrays_zip(F.array(*map(F.lit, COUNTERS)).alias("tokenizer_version"), F.col("token_counts").alias("n")))
    guess = (F.coalesce("n_chars", F.lit(0)) / 6).cast("long").alias("guess")
    rows = counted.select("source", "lang", guess, F.element_at("token_counts", 1).alias("words"), each).toDF("source", "lang", "guess", "words", "tokenizer_version", "n")
    store = RollupStore(spark, scratch_path(spark, "rollups"))
    revision = rows.select(F.lit("revise").alias("op"), *KEYS, F.col("n").alias("n_tokens"), F.col("guess").alias("old_tokens"))
    store.commit("load", rows.select(F.lit("insert").alias("op"), *KEYS, F.col("guess").alias("n_tokens")))
    store.commit("revise", revision)
    store.commit("short", rows.where("words < 20").select(F.lit("delete").alias("op"), *KEYS, F.col("n").alias("n_tokens")))
    store.commit("revise", revision)
    return store.totals()


OP6_SQL = r"""
WITH c AS (
  SELECT source, lang,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS alnum
  FROM documents
), r AS (
  SELECT source, lang, 'words-1' AS tokenizer_version, words, words AS n FROM c UNION ALL SELECT source, lang, 'alnum-1', words, alnum FROM c
)
SELECT source, lang, tokenizer_version, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens
FROM r WHERE words >= 20 GROUP BY ALL
"""
