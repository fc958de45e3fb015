"""What lies between a question and its rows: labels, routes, schema linking, clean SQL, replies and evidence."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def label_in(text: Column, labels: Iterable[str], otherwise: str = "out_of_scope") -> Column:
    """The label that text is; else the longest label that it holds as a word; else otherwise."""
    clean = F.lower(F.trim(text))
    ordered = sorted(labels, key=lambda x: (-len(x), x))
    out = F.when(clean.isin(ordered), clean)
    for label in ordered:
        out = out.when(clean.rlike(rf"\b{re.escape(label.lower())}\b"), F.lit(label))
    return out.otherwise(F.lit(otherwise))


def confidence(logprobs: Column) -> Column:
    """exp of the sum of an array of log-probabilities, within 0 and 1; null where there is none."""
    total = F.aggregate(logprobs, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))
    return F.when(F.size(logprobs) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(total))))


def routed(questions: DataFrame, routes: dict[str, str], default: str, label: str = "label") -> DataFrame:
    """questions with flow, the route of their label. Every route must be named, or this fails at once."""
    if not default or not all(routes.values()):
        raise ValueError("a route without a flow")
    if not routes:
        return questions.withColumn("flow", F.lit(default))
    pairs = F.create_map(*[F.lit(x) for pair in routes.items() for x in pair])
    return questions.withColumn("flow", F.coalesce(F.try_element_at(pairs, F.col(label)), F.lit(default)))


def clean_sql(text: Column) -> Column:
    """The statement in a generated text: fences, a leading ``sql`` or ``SQL:`` and trailing semicolons go."""
    fenced = F.regexp_extract(text, r"(?s)```(?:\w+)?\s*(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(text)
    return F.regexp_replace(F.regexp_replace(body, r"(?i)^\s*sql\s*:?\s*\n?(?=\s*(?:select|with)\b)", ""), r"^\s+|[\s;]+$", "")


class QueryError(ValueError):
    """A statement that is refused or cannot be analysed."""


def run_sql(spark: SparkSession, text: str, limit: int | None = None) -> DataFrame:
    """The rows of one reading statement, in its own order, at most limit of them."""
    if not re.match(r"(?is)\s*(select|with|values)\b", text):
        raise QueryError("only a reading statement runs")
    try:
        out = spark.sql(text)
    except (AnalysisException, ParseException) as e:
        raise QueryError(str(e).splitlines()[0]) from e
    return out if limit is None else out.limit(limit)


def linked_schema(wanted: DataFrame, known: DataFrame, max_tables: int | None = None) -> DataFrame:
    """wanted (question, ord, table_name, column_name) without tables and columns that known (table_name, column_name) lacks.

    Names are compared without case and returned as known writes them. A row
    without a column keeps its table. With max_tables, a question keeps its
    first tables by ord.
    """
    names = known.select(F.col("table_name").alias("t"), F.col("column_name").alias("c"))
    tables = F.broadcast(names.select("t").distinct())
    kept = wanted.join(tables, F.lower("table_name") == F.lower("t"))
    exact = kept.where("column_name is not null").join(F.broadcast(names.withColumnRenamed("t", "t2")), (F.lower("table_name") == F.lower("t2")) & (F.lower("column_name") == F.lower("c")))
    out = exact.select("question", "ord", F.col("t").alias("table_name"), F.col("c").alias("column_name")).unionByName(kept.where("column_name is null").select("question", "ord", F.col("t").alias("table_name"), "column_name"))
    if max_tables is None:
        return out
    first = out.groupBy("question", "table_name").agg(F.min("ord").alias("o"))
    chosen = first.groupBy("question").agg(F.slice(F.array_sort(F.collect_list(F.struct("o", "table_name"))), 1, max_tables).alias("x"))
    return out.join(chosen.select("question", F.explode("x.table_name").alias("table_name")), ["question", "table_name"], "left_semi").select("question", "ord", "table_name", "column_name")


def known_columns(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, type) of tables."""
    rows = [(t, f.name, f.dataType.simpleString()) for t, df in tables.items() for f in df.schema.fields]
    return spark.createDataFrame(rows, "table_name string, column_name string, type string")


def schema_text(columns: DataFrame) -> DataFrame:
    """(table_name, text): one line a table, its columns in name order."""
    parts = F.array_sort(F.collect_list(F.concat_ws(" ", "column_name", "type")))
    return columns.groupBy("table_name").agg(F.concat("table_name", F.lit("("), F.array_join(parts, ", "), F.lit(")")).alias("text"))


def reply_check(cited: Column, evidence: Column) -> Column:
    """struct<known, unknown>: the distinct ids that a reply cites, parted by whether they are evidence."""
    return F.struct(F.array_intersect(cited, evidence).alias("known"), F.array_except(cited, evidence).alias("unknown"))


def row_text(columns: list[str]) -> Column:
    """``name=value`` of columns, null as empty, joined by `` | ``."""
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])


def merged_passes(*passes: DataFrame) -> DataFrame:
    """Results of several searches one after another, with branch (the pass's place)."""
    out = None
    for k, one in enumerate(passes):
        tagged = one.withColumn("branch", F.lit(k))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def condition_changes(before: Column, now: Column, dropped: Column) -> Column:
    """struct<kept, added, removed> of constraint lists: an ordered union without the dropped ones, compared without case."""
    gone = F.transform(dropped, lambda x: F.lower(x))
    stays = lambda x: ~F.coalesce(F.array_contains(gone, F.lower(x)), F.lit(False))
    every = F.array_union(before, now)
    return F.struct(F.filter(every, stays).alias("kept"), F.array_except(F.filter(now, stays), before).alias("added"), F.filter(before, lambda x: ~stays(x)).alias("removed"))


def recent_entities(mentions: DataFrame, key: str, entity: str, turn: str, window: int) -> DataFrame:
    """(key, entity, last): entities that were mentioned within window turns of the key's last turn."""
    last = mentions.groupBy(key, entity).agg(F.max(turn).alias("last"))
    end = mentions.groupBy(key).agg(F.max(turn).alias("__end"))
    return last.join(end, key).where(F.col("__end") - F.col("last") <= window).drop("__end")


def with_retries(f: Callable, attempts: int = 3) -> Callable:
    """f, tried again on an error; the last error is raised. For model calls inside Arrow batches."""

    def call(*args):
        for k in range(attempts):
            try:
                return f(*args)
            except Exception:
                if k == attempts - 1:
                    raise
        raise ValueError("no attempt")

    return call


def hash_embedding(text: Column, dims: int = 64) -> Column:
    """An embedding without a model: signed counts of hashed words, of length 1 (zeros where there is no word)."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    slot = F.transform(hashes, lambda h: F.pmod(h, F.lit(dims)))
    signed = F.zip_with(slot, hashes, lambda s, h: F.struct(s.alias("s"), F.when(F.pmod(F.shiftright(h, 32), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("v")))
    sums = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.aggregate(F.filter(signed, lambda x: x["s"] == i), F.lit(0.0), lambda a, x: a + x["v"]))
    length = F.sqrt(F.aggregate(sums, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(length > 0, F.transform(sums, lambda x: x / length)).otherwise(sums)
