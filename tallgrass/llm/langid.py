"""Operator 7: language identification by multinomial naive Bayes over hashed character n-grams.

Features are the 1-, 2- and 3-grams of lower-cased characters, hashed into
2**bits buckets. Training counts them by language in one pass over labelled
rows (a bounded, hash-chosen sample of at most about ``rows_per_language`` rows
of each language; everything where there are fewer), the log-probability matrix
(buckets by languages) is broadcast, and texts are scored in batches: a text's
sparse feature list gathers rows of the matrix, sums of its segments are the
languages' log-likelihoods.

Defined cases: null text or text without a letter gives ``und`` with score 0;
rows without language teach nothing, nor do those of languages beyond the
``max_languages`` with most rows (ties: the smaller value); with no learned language every text is
``und``; ties go to the smaller language value; repeated rows are scored alike;
very long texts are scored whole, in bounded pieces; extra columns pass through
(columns named as the added ones are replaced).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallgrass.llm import textkernel as K
from tallgrass.llm.common import shielded
from tallgrass.session import table

ORDERS = (1, 2, 3)
BITS = 15
#: Characters handled at once.
CHUNK = 1 << 18
#: Values of the matrix that are gathered at once.
CELLS = 1 << 22
ROWS_PER_LANGUAGE = 20_000
MAX_LANGUAGES = 1_000
UNKNOWN = "und"


def _features(codes: np.ndarray, bits: int) -> list[np.ndarray]:
    """For each order, the bucket of the n-gram at each start."""
    wide = codes.astype(np.uint64)
    out = []
    for n in ORDERS:
        count = len(wide) - n + 1
        if count <= 0:
            out.append(np.zeros(0, dtype=np.int64))
            continue
        h = wide[:count] + np.uint64(n << 40)
        for k in range(1, n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + wide[k : k + count]
        out.append((K.mix(h) >> np.uint64(64 - bits)).astype(np.int64))
    return out


def _pieces(texts: list[str | None]):
    """(rows, codes, bounds): whole texts gathered to CHUNK characters, longer texts in pieces that share n - 1 characters with the next."""
    rows, parts, size = [], [], 0
    overlap = max(ORDERS) - 1
    for row, text in enumerate(texts):
        low = (text or "").lower()
        step = 0
        while step < len(low):
            part = low[step : step + CHUNK + overlap]
            step += CHUNK
            rows.append(row)
            parts.append(part)
            size += len(part)
            if size >= CHUNK:
                yield _coded(rows, parts)
                rows, parts, size = [], [], 0
    if rows:
        yield _coded(rows, parts)


def _coded(rows, parts):
    lengths = np.array([len(p) for p in parts], dtype=np.int64)
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.array(rows, dtype=np.int64), codes, np.concatenate(([0], np.cumsum(lengths)))


def _segments(rows, codes, bounds, bits):
    """For each order: (buckets of n-grams that stay inside their text's piece, segment of each). Pieces of one long text overlap; an n-gram is taken where it starts."""
    owner = np.repeat(np.arange(len(rows)), np.diff(bounds))
    offset = np.arange(len(codes)) - np.repeat(bounds[:-1], np.diff(bounds))
    for n, buckets in zip(ORDERS, _features(codes, bits), strict=True):
        count = len(buckets)
        keep = (owner[:count] == owner[n - 1 :]) & (offset[:count] < CHUNK) if count else np.zeros(0, dtype=bool)
        yield buckets[keep], owner[:count][keep]


def _slices(batches, text_column: str):
    """The batches in slices of bounded text, so that few Python strings live at once."""
    for batch in batches:
        _, offsets = K.string_buffer(batch.column(text_column))
        for a, b in K.row_groups(offsets, K.PIECE):
            yield batch.slice(a, b - a)


def _trainer(languages: list[str], bits: int):
    index = {x: i for i, x in enumerate(languages)}

    def count(batches):
        totals = np.zeros((len(languages), 1 << bits), dtype=np.int64)
        for batch in _slices(batches, "text"):
            langs = np.array([index[x] for x in batch.column("lang").to_pylist()], dtype=np.int64)
            for rows, codes, bounds in _pieces(batch.column("text").to_pylist()):
                for buckets, owner in _segments(rows, codes, bounds, bits):
                    flat = langs[rows][owner] * (1 << bits) + buckets
                    totals += np.bincount(flat, minlength=totals.size).reshape(totals.shape)
        lang, bucket = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(lang, type=pa.int32()), pa.array(bucket, type=pa.int32()), pa.array(totals[lang, bucket], type=pa.int64())], names=["lang", "bucket", "n"])

    return count


class LanguageModel:
    """Languages in order and the log-probability matrix (buckets x languages), with log priors."""

    def __init__(self, languages: list[str], matrix: np.ndarray, priors: np.ndarray, bits: int):
        self.languages, self.matrix, self.priors, self.bits = languages, matrix, priors, bits

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        width = len(self.languages)
        total = np.tile(self.priors, (len(texts), 1)) if width else np.zeros((len(texts), 0))
        for rows, codes, bounds in _pieces(texts) if width else ():
            sums = np.zeros((len(rows), width))
            for buckets, owner in _segments(rows, codes, bounds, self.bits):
                step = max(1, CELLS // width)
                for at in range(0, len(owner), step):
                    own = owner[at : at + step]
                    heads = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                    sums[own[heads]] += np.add.reduceat(self.matrix[buckets[at : at + step]], heads, axis=0, dtype=np.float64)
            np.add.at(total, rows, sums)
        names, scores = [], []
        best = total.argmax(axis=1) if width else np.zeros(len(texts), dtype=int)
        for i, text in enumerate(texts):
            if not width or not text or not has_letter(text):
                names.append(UNKNOWN)
                scores.append(0.0)
            else:
                names.append(self.languages[best[i]])
                scores.append(float(1.0 / np.exp(total[i] - total[i, best[i]]).sum()))
        return names, scores


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def train(labelled: DataFrame, *, text_column: str = "text", lang_column: str = "lang", key: Column | str = "doc_id", bits: int = BITS, rows_per_language: int = ROWS_PER_LANGUAGE, max_languages: int = MAX_LANGUAGES, smoothing: float = 0.5) -> LanguageModel:
    """Fit on labelled rows. The sample is chosen by a hash of key; the counts that reach the driver are at most languages x buckets."""
    spark = labelled.sparkSession
    rows = labelled.select(F.col(text_column).alias("text"), F.col(lang_column).alias("lang"), (F.col(key) if isinstance(key, str) else key).alias("key")).where("lang is not null and text is not null")
    commonest = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages)
    counts = {r["lang"]: r["n"] for r in commonest.collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros((1 << bits, 0), dtype=np.float32), np.zeros(0), bits)
    share = F.pmod(F.xxhash64("key", "lang"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    wanted = F.lit(1.0)
    for name in languages:
        if counts[name] > rows_per_language:
            wanted = F.when(F.col("lang") == name, rows_per_language / counts[name]).otherwise(wanted)
    parts = rows.where(F.col("lang").isin(languages)).where(share < wanted).select("text", "lang").mapInArrow(K.returning(_trainer(languages, bits)), "lang int, bucket int, n long")
    found = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    totals = np.zeros((1 << bits, len(languages)))
    totals[found["bucket"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy()
    matrix = np.log((totals + smoothing) / (totals.sum(axis=0) + smoothing * len(totals)))
    priors = np.array([counts[x] for x in languages], dtype=float)
    return LanguageModel(languages, matrix.astype(np.float32), np.log(priors / priors.sum()), bits)


def predict(docs: DataFrame, model: LanguageModel, *, text_column: str = "text") -> DataFrame:
    """docs with lang_pred string and score double (posterior probability of lang_pred)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = {"lang_pred", "score"}
    base = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c.lower() not in added])
    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def score(batches):
        for batch in _slices(batches, text_column):
            names, scores = shared.value.score(batch.column(text_column).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, K.arrow_strings(names), pa.array(scores, type=pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return base.mapInArrow(K.returning(score), schema)


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo; null counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(modulus))


def keep_identified(docs: DataFrame, model: LanguageModel | None = None, *, min_score: float = 0.35) -> DataFrame:
    """docs whose language is identified; the columns of docs only. Texts without a letter, and those whose best language is less than min_score likely, go. With no learned language only the former go."""
    model = model or train(docs)
    if not model.languages:
        letter = F.regexp_like(F.col("text"), F.lit(r"\p{L}"))
        return docs.where(letter)
    return shielded(docs, {"lang_pred", "score"}, lambda d: predict(d, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)))


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(remainder("doc_id", 4) != 2))
    return predict(docs.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "text"), model).drop("text")
