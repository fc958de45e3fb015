"""Operator 9: secret scan by one combined deterministic automaton.

All rules are compiled into one minimised automaton that reads a text's bytes
once, from the end, and marks every byte where a match of a rule begins. From
the marks, in order, each rule's own automaton takes the longest match, and
marks inside it are passed over: leftmost, longest, not overlapping within a
rule, as a regex engine's search gives for these rules.

Defined cases: null or empty text has no spans; repeated rows are scanned each;
matches are by bytes, spans are in code points; extra columns pass through
(columns named as the added ones are replaced).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallgrass.llm import textkernel as K
from tallgrass.llm.automaton import Dfa, scan_backward
from tallgrass.llm.common import shielded
from tallgrass.session import table


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if the given group of the pattern has at_least bytes; a shorter match still hides what it covers."""

    kind: str
    pattern: str
    group: int = 0
    at_least: int = 0


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # runs of [0-9a-f]+ of 24 characters and more: shorter runs have no mark
    Rule("hex", r"[0-9a-f]{24}[0-9a-f]*"),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[opsur]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("cloud", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)
RULES = BASE + MORE
_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


class Scanner:
    """Compiled rules."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.marks = Dfa([r.pattern for r in rules], search=True, backward=True)
        self.own = [Dfa([r.pattern], search=False, backward=False) for r in rules]
        self.groups = [re.compile(r.pattern.encode(), re.DOTALL) if r.group else None for r in rules]

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[str, int, int]]]:
        """Spans (kind, start, end) in code points by row, sorted by start, then rule order."""
        rows, places, masks = scan_backward(self.marks, data, offsets)
        out: dict[int, list[tuple[str, int, int]]] = {}
        if not len(rows):
            return out
        order = np.lexsort((places, rows))
        rows, places, masks = rows[order], places[order], masks[order]
        heads = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        for a, b in zip(heads.tolist(), np.append(heads[1:], len(rows)).tolist(), strict=True):
            row = int(rows[a])
            part = data[offsets[row] : offsets[row + 1]]
            raw = part.tobytes()
            spans = []
            cursor = [0] * len(self.rules)
            for place, mask in zip(places[a:b].tolist(), masks[a:b].tolist(), strict=True):
                for k, rule in enumerate(self.rules):
                    if mask >> k & 1 and place >= cursor[k]:
                        end = self.own[k].longest(raw, place)
                        cursor[k] = end
                        found = raw[place:end]
                        held = self.groups[k].fullmatch(found).group(rule.group) if rule.group else found
                        if len(held) >= rule.at_least:
                            spans.append((place, k, end))
            if spans:
                spans.sort()
                points = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
                out[row] = [(self.rules[k].kind, int(points[s]), int(points[e])) for s, k, e in spans]
        return out


@cache
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


def _scan_rows(rules: tuple[Rule, ...], text_column: str):
    def scan(batches):
        for batch in batches:
            data, offsets = K.string_buffer(batch.column(text_column))
            spans: list[list] = []
            for a, b in K.row_groups(offsets, 8 * K.PIECE):
                found = scanner(rules).scan(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                spans += [[{"kind": k, "start": s, "end": e} for k, s, e in found.get(i, ())] for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, type=_ARROW_SPANS)], names=[*batch.schema.names, "secrets"])

    return scan


def find_secrets(docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, text_column: str = "text") -> DataFrame:
    """docs with secrets array<struct<kind,start,end>>, by start, then rule order."""
    base = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c.lower() != "secrets"])
    return base.mapInArrow(K.returning(_scan_rows(rules, text_column)), T.StructType([*base.schema.fields, T.StructField("secrets", _SPANS)]))


def redact(text: str | None, spans, mark: str) -> str | None:
    """text with the union of spans replaced by mark, a run of overlapping spans by one."""
    if not text or spans is None or not len(spans):
        return text
    out, upto = [], 0
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        if a >= upto:
            out += [text[upto:a], mark]
        upto = max(upto, b)
    return "".join([*out, text[upto:]])


def _redact_rows(rules: tuple[Rule, ...], text_column: str, mark: str):
    """Scan and redact in one pass, so that a task has one Python worker."""

    def work(batches):
        for batch in _scan_rows(rules, text_column)(batches):
            spans = batch.column("secrets")
            touched = np.flatnonzero(np.diff(np.asarray(spans.offsets)) > 0).tolist()
            texts = batch.column(text_column)
            if touched:
                new = pa.array([redact(texts[i].as_py(), spans[i].as_py(), mark) for i in touched], type=texts.type)
                mask = np.zeros(len(batch), dtype=bool)
                mask[touched] = True
                texts = pc.replace_with_mask(texts, pa.array(mask), new)
            names = [x for x in batch.schema.names if x != "secrets"]
            yield pa.RecordBatch.from_arrays([texts if x == text_column else batch.column(x) for x in names], names=names)

    return work


def redact_secrets(docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, text_column: str = "text", mark: str = "[REDACTED]", length_column: str = "n_chars") -> DataFrame:
    """docs with every secret replaced by mark; the columns of docs only. A column length_column, if there is one, follows the new text."""

    def work(moved: DataFrame) -> DataFrame:
        done = moved.mapInArrow(K.returning(_redact_rows(rules, text_column, mark)), moved.schema)
        if length_column in moved.columns:
            kind = moved.schema[length_column].dataType
            done = done.withColumn(length_column, F.when(F.col(text_column).isNull(), F.col(length_column)).otherwise(F.length(text_column).cast(kind)))
        return done

    return shielded(docs, {"secrets"}, work)


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_secrets(docs)
    base = F.filter("secrets", lambda s: s["kind"].isin([r.kind for r in BASE]))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("secrets")).alias("spans"))
