"""Rules on literal cases: nulls, ties, empty tables."""

import uuid

import pytest
from pyspark.sql import functions as F

from tallgrass.operators import rules


def test_point_ids(spark):
    names = ["doc::c0", "", "é", None, "x" * 1000]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(rules.point_id(F.col("n"))).collect()]
    assert got == [None if n is None else str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]


def test_owner_of_path(spark):
    owners = spark.createDataFrame([("ab-12", "n1"), ("ab", "n2"), ("radios", "n3"), ("old", "n4")], "name string, node string")
    paths = spark.createDataFrame([("radios/old/AB-12_sheet.pdf",), ("radios/AB-99 x.pdf",), ("radios\\old\\notes.pdf",), ("radios/x.y/notes.pdf",), ("notes.pdf",), (None,)], "rel_path string")
    got = {r.rel_path: r.owner for r in rules.owner_of_path(paths, owners).collect()}
    assert got == {"radios/old/AB-12_sheet.pdf": "n1", "radios/AB-99 x.pdf": "n2", "radios\\old\\notes.pdf": "n4", "radios/x.y/notes.pdf": "n3", "notes.pdf": None, None: None}


def test_planner_and_issues(spark):
    stages = ["scan", "parse", "chunk"]
    assert rules.planned(stages) == stages and rules.planned(stages, from_stage="parse") == ["parse", "chunk"] and rules.planned(stages, "chunk") == ["chunk"]
    with pytest.raises(ValueError):
        rules.planned(stages, "pars")
    none = spark.createDataFrame([], "k string, reason string")
    assert rules.issues_from(none, "parse", "error", "k").isEmpty()
    with pytest.raises(ValueError):
        rules.issues_from(none, "parse", "fatal", "k")


def test_list_union(spark):
    rows = [("k", 2, [("b", "two"), (None, "free")], "later"), ("k", 1, [("b", "first"), ("a", None)], " raw "), ("k", 3, None, "raw"), ("l", 1, [(None, None)], None)]
    df = spark.createDataFrame(rows, "key string, ord int, items array<struct<item_code:string,item_text:string>>, raw_text string")
    got = {r["key"]: ([tuple(i) for i in r["items"]], r["raw_text"]) for r in rules.list_union(df, ["key"]).collect()}
    assert got == {"k": ([(1, "b", "first"), (2, "a", None), (3, "free", "free")], "raw\nlater")}
    assert rules.list_union(df.limit(0), ["key"]).isEmpty()


def test_predicates_with_nulls(spark):
    df = spark.createDataFrame([("a", None, None, None), (None, 8.0, 0, 0), ("PRICE list.PDF", 1.0, 1, 0), ("b.docx", 1.0, 1, 1), ("c", 1.0, 0, 0)], "name string, hours double, failed int, finished int")
    got = [tuple(r) for r in df.select(rules.classified("name", [("LIST", "prices")], {".docx": "text"}), rules.outcome("hours", "failed", "finished"), rules.fallback_state("name"), rules.info_status(F.array("name"), ["c"])).collect()]
    assert [g[0] for g in got] == [None, None, "prices", "text", None]
    assert [g[1] for g in got] == ["failed", "partial", "failed", "partial", "full"]
    assert [g[2] for g in got] == ["queued"] * 5 and got[4][3] == "extracted"
