"""Block, table and question rules on literal cases: nulls, ties, empty tables."""

from pyspark.sql import functions as F

from tallgrass.operators import blocks


def one(spark, schema, value, f):
    return spark.createDataFrame([(value,)], f"v {schema}").select(f(F.col("v"))).first()[0]


def test_lists(spark):
    rows = [("d", 1, None, None), ("d", 2, "a", None), ("d", 3, "a", True), ("d", 4, None, True), ("d", 5, "a", False), ("d", 6, "b", True), ("e", 1, "a", True)]
    df = spark.createDataFrame(rows, "doc string, ord int, list_id string, opens boolean")
    got = [(r.container, r["item"]) for r in blocks.list_groups(df, "doc", "ord").orderBy("doc", "ord").collect()]
    assert got == [(None, None), ("a", 1), ("a", 2), (None, None), ("a#2", 1), ("b", 1), ("a", 1)]
    assert blocks.list_groups(df.limit(0), "doc", "ord").isEmpty()
    items = "array<struct<level:int,ordered:boolean>>"
    numbers = lambda v: one(spark, items, v, blocks.list_markers)
    assert numbers([(0, True), (1, True), (1, True), (0, True), (1, True), (1, False), (1, True)]) == [1, 1, 2, 2, 1, 0, 1]
    assert numbers([]) == [] and numbers(None) is None


def test_paths(spark):
    prefix = lambda v: one(spark, "array<array<string>>", v, blocks.common_prefix)
    assert prefix([["a", "b", "c"], ["a", "b"], ["a", "b", "d"]]) == ["a", "b"]
    assert prefix([["a"]]) == ["a"] and prefix([]) == [] and prefix([["a"], ["b"]]) == [] and prefix([[], ["b"]]) == []
    rows = [("d", 1, [2], False), ("d", 2, [3], True), ("d", 3, [3, 1], False), ("d", 4, [3, 1], False), ("d", 5, [9], False), ("d", 6, [3, 2], False), ("d", 7, None, False), ("d", 8, [4], True), ("d", 9, [3], False), ("d", 10, [5], None), ("e", 1, [1], False)]
    df = spark.createDataFrame(rows, "doc string, ord int, path array<int>, heading boolean")
    assert [r.ord for r in blocks.gap_fills(df, "doc", "ord").orderBy("ord").collect()] == [1, 3, 6, 10]


def test_case(spark):
    caps = {v: one(spark, "string", v, blocks.all_caps) for v in ("ABC", "Ab", "A 1", "A\nB", "ÇÖ 12", "", None)}
    assert caps == {"ABC": True, "Ab": False, "A 1": False, "A\nB": True, "ÇÖ 12": True, "": False, None: False}
    titled = {v: one(spark, "string", v, blocks.title_case) for v in ("Wind Tunnel of it", "Wind tunnel", "WIND TUNNEL", "Wind", "Şema Listesi", None)}
    assert titled == {"Wind Tunnel of it": True, "Wind tunnel": False, "WIND TUNNEL": False, "Wind": False, "Şema Listesi": True, None: False}


def test_tables(spark):
    worth = lambda v: one(spark, "array<array<string>>", v, blocks.worth_emitting)
    assert [worth(v) for v in ([], [[]], [["-", None]], [["a"], ["b c"]], [["a b"], ["c d"], ["e f"]], [["a"], ["b"], ["c"]], [["x", ""], ["", ""]], [["x"] + [""] * 6])] == [False, False, False, True, False, True, True, False]
    df = spark.createDataFrame([(["5 V supply and 24 pins", "none", "Supply", None], [["x", "Supply"], [" 24 pins ", None], ["supply", "5 V"]]), (["a"], [])], "facts array<string>, rows array<array<string>>")
    got = [r[0] for r in df.select(blocks.fact_rows(F.col("facts"), F.col("rows"))).collect()]
    assert got == [[2, None, 0, None], [None]]
    nodes = spark.createDataFrame([("d", 1, "n1", False), ("d", 2, "n2", True), ("d", 3, "n3", True), ("d", 4, "n4", None)], "doc string, ord int, node string, gone boolean")
    assert [(r.node, r.prev, r.next) for r in blocks.without_nodes(nodes, F.col("gone"), "doc", "ord", "node").orderBy("ord").collect()] == [("n1", None, "n4"), ("n4", "n1", None)]


def test_surface_forms(spark):
    forms = {"sheet": ["data sheet", "sheet"], "manual": ["manual"]}
    got = {v: tuple(one(spark, "string", v, lambda c: blocks.surface_form(c, forms)) or ()) for v in ("The Manual or Data Sheet  of X", "SHEET", "x", "", None)}
    assert got == {"The Manual or Data Sheet  of X": ("sheet", "The Manual or of X"), "SHEET": ("sheet", None), "x": (None, "x"), "": (None, None), None: (None, None)}


def test_facts_and_records(spark):
    dictionary = spark.createDataFrame([("b", "k", "single", ["c"]), ("b", "m", "conditional", ["c"]), ("e", "m", "single", None)], "block string, key string, kind string, conditions array<string>")
    facts = spark.createDataFrame([(1, "z", "k", True, None), (2, "z", "k", None, "c"), (3, "z", "m", True, "c"), (4, "b", "m", True, None), (5, "b", "k", False, "q"), (6, "e", "m", False, "c"), (7, None, None, True, None), (8, "b", "m", False, "c")], "n int, block string, key string, is_new_key boolean, condition string")
    got = {r.n: (r.block, r.outcome, r.reason) for r in blocks.classify_facts(facts, dictionary).collect()}
    assert got == {1: ("b", "ok", None), 2: ("z", "dropped", "unknown key"), 3: ("z", "new_key", None), 4: ("b", "dropped", "conditional without condition"), 5: ("b", "dropped", "condition outside the closed list"), 6: ("e", "dropped", "condition outside the closed list"), 7: (None, "new_key", None), 8: ("b", "ok", None)}
    registry = spark.createDataFrame([("p", "i1"), ("q", "i2")], "path string, id string")
    seen = spark.createDataFrame([("q", "x"), ("r", "y")], "path string, id string")
    assert sorted(tuple(r) for r in blocks.upserted(registry, seen, "path", "id").select("path", "id", "verdict").collect()) == [("p", "i1", None), ("q", "i2", "MODIFIED"), ("r", "y", "NEW")]


def test_gap_fills_sort_once(spark):
    rows = [("d", 1, 1, [2], False), ("d", 1, 2, [3], True), ("d", 2, 1, [3, 1], False), ("d", 2, 2, [3, 1], False), ("d", 2, 3, [4], True), ("d", 3, 1, [3], False), ("d", 3, 2, [4, 2], False), ("d", 3, 3, [4, 1], None), ("e", 1, 1, [1], False), ("f", 1, 1, [9], True), ("f", 1, 2, None, False)]
    df = spark.createDataFrame(rows, "doc string, page int, ord int, path array<int>, heading boolean").repartition(3)
    found = blocks.gap_fills(df, "doc", ["page", "ord"])
    assert sorted((r.doc, r.page, r.ord) for r in found.collect()) == [("d", 1, 1), ("d", 2, 1), ("d", 3, 2)]
    assert found.columns == df.columns
    plan = blocks.gap_fills(df, "doc", "ord")._jdf.queryExecution().executedPlan().toString()
    assert plan.count(" Sort [") == 1
