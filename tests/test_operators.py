import os
import random
import re
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallgrass.functions import text as X
from tallgrass.operators import changes, facts, relational, structure, vectors
from tallgrass.plans import blocks, catalog, lookups, rules  # noqa: F401  (all register their queries with catalog)
from tallgrass.sources import html, markdown
from tallgrass.sources.html import parse_html
from tallgrass.streaming import state

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(rows):
    fixed = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(repr(tuple(map(fixed, r))) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.SQL[name]})").fetchall()
    assert normal(tuple(r) for r in df.select(*columns).collect()) == normal(want)


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_text_functions(spark):
    assert one(spark, X.numeric("t"), t=" 20,5 ") == 20.5
    assert one(spark, X.numeric("t"), t="x") is None
    assert one(spark, X.heading_number("t"), t="2.10.3 Title") == [2, 10, 3]
    assert one(spark, X.toc_entry("t"), t="Setup ......... 12").asDict() == {"title": "Setup", "page": 12}
    assert one(spark, X.toc_entry("t"), t="Relay Type 2").asDict() == {"title": "Relay Type", "page": 2} and one(spark, X.toc_entry("t"), t="12") is None and one(spark, X.toc_entry("t"), t="no page") is None
    assert one(spark, X.content_tokens("t"), t="Supply (3.5 V), 24-pin = →") == ["supply", "3.5", "v", "24-pin"]
    assert [one(spark, X.detect_language("t"), t=t) for t in ("What is the price?", "fiyat nedir", "Größe", "xyz", "kaç the the", "")] == ["en", "tr", "tr", "tr", "tr", "tr"]
    assert one(spark, X.product_codes("t", r"\b(pxi\d+)\b"), t="PXI12 and pxi12 or PN-33") == ["PXI12"]
    assert one(spark, X.product_codes("t"), t="see abc-123 and ABC-123, XY-99") == ["ABC-123", "XY-99"]
    assert one(spark, X.pipe_cells("t"), t=r"| a \| b | c |") == ["a | b", "c"]
    assert one(spark, X.base_name("t"), t="a\\b/c.txt") == "c.txt"
    assert one(spark, X.remove_block("t", F.lit("b")), t="a\n\nb\n\nc") == "a\n\nc"
    assert one(spark, X.version_behind("t", F.lit("1.10.0")), t="1.9.2+x") is True
    assert one(spark, X.degenerate("t"), t="abc def " * 60) is True


def test_markdown_round_trip(spark):
    source = "# A\n\ntext one\n\n## B\n\n- x\n\n```\ncode  here\n```\n\n| a | b |\n| 1 | 2 |"
    blocks = markdown.markdown_blocks(spark.createDataFrame([(1, source), (2, None)], "doc_id long, text string"))
    assert [r.kind for r in blocks.orderBy("pos").collect()] == ["heading", "paragraph", "heading", "list", "code", "table"]
    assert markdown.to_markdown(blocks).first().markdown == source


def test_html_blocks():
    page = "<h1 id=a>T</h1><script>x</script><ul><li>one<ul><li>two</li></ul></li></ul><table><tr><th>k</th><td>v</td></tr></table><pre>a\n b</pre>"
    assert [(b[0], b[4]) for b in parse_html(page)] == [("heading", "T"), ("list", "one"), ("list", "two"), ("table", "k | v"), ("code", "a\n b")]


def test_heading_paths_and_chunks(spark):
    rows = [(1, 0, "heading", 1, "A"), (1, 1, "paragraph", 0, "w " * 30), (1, 2, "heading", 2, "B"), (1, 3, "paragraph", 0, "Long one. " * 40), (1, 4, "heading", 1, "C"), (1, 5, "paragraph", 0, "end")]
    blocks = structure.heading_paths(spark.createDataFrame(rows, "doc_id long, pos int, kind string, level int, text string"))
    assert [r.heading_path for r in blocks.orderBy("pos").collect()] == [["A"], ["A"], ["A", "B"], ["A", "B"], ["C"], ["C"]]
    out = structure.chunks(blocks, target=40, hard_max=60, least=5).orderBy("chunk").collect()
    assert all(r.tokens <= 60 and not r.overflow for r in out) and out[0].text.startswith("**A**")


FACT = "status string, kind string, num_value double, text_value string, val_min double, val_typ double, val_max double, bool_value boolean, items array<struct<ordinal:int,item_code:string,item_text:string>>, source_chunk_id string, raw_text string"


def fact(kind, status="present", **kw):
    names = [c.strip().split(" ")[0] for c in re.split(r",(?![^<]*>)", FACT)]
    return tuple({"kind": kind, "status": status, **kw}.get(n) for n in names)


def test_fact_validity(spark):
    item = [(1, "a", "A")]
    cases = [
        (fact("single", num_value=1.0), None), (fact("single", num_value=1.0, text_value="x"), "single without exactly one value"), (fact("single"), "single without exactly one value"),
        (fact("range", val_min=5.0, val_max=2.0), "ends out of order"), (fact("range", val_max=2.0), None), (fact("range"), "range without ends"), (fact("min_typ_max", val_typ=3.0, val_max=2.0), "typical outside the ends"),
        (fact("min_typ_max"), "no end"), (fact("boolean"), "boolean without value"), (fact("boolean", bool_value=False), None), (fact("list"), "list without items"), (fact("list", items=item), None), (fact("conditional", num_value=2.0), None),
        (fact("single", "absent", num_value=1.0), "payload without presence"), (fact("single", "absent"), "absence without source"), (fact("single", "absent", source_chunk_id="d::c1"), None), (fact("single", "not_specified"), None), (fact("single", "conflicting"), "unknown status"), (fact("single", None), "unknown status"),
    ]
    got = [r.r for r in spark.createDataFrame([c for c, _ in cases], FACT).select(facts.invalid_reason(F.col("kind")).alias("r")).collect()]
    assert got == [w for _, w in cases]
    words = spark.createDataFrame([("12", "x")], "val_min string, val_max string").select(F.lit("present").alias("status"), F.lit("range").alias("kind"), F.lit(None).cast("double").alias("num_value"), F.lit(None).alias("text_value"), "val_min", F.lit(None).alias("val_typ"), "val_max", F.lit(None).alias("bool_value"), F.array().alias("items"), F.lit(None).alias("source_chunk_id"))
    assert words.select(facts.invalid_reason(F.col("kind")).alias("r")).first().r == "val_max is not a number"


def test_kind_coercion(spark):
    item = [(1, "a", "A")]
    cases = [
        ("conditional", fact("single", num_value=8.0), {"kind": "conditional", "num_value": 8.0}), ("single", fact("conditional", num_value=8.0), {"kind": "single"}), ("single", fact("range", val_min=2.0, val_max=2.0), {"num_value": 2.0, "val_min": None, "val_max": None}),
        ("single", fact("min_typ_max", val_min=1.0, val_typ=2.0), {"num_value": 2.0, "val_typ": None}), ("single", fact("range", val_min=1.0, val_max=2.0), {"reason": "kind mismatch", "kind": "range", "val_min": 1.0}), ("single", fact("list", items=item), {"text_value": "a", "items": None}),
        ("single", fact("list", items=item * 2), {"reason": "kind mismatch"}), ("min_typ_max", fact("single", num_value=3.0), {"val_typ": 3.0, "num_value": None}), ("min_typ_max", fact("range", val_max=3.0), {"kind": "min_typ_max", "val_max": 3.0}), ("min_typ_max", fact("min_typ_max", num_value=3.0), {"val_typ": 3.0, "num_value": None}),
        ("range", fact("min_typ_max", val_min=1.0, val_typ=2.0), {"val_min": 1.0, "val_typ": None}), ("range", fact("min_typ_max", val_typ=2.0), {"val_min": 2.0, "val_max": 2.0, "val_typ": None}), ("range", fact("single", num_value=4.0), {"val_min": 4.0, "val_max": 4.0, "num_value": None}), ("range", fact("range", num_value=4.0), {"val_min": 4.0}),
        ("list", fact("single", text_value="Two Way"), {"items": [(1, "two_way", "Two Way")], "text_value": None}), ("list", fact("range", val_min=1.0, raw_text="from 1"), {"items": [(1, "from_1", "from 1")], "val_min": None}), ("list", fact("boolean", bool_value=True), {"reason": "kind mismatch"}),
        ("boolean", fact("single", num_value=1.0), {"reason": "kind mismatch"}), ("boolean", fact("single", "absent"), {"kind": "boolean", "reason": None}),
    ]
    rows = [(*row, to, i) for i, (to, row, _) in enumerate(cases)]
    got = facts.coerce_kind(spark.createDataFrame(rows, f"{FACT}, wanted string, i int")).orderBy("i").collect()
    for r, (_, _, want) in zip(got, cases, strict=True):
        for name, value in {"reason": None, **want}.items():
            mine = [tuple(x) for x in r[name]] if isinstance(r[name], list) else r[name]
            assert mine == value, (r, name)


def test_interval_merge_by_brute_force(spark):
    rng = random.Random(7)
    pick = lambda: rng.choice([None, None, 1.0, 2.0, 3.0])
    rows = [(f"k{i % 40}", i, rng.choice(["present", "present", "absent"]), pick(), pick(), pick()) for i in range(240)]
    rows = [(*r[:3], None, None, None) if r[2] == "absent" else r for r in rows]
    want = {}
    for key, _, status, *ends in rows:
        values = want.setdefault(key, {})
        values[status, *ends] = values.get((status, *ends), 0) + 1
    folded = []
    for key, values in want.items():
        groups = []
        for (status, *ends), n in values.items():
            for g in groups:
                both = [a if a is not None else b for a, b in zip(g[1], ends, strict=True)]
                clash = any(a is not None and b is not None and a != b for a, b in zip(g[1], ends, strict=True))
                fills = any((a is None) != (b is None) for a, b in zip(g[1], ends, strict=True))
                low, typical, high = both
                ordered = not ((low is not None and high is not None and low > high) or (typical is not None and ((low is not None and typical < low) or (high is not None and typical > high))))
                if g[0] == status and not clash and fills and ordered:
                    g[1], g[2] = both, g[2] + n
                    break
            else:
                groups.append([status, ends, n])
        folded += [(key, g[0], *g[1], g[2]) for g in groups]
    df = spark.createDataFrame(rows, "key string, ord int, status string, val_min double, val_typ double, val_max double")
    got = [tuple(r) for r in facts.interval_merge(df.repartition(3), ["key"]).collect()]
    assert sorted(got, key=str) == sorted(folded, key=str) and facts.interval_merge(df.limit(0), ["key"]).isEmpty()


def test_scan_diff_moves_and_deletes(spark):
    before = spark.createDataFrame([("1", "a", "h1", "NEW"), ("2", "b", "h2", "NEW"), ("3", "c", "h3", "NEW"), ("4", "d", "h4", "DELETED")], "doc_id string, rel_path string, content_hash string, scan_status string")
    now = spark.createDataFrame([("a", "h1"), ("b", "x"), ("e", "h3"), ("f", "h9")], "rel_path string, content_hash string")
    got = {r.rel_path: (r.scan_status, r.doc_id) for r in changes.scan_diff(now, before).collect()}
    assert got["a"] == ("UNCHANGED", "1") and got["b"] == ("MODIFIED", "2") and got["e"] == ("MOVED", "3") and got["f"][0] == "NEW" and got["d"] == ("DELETED", "4")


def test_ancestor_and_metrics(spark):
    rows = spark.createDataFrame([("f", "s"), ("f", "t")], "a string, b string")
    nodes = spark.createDataFrame([("f", None, "F"), ("f", "s", "FS")], "a string, b string, v string")
    assert sorted(r.v for r in relational.best_ancestor(rows, nodes, ["a", "b"], "v").collect()) == ["F", "FS"]
    got = spark.range(1).select(vectors.recall_at(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")), 1).alias("r"), vectors.reciprocal_rank(F.array(F.lit("a")), F.array(F.lit("c"), F.lit("a"))).alias("m")).first()
    assert (got.r, got.m) == (0.5, 0.5)


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = state.latest_state(state.read_files(spark, str(tmp_path / "in"), events.schema), "user_id", "event_id", "event_type")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("latest").collect())) == sorted(map(tuple, state.latest_state(events, "user_id", "event_id", "event_type").collect()))


def test_top_k_on_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [1.0, None]), (7, [1.0, float("nan")]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (9, [2.0, 0.0]), (10, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = lambda metric, k: [tuple(r) for r in vectors.top_k(df, df.where("vec_id in (2, 4, 7)"), k=k, metric=metric).orderBy("query_id", "rank").collect()]
    assert got("cosine", 3) == [(2, 1, 1, 1.0), (2, 2, 9, 1.0), (2, 3, 3, 0.0)]
    assert got("dot", 9) == [(2, 1, 9, 2.0), (2, 2, 1, 1.0), (2, 3, 3, 0.0), (2, 4, 10, -1.0)]
    assert got("euclid", 2) == [(2, 1, 1, 0.0), (2, 2, 3, 1.0)]
    assert vectors.top_k(df.limit(0), df, k=2).isEmpty() and vectors.top_k(df, df.limit(0), k=2).isEmpty()
    with pytest.raises(ValueError):
        vectors.top_k(df, df, k=2, max_queries=3)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    points = rng.integers(-2, 3, size=(6_000, 4)).astype(float)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>").repartition(2)
    for metric in ("dot", "euclid"):
        want = []
        for q in range(0, 6_000, 500):
            near = points @ points[q] if metric == "dot" else -np.sqrt(((points - points[q]) ** 2).sum(1))
            order = [i for i in np.lexsort((np.arange(6_000), -np.round(near, 6))).tolist() if i != q][:5]
            want += [(q, r + 1, i, round(abs(near[i]) if metric == "euclid" else near[i], 6)) for r, i in enumerate(order)]
        found = vectors.top_k(df, df.where("vec_id % 500 = 0"), k=5, metric=metric).orderBy("query_id", "rank").collect()
        assert [tuple(r) for r in found] == want


def test_range_join_over_all_scales(spark):
    rng, inf = random.Random(5), float("inf")
    points = [(i, rng.choice([None, rng.uniform(-50, 50), rng.uniform(-1e6, 1e6), float(rng.randrange(9))])) for i in range(400)] + [(900, float("nan")), (901, inf)]
    spans = [(i, a, a + rng.choice([0.0, 0.5, 8.0, 1e5, 1e12, -1.0])) for i, a in enumerate(rng.choice([rng.uniform(-50, 50), float(rng.randrange(9)), -1e6]) for _ in range(200))] + [(900, None, 1.0), (901, -inf, inf), (902, 3.0, float("nan")), (903, 2.0, None)]
    p, s = spark.createDataFrame(points, "i long, x double"), spark.createDataFrame(spans, "j long, lo double, hi double")
    good = lambda *v: all(x is not None and x == x for x in v)
    want = sorted((i, j) for i, x in points for j, lo, hi in spans if good(x, lo, hi) and lo <= x <= hi)
    assert sorted((r.i, r.j) for r in relational.range_join(p, s, "x", "lo", "hi", 0.25).collect()) == want
    assert relational.range_join(p, s.limit(0), "x", "lo", "hi", 0.25).isEmpty() and relational.range_join(p.limit(0), s, "x", "lo", "hi", 0.25).isEmpty()


def test_descendants_of_odd_graphs(spark):
    below = lambda rows: sorted(tuple(r) for r in relational.descendants(spark.createDataFrame(rows, "p string, c string"), "p", "c").collect())
    assert below([("a", "b"), ("b", "c"), ("b", "c"), ("a", "c"), ("c", "d"), (None, "x"), ("d", None)]) == [("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("b", "c", 1), ("b", "d", 2), ("c", "d", 1)]
    assert below([("a", "b"), ("b", "a")]) == [("a", "a", 2), ("a", "b", 1), ("b", "a", 1), ("b", "b", 2)] and below([]) == []


def test_trust_order_of_equal_sources(spark, tmp_path):
    for at, suppliers in enumerate(((3, 5, 9), (9, 5, 3))):
        lines = [(order, 1, supplier) for order in range(20) for supplier in suppliers]
        spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long").coalesce(1).write.parquet(f"{tmp_path}/{at}/lineitem.parquet")
        spark.createDataFrame([(s, 7.0) for s in suppliers], "s_suppkey long, s_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/{at}/supplier.parquet")
        assert sorted(map(tuple, catalog.QUERIES["m17_trust_order"](spark, f"{tmp_path}/{at}").collect())) == [(order, 1, 3) for order in range(20)]


def test_large_batches_are_parsed_in_pieces():
    pages = [(i, f"<h1>T{i}</h1><p>{'some words ' * 300}</p><p>{i}</p>" if i % 7 else None) for i in range(2_000)]
    batch = pa.RecordBatch.from_arrays([pa.array([p[0] for p in pages]), pa.array([p[1] for p in pages])], names=["page_id", "html"])
    parsed = list(html._parse_rows([batch]))
    assert max(b.nbytes for b in parsed) < 2 << 20
    assert [tuple(r.values()) for b in parsed for r in b.to_pylist()] == [(i, pos, *block) for i, text in pages for pos, block in enumerate(parse_html(text))]


def test_large_batches_are_packed_in_pieces():
    blocks = [[{"pos": 0, "kind": "paragraph", "crumb": "A", "text": "word " * 600}, {"pos": 1, "kind": "list", "crumb": "A", "text": None}]] * 2_000
    whole = pa.RecordBatch.from_arrays([pa.array(range(2_000)), pa.array(blocks)], names=["doc_id", "blocks"])
    packed = list(structure._pack_rows([whole]))
    assert max(b.nbytes for b in packed) < 3 << 20
    want = structure.pack_document([(b["kind"], b["crumb"], b["text"] or "") for b in blocks[0]])
    assert [tuple(r.values()) for b in packed for r in b.to_pylist()] == [(i, k, f"{i}::c{k}", *row) for i in range(2_000) for k, row in enumerate(want)]


def test_top_k_of_more_queries_than_a_block(spark):
    points = np.random.default_rng(4).integers(-40, 41, size=(10_100, 2)).astype(float)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>").repartition(2)
    found = [tuple(r) for r in vectors.top_k(df.where("vec_id < 300"), df, k=2, metric="dot").orderBy("query_id", "rank").collect()]
    want = []
    for q in range(10_100):
        near = points[:300] @ points[q]
        want += [(q, r + 1, i, near[i]) for r, i in enumerate([i for i in np.lexsort((np.arange(300), -near)).tolist() if i != q][:2])]
    assert found == want
    few = df.where("vec_id < 100")
    blocks = vectors.top_k(few, few, k=3, metric="euclid", block_queries=7)
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, vectors.top_k(few, few, k=3, metric="euclid").collect()))


def test_equal_vectors_are_compared_within_bounds():
    class Shared:
        value = np.arange(1_024), np.ones((1_024, 16))

    rows = pa.RecordBatch.from_arrays([pa.array(range(8_192)), pa.array([[1.0] * 16] * 8_192)], names=["id", "v"])
    tracemalloc.start()
    found = [tuple(r.values()) for b in vectors._searcher(Shared, 3, "euclid", 6, "vec_id")([rows]) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    assert found == [(q, i, 0.0) for q in range(1_024) for i in [i for i in range(4) if i != q][:3]]
