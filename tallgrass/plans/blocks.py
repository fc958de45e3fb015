"""Registered queries of operators/blocks.py, each with the SQL that computes the same rule."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallgrass.operators import blocks
from tallgrass.plans.catalog import query
from tallgrass.session import table as T


@query("""WITH b AS (SELECT user_id, event_id, nullif(event_type, 'purchase') AS l, event_id % 3 = 0 AS opens FROM events),
f AS (SELECT *, CAST(l IS NOT NULL AND l IS DISTINCT FROM lag(l) OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS begins FROM b),
t AS (SELECT *, sum(begins) OVER (PARTITION BY user_id, l ORDER BY event_id) AS turn FROM f)
SELECT user_id, event_id, CASE WHEN l IS NOT NULL THEN l || CASE WHEN turn > 1 THEN '#' || CAST(turn AS BIGINT) ELSE '' END END AS container,
CASE WHEN l IS NOT NULL THEN CAST(sum(CASE WHEN begins = 1 OR opens THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, l, turn ORDER BY event_id) AS BIGINT) END AS item FROM t""")
def d03_list_groups(spark, d):
    rows = T(spark, d, "events").select("user_id", "event_id", F.nullif("event_type", F.lit("purchase")).alias("list_id"), (F.col("event_id") % 3 == 0).alias("opens"))
    return blocks.list_groups(rows, "user_id", "event_id").select("user_id", "event_id", "container", "item")


@query("""WITH e AS (SELECT user_id, event_id, event_id % 3 AS level, event_type <> 'error' AS ordered FROM events),
s AS (SELECT *, sum(CASE WHEN level < 1 THEN 1 ELSE 0 END) OVER w AS below1, sum(CASE WHEN level < 2 THEN 1 ELSE 0 END) OVER w AS below2 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, CASE level WHEN 0 THEN 0 WHEN 1 THEN below1 ELSE below2 END AS part FROM s),
i AS (SELECT *, CAST(ordered IS DISTINCT FROM lag(ordered) OVER (PARTITION BY user_id, level, part ORDER BY event_id) AS INTEGER) AS begins FROM g),
r AS (SELECT *, sum(begins) OVER (PARTITION BY user_id, level, part ORDER BY event_id) AS run FROM i),
n AS (SELECT user_id, event_id, CASE WHEN ordered THEN row_number() OVER (PARTITION BY user_id, level, part, run ORDER BY event_id) ELSE 0 END AS n FROM r)
SELECT user_id, list(CAST(n AS INTEGER) ORDER BY event_id) AS numbers FROM n GROUP BY 1""")
def f11_list_markers(spark, d):
    item = F.struct("event_id", (F.col("event_id") % 3).alias("level"), (F.col("event_type") != "error").alias("ordered"))
    lists = T(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return lists.select("user_id", blocks.list_markers("items").alias("numbers"))


@query("""SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN [] WHEN count(DISTINCT o_orderpriority) > 1 THEN [min(o_orderstatus)] ELSE [min(o_orderstatus), min(o_orderpriority)] END AS prefix FROM orders GROUP BY 1""")
def d09_common_prefix(spark, d):
    paths = T(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.array("o_orderstatus", "o_orderpriority")).alias("paths"))
    return paths.select("o_custkey", blocks.common_prefix(F.col("paths")).alias("prefix"))


@query("""WITH RECURSIVE b AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k, l_returnflag = 'R' AS heading, CASE WHEN l_suppkey % 7 > 0 THEN [l_linenumber % 4 + 1, l_suppkey % 5] END AS path FROM lineitem),
a AS (SELECT *, coalesce(lead(path) OVER (PARTITION BY l_orderkey ORDER BY k), [1000000]) AS high, lead(k, 1, 1000000000) OVER (PARTITION BY l_orderkey ORDER BY k) AS upto FROM (
  SELECT l_orderkey, k, path FROM b WHERE heading AND path IS NOT NULL UNION ALL SELECT DISTINCT l_orderkey, 0, [] FROM b WHERE heading AND path IS NOT NULL)),
c AS (SELECT b.l_orderkey, b.k, b.path, a.path AS low, a.k AS part FROM b JOIN a ON a.l_orderkey = b.l_orderkey AND b.k > a.k AND b.k < a.upto WHERE NOT heading AND b.path IS NOT NULL AND b.path < a.high),
w AS (SELECT l_orderkey, part, part AS k, low AS reached, false AS taken FROM (SELECT DISTINCT l_orderkey, part, low FROM c)
  UNION ALL SELECT n.l_orderkey, n.part, n.k, CASE WHEN n.path > w.reached THEN n.path ELSE w.reached END, n.path > w.reached FROM w JOIN c n ON n.l_orderkey = w.l_orderkey AND n.part = w.part AND n.k = (SELECT min(k) FROM c m WHERE m.l_orderkey = w.l_orderkey AND m.part = w.part AND m.k > w.k))
SELECT l_orderkey, k, reached AS path FROM w WHERE taken""")
def f17_gap_fills(spark, d):
    """Each line item as a numbered block of its order; the SQL walks from block to block."""
    by = ["l_linenumber", "l_partkey", "l_suppkey"]
    rows = T(spark, d, "lineitem").select("l_orderkey", *by, (F.col("l_returnflag") == "R").alias("heading"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*by)).cast("long"))
    path = F.when(F.col("l_suppkey") % 7 > 0, F.array((F.col("l_linenumber") % 4 + 1).cast("int"), (F.col("l_suppkey") % 5).cast("int")))
    found = blocks.gap_fills(rows.withColumn("path", path), "l_orderkey", by)
    return found.select("l_orderkey", "k", F.col("path").cast("array<long>").alias("path"))


@query("""WITH t AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN upper(p_name[1]) || p_name[2:] ELSE array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS t FROM part)
SELECT p_partkey, t = upper(t) AS caps, len(list_filter(string_split(t, ' '), lambda w: len(w) > 3)) >= 2 AND len(list_filter(string_split(t, ' '), lambda w: len(w) > 3 AND w[1] <> upper(w[1]))) = 0 AND t <> upper(t) AS titled FROM t""")
def i16_heading_case(spark, d):
    name = F.col("p_name")
    cased = F.array(name, F.upper(name), F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1_000)), F.initcap(name))
    text = F.element_at(cased, (F.col("p_size") % 4 + 1).cast("int"))
    return T(spark, d, "part").select("p_partkey", blocks.all_caps(text).alias("caps"), blocks.title_case(text).alias("titled"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN false WHEN 1 THEN len(string_split(p_name, ' ')) * 3 < 6 WHEN 2 THEN 1 >= 0.15 * 6 ELSE 1 >= 0.15 * 7 END AS worth FROM part""")
def b16_tables_worth(spark, d):
    name, blank = F.col("p_name"), F.lit(" - ")
    grids = F.array(F.array(F.array(blank, blank)), F.array(F.array(name), F.array(name), F.array(name)), F.array(F.array(name, blank, blank), F.array(blank, blank, blank)), F.array(F.array(name, blank, blank, blank), F.array(blank, blank, blank, F.lit(None).cast("string"))))
    return T(spark, d, "part").select("p_partkey", blocks.worth_emitting(F.element_at(grids, (F.col("p_partkey") % 4 + 1).cast("int"))).alias("worth"))


@query("SELECT p_partkey, [[coalesce(nullif(p_brand, 'Brand#2'), ''), p_type]] AS cells FROM part")
def d04_flat_cells(spark, d):
    return T(spark, d, "part").select("p_partkey", blocks.flat_cells(F.array(F.array(F.nullif("p_brand", F.lit("Brand#2")), F.col("p_type")))).alias("cells"))


_ROW_SCORE = "CASE WHEN len(trim(c)) >= 2 AND contains(lower(f), lower(trim(c))) THEN len(trim(c)) ELSE 0 END"


@query(f"""WITH f AS (SELECT p_partkey, unnest([0, 1, 2]) AS k, unnest([upper(p_name), p_type || ' ' || p_brand, 'x']) AS f FROM part),
c AS (SELECT p_partkey, unnest([0, 0, 1, 1, 2]) AS r, unnest([p_brand, 'x', ' ' || p_name || ' ', p_brand, p_type]) AS c FROM part),
s AS (SELECT p_partkey, k, r, sum({_ROW_SCORE}) AS score FROM f JOIN c USING (p_partkey) GROUP BY ALL)
SELECT p_partkey, list(CAST(r AS BIGINT) ORDER BY k) AS rows FROM (SELECT p_partkey, k, CASE WHEN max(score) > 0 THEN arg_max(r, (score, -r)) END AS r FROM s GROUP BY 1, 2) GROUP BY 1""".replace(" AS rows", " AS table_rows"))
def d15_fact_rows(spark, d):
    name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    facts = F.array(F.upper(name), F.concat(kind, F.lit(" "), brand), F.lit("x"))
    rows = F.array(F.array(brand, F.lit("x")), F.array(F.concat(F.lit(" "), name, F.lit(" ")), brand), F.array(kind))
    return T(spark, d, "part").select("p_partkey", blocks.fact_rows(facts, rows).cast("array<long>").alias("table_rows"))


@query("""WITH n AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus <> 'F')
SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after FROM n WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def d22_chain_repair(spark, d):
    nodes = blocks.without_nodes(T(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), F.col("o_orderstatus") == "F", "o_custkey", "o_orderkey", "o_orderkey")
    return nodes.select("o_custkey", "o_orderkey", F.col("prev").alias("before"), F.col("next").alias("after"))


@query("""WITH q AS (SELECT p_partkey, p_name || ' of  ' || p_brand AS t FROM part), m AS (SELECT p_partkey, t, CASE WHEN contains(lower(t), 'ring') THEN 'ring' WHEN contains(lower(t), 'small') THEN 'small' WHEN contains(lower(t), 'box') THEN 'box' END AS form FROM q)
SELECT p_partkey, CASE WHEN form IN ('ring', 'small') THEN 'jewel' WHEN form = 'box' THEN 'case' END AS value, trim(regexp_replace(CASE WHEN form IS NULL THEN t ELSE substr(t, 1, instr(lower(t), form) - 1) || substr(t, instr(lower(t), form) + len(form)) END, '\\s+', ' ', 'g')) AS residual FROM m""")
def i25_surface_forms(spark, d):
    text = F.concat("p_name", F.lit(" of  "), "p_brand")
    found = T(spark, d, "part").select("p_partkey", blocks.surface_form(text, {"jewel": ["ring", "small"], "case": ["box"]}).alias("s"))
    return found.select("p_partkey", "s.value", "s.residual")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'SQL' ELSE 'DOC' END AS kind, CASE WHEN doc_id % 4 = 0 THEN '' ELSE ', ' || concat_ws(', ', CASE WHEN doc_id % 4 IN (1, 3) THEN 'doc=' || doc_id END, CASE WHEN doc_id % 4 IN (2, 3) THEN 'section=' || source || ' > ' || lang END,
CASE WHEN doc_id % 4 = 3 THEN 'page=' || (doc_id % 5) || CASE WHEN doc_id % 2 + doc_id % 3 + 2 <> doc_id % 5 THEN '-' || (doc_id % 2 + doc_id % 3 + 2) ELSE '' END END, CASE WHEN doc_id % 4 = 1 AND doc_id % 3 > 0 THEN 'images=' || (doc_id % 3) END) END AS suffix FROM documents""")
def i33_source_suffix(spark, d):
    key = F.col("doc_id")
    name, path = F.when((key % 4).isin(1, 3), key), F.when((key % 4).isin(2, 3), F.array("source", "lang"))
    start, images = F.when(key % 4 == 3, key % 5), F.when(key % 4 == 1, key % 3)
    marks = T(spark, d, "documents").select("doc_id", name.alias("name"), path.alias("path"), start.alias("a"), (key % 2 + key % 3 + 2).alias("b"), images.alias("n"))
    return marks.select("doc_id", blocks.source_kind("name", F.col("path"), "a").alias("kind"), blocks.source_suffix("name", F.col("path"), "a", "b", "n").alias("suffix"))


@query("SELECT p_partkey, lower(p_name) || ' 12 v ' || lower(p_type) AS label FROM part")
def i39_normal_labels(spark, d):
    text = F.concat(F.lit("## 3.1 "), "p_name", F.lit(" (12_V)®:<BR/>"), "p_type", F.lit(" - "))
    return T(spark, d, "part").select("p_partkey", blocks.normal_label(text).alias("label"))


_DICTIONARY = [("A", "k1", "single", []), ("N", "k1", "boolean", []), ("R", "k2", "conditional", ["c0", "c1"]), ("A", "k3", "list", ["c1"]), ("N", "k4", "range", [])]


@query("""WITH d(block, key, kind, conditions) AS (VALUES ('A', 'k1', 'single', []::VARCHAR[]), ('N', 'k1', 'boolean', []), ('R', 'k2', 'conditional', ['c0', 'c1']), ('A', 'k3', 'list', ['c1']), ('N', 'k4', 'range', [])),
f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag AS block, 'k' || l_linenumber AS key, l_orderkey % 3 = 0 AS fresh, CASE WHEN l_suppkey % 4 > 1 THEN 'c' || (l_suppkey % 4 - 2) WHEN l_suppkey % 4 = 1 THEN '' END AS condition FROM lineitem),
j AS (SELECT f.*, CASE WHEN d.kind IS NULL AND fresh AND (SELECT count(*) FROM d x WHERE x.key = f.key) = 1 THEN (SELECT max(x.block) FROM d x WHERE x.key = f.key) ELSE f.block END AS to_block FROM f LEFT JOIN d ON d.block = f.block AND d.key = f.key),
k AS (SELECT j.*, d.kind, d.conditions, nullif(condition, '') AS c FROM j LEFT JOIN d ON d.block = to_block AND d.key = j.key),
r AS (SELECT *, CASE WHEN kind IS NULL AND NOT fresh THEN 'unknown key' WHEN kind IS NOT NULL AND c IS NOT NULL AND NOT list_contains(conditions, c) THEN 'condition outside the closed list' WHEN kind = 'conditional' AND c IS NULL THEN 'conditional without condition' END AS reason FROM k)
SELECT l_orderkey, l_linenumber, l_partkey, to_block AS block, kind, CASE WHEN kind IS NULL AND fresh THEN 'new_key' WHEN reason IS NULL THEN 'ok' ELSE 'dropped' END AS outcome, reason FROM r""")
def j03_classified_facts(spark, d):
    supp = F.col("l_suppkey") % 4
    condition = F.when(supp > 1, F.concat(F.lit("c"), (supp - 2).cast("string"))).when(supp == 1, "")
    facts = T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("block"), F.concat(F.lit("k"), F.col("l_linenumber").cast("string")).alias("key"), (F.col("l_orderkey") % 3 == 0).alias("is_new_key"), condition.alias("condition"))
    dictionary = spark.createDataFrame(_DICTIONARY, "block string, key string, kind string, conditions array<string>")
    return blocks.classify_facts(facts, dictionary).select("l_orderkey", "l_linenumber", "l_partkey", "block", "kind", "outcome", "reason")


@query("""SELECT DISTINCT l_partkey AS code FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 496000) OR l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice < 2000) UNION SELECT p_partkey FROM part WHERE p_size > 48""")
def k04_incremental_codes(spark, d):
    o = T(spark, d, "orders").withColumnRenamed("o_orderkey", "doc_id")
    owners = T(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("code"))
    return blocks.incremental_codes(o.where("o_totalprice > 496000"), o.where("o_totalprice < 2000"), owners, T(spark, d, "part").where("p_size > 48").select(F.col("p_partkey").alias("code")))


@query("""SELECT coalesce(r.k, s.k) AS k, CASE WHEN s.k IS NULL THEN r.hash ELSE s.hash END AS hash, coalesce(r.id, s.id) AS id, CASE WHEN s.k IS NULL THEN NULL WHEN r.k IS NULL THEN 'NEW' ELSE 'MODIFIED' END AS verdict
FROM (SELECT c_custkey AS k, c_mktsegment AS hash, 'old' || c_custkey AS id FROM customer WHERE c_custkey % 3 > 0) r FULL JOIN (SELECT o_custkey AS k, min(o_orderpriority) AS hash, 'new' || o_custkey AS id FROM orders GROUP BY 1) s ON r.k = s.k""")
def k14_registry_upsert(spark, d):
    registry = T(spark, d, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("hash"), F.concat(F.lit("old"), F.col("c_custkey").cast("string")).alias("id"))
    seen = T(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderpriority").alias("hash")).withColumn("id", F.concat(F.lit("new"), F.col("k").cast("string")))
    return blocks.upserted(registry, seen, "k", "id")
