"""The registered queries and, where SQL can express them, the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallgrass.functions import text as X
from tallgrass.operators import changes, facts, relational, structure, vectors
from tallgrass.sources import html
from tallgrass.session import table as T
from tallgrass.streaming import state

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# ---- sources and structure -----------------------------------------------------


@query()
def a13_html_blocks(spark, d):
    return html.html_blocks(T(spark, d, "pages"))


@query("SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, count(*) AS n, min(page_id) AS page_id FROM pages GROUP BY 1")
def a12_pages_by_host(spark, d):
    host = F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")
    return T(spark, d, "pages").groupBy(host).agg(F.count("*").alias("n"), F.min("page_id").alias("page_id"))


@query()
def d01_heading_paths(spark, d):
    return structure.heading_paths(html.html_blocks(T(spark, d, "pages")), "page_id")


@query()
def d02_sections(spark, d):
    return structure.sections(html.html_blocks(T(spark, d, "pages")), "page_id").groupBy("page_id", "section").agg(F.count("*").alias("blocks"))


@query()
def d05_page_chunks(spark, d):
    return structure.chunks(structure.heading_paths(html.html_blocks(T(spark, d, "pages")), "page_id"), "page_id")


@query("""WITH l AS (SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos, string_split(text, chr(10)) AS a FROM documents),
w AS (SELECT doc_id, pos, len(list_filter(string_split_regex(a[pos], '\\s+'), lambda x: x <> '')) AS n FROM l),
c AS (SELECT doc_id, pos, n, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM w)
SELECT doc_id, CAST((upto - 1) // 512 AS BIGINT) AS chunk, CAST(sum(n) AS BIGINT) AS tokens, count(*) AS n_lines FROM c WHERE n > 0 GROUP BY ALL""".replace("\\\\", "\\"))
def d05_fixed_packing(spark, d):
    """The cumulative form of packing: lines by where their last token falls."""
    lines = T(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    n = F.size(F.filter(F.split("line", r"\s+"), lambda w: w != ""))
    upto = F.sum("n").over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    packed = lines.select("doc_id", "pos", n.alias("n")).withColumn("upto", upto).where("n > 0")
    return packed.groupBy("doc_id", F.floor((F.col("upto") - 1) / 512).cast("long").alias("chunk")).agg(F.sum("n").cast("long").alias("tokens"), F.count("*").alias("n_lines"))


# ---- filters and scalars --------------------------------------------------------


@query("SELECT doc_id, 'sha256:' || sha256(text) AS content_hash, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS INTEGER) AS tokens FROM documents")
def i01_hash_and_tokens(spark, d):
    return T(spark, d, "documents").select("doc_id", X.content_hash("text").alias("content_hash"), X.token_count("text").alias("tokens"))


@query("SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS line FROM documents")
def i07_normal_lines(spark, d):
    return T(spark, d, "documents").select("doc_id", X.normal_line("text").alias("line"))


@query("SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '\\d+'))) AS runs FROM documents")
def i10_digit_runs(spark, d):
    return T(spark, d, "documents").select("doc_id", X.digit_runs("text").alias("runs"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name)), '[^\\w\\s-]', '', 'g'), '\\s', '-', 'g') AS slug, regexp_replace(lower(p_type), '[^a-z0-9.]+', '_', 'g') AS item FROM part")
def i12_slugs(spark, d):
    return T(spark, d, "part").select("p_partkey", X.slug("p_name").alias("slug"), X.item_slug("p_type").alias("item"))


@query("SELECT doc_id, CASE WHEN length(t) <= 280 THEN t ELSE substr(t, 1, 279) || '…' END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)")
def g12_snippets(spark, d):
    return T(spark, d, "documents").select("doc_id", X.snippet("text").alias("snippet"))


@query("SELECT conv_id, turn, CASE WHEN n = 0 THEN 'zero' WHEN n = 1 THEN 'one' WHEN n <= 5 THEN 'few' ELSE 'many' END AS shape FROM (SELECT conv_id, turn, len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '')) AS n FROM conversations)")
def b20_result_shape(spark, d):
    return T(spark, d, "conversations").select("conv_id", "turn", relational.result_shape(X.token_count("text")).alias("shape"))


@query("SELECT event_id, props, event_type, value FROM events WHERE event_type = 'click' AND value > 0.5")
def b08_conjunctive_filter(spark, d):
    return relational.conjunction(T(spark, d, "events"), event_type="click", user_id=None).where("value > 0.5").select("event_id", "props", "event_type", "value")


# ---- joins ----------------------------------------------------------------------


@query("SELECT n_name, r_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def c02_star_join(spark, d):
    joined = T(spark, d, "customer").join(T(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(T(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return joined.groupBy("n_name", "r_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT p_partkey, key FROM part JOIN (VALUES ('size', '*'), ('price', 'Brand#11'), ('type', 'Brand#22')) a(key, scope) ON scope = '*' OR scope = p_brand")
def c04_theta_join(spark, d):
    """Applicability (no scope, or the family's own) as an equi-join on the scopes that a product falls in."""
    attributes = spark.createDataFrame([("size", "*"), ("price", "Brand#11"), ("type", "Brand#22")], "key string, scope string")
    scopes = T(spark, d, "part").select("p_partkey", F.explode(F.array(F.lit("*"), "p_brand")).alias("scope"))
    return scopes.join(F.broadcast(attributes), "scope").drop("scope")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def c05_anti_join(spark, d):
    return T(spark, d, "customer").join(T(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def c05_semi_join(spark, d):
    return T(spark, d, "orders").join(T(spark, d, "lineitem").where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("""WITH RECURSIVE e(p, c) AS (SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
t(ancestor, node, depth) AS (SELECT p, c, 1 FROM e UNION ALL SELECT t.ancestor, e.c, t.depth + 1 FROM t JOIN e ON t.node = e.p) SELECT * FROM t""")
def c11_hierarchy(spark, d):
    top = T(spark, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("p"), F.concat(F.lit("n"), "n_nationkey").alias("c"))
    leaf = T(spark, d, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("p"), F.concat(F.lit("s"), "s_suppkey").alias("c"))
    return relational.descendants(top.unionByName(leaf), "p", "c")


@query("SELECT conv_id, turn, lag(turn) OVER w AS prev_turn, lead(turn) OVER w AS next_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def c18_neighbours(spark, d):
    return relational.neighbours(T(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn", "turn")


@query("SELECT e.event_id, s.s_suppkey FROM events e JOIN (SELECT s_suppkey, s_acctbal / 10000 AS lo, s_acctbal / 10000 + 0.001 AS hi FROM supplier) s ON e.value BETWEEN s.lo AND s.hi")
def x_range_join(spark, d):
    spans = T(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 10000).alias("lo"), (F.col("s_acctbal") / 10000 + 0.001).alias("hi"))
    return relational.range_join(T(spark, d, "events").select("event_id", "value"), spans, "value", "lo", "hi", 0.01).select("event_id", "s_suppkey")


@query("""SELECT l.event_id, l.user_id, r.value AS last_click FROM (SELECT * FROM events WHERE event_type <> 'click') l
ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY ALL) r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def x_as_of_join(spark, d):
    e = T(spark, d, "events")
    right = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("value").alias("last_click"))
    return relational.as_of_join(e.where("event_type <> 'click'").select("event_id", "user_id", "ts"), right, "user_id", "ts", "last_click").select("event_id", "user_id", "last_click")


# ---- aggregates -----------------------------------------------------------------


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def e01_status_counts(spark, d):
    return T(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT p_brand, count(DISTINCT p_type) AS n_values FROM part GROUP BY 1 HAVING count(DISTINCT p_type) >= 2 ORDER BY 2 DESC, 1 LIMIT 10")
def e02_informative_slots(spark, d):
    return relational.informative(T(spark, d, "part"), ["p_brand"], "p_type", 2, 10)


@query("""SELECT event_type AS stage, count(*) AS total, count(*) FILTER (WHERE value < 0.5) AS stale, max(event_id) AS last_ran_at FROM events GROUP BY 1
UNION ALL SELECT 'none', 0, 0, NULL""")
def e05_stage_summary(spark, d):
    e = T(spark, d, "events").select(F.col("event_type").alias("stage"), (F.col("value") < 0.5).alias("is_stale"), F.col("event_id").alias("ran_at"))
    stages = e.select("stage").distinct().unionByName(spark.createDataFrame([("none",)], "stage string"))
    return relational.stage_summary(e, stages)


@query("SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'user') AS asked, max_by(substr(text, 1, 120), turn) AS last_message FROM conversations GROUP BY 1")
def e11_conversation_summary(spark, d):
    return T(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), F.max_by(F.substring("text", 1, 120), "turn").alias("last_message"))


@query("""WITH t AS (SELECT quality AS label, count(*) AS support FROM labels GROUP BY 1), p AS (SELECT toxic AS label, count(*) AS n FROM labels GROUP BY 1),
h AS (SELECT quality AS label, count(*) AS tp FROM labels WHERE quality = toxic GROUP BY 1),
j AS (SELECT coalesce(t.label, p.label) AS label, coalesce(support, 0) AS support, coalesce(n, 0) AS n, coalesce(tp, 0) AS tp FROM t FULL JOIN p ON t.label = p.label LEFT JOIN h ON h.label = coalesce(t.label, p.label)),
r AS (SELECT label, support, tp, CASE WHEN n > 0 THEN tp / n ELSE 0.0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM j)
SELECT label, support, tp, round(precision, 9) AS precision, round(recall, 9) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 9) AS f1 FROM r""")
def e13_classification_metrics(spark, d):
    out = vectors.classification_metrics(T(spark, d, "labels"), "quality", "toxic")
    return out.select("label", "support", "tp", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS score FROM lineitem GROUP BY 1")
def e18_weighted_mean(spark, d):
    return T(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(relational.weighted_mean("l_discount", "l_quantity"), 9).alias("score"))


@query("""WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), n AS (SELECT source, doc_id, lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))) AS line FROM l),
p AS (SELECT source, count(DISTINCT doc_id) AS pages FROM n WHERE line <> '' GROUP BY 1), o AS (SELECT source, line, count(DISTINCT doc_id) AS on_pages FROM n WHERE line <> '' GROUP BY 1, 2)
SELECT source, line, on_pages, pages FROM o JOIN p USING (source) WHERE on_pages >= greatest(2, least(3, pages))""")
def e21_running_lines(spark, d):
    lines = T(spark, d, "documents").select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line")).select("source", "doc_id", X.normal_line("line").alias("line")).where("line <> ''")
    return relational.running_lines(lines, "source", "doc_id", "line")


@query("SELECT r_name, n_name, count(*) AS n, CAST(grouping(n_name) AS INTEGER) AS subtotal FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def x_rollup(spark, d):
    return T(spark, d, "nation").join(T(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.grouping("n_name").cast("int").alias("subtotal"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
round(avg(l_quantity), 6) AS avg_qty, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def x_pricing_summary(spark, d):
    kept = T(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    price = F.col("l_extendedprice")
    return kept.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_base_price"), F.round(F.sum(price * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("count_order"))


# ---- windows --------------------------------------------------------------------


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def f06_latest_event(spark, d):
    return relational.latest(T(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2")
def f13_memory_window(spark, d):
    return relational.memory_window(T(spark, d, "conversations"), "conv_id", "turn", 2).select("conv_id", "turn", "role")


@query("SELECT p_partkey, CASE WHEN k > 0 THEN p_brand || '-' || k ELSE p_brand END AS slug FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_size, p_brand ORDER BY p_partkey) - 1 AS k FROM part)")
def f10_numbered_repeats(spark, d):
    return relational.numbered_repeats(T(spark, d, "part"), ["p_size"], "p_brand", "p_partkey", "slug").select("p_partkey", "slug")


@query("""WITH s AS (SELECT n.n_regionkey AS g, s_acctbal AS v FROM supplier JOIN nation n ON s_nationkey = n_nationkey),
m AS (SELECT g, v, CASE WHEN v - lag(v) OVER (PARTITION BY g ORDER BY v) > 50 THEN 1 ELSE 0 END AS b FROM s), c AS (SELECT g, v, sum(b) OVER (PARTITION BY g ORDER BY v ROWS UNBOUNDED PRECEDING) AS cluster FROM m)
SELECT g, CAST(cluster AS BIGINT) AS cluster, round(avg(v), 6) AS mean, count(*) AS size FROM c GROUP BY ALL""")
def f15_clusters_1d(spark, d):
    s = T(spark, d, "supplier").join(T(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("g"), F.col("s_acctbal").alias("v"))
    return relational.clusters_1d(s, "g", "v", 50.0).withColumn("mean", F.round("mean", 6))


@query("""WITH i AS (SELECT l_partkey AS g, l_suppkey AS lo, l_suppkey + CAST(l_quantity AS BIGINT) AS hi FROM lineitem),
m AS (SELECT g, lo, hi, max(hi) OVER (PARTITION BY g ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM i)
SELECT g, CAST(sum(greatest(0, hi - greatest(lo, coalesce(r, lo)))) AS BIGINT) AS covered FROM m GROUP BY 1""")
def f16_covered_length(spark, d):
    i = T(spark, d, "lineitem").select(F.col("l_partkey").alias("g"), F.col("l_suppkey").alias("lo"), (F.col("l_suppkey") + F.col("l_quantity").cast("long")).alias("hi"))
    return relational.covered_length(i, "g", "lo", "hi")


# ---- vectors --------------------------------------------------------------------

_VECTOR_SQL = """WITH s AS (SELECT q.vec_id AS query_id, c.vec_id, round({score}, 6) AS score FROM embeddings q JOIN embeddings c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, vec_id) AS rank FROM s) WHERE rank <= 10"""


def _vectors(spark, d, metric):
    rows = T(spark, d, "embeddings")
    return vectors.top_k(rows, rows.where("vec_id % 20 = 0"), k=10, metric=metric)


@query(_VECTOR_SQL.format(score="list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[])", order="DESC"))
def g1_vector_top_k_cosine(spark, d):
    return _vectors(spark, d, "cosine")


@query(_VECTOR_SQL.format(score="list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[])", order="DESC"))
def g2_vector_top_k_dot(spark, d):
    return _vectors(spark, d, "dot")


@query(_VECTOR_SQL.format(score="list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[])", order="ASC"))
def g2_vector_top_k_euclid(spark, d):
    return _vectors(spark, d, "euclid")


@query(f"""WITH k AS ({_VECTOR_SQL.format(score="list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[])", order="DESC")}),
h AS (SELECT query_id, rank, q.label = e.label AS hit FROM k JOIN embeddings e ON e.vec_id = k.vec_id JOIN embeddings q ON q.vec_id = k.query_id)
SELECT query_id, CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS hits, round(coalesce(1.0 / min(rank) FILTER (WHERE hit), 0), 9) AS reciprocal_rank FROM h GROUP BY 1""")
def e16_retrieval_evaluation(spark, d):
    labels = T(spark, d, "embeddings").select("vec_id", "label")
    found = _vectors(spark, d, "cosine").join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted")), "query_id")
    hit = F.col("label") == F.col("wanted")
    return found.groupBy("query_id").agg(F.count_if(hit).alias("hits"), F.round(F.coalesce(1.0 / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)), 9).alias("reciprocal_rank"))


# ---- sets -----------------------------------------------------------------------


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
def h01_union(spark, d):
    return relational.union_of(T(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("k")), T(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("k")))


@query("SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT p_partkey FROM part WHERE p_size < 10")
def h02_intersection(spark, d):
    return T(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("k")).intersect(T(spark, d, "part").where("p_size < 10").select("p_partkey"))


@query("SELECT p_partkey, p_brand FROM part WHERE p_size >= 10 UNION ALL SELECT p_partkey, 'new' FROM part WHERE p_size < 10")
def h05_override_union(spark, d):
    p = T(spark, d, "part")
    return relational.override_union(p.select("p_partkey", "p_brand"), p.where("p_size < 10").select("p_partkey", F.lit("new").alias("p_brand")), "p_partkey")


# ---- facts ----------------------------------------------------------------------

_FACTS_SQL = """f AS (SELECT p_partkey, p_brand, 'brand' AS key, p_brand AS raw_text, CAST(NULL AS DOUBLE) AS num_value, CAST(NULL AS DOUBLE) AS val_min, CAST(NULL AS DOUBLE) AS val_max FROM part
UNION ALL SELECT p_partkey, p_brand, 'size', CAST(p_size AS VARCHAR), p_size, NULL, NULL FROM part
UNION ALL SELECT p_partkey, p_brand, 'price', NULL, NULL, p_retailprice * 0.9, p_retailprice * 1.1 FROM part)"""


def _facts(spark, d):
    p, none = T(spark, d, "part"), F.lit(None).cast("double")
    row = lambda key, raw, num, low, high: F.struct(F.lit(key).alias("key"), raw.cast("string").alias("raw_text"), num.cast("double").alias("num_value"), low.alias("val_min"), high.alias("val_max"))
    price = F.col("p_retailprice")
    return p.select("p_partkey", "p_brand", F.inline(F.array(row("brand", F.col("p_brand"), none, none, none), row("size", F.col("p_size"), F.col("p_size"), none, none), row("price", F.lit(None), none, price * 0.9, price * 1.1))))


@query(f"WITH {_FACTS_SQL} SELECT p_partkey, key FROM f WHERE val_min <= 1000 AND val_max >= 1000")
def m03_supported_at(spark, d):
    return _facts(spark, d).where(facts.supported_at(1000)).select("p_partkey", "key")


@query(f"WITH {_FACTS_SQL} SELECT p_partkey, key FROM f WHERE coalesce(val_max, num_value) >= 40")
def m04_at_least(spark, d):
    return _facts(spark, d).where(facts.at_least(40)).select("p_partkey", "key")


@query(f"WITH {_FACTS_SQL} SELECT p_partkey, key FROM f WHERE coalesce(val_min, num_value) <= 10")
def m05_at_most(spark, d):
    return _facts(spark, d).where(facts.at_most(10)).select("p_partkey", "key")


@query("SELECT p_partkey, key, CASE WHEN scope IS NULL OR scope = p_brand THEN 'not_specified' ELSE 'not_applicable' END AS status FROM part, (VALUES ('size', NULL), ('price', 'Brand#11'), ('type', 'Brand#22')) a(key, scope)")
def j01_grid(spark, d):
    attributes = spark.createDataFrame([("size", None), ("price", "Brand#11"), ("type", "Brand#22")], "key string, scope string")
    return facts.grid(T(spark, d, "part").select("p_partkey", F.col("p_brand").alias("family")), F.broadcast(attributes)).select("p_partkey", "key", "status")


@query("""WITH g AS (SELECT l_partkey, l_returnflag, max(l_linenumber) AS trust, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS first_seen FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, l_returnflag, trust, n, first_seen, CASE WHEN row_number() OVER (PARTITION BY l_partkey ORDER BY trust DESC, n DESC, first_seen) = 1 THEN 'present' ELSE 'conflicting' END AS status FROM g""")
def f01_winners(spark, d):
    rows = T(spark, d, "lineitem").withColumn("ord", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return facts.winners(rows, ["l_partkey"], "l_returnflag", "l_linenumber", "ord")


@query("""SELECT key, a, b FROM (SELECT p_type AS key, min(p_name) FILTER (WHERE p_brand = 'Brand#11') AS a, min(p_name) FILTER (WHERE p_brand = 'Brand#22') AS b FROM part GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL""")
def j06_comparison(spark, d):
    rows = T(spark, d, "part").select(F.col("p_type").alias("key"), F.col("p_brand").alias("product_code"), F.col("p_name").alias("raw_text"), F.lit("present").alias("status"))
    return facts.comparison(rows, ["Brand#11", "Brand#22"]).toDF("key", "a", "b")


@query("""SELECT l_partkey, list(CAST(l_orderkey AS VARCHAR) ORDER BY -t, l_orderkey) AS docs FROM (SELECT l_partkey, l_orderkey, max(l_linenumber) AS t FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def e29_merge_evidence(spark, d):
    rows = T(spark, d, "lineitem").select("l_partkey", F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("chunk_id"), F.col("l_linenumber").alias("trust"))
    return facts.merge_evidence(rows, ["l_partkey"]).select("l_partkey", F.transform("evidence", lambda e: e["doc_id"].cast("string")).alias("docs"))


# ---- changes --------------------------------------------------------------------


@query("""WITH b AS (SELECT doc_id, 'p' || doc_id AS path, sha256(text) AS h FROM documents WHERE lang IS DISTINCT FROM 'de'),
n AS (SELECT doc_id, 'p' || doc_id AS path, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE lang IS DISTINCT FROM 'fr')
SELECT path AS rel_path, CASE WHEN n.path IS NULL THEN 'DELETED' WHEN b.path IS NULL THEN 'NEW' WHEN n.h = b.h THEN 'UNCHANGED' ELSE 'MODIFIED' END AS scan_status FROM n FULL JOIN b USING (path)""")
def k01_scan_diff(spark, d):
    docs = T(spark, d, "documents")
    name = F.concat(F.lit("p"), "doc_id")
    # hashes take the path in, so that copies of one text at two paths are not a move
    before = docs.where("lang is distinct from 'de'").select(F.col("doc_id").cast("string").alias("doc_id"), name.alias("rel_path"), F.sha2(F.concat(name, "text"), 256).alias("content_hash"), F.lit("NEW").alias("scan_status"))
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    now = docs.where("lang is distinct from 'fr'").select(name.alias("rel_path"), F.sha2(F.concat(name, text), 256).alias("content_hash"))
    return changes.scan_diff(now, before).select("rel_path", "scan_status")


@query("SELECT doc_id, 'stale' AS state FROM documents WHERE doc_id % 5 = 0")
def k05_stale_scopes(spark, d):
    docs = T(spark, d, "documents").select(F.col("doc_id").alias("scope"), F.sha2("text", 256).alias("signature"))
    saved = docs.withColumn("signature", F.when(F.col("scope") % 5 == 0, "old").otherwise(F.col("signature")))
    return vectors.stale_scopes(docs, saved).select(F.col("scope").alias("doc_id"), F.lit("stale").alias("state"))


@query("SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def x_tumbling_windows(spark, d):
    return state.tumbling(T(spark, d, "events"), "ts", "1 hour", ["event_type"]).select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def k22_sessions(spark, d):
    return state.sessions(T(spark, d, "events"), "ts", "6 hours", "user_id").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
