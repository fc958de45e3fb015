"""Further registered queries: the question templates over facts, evidence, lifecycle and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallgrass.functions import text as X
from tallgrass.operators import asking, relational
from tallgrass.plans.catalog import query
from tallgrass.session import table as T

# ---- questions over facts --------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN p_size >= 40 THEN p_size * 2.54::DOUBLE ELSE p_size::DOUBLE END AS size_cm FROM part")
def m07_unit_normalisation(spark, d):
    """Values scaled by a unit table; the observed unit never filters."""
    units = spark.createDataFrame([("in", 2.54), ("cm", 1.0)], "unit string, factor double")
    rows = T(spark, d, "part").select("p_partkey", "p_size", F.when(F.col("p_size") >= 40, "in").otherwise("cm").alias("unit"))
    return rows.join(F.broadcast(units), "unit", "left").select("p_partkey", (F.col("p_size") * F.coalesce("factor", F.lit(1.0))).alias("size_cm"))


@query("SELECT p_partkey, p_type FROM part WHERE list_contains(string_split(upper(p_type), ' '), 'PROMO')")
def m09_list_item(spark, d):
    return T(spark, d, "part").where(F.array_contains(F.split(F.upper("p_type"), " "), "PROMO")).select("p_partkey", "p_type")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_type ILIKE '%promo%')")
def m11_key_discovery(spark, d):
    p = T(spark, d, "part")
    return p.join(p.where(F.col("p_type").ilike("%promo%")).select("p_brand"), "p_brand", "left_semi").select("p_partkey", "p_brand")


@query("SELECT p_partkey, p_brand FROM part WHERE upper(p_brand) IN (upper('brand#4'), upper('BRAND#7'))")
def m13_code_match(spark, d):
    return T(spark, d, "part").where(F.upper("p_brand").isin([x.upper() for x in ("brand#4", "BRAND#7")])).select("p_partkey", "p_brand")


@query("SELECT CASE WHEN p_retailprice IS NULL THEN 'no record' WHEN p_retailprice < 1000 THEN 'on request' ELSE 'priced' END AS price_state, count(*) AS n FROM part GROUP BY 1")
def m15_price_states(spark, d):
    state = F.when(F.col("p_retailprice").isNull(), "no record").when(F.col("p_retailprice") < 1000, "on request").otherwise("priced")
    return T(spark, d, "part").groupBy(state.alias("price_state")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, s_suppkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY s_acctbal DESC, l_linenumber) = 1")
def m17_trust_order(spark, d):
    """Of several sources, the one that is trusted most; of equally trusted ones on lines of one number, the smallest key, which the SQL leaves open."""
    joined = T(spark, d, "lineitem").join(T(spark, d, "supplier").select("s_suppkey", "s_acctbal"), F.col("l_suppkey") == F.col("s_suppkey"))
    return relational.latest(joined, "l_orderkey", [F.desc("s_acctbal"), F.asc("l_linenumber"), F.asc("s_suppkey")]).select("l_orderkey", "l_linenumber", "s_suppkey")


@query("SELECT p_brand, count(DISTINCT p_partkey) AS products FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY 1")
def m22_count_supporting(spark, d):
    used = T(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_partkey")
    return T(spark, d, "part").join(used, F.col("p_partkey") == F.col("l_partkey"), "left_semi").groupBy("p_brand").agg(F.count("*").alias("products"))


@query("SELECT p_partkey, p_type FROM part WHERE p_type ILIKE '%economy%' OR p_type ILIKE '%small%'")
def m23_synonyms(spark, d):
    return T(spark, d, "part").where(F.col("p_type").ilike("%economy%") | F.col("p_type").ilike("%small%")).select("p_partkey", "p_type")


# ---- aggregates ------------------------------------------------------------------


@query("SELECT o_custkey, max(o_orderdate) AS last_at, count(*) AS n FROM orders GROUP BY 1")
def e03_last_and_count(spark, d):
    return T(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_at"), F.count("*").alias("n"))


@query("SELECT max(ts) AS newest FROM events")
def e04_newest(spark, d):
    return T(spark, d, "events").agg(F.max("ts").alias("newest"))


@query("""SELECT 'status' AS axis, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2
UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY 2""")
def e07_scan_summary(spark, d):
    """Counts on several axes in one pass over the rows."""
    axes = F.inline(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(c).alias("value")) for a, c in (("status", "o_orderstatus"), ("priority", "o_orderpriority"))]))
    return T(spark, d, "orders").select(axes).groupBy("axis", "value").agg(F.count("*").alias("n"))


@query("SELECT p_size, mode AS common_brand FROM (SELECT p_size, p_brand AS mode, row_number() OVER (PARTITION BY p_size ORDER BY count(*) DESC, p_brand) AS k FROM part GROUP BY 1, 2) WHERE k = 1")
def e25_mode(spark, d):
    counted = T(spark, d, "part").groupBy("p_size", "p_brand").agg(F.count("*").alias("n"))
    best = F.min_by("p_brand", F.struct((-F.col("n")).alias("n"), "p_brand"))
    return counted.groupBy("p_size").agg(best.alias("common_brand"))


@query("""SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS before_n, coalesce(b.n, 0) AS after_n FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a
FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k""")
def e32_before_and_after(spark, d):
    a = T(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("before_n"))
    b = T(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("after_n"))
    return a.join(b, "k", "full").select("k", F.coalesce("before_n", F.lit(0)).alias("before_n"), F.coalesce("after_n", F.lit(0)).alias("after_n"))


# ---- evidence and conversations --------------------------------------------------


@query("SELECT conv_id, turn, 'conv_id=' || conv_id || ' | role=' || coalesce(role, '') AS row_text FROM conversations")
def g06_row_text(spark, d):
    return T(spark, d, "conversations").select("conv_id", "turn", asking.row_text(["conv_id", "role"]).alias("row_text"))


@query("SELECT conv_id, role, last FROM (SELECT conv_id, role, max(turn) AS last, max(max(turn)) OVER (PARTITION BY conv_id) AS e FROM conversations GROUP BY 1, 2) WHERE e - last <= 1")
def f12_recent_entities(spark, d):
    return asking.recent_entities(T(spark, d, "conversations"), "conv_id", "role", "turn", 1)


@query("SELECT doc_id, lang, k AS place FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k FROM documents)")
def g15_round_robin(spark, d):
    """Documents dealt one per language per round: the round of each."""
    w = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    return T(spark, d, "documents").select("doc_id", "lang", F.row_number().over(w).cast("long").alias("place"))


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(lower(trim(text)), '\\bcompare\\b') THEN 'compare' WHEN regexp_matches(lower(trim(text)), '\\bfind\\b') THEN 'find' ELSE 'out_of_scope' END AS label FROM conversations")
def i36_label(spark, d):
    return T(spark, d, "conversations").select("conv_id", "turn", asking.label_in(F.coalesce("text", F.lit("")), ["find", "compare"]).alias("label"))


@query("SELECT event_type, CASE event_type WHEN 'click' THEN 'search' WHEN 'purchase' THEN 'order' ELSE 'none' END AS flow, count(*) AS n FROM events GROUP BY 1, 2")
def l11_router(spark, d):
    rows = asking.routed(T(spark, d, "events"), {"click": "search", "purchase": "order"}, "none", "event_type")
    return rows.groupBy("event_type", "flow").agg(F.count("*").alias("n"))


@query("SELECT 'part' AS table_name, 'part(p_brand string, p_name string, p_partkey bigint, p_retailprice double, p_size int, p_type string)' AS text")
def l08_schema_text(spark, d):
    return asking.schema_text(asking.known_columns(spark, {"part": T(spark, d, "part")}))


@query("SELECT 'q' AS question, CAST(1 AS INTEGER) AS ord, 'part' AS table_name, 'p_size' AS column_name")
def l07_schema_linking(spark, d):
    known = asking.known_columns(spark, {n: T(spark, d, n) for n in ("part", "supplier")})
    wanted = spark.createDataFrame([("q", 1, "PART", "P_Size"), ("q", 2, "part", "colour"), ("q", 3, "stock", "n")], "question string, ord int, table_name string, column_name string")
    return asking.linked_schema(wanted, known)


@query("SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def g05_row_cap(spark, d):
    """A generated statement over temporary views, cleaned, its first five rows kept."""
    for name in ("supplier", "nation"):
        T(spark, d, name).createOrReplaceTempView(name)
    raw = "```sql\nSELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 ORDER BY 2 DESC, 1;\n```"
    text = spark.range(1).select(asking.clean_sql(F.lit(raw)).alias("t")).first()["t"]
    return asking.run_sql(spark, text, 5)


# ---- lifecycle -------------------------------------------------------------------


@query("""SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') AND min(value) >= 0 THEN 'done' WHEN count(*) = 0 THEN 'orphaned' ELSE 'pending' END AS state FROM events GROUP BY 1""")
def f07_settle(spark, d):
    done = F.bool_or(F.col("event_type") == "purchase") & (F.min("value") >= 0)
    return T(spark, d, "events").groupBy("user_id").agg(F.when(done, "done").otherwise("pending").alias("state"))


@query("SELECT doc_id, count(*) AS lines, sum(CASE WHEN regexp_matches(line, '\\d') THEN 1 ELSE 0 END)::BIGINT AS with_digits FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1")
def e34_line_profile(spark, d):
    lines = F.split("text", "\n")
    return T(spark, d, "documents").where("text is not null").select("doc_id", F.size(lines).cast("long").alias("lines"), F.size(F.filter(lines, lambda x: x.rlike("\\d"))).cast("long").alias("with_digits"))


@query("SELECT doc_id, CASE WHEN n <= 8 THEN 0 ELSE (n - 8 + 5) // 6 END + 1 AS n_spans FROM (SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '')) AS n FROM documents)")
def d10_span_count(spark, d):
    """How many spans of 8 words with an overlap of 2 cover a text."""
    n = X.token_count(F.coalesce("text", F.lit("")))
    return T(spark, d, "documents").select("doc_id", (F.when(n <= 8, 0).otherwise(F.floor((n - 8 + 5) / 6)) + 1).cast("long").alias("n_spans"))
