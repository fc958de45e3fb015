"""Registered queries of operators/rules.py and of further templates over facts, each with the SQL that computes the same rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallgrass.functions import text as X
from tallgrass.operators import facts, rules
from tallgrass.plans.catalog import query
from tallgrass.session import table as T

# ---- predicates and labels ----------------------------------------------------------


@query("SELECT doc_id, trim(coalesce(text, '')) <> '' AND doc_id % 4 = 0 AS leaf_only, trim(coalesce(text, '')) <> '' AS with_summaries FROM documents")
def b03_embeddable(spark, d):
    level = F.col("doc_id") % 4
    return T(spark, d, "documents").select("doc_id", rules.embeddable("text", level).alias("leaf_only"), rules.embeddable("text", level, True).alias("with_summaries"))


@query("SELECT doc_id || '::c0' AS node_id, CAST(doc_id AS VARCHAR) AS doc_id, lang, source, CAST(len(string_split(coalesce(text, ''), ' ')) AS BIGINT) AS words, 'sha256:' || sha256(coalesce(text, '')) AS content_hash FROM documents")
def b04_payload(spark, d):
    """What goes beside a vector, provenance included."""
    text = F.coalesce("text", F.lit(""))
    return T(spark, d, "documents").select(
        rules.leaf_id("doc_id", F.lit(0)).alias("node_id"), F.col("doc_id").cast("string").alias("doc_id"), "lang", "source", F.size(F.split(text, " ")).cast("long").alias("words"), F.concat(F.lit("sha256:"), F.sha2(text, 256)).alias("content_hash"))


_STATUS = "CASE WHEN p_size < 10 THEN 'not_specified' WHEN p_size < 20 THEN 'absent' WHEN p_size < 25 THEN 'conflicting' ELSE 'present' END"


def _spec(spark, d):
    """Parts as facts: one row a part with a status and a kind."""
    size = F.col("p_size")
    status = F.when(size < 10, "not_specified").when(size < 20, "absent").when(size < 25, "conflicting").otherwise("present")
    return T(spark, d, "part").withColumn("status", status)


@query(f"SELECT p_partkey, status FROM (SELECT *, {_STATUS} AS status FROM part) WHERE status IN ('present', 'absent')")
def b05_present_view(spark, d):
    return _spec(spark, d).where(facts.answers(with_absent=True)).select("p_partkey", "status")


@query(f"SELECT p_partkey FROM (SELECT *, {_STATUS} AS status FROM part) WHERE status = 'not_specified'")
def b06_gap_view(spark, d):
    return _spec(spark, d).where("status = 'not_specified'").select("p_partkey")


@query("SELECT doc_id, coalesce(lang NOT IN ('de', 'fr'), true) AS in_scope, coalesce(lang NOT IN ('de', 'fr'), true) AND doc_id % 3 = 0 AS leaf FROM documents")
def b09_scope(spark, d):
    return T(spark, d, "documents").select("doc_id", rules.included("lang", ["de", "fr"]).alias("in_scope"), rules.included("lang", ["de", "fr"], F.col("doc_id") % 3).alias("leaf"))


@query("SELECT l_orderkey, count(*) FILTER (WHERE coalesce(nullif(l_returnflag, 'A') <> 'R', true)) AS shown FROM lineitem GROUP BY 1")
def b12_visible_images(spark, d):
    image = F.struct(F.col("l_linenumber").alias("id"), F.nullif("l_returnflag", F.lit("A")).alias("visual_type"))
    each = T(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(image).alias("images"))
    return each.select("l_orderkey", F.size(rules.visible(F.col("images"), ["R"])).cast("long").alias("shown"))


@query("SELECT p_partkey, p_name FROM part WHERE NOT coalesce(lower(translate(trim(p_name), 'Iİ', 'ıi')) IN ('small ring', 'large box'), false)")
def b13_without_boilerplate(spark, d):
    return T(spark, d, "part").where(~rules.boilerplate("p_name", ["small ring", "large box"])).select("p_partkey", "p_name")


@query("""SELECT conv_id, turn, CASE WHEN contains(lower(text), 'the') THEN 'The' WHEN contains(lower(text), 'dans') THEN 'dans' WHEN contains(lower(text), 'un') THEN 'UN' END AS marker FROM conversations""")
def b19_first_marker(spark, d):
    return T(spark, d, "conversations").select("conv_id", "turn", rules.first_marker("text", ["The", "dans", "UN"]).alias("marker"))


@query("""SELECT page_id, CASE WHEN contains(upper(url), '/FR/') THEN 'french' WHEN contains(upper(url), 'REF') THEN 'linked' ELSE CASE lower(regexp_extract(url, '(\\.[^./\\\\]+)$', 1)) WHEN '.html' THEN 'page' WHEN '.com' THEN 'site' END END AS kind FROM pages""")
def b23_classified(spark, d):
    return T(spark, d, "pages").select("page_id", rules.classified("url", [("/FR/", "french"), ("REF", "linked")], {".html": "page", ".com": "site"}).alias("kind"))


@query("""SELECT c_custkey, CASE WHEN count(o_orderkey) = 0 THEN 'no_documents' WHEN count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) > 0 THEN 'extracted' ELSE 'no_extractable_documents' END AS info_status
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def b24_info_status(spark, d):
    types = T(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("types"))
    return T(spark, d, "customer").join(types, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", rules.info_status(F.col("types"), ["1-URGENT", "2-HIGH"]).alias("info_status"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'P' THEN 'error' ELSE 'queued' END AS state FROM orders")
def b25_fallback_state(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "SUCCESS").when(F.col("o_orderstatus") == "P", "FAILED").otherwise("PENDING")
    return T(spark, d, "orders").select("o_orderkey", rules.fallback_state(status).alias("state"))


# ---- joins ------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, p_partkey, concat_ws(' | ', p_name, p_brand, s_name) AS chunk FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey")
def c03_three_way_view(spark, d):
    rows = T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey"))
    joined = rows.join(T(spark, d, "part").select("p_partkey", "p_name", "p_brand"), "p_partkey").join(T(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey")
    return joined.select("l_orderkey", "l_linenumber", "p_partkey", F.concat_ws(" | ", "p_name", "p_brand", "s_name").alias("chunk"))


_CODES = "CASE WHEN event_id % 7 = 0 THEN 'broken' WHEN event_id % 5 = 0 THEN NULL ELSE '[\"' || event_type || '\", \"u' || user_id || '\"]' END"


def _coded(spark, d):
    """Events as documents with a JSON array of codes, some broken or null."""
    at = F.col("event_id")
    codes = F.when(at % 7 == 0, "broken").when(at % 5 != 0, F.concat(F.lit('["'), "event_type", F.lit('", "u'), F.col("user_id").cast("string"), F.lit('"]')))
    return T(spark, d, "events").withColumn("codes", codes)


@query(f"""SELECT event_id, unnest(CAST(from_json(codes, '["VARCHAR"]') AS VARCHAR[])) AS code FROM (SELECT event_id, {_CODES} AS codes FROM events) WHERE codes LIKE '[%'""")
def c06_unnested_codes(spark, d):
    return rules.exploded_codes(_coded(spark, d), "codes", "event_id")


@query(f"SELECT event_id, CASE WHEN codes LIKE '[%' THEN 2::BIGINT ELSE 0::BIGINT END AS owners FROM (SELECT event_id, {_CODES} AS codes FROM events)")
def e06_owner_counts(spark, d):
    return rules.owner_counts(_coded(spark, d), "codes", "event_id")


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, sha256(CAST(o_totalprice > 100000 AS VARCHAR)) AS hash FROM orders) o
JOIN (SELECT l_orderkey AS k, sha256(CAST(max(l_linenumber) > 4 AS VARCHAR)) AS hash, CASE WHEN max(l_quantity) > 45 THEN 'FAILED' ELSE 'SUCCESS' END AS status FROM lineitem GROUP BY 1) r ON k = o_orderkey
WHERE o.hash IS DISTINCT FROM r.hash OR status IS DISTINCT FROM 'SUCCESS'""")
def c07_stale_documents(spark, d):
    docs = T(spark, d, "orders").select("o_orderkey", F.sha2((F.col("o_totalprice") > 100000).cast("string"), 256).alias("hash"))
    runs = T(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sha2((F.max("l_linenumber") > 4).cast("string"), 256).alias("hash"), F.when(F.max("l_quantity") > 45, "FAILED").otherwise("SUCCESS").alias("status"))
    return rules.stale_documents(docs, runs, "o_orderkey").select("o_orderkey")


@query("""WITH a AS (SELECT l_orderkey AS doc, l_linenumber AS chunk, l_partkey AS code, l_discount * 10 AS confidence FROM lineitem)
SELECT doc, chunk, list_sort(list(DISTINCT CAST(code AS VARCHAR))) AS owners FROM a WHERE confidence >= 0.8 GROUP BY 1, 2""")
def c14_ownership_index(spark, d):
    rows = T(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("chunk"), F.col("l_partkey").cast("string").alias("code"), (F.col("l_discount") * 10).alias("confidence"))
    return rules.ownership_index(rows, ["doc", "chunk"], "code")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN p_partkey IS NULL THEN 'unknown code' WHEN l_discount * 10 < 0.8 THEN 'low confidence' ELSE 'accepted' END AS verdict
FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size < 30) ON p_partkey = l_partkey""")
def j11_acceptance(spark, d):
    rows = T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("code"), (F.col("l_discount") * 10).alias("confidence"))
    return rules.accepted(rows, T(spark, d, "part").where("p_size < 30").select(F.col("p_partkey").alias("code"))).select("l_orderkey", "l_linenumber", "verdict")


@query("""SELECT o_custkey AS doc, count(DISTINCT o_orderstatus) AS owners, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN 'deterministic' ELSE 'job' END AS way,
CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS owner, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN 1.0::DOUBLE END AS confidence FROM orders GROUP BY 1""")
def j10_ownership_split(spark, d):
    return rules.ownership_split(T(spark, d, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderstatus").alias("status")), "doc", "status")


@query("SELECT DISTINCT l_orderkey, l_partkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size >= 10")
def c15_products_of_documents(spark, d):
    """The distinct active products of each changed document."""
    active = T(spark, d, "part").where("p_size >= 10").select(F.col("p_partkey").alias("l_partkey"))
    return T(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(active, "l_partkey", "left_semi").distinct().select("l_orderkey", "l_partkey")


@query("""WITH p AS (SELECT conv_id, CASE WHEN turn % 4 <> 3 THEN (CASE WHEN turn % 3 = 0 THEN '999' ELSE CAST(conv_id AS VARCHAR) END) || '::c' || (turn // 2) END AS chunk_id, turn AS ord FROM conversations),
f AS (SELECT conv_id, chunk_id, min(ord) AS ord FROM p WHERE chunk_id IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY ord, chunk_id) AS place FROM f),
c AS (SELECT doc_id || '::c0' AS chunk_id, 'd' || doc_id AS doc_id, text FROM documents UNION ALL SELECT doc_id || '::c1', 'd' || doc_id, NULL FROM documents)
SELECT conv_id, CAST(place AS INTEGER) AS place, chunk_id, coalesce(doc_id, split_part(chunk_id, '::', 1)) AS doc_id, substr(coalesce(text, ''), 1, 120) AS snippet FROM r LEFT JOIN c USING (chunk_id) WHERE place <= 3""")
def c17_evidence_chunks(spark, d):
    turn = F.col("turn")
    chunk = F.when(turn % 4 != 3, F.concat(F.when(turn % 3 == 0, "999").otherwise(F.col("conv_id").cast("string")), F.lit("::c"), F.floor(turn / 2).cast("string")))
    pointers = T(spark, d, "conversations").select("conv_id", chunk.alias("chunk_id"), turn.alias("ord"))
    docs = T(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("name"), "doc_id", "text")
    chunks = docs.select(F.posexplode(F.array(F.col("text"), F.lit(None).cast("string"))).alias("k", "text"), "doc_id", "name").select(rules.leaf_id("doc_id", F.col("k")).alias("chunk_id"), F.col("name").alias("doc_id"), "text")
    return rules.evidence_chunks(pointers, chunks, "conv_id")


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_suppkey END AS direct FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(s_name, 'by part ' || p_name) AS pointer FROM v LEFT JOIN supplier ON s_suppkey = direct LEFT JOIN part ON p_partkey = l_partkey""")
def c16_evidence_pointers(spark, d):
    """A row's pointer by its own id, else by its (product, key)."""
    direct = F.when(F.col("l_returnflag") == "R", None).otherwise(F.col("l_suppkey"))
    rows = T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), direct.alias("s_suppkey"))
    joined = rows.join(T(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey", "left").join(T(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", "left")
    return joined.select("l_orderkey", "l_linenumber", F.coalesce("s_name", F.concat(F.lit("by part "), "p_name")).alias("pointer"))


@query("""WITH l AS (SELECT o_custkey AS doc, o_orderkey AS node, o_orderpriority AS anchor FROM orders),
a AS (SELECT doc, anchor, min(block) AS block FROM (SELECT o_custkey AS doc, o_orderpriority AS anchor, o_orderstatus AS block FROM orders) GROUP BY 1, 2 HAVING count(DISTINCT block) = 1),
n AS (SELECT doc, block, arg_min(node, (ord, node)) AS target FROM (SELECT o_custkey AS doc, o_orderstatus AS block, o_orderkey AS node, o_orderdate AS ord FROM orders) GROUP BY 1, 2)
SELECT DISTINCT doc, node, target FROM l JOIN a USING (doc, anchor) JOIN n USING (doc, block) WHERE node <> target""")
def c19_cross_references(spark, d):
    o = T(spark, d, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("node"), F.col("o_orderpriority").alias("anchor"), F.col("o_orderstatus").alias("block"), F.col("o_orderdate").alias("ord"))
    return rules.cross_references(o.select("doc", "node", "anchor"), o.select("doc", "anchor", "block"), o.select("doc", "block", "node", "ord"))


@query("""WITH e AS (SELECT 'c' || o_custkey AS src, 's' || o_orderstatus AS dst, year(o_orderdate) AS y FROM orders), m AS (SELECT * FROM e WHERE y = (SELECT max(y) FROM e))
SELECT 'up' AS way, src AS other FROM m WHERE dst = 'sF' UNION ALL SELECT 'down', dst FROM m WHERE src = 'sF'""")
def c20_lineage_edges(spark, d):
    edges = T(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "o_orderstatus").alias("dst"), F.year("o_orderdate").alias("at"))
    return rules.edges_of(edges, "sF", "at")


@query("""WITH f AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT o_orderkey AS k, o_orderstatus AS h FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'x' ELSE o_orderstatus END AS h FROM orders WHERE o_orderkey % 5 <> 0)
SELECT f.k AS o_orderkey, CASE WHEN n.h IS NULL THEN 'chunk gone' WHEN b.h IS NULL THEN 'nothing before' WHEN b.h <> n.h THEN 'text changed' ELSE 'carried' END AS verdict FROM f LEFT JOIN b ON f.k = b.k LEFT JOIN n ON f.k = n.k""")
def c21_carried_over(spark, d):
    key, o = F.col("o_orderkey"), T(spark, d, "orders")
    failed = T(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    now = F.when(key % 4 == 0, "x").otherwise(F.col("o_orderstatus"))
    return rules.carried_over(failed, o.where(key % 3 != 0).select("o_orderkey", F.col("o_orderstatus").alias("hash")), o.where(key % 5 != 0).select("o_orderkey", now.alias("hash")), "o_orderkey")


@query("""WITH f AS (SELECT user_id, event_type, min(event_id) AS seen FROM events GROUP BY 1, 2)
SELECT user_id, list(event_type ORDER BY seen, event_type) AS codes FROM f GROUP BY 1 HAVING count(*) >= 2""")
def c22_candidates(spark, d):
    return rules.candidates(T(spark, d, "events"), ["user_id"], "event_type", "event_id")


@query("SELECT o.o_orderkey, o.o_totalprice, coalesce(CASE WHEN o.o_orderkey % 2 = 0 THEN p.c_name END, 'new') AS owner FROM orders o LEFT JOIN customer p ON p.c_custkey = o.o_orderkey")
def c23_merged_records(spark, d):
    current = T(spark, d, "orders").select("o_orderkey", "o_totalprice", F.lit("new").alias("owner"))
    previous = T(spark, d, "customer").select(F.col("c_custkey").alias("o_orderkey"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("owner"))
    return rules.merged_record(current, previous, "o_orderkey", ["owner"])


# ---- aggregates ----------------------------------------------------------------------------


@query("SELECT count(*) FILTER (WHERE value IS NULL OR value < 5) AS open FROM events WHERE event_type = 'error'")
def e08_open_issues(spark, d):
    issues = T(spark, d, "events").select(F.col("event_type").alias("reason"), F.when(F.col("value") >= 5, F.col("ts")).alias("resolved_at"))
    return rules.open_issues(issues, "error")


@query("""WITH s AS (SELECT o_orderstatus AS status FROM orders UNION ALL SELECT o_orderpriority FROM orders) SELECT a.status, count(s.status) AS n FROM (VALUES ('F'), ('P'), ('1-URGENT'), ('none')) a(status) LEFT JOIN s USING (status) GROUP BY 1""")
def e09_stale_breakdown(spark, d):
    maps = T(spark, d, "orders").select(F.create_map(F.lit("chunk"), "o_orderstatus", F.lit("facts"), "o_orderpriority").alias("stages"))
    return rules.status_breakdown(maps, "stages", ["F", "P", "1-URGENT", "none"])


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS done, (SELECT count(*) FROM events WHERE event_type = 'error') AS errors, (SELECT count(*) FROM documents WHERE text IS NULL) AS empty_texts")
def e10_dashboard(spark, d):
    return rules.dashboard(done=(T(spark, d, "orders"), F.col("o_orderstatus") == "F"), errors=(T(spark, d, "events"), F.col("event_type") == "error"), empty_texts=(T(spark, d, "documents"), F.col("text").isNull()))


@query("SELECT conv_id, turns, last_seen, last_message, CAST(row_number() OVER (ORDER BY last_seen DESC, conv_id DESC) AS INTEGER) AS place FROM (SELECT conv_id, count(*) AS turns, max(turn) AS last_seen, substr(arg_max(text, turn), 1, 120) AS last_message FROM conversations GROUP BY 1)")
def e12_conversation_list(spark, d):
    return rules.conversation_list(T(spark, d, "conversations"), "conv_id", "turn", "text")


@query("SELECT p_partkey, round((least(100, greatest(0, p_size * 3.0)) * 2 + least(100, greatest(0, p_retailprice / 21)) * 1) / 3, 1) AS overall FROM part")
def e19_weighted_score(spark, d):
    return T(spark, d, "part").select("p_partkey", rules.weighted_score({"fit": F.col("p_size") * 3.0, "price": F.col("p_retailprice") / 21}, {"fit": 2.0, "price": 1.0}).alias("overall"))


@query("SELECT p_brand, round(avg(p_size), 1) AS size, round(avg(p_retailprice), 1) AS price, count(*) AS n FROM part GROUP BY 1")
def e20_report_average(spark, d):
    return T(spark, d, "part").groupBy("p_brand").agg(F.round(F.avg("p_size"), 1).alias("size"), F.round(F.avg("p_retailprice"), 1).alias("price"), F.count("*").alias("n"))


@query("""WITH n AS (SELECT o_custkey AS k, o_orderpriority AS token FROM orders WHERE o_orderstatus = 'F'), h AS (SELECT o_custkey AS k, o_orderpriority AS token FROM orders WHERE o_orderstatus <> 'F'),
a AS (SELECT k, token, count(*) AS need FROM n GROUP BY 1, 2), b AS (SELECT k, token, count(*) AS have FROM h GROUP BY 1, 2)
SELECT a.k, bool_and(need <= coalesce(have, 0)) AS contained FROM a LEFT JOIN b ON a.k = b.k AND a.token = b.token GROUP BY 1""")
def e23_critical_subset(spark, d):
    tokens = lambda df: df.groupBy(F.col("o_custkey").alias("k")).agg(F.collect_list("o_orderpriority").alias("tokens"))
    o = T(spark, d, "orders")
    return rules.critical_subset(tokens(o.where("o_orderstatus = 'F'")), tokens(o.where("o_orderstatus <> 'F'")), "k")


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[éèàÉ]')) AS BIGINT) AS hits FROM documents WHERE len(regexp_extract_all(text, '[éèàÉ]')) >= 20")
def e24_junk_characters(spark, d):
    return rules.junk_characters(T(spark, d, "documents"), "doc_id", "text", "[éèàÉ]", 20)


@query("""WITH r AS (SELECT o_custkey, CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '1-URGENT' THEN 3 END AS k FROM orders)
SELECT o_custkey, CASE min(k) WHEN 1 THEN '5-LOW' WHEN 2 THEN '3-MEDIUM' WHEN 3 THEN '1-URGENT' END AS lowest FROM r GROUP BY 1""")
def e26_lowest_provenance(spark, d):
    each = T(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"))
    return each.select("o_custkey", rules.lowest(F.col("p"), ["5-LOW", "3-MEDIUM", "1-URGENT"]).alias("lowest"))


@query("""WITH i AS (SELECT o_custkey, o_orderkey AS ord, unnest([{'at': 0, 'c': CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END, 't': o_orderstatus}, {'at': 1, 'c': o_orderstatus, 't': 'x' || o_orderkey}]) AS x FROM orders),
f AS (SELECT o_custkey, coalesce(x.c, x.t) AS code, min((ord, x.at, x.t)) AS m FROM i GROUP BY 1, 2)
SELECT o_custkey, list(code || '=' || m[3] ORDER BY m[1], m[2], code) AS items FROM f GROUP BY 1""")
def e27_list_union(spark, d):
    """Items of all of a key's rows, one for each code, numbered in order of first appearance."""
    key = F.col("o_orderkey")
    items = F.array(F.struct(F.when(key % 3 > 0, F.col("o_orderpriority")).alias("item_code"), F.col("o_orderstatus").alias("item_text")), F.struct(F.col("o_orderstatus").alias("item_code"), F.concat(F.lit("x"), key).alias("item_text")))
    rows = T(spark, d, "orders").select("o_custkey", key.alias("ord"), items.alias("items"), F.col("o_orderstatus").alias("raw_text"))
    return rules.list_union(rows, ["o_custkey"]).select("o_custkey", F.transform("items", lambda i: F.concat(i["item_code"], F.lit("="), i["item_text"])).alias("items"))


@query("""WITH f AS (SELECT unnest([CASE WHEN n_chars < 2000 THEN 'short' END, CASE WHEN lang <> 'en' THEN 'foreign' END, CASE WHEN text IS NULL THEN 'empty' END]) AS criterion, doc_id, source FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY criterion ORDER BY doc_id) AS k FROM f WHERE criterion IS NOT NULL)
SELECT criterion, count(*) AS n, count(DISTINCT source) AS products, list(CAST(doc_id AS VARCHAR) ORDER BY doc_id) FILTER (WHERE k <= 10) AS examples FROM r GROUP BY 1""")
def e30_staleness_criteria(spark, d):
    criteria = {"short": F.col("n_chars") < 2000, "foreign": F.col("lang") != "en", "empty": F.col("text").isNull()}
    found = rules.criteria_counts(T(spark, d, "documents"), criteria, "doc_id", "source")
    return found.withColumn("examples", F.transform("examples", lambda x: x.cast("string")))


@query("SELECT CAST(sum(n) AS BIGINT) AS lines, CAST(sum(q) AS DOUBLE) AS quantity, count(*) AS reports FROM (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1)")
def e31_load_totals(spark, d):
    reports = T(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    return reports.agg(F.sum("n").alias("lines"), F.sum("q").alias("quantity"), F.count("*").alias("reports"))


@query("SELECT p_brand AS family, CASE WHEN p_size > 25 THEN p_type END AS sub, CASE WHEN p_size > 40 THEN p_name END AS sub2, count(*) AS products FROM part GROUP BY 1, 2, 3")
def e33_taxonomy_counts(spark, d):
    """Products by a path of three levels, nulls kept as a value of their own."""
    size = F.col("p_size")
    return T(spark, d, "part").groupBy(F.col("p_brand").alias("family"), F.when(size > 25, F.col("p_type")).alias("sub"), F.when(size > 40, F.col("p_name")).alias("sub2")).agg(F.count("*").alias("products"))


# ---- one of several ----------------------------------------------------------------------------


@query("SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber DESC, l_orderkey) = 1")
def f02_representatives(spark, d):
    return rules.representative(T(spark, d, "lineitem"), ["l_partkey"], "l_linenumber", "l_orderkey").select("l_partkey", "l_orderkey", "l_linenumber")


@query("""SELECT min(doc_id) AS doc_id, count(*) AS n FROM (SELECT doc_id, lang, n_chars // 500 AS b, list_sort([coalesce(source, ''), coalesce(lang, '')]) AS i FROM documents) GROUP BY lang, b, i""")
def f03_value_signatures(spark, d):
    items = F.array(F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    rows = T(spark, d, "documents").select("doc_id", "lang", F.floor(F.col("n_chars") / 500).alias("b"), items.alias("i"))
    return rows.groupBy(rules.value_signature(["lang", "b"], "i").alias("s")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).select("doc_id", "n")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN k = 1 AND p_partkey IS NOT NULL THEN 'update' ELSE 'insert' END AS action, CASE WHEN k = 1 THEN 'present' ELSE 'conflicting' END AS status
FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber) AS k FROM lineitem) LEFT JOIN (SELECT p_partkey FROM part WHERE p_size < 20) ON p_partkey = l_partkey""")
def f04_claims(spark, d):
    rows = T(spark, d, "lineitem").withColumn("ord", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    base = T(spark, d, "part").where("p_size < 20").select(F.col("p_partkey").alias("l_partkey"))
    return rules.claimed(base, rows, ["l_partkey"], "ord").select("l_orderkey", "l_linenumber", "action", "status")


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey, CAST(NULL AS VARCHAR) AS o_orderstatus FROM orders GROUP BY 1")
def f05_reset(spark, d):
    return rules.reset(T(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey", ["o_orderstatus"])


@query("""SELECT o_custkey, o_orderpriority, seen_at, CAST(k AS INTEGER) AS place FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS seen_at, row_number() OVER (PARTITION BY o_custkey ORDER BY min(o_orderkey), o_orderpriority) AS k FROM orders GROUP BY 1, 2) WHERE k <= 3""")
def f08_first_seen(spark, d):
    return rules.first_seen(T(spark, d, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey", 3).withColumnRenamed("at", "seen_at")


@query("SELECT max('report-' || strftime(o_orderdate, '%Y-%m-%d') || '.json') AS report FROM orders")
def f09_last_report(spark, d):
    """The greatest report name."""
    return T(spark, d, "orders").agg(F.max(F.concat(F.lit("report-"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".json"))).alias("report"))


@query("""SELECT p_partkey, status FROM (SELECT p_partkey, p_brand, p_type, CASE WHEN p_size < 25 THEN 'not_specified' ELSE 'present' END AS status,
max(CASE WHEN p_size < 25 THEN 0 ELSE 1 END) OVER (PARTITION BY p_brand, p_type) AS v FROM part) WHERE v = 0 OR status <> 'not_specified'""")
def f01_missing_dropped(spark, d):
    """not_specified rows leave keys that have any value."""
    rows = T(spark, d, "part").withColumn("status", F.when(F.col("p_size") < 25, "not_specified").otherwise("present"))
    return rules.with_missing_dropped(rows, ["p_brand", "p_type"]).select("p_partkey", "status")


@query("""WITH l AS (SELECT o_custkey, o_orderkey, CAST(o_orderkey AS DOUBLE) AS top, o_orderkey + 1.0 + (o_orderkey % 400) AS bottom FROM orders),
g AS (SELECT *, median(bottom - top) OVER (PARTITION BY o_custkey) AS m, top - lag(bottom) OVER (PARTITION BY o_custkey ORDER BY top, bottom) AS gap FROM l)
SELECT o_custkey, o_orderkey, CAST(sum(CASE WHEN gap > 1.6 * m OR gap IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY top, bottom ROWS UNBOUNDED PRECEDING) AS BIGINT) AS paragraph FROM g""")
def f14_paragraphs(spark, d):
    key = F.col("o_orderkey")
    lines = T(spark, d, "orders").select("o_custkey", "o_orderkey", key.cast("double").alias("top"), (key + 1.0 + key % 400).alias("bottom"))
    return rules.paragraph_starts(lines, ["o_custkey"], "top", "bottom").select("o_custkey", "o_orderkey", "paragraph")


@query("SELECT doc_id, CAST(CASE WHEN doc_id % 3 > 0 THEN doc_id // 3 END AS INTEGER) AS ordinal FROM documents")
def f18_leaf_ordinals(spark, d):
    """Leaf ids and back: the number behind ::c."""
    third = F.floor(F.col("doc_id") / 3)
    name = F.when(F.col("doc_id") % 3 > 0, rules.leaf_id("doc_id", third)).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit("::s1.0")))
    return T(spark, d, "documents").select("doc_id", rules.leaf_ordinal(name).alias("ordinal"))


# ---- facts ------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, CASE WHEN k IN (2, 3) THEN p_size - 1::DOUBLE END AS low, CASE WHEN k IN (2, 3) THEN p_size::DOUBLE END AS typical, CASE WHEN k IN (2, 3) THEN p_size + 1::DOUBLE END AS high,
CASE WHEN k IN (0, 4) THEN p_size::DOUBLE WHEN k = 1 THEN CASE WHEN p_size > 20 THEN 1::DOUBLE ELSE 0 END END AS value FROM (SELECT *, p_partkey % 6 AS k FROM part)""")
def m02_kind_slots(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("single", "boolean", "range", "min_typ_max", "conditional", "list"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    size = F.col("p_size")
    rows = T(spark, d, "part").select("p_partkey", kind.alias("kind"), (size * 1.0).alias("num_value"), (size - 1.0).alias("val_min"), (size * 1.0).alias("val_typ"), (size + 1.0).alias("val_max"), (size > 20).alias("bool_value"))
    found = rows.select("p_partkey", rules.slots("kind").alias("s"))
    return found.select("p_partkey", *[F.col(f"s.{c}").cast("double").alias(c) for c in ("low", "typical", "high", "value")])


@query("SELECT p_partkey, p_name || ' ' || p_size AS shown FROM part WHERE p_size >= 40")
def m08_display_and_filter(spark, d):
    """Filters compare typed slots, the answer shows the raw text."""
    rows = T(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_size").alias("raw_text"), F.col("p_size").alias("num_value"), F.lit(None).cast("int").alias("val_max"))
    return rows.where(facts.at_least(40)).select("p_partkey", F.col("raw_text").alias("shown"))


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_type = 'ECONOMY' AND p_size BETWEEN 10 AND 20")
def m10_condition_match(spark, d):
    return T(spark, d, "part").where((F.col("p_type") == "ECONOMY") & F.col("p_size").between(10, 20)).select("p_partkey", "p_retailprice")


@query("SELECT key, block, count(*) AS n FROM (SELECT p_size AS key, p_type AS block FROM part UNION ALL SELECT p_size, p_brand FROM part) WHERE key = 7 GROUP BY 1, 2")
def m12_blocks_of_a_key(spark, d):
    """A plain key covers all blocks that have it; the pair (block, key) tells them apart."""
    p = T(spark, d, "part")
    return p.select(F.col("p_size").alias("key"), F.explode(F.array("p_type", "p_brand")).alias("block")).where("key = 7").groupBy("key", "block").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand ILIKE '%nd#2%'")
def m14_loose_family(spark, d):
    return T(spark, d, "part").where(F.col("p_brand").ilike("%nd#2%")).select("p_partkey", "p_brand")


@query(f"""SELECT DISTINCT code, event_type FROM (SELECT event_type, value, unnest(CAST(from_json(codes, '["VARCHAR"]') AS VARCHAR[])) AS code FROM (SELECT event_type, value, {_CODES} AS codes FROM events) WHERE codes LIKE '[%') WHERE value > 5 AND code LIKE 'u%'""")
def m16_files_of_a_product(spark, d):
    """Files of each product through the unnested codes, active ones only."""
    return rules.exploded_codes(_coded(spark, d).where("value > 5"), "codes", "event_type").where("code like 'u%'").select("code", "event_type").distinct()


@query("SELECT p_partkey, p_retailprice FROM part WHERE upper(p_name) = upper('small ring')")
def m18_single_attribute(spark, d):
    return T(spark, d, "part").where(F.upper("p_name") == "SMALL RING").select("p_partkey", "p_retailprice")


@query("SELECT p_brand, p_partkey, p_size FROM part WHERE p_size >= 45")
def m19_cross_family_filter(spark, d):
    """One numeric bound over all families."""
    return T(spark, d, "part").where("p_size >= 45").select("p_brand", "p_partkey", "p_size")


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def m20_category_join(spark, d):
    nations = T(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return T(spark, d, "customer").join(nations, "c_nationkey").select("c_custkey", "n_name")


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name ILIKE '%_1%'")
def m21_family_join(spark, d):
    nations = T(spark, d, "nation").where(F.col("n_name").ilike("%_1%")).select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return T(spark, d, "supplier").join(nations, "s_nationkey").select("s_suppkey", "n_name")


@query("""WITH g AS (SELECT p_partkey, key, CASE WHEN p_size < 25 THEN 'not_specified' ELSE 'not_applicable' END AS status FROM part, (VALUES ('has_return'), ('has_open'), ('size')) k(key)),
o AS (SELECT l_partkey, l_returnflag AS t, min(l_orderkey) AS doc FROM lineitem GROUP BY 1, 2)
SELECT p_partkey, key, CASE WHEN status = 'not_specified' AND doc IS NOT NULL THEN 'present' ELSE status END AS status, CASE WHEN status = 'not_specified' THEN doc END AS source_doc
FROM g LEFT JOIN o ON l_partkey = p_partkey AND t = CASE key WHEN 'has_return' THEN 'R' WHEN 'has_open' THEN 'N' END""")
def j02_boolean_fill(spark, d):
    status = F.when(F.col("p_size") < 25, "not_specified").otherwise("not_applicable")
    grid = T(spark, d, "part").select(F.col("p_partkey").alias("product_code"), status.alias("status"), F.explode(F.array(*map(F.lit, ("has_return", "has_open", "size")))).alias("key"))
    docs = T(spark, d, "lineitem").select(F.col("l_partkey").alias("product_code"), F.col("l_returnflag").alias("doc_type"), F.col("l_orderkey").alias("doc_id"))
    return rules.boolean_fill(grid, docs, {"has_return": "R", "has_open": "N"}).withColumnRenamed("product_code", "p_partkey")


# ---- lifecycle -----------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT l_partkey, l_linenumber AS ord, CAST(l_orderkey AS VARCHAR) AS doc FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'))
SELECT l_partkey, list(doc ORDER BY ord, doc) AS evidence, arg_min(doc, (ord, doc)) AS primary_doc FROM l GROUP BY 1""")
def h03_forgotten(spark, d):
    rows = T(spark, d, "lineitem").select("l_partkey", F.col("l_linenumber").alias("ord"), F.col("l_orderkey").cast("string").alias("doc_id"))
    return rules.forgotten(rows, T(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("doc_id")), "l_partkey").withColumnRenamed("primary", "primary_doc")


@query("SELECT DISTINCT o_custkey AS c_custkey, CASE WHEN c_custkey IS NULL THEN 'unmatched' WHEN c_acctbal > 0 THEN 'changed' ELSE 'already_inactive' END AS verdict FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) ON c_custkey = o_custkey")
def h08_marked_inactive(spark, d):
    docs = T(spark, d, "customer").where("c_custkey % 5 <> 0").select("c_custkey", (F.col("c_acctbal") > 0).alias("is_active"))
    return rules.marked_inactive(docs, T(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""SELECT o_orderkey, (o_orderstatus IS DISTINCT FROM h) AS chunk_stale, f IS NULL OR f < o_orderdate AS facts_stale FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linestatus) AS h, max(l_shipdate) AS f FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def k07_stage_staleness(spark, d):
    ran = T(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("chunk_hash"), F.max("l_shipdate").alias("extracted_at"))
    docs = T(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("hash"), F.col("o_orderdate").alias("chunked_at")).join(ran, "o_orderkey", "left")
    return rules.stage_staleness(docs).select("o_orderkey", "chunk_stale", "facts_stale")


@query("SELECT DISTINCT user_id, event_type AS stage, CAST(list_position(['view', 'click', 'purchase', 'error'], event_type) AS INTEGER) AS place FROM events WHERE event_type IN ('purchase', 'error')")
def k08_cascade(spark, d):
    return rules.cascade(T(spark, d, "events").select("user_id", F.col("event_type").alias("stage")), ["view", "click", "purchase", "error"], "click", "user_id")


@query("SELECT doc_id || '::c' || (i - 1) AS node_id, doc_id, sha256(l) AS content_hash FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)")
def k09_chunk_snapshot(spark, d):
    """Every line of every document as a chunk row with its hash."""
    lines = T(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "l"))
    return lines.select(rules.leaf_id("doc_id", F.col("i")).alias("node_id"), "doc_id", F.sha2("l", 256).alias("content_hash"))


@query(f"SELECT p_brand, count(*) AS conflicts FROM (SELECT *, {_STATUS} AS status FROM part) WHERE status = 'conflicting' GROUP BY 1")
def k10_conflicts(spark, d):
    return _spec(spark, d).where("status = 'conflicting'").groupBy("p_brand").agg(F.count("*").alias("conflicts"))


@query("""SELECT DISTINCT 'facts' AS stage, 'warning' AS severity, p_partkey AS source_doc, 'too small' AS reason FROM part WHERE p_size < 5 AND p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#2')""")
def k18_issues(spark, d):
    """Rejected rows become issues once."""
    p = T(spark, d, "part")
    rejected = p.where("p_size < 5").select("p_partkey", F.lit("too small").alias("reason"))
    known = p.where("p_brand = 'Brand#2'").select(F.lit("facts").alias("stage"), F.col("p_partkey").alias("source_doc"), F.lit("too small").alias("reason"))
    return rules.issues_from(rejected, "facts", "warning", "p_partkey", known)


@query("""SELECT user_id, CASE WHEN h >= 8 THEN 'partial' WHEN failed = 0 THEN 'full' WHEN done > 0 THEN 'partial' ELSE 'failed' END AS outcome FROM
(SELECT user_id, count(*) / 4.0 AS h, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type = 'purchase') AS done FROM events GROUP BY 1)""")
def k21_outcomes(spark, d):
    runs = T(spark, d, "events").groupBy("user_id").agg((F.count("*") / 4.0).alias("hours"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("event_type") == "purchase").alias("done"))
    return runs.select("user_id", rules.outcome("hours", "failed", "done").alias("outcome"))


@query("SELECT doc_id, array_to_string(l[1:3], chr(10)) || CASE WHEN len(l) > 3 THEN chr(10) || '… ' || (len(l) - 3) || ' more rows' ELSE '' END AS capped FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)")
def i21_capped_text(spark, d):
    return T(spark, d, "documents").select("doc_id", rules.capped_table(F.split(F.coalesce("text", F.lit("")), "\n"), 3).alias("capped"))


@query("""SELECT o_orderkey, CAST(greatest(0, least(10 + o_orderkey % 7, 12) - greatest(o_orderkey % 7, 8)) * greatest(0, least(5, 3 + o_orderkey % 3) - greatest(0, o_orderkey % 3)) AS DOUBLE) AS area FROM orders""")
def i40_overlap_area(spark, d):
    box = lambda x0, y0, x1, y1: F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    key, n = F.col("o_orderkey"), lambda v: F.lit(float(v))
    a = box((key % 7).cast("double"), n(0), (key % 7) + 10.0, n(5))
    b = box(n(8), (key % 3).cast("double"), n(12), (key % 3) + 3.0)
    return T(spark, d, "orders").select("o_orderkey", a.alias("a"), b.alias("b")).select("o_orderkey", rules.overlap_area("a", "b").alias("area"))


# ---- text and fact rules ---------------------------------------------------------------------------------

_EDGES = X.EDGES.replace("'", "''")


@query(rf"""SELECT doc_id, CAST(len(t) AS BIGINT) AS n, sha256(array_to_string(t, ' ')) AS tokens FROM
(SELECT doc_id, list_filter(list_transform(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: trim(x, '{_EDGES}')), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]')) AS t FROM documents)""")
def i09_content_tokens(spark, d):
    tokens = X.content_tokens(F.coalesce("text", F.lit("")))
    return T(spark, d, "documents").select("doc_id", tokens.alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.sha2(F.array_join("t", " "), 256).alias("tokens"))


@query(r"""SELECT p_partkey, title, page FROM (SELECT p_partkey, rtrim(regexp_replace(rtrim(regexp_extract(t, '(?s)^(.*?)(\d+)\s*$', 1)), '[.\s]{2,}$', '')) AS title, TRY_CAST(regexp_extract(t, '(\d+)\s*$', 1) AS INTEGER) AS page
FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || ' ..... ' || p_size WHEN 1 THEN p_brand || ' ' || p_size || ' ' ELSE p_name END AS t FROM part)) WHERE page IS NOT NULL AND title <> ''""")
def i18_contents_entries(spark, d):
    third = F.col("p_partkey") % 3
    line = F.when(third == 0, F.concat_ws(" ..... ", "p_name", "p_size")).when(third == 1, F.concat("p_brand", F.lit(" "), "p_size", F.lit(" "))).otherwise(F.col("p_name"))
    return T(spark, d, "part").select("p_partkey", X.toc_entry(line).alias("e")).where("e is not null").select("p_partkey", "e.title", "e.page")


_HITS = "len(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'), lambda w: list_contains([{}], w)))"
_TR, _EN = (_HITS.format(", ".join(f"'{w}'" for w in known)) for known in (X.TURKISH_WORDS, X.ENGLISH_WORDS))


@query(f"SELECT conv_id, turn, CASE WHEN regexp_matches(coalesce(text, ''), '[{X.TURKISH_LETTERS}]') THEN 'tr' WHEN {_EN} > {_TR} THEN 'en' ELSE 'tr' END AS lang FROM conversations")
def i23_language(spark, d):
    return T(spark, d, "conversations").select("conv_id", "turn", X.detect_language(F.coalesce("text", F.lit(""))).alias("lang"))


@query("SELECT p_partkey, ['BRAND#' || regexp_extract(p_brand, '[0-9]+')] AS codes FROM part")
def i24_product_codes(spark, d):
    return T(spark, d, "part").select("p_partkey", X.product_codes(F.concat_ws(" or ", "p_brand", F.lower("p_brand")), r"(brand#\d+)").alias("codes"))


def _ends(spark, d):
    """Parts as facts of four kinds with ends that may be missing or out of order."""
    key, size, none = F.col("p_partkey"), F.col("p_size").cast("double"), F.lit(None)
    kind = F.element_at(F.array(*map(F.lit, ("range", "min_typ_max", "single", "boolean"))), (key % 4 + 1).cast("int"))
    low, high = F.when(key % 5 > 0, size), F.when(key % 7 > 1, 50 - size)
    return T(spark, d, "part").select(
        "p_partkey", "p_brand", kind.alias("kind"), F.when(key % 11 == 0, "absent").otherwise("present").alias("status"), F.when(key % 3 == 0, size).alias("num_value"), none.cast("string").alias("text_value"), low.alias("val_min"), F.when(key % 2 == 0, F.lit(25.0)).alias("val_typ"), high.alias("val_max"),
        none.cast("boolean").alias("bool_value"), none.cast("array<struct<ordinal:int,item_code:string,item_text:string>>").alias("items"), none.cast("string").alias("source_chunk_id"), F.col("p_name").alias("raw_text"), key.alias("ord"))


_ENDS_SQL = """SELECT p_partkey, p_brand, ['range', 'min_typ_max', 'single', 'boolean'][p_partkey % 4 + 1] AS kind, CASE WHEN p_partkey % 11 = 0 THEN 'absent' ELSE 'present' END AS status, CASE WHEN p_partkey % 3 = 0 THEN p_size::DOUBLE END AS num,
CASE WHEN p_partkey % 5 > 0 THEN p_size::DOUBLE END AS low, CASE WHEN p_partkey % 2 = 0 THEN 25::DOUBLE END AS typ, CASE WHEN p_partkey % 7 > 1 THEN 50 - p_size::DOUBLE END AS high FROM part"""


@query(f"""SELECT p_partkey, CASE WHEN status <> 'present' AND coalesce(num, low, typ, high) IS NOT NULL THEN 'payload without presence' WHEN status = 'absent' THEN 'absence without source' WHEN kind = 'single' AND num IS NULL THEN 'single without exactly one value'
WHEN kind = 'boolean' THEN 'boolean without value' WHEN kind = 'range' AND low IS NULL AND high IS NULL THEN 'range without ends' WHEN kind = 'min_typ_max' AND coalesce(low, typ, high) IS NULL THEN 'no end'
WHEN low > high THEN 'ends out of order' WHEN typ < low OR typ > high THEN 'typical outside the ends' END AS reason FROM ({_ENDS_SQL})""")
def b14_fact_validity(spark, d):
    return _ends(spark, d).select("p_partkey", facts.invalid_reason(F.col("kind")).alias("reason"))


@query(f"""SELECT p_partkey, CASE WHEN status <> 'present' OR kind IN ('single', 'boolean') AND kind = 'single' THEN num WHEN kind = 'boolean' THEN num WHEN typ IS NOT NULL THEN typ WHEN low = high OR low IS NULL OR high IS NULL THEN coalesce(low, high, num) ELSE num END AS num_value,
CASE WHEN status <> 'present' OR kind = 'single' THEN NULL WHEN kind = 'boolean' THEN 'kind mismatch' WHEN typ IS NOT NULL THEN NULL WHEN low IS NULL AND high IS NULL THEN 'kind mismatch' WHEN low <> high THEN 'kind mismatch' END AS reason FROM ({_ENDS_SQL})""")
def i29_kind_coercion(spark, d):
    """Facts of all kinds as singles where that loses nothing."""
    return facts.coerce_kind(_ends(spark, d).withColumn("wanted", F.lit("single"))).select("p_partkey", "num_value", "reason")


@query()
def e28_interval_merge(spark, d):
    """Halves of one interval of each brand joined; SQL has no such fold, so a test compares it with brute force."""
    return facts.interval_merge(_ends(spark, d).where("kind = 'min_typ_max'"), ["p_brand"])
