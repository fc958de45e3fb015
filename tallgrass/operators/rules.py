"""Rules over documents, chunks, facts and runs: predicates as columns, and small relational operators.

Unless a docstring says otherwise a null input makes a predicate null (a filter
drops it), a null key joins nothing, ties go to the smaller key, and an empty
table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallgrass.functions import text as X

# ---- predicates and labels -----------------------------------------------------


def embeddable(text, level, with_summaries: bool = False) -> Column:
    """Whether a node is embedded: its text is not blank, and it is a leaf (level 0, or null) unless summaries are wanted."""
    filled = F.trim(F.coalesce(X._c(text), F.lit(""))) != ""
    return filled if with_summaries else filled & (F.coalesce(X._c(level), F.lit(0)) == 0)


def included(doc_type, excluded: list[str], level=None) -> Column:
    """Whether a document type is in scope (a null type is), of leaves only where level is given."""
    inside = ~F.coalesce(X._c(doc_type).isin(excluded), F.lit(False))
    return inside if level is None else inside & (F.coalesce(X._c(level), F.lit(0)) == 0)


def visible(images, excluded: list[str]) -> Column:
    """The images (structs with visual_type) whose type is not excluded; one without type stays."""
    return F.filter(images, lambda x: ~F.coalesce(x["visual_type"].isin(excluded), F.lit(False)))


def boilerplate(heading, dropped: list[str]) -> Column:
    """Whether a section's own heading, trimmed and folded, is one of those to drop; a section without heading is not."""
    return F.coalesce(X.turkish_fold(F.trim(heading)).isin(dropped), F.lit(False))


def first_marker(text, markers: list[str]) -> Column:
    """The first of markers, in their order, that text holds in any case; null if none."""
    low = F.lower(X._c(text))
    return F.coalesce(*[F.when(F.instr(low, m.lower()) > 0, m) for m in markers])


def classified(name, rules: list[tuple[str, str]], extensions: dict[str, str]) -> Column:
    """Type of a file: of the first rule (word in upper case, type) whose word its name holds, else of its extension, else null."""
    upper = F.upper(X._c(name))
    found = [F.when(F.instr(upper, word) > 0, kind) for word, kind in rules]
    extension = F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))
    return F.coalesce(*found, *[F.when(extension == e, kind) for e, kind in extensions.items()])


def info_status(doc_types, extractable: list[str]) -> Column:
    """no_documents for an empty (or null) array of types, extracted if one of them is extractable, else no_extractable_documents."""
    types = F.coalesce(doc_types, F.array().cast("array<string>"))
    return F.when(F.size(types) == 0, "no_documents").when(F.arrays_overlap(types, F.array(*map(F.lit, extractable))), "extracted").otherwise("no_extractable_documents")


def fallback_state(parse_status) -> Column:
    """State of a document that has none of its own."""
    status = X._c(parse_status)
    return F.when(status == "SUCCESS", "ready").when(status.isin("FAILED", "ERROR"), "error").otherwise("queued")


def lowest(values: Column, order: list[str]) -> Column:
    """Of an array of names the one that comes first in order; unknown ones and nulls are passed over, null if none is left."""
    rank = lambda v: F.array_position(F.array(*map(F.lit, order)), v)
    known = F.filter(values, lambda v: v.isNotNull() & (rank(v) > 0))
    best = F.array_min(F.transform(known, rank))
    return reduce(lambda out, name: F.when(best == name[0] + 1, name[1]).otherwise(out), enumerate(order), F.lit(None).cast("string"))


def outcome(hours, failed, finished, most_hours: float = 8.0) -> Column:
    """A run's outcome: partial once it reaches most_hours, full without failures, else partial if anything was finished, failed if nothing."""
    return F.when(X._c(hours) >= most_hours, "partial").when(X._c(failed) == 0, "full").when(X._c(finished) > 0, "partial").otherwise("failed")


def slots(kind) -> Column:
    """struct(low, typical, high, value) of a fact: the columns that its kind fills; booleans as 1 and 0."""
    kind = X._c(kind)
    span = kind.isin("range", "min_typ_max")
    return F.struct(
        F.when(span, F.col("val_min")).alias("low"), F.when(span, F.col("val_typ")).alias("typical"), F.when(span, F.col("val_max")).alias("high"),
        F.when(kind.isin("single", "conditional"), F.col("num_value")).when(kind == "boolean", F.col("bool_value").cast("double")).alias("value"),
    )


def leaf_ordinal(node_id) -> Column:
    """The number behind the last ::c of a leaf's id; null for other ids."""
    return F.regexp_extract(node_id, r"::c(\d+)$", 1).try_cast("int")


def leaf_id(doc_id, ordinal) -> Column:
    return F.concat(X._c(doc_id).cast("string"), F.lit("::c"), X._c(ordinal).cast("string"))


def point_id(name, namespace: str = "6ba7b810-9dad-11d1-80b4-00c04fd430c8") -> Column:
    """The version-5 UUID of name in namespace (the fixed one of DNS names unless given)."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))


def overlap_area(a: str, b: str) -> Column:
    """Common area of two boxes given as structs x0, y0, x1, y1; 0 where they only touch."""
    side = lambda low, high: F.greatest(F.lit(0.0), F.least(F.col(f"{a}.{high}"), F.col(f"{b}.{high}")) - F.greatest(F.col(f"{a}.{low}"), F.col(f"{b}.{low}")))
    return side("x0", "x1") * side("y0", "y1")


def capped_table(lines: Column, most: int) -> Column:
    """The first most lines of an array, and a notice that says how many are missing."""
    more = F.size(lines) - most
    return F.concat_ws("\n", F.slice(lines, 1, most), F.when(more > 0, F.concat(F.lit("… "), more.cast("string"), F.lit(" more rows"))))


def weighted_score(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean of scores clamped to 0..100, to one decimal; a null score leaves its weight out, no score at all gives null."""
    clamped = {k: F.greatest(F.lit(0.0), F.least(F.lit(100.0), v.cast("double"))) for k, v in scores.items() if k in weights}
    total = sum((F.coalesce(F.when(scores[k].isNotNull(), v * weights[k]), F.lit(0.0)) for k, v in clamped.items()), F.lit(0.0))
    weight = sum((F.when(scores[k].isNotNull(), weights[k]).otherwise(0.0) for k in clamped), F.lit(0.0))
    return F.round(total / F.nullif(weight, F.lit(0.0)), 1)


# ---- joins ---------------------------------------------------------------------


def exploded_codes(docs: DataFrame, codes: str, *keep: str) -> DataFrame:
    """One row for each code of a JSON array column; null, empty and broken arrays give none."""
    return docs.select(*keep, F.explode(F.from_json(codes, "array<string>")).alias("code")).where("code is not null")


def owner_counts(docs: DataFrame, codes: str, *keep: str) -> DataFrame:
    """The length of each row's JSON array, 0 where it is null or broken."""
    return docs.select(*keep, F.coalesce(F.nullif(F.size(F.from_json(codes, "array<string>")), F.lit(-1)), F.lit(0)).cast("long").alias("owners"))


def stale_documents(docs: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """docs whose run was on other content (hash, null-safe) or did not succeed; docs without run are left out."""
    ran = runs.select(key, F.col("hash").alias("ran_hash"), "status")
    return docs.join(ran, key).where(~F.col("hash").eqNullSafe(F.col("ran_hash")) | ~F.col("status").eqNullSafe("SUCCESS")).drop("ran_hash")


def owner_of_path(paths: DataFrame, owners: DataFrame, path: str = "rel_path") -> DataFrame:
    """paths with owner: the node of the first file-name token that is a code, else of the first whose part before '-' is one, else of the deepest folder named like a node. owners: (name, node), names in lower case; ties by name."""
    parts = F.split(F.lower(F.regexp_replace(path, r"\\", "/")), "/")
    tokens = F.filter(F.split(F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", ""), r"[\s_]+"), lambda t: t != "")
    candidates = F.concat(
        F.transform(tokens, lambda t, i: F.struct(t.alias("name"), i.alias("priority"))),
        F.transform(tokens, lambda t, i: F.struct(F.substring_index(t, "-", 1).alias("name"), (i + 10_000).alias("priority"))),
        F.transform(F.reverse(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))), lambda t, i: F.struct(t.alias("name"), (i + 20_000).alias("priority"))),
    )
    hits = paths.select(path, F.explode(candidates).alias("c")).select(path, "c.name", "c.priority").join(owners, "name").groupBy(path).agg(F.min_by("node", F.struct("priority", "name")).alias("owner"))
    return paths.join(hits, path, "left")


def ownership_index(assignments: DataFrame, keys: list[str], owner: str, least: float = 0.8) -> DataFrame:
    """Sorted distinct owners of each key among accepted assignments (confidence of least or more)."""
    return assignments.where(F.col("confidence") >= least).groupBy(*keys).agg(F.array_sort(F.collect_set(owner)).alias("owners"))


def accepted(assignments: DataFrame, products: DataFrame, least: float = 0.8) -> DataFrame:
    """assignments with verdict: accepted if the code is known and the confidence high enough, else the reason."""
    known = products.select("code", F.lit(True).alias("known"))
    verdict = F.when(F.col("known").isNull(), "unknown code").when(F.col("confidence").isNull() | (F.col("confidence") < least), "low confidence").otherwise("accepted")
    return assignments.join(known, "code", "left").withColumn("verdict", verdict).drop("known")


def ownership_split(owned: DataFrame, doc: str, owner: str) -> DataFrame:
    """Each document's way: deterministic with its one owner and confidence 1.0, or job (several owners, no confidence)."""
    found = owned.groupBy(doc).agg(F.countDistinct(owner).alias("owners"), F.min(owner).alias("only"))
    one = F.col("owners") == 1
    return found.select(doc, "owners", F.when(one, "deterministic").otherwise("job").alias("way"), F.when(one, F.col("only")).alias("owner"), F.when(one, F.lit(1.0)).alias("confidence"))


def evidence_chunks(pointers: DataFrame, chunks: DataFrame, key: str, most: int = 3, length: int = 120) -> DataFrame:
    """Each row's first most distinct evidence chunks in order: (key, place, chunk_id, doc_id, snippet). The document is the chunk's, or where the chunk is unknown the part of its id before '::'."""
    first = pointers.where("chunk_id is not null").groupBy(key, "chunk_id").agg(F.min("ord").alias("ord"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("ord", "chunk_id"))
    few = first.withColumn("place", place).where(F.col("place") <= most)
    return few.join(chunks.select("chunk_id", "doc_id", "text"), "chunk_id", "left").select(
        key, "place", "chunk_id", F.coalesce("doc_id", F.substring_index("chunk_id", "::", 1)).alias("doc_id"), F.substring(F.coalesce("text", F.lit("")), 1, length).alias("snippet"))


def cross_references(links: DataFrame, anchors: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, target): the first node (least ord) that carries the block of a link's anchor; anchors that several blocks of a document bear resolve to nothing."""
    unique = anchors.groupBy("doc", "anchor").agg(F.min("block").alias("block"), F.countDistinct("block").alias("n")).where("n = 1")
    carrier = nodes.groupBy("doc", "block").agg(F.min_by("node", F.struct("ord", "node")).alias("target"))
    return links.join(unique, ["doc", "anchor"]).join(carrier, ["doc", "block"]).where("node <> target").select("doc", "node", "target").distinct()


def edges_of(edges: DataFrame, node: str, ingest: str = "ingested_at") -> DataFrame:
    """Edges into (up) and out of (down) a node at the latest ingest."""
    newest = edges.agg(F.max(ingest).alias("newest"))
    now = edges.join(F.broadcast(newest), F.col(ingest) == F.col("newest")).drop("newest")
    up = now.where(F.col("dst") == node).select(F.lit("up").alias("way"), F.col("src").alias("other"))
    return up.unionByName(now.where(F.col("src") == node).select(F.lit("down").alias("way"), F.col("dst").alias("other")))


def carried_over(failed: DataFrame, before: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """failed with verdict: carried where the chunk is still there with the text of the earlier accepted row, else the reason."""
    old = before.select(key, F.col("hash").alias("old_hash"))
    now = nodes.select(key, F.col("hash").alias("now_hash"))
    verdict = F.when(F.col("now_hash").isNull(), "chunk gone").when(F.col("old_hash").isNull(), "nothing before").when(F.col("old_hash") != F.col("now_hash"), "text changed").otherwise("carried")
    return failed.join(old, key, "left").join(now, key, "left").withColumn("verdict", verdict).drop("old_hash", "now_hash")


def candidates(results: DataFrame, keys: list[str], code: str, order: str, least: int = 2) -> DataFrame:
    """Distinct codes of each key in order of first appearance, where there are least of them."""
    first = results.where(F.col(code).isNotNull()).groupBy(*keys, code).agg(F.min(order).alias("at"))
    found = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", code))), lambda x: x[code]).alias("codes"))
    return found.where(F.size("codes") >= least)


def merged_record(current: DataFrame, previous: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """current with the kept columns of the previous record of the same key where it has them."""
    old = previous.select(key, *[F.col(c).alias(f"__{c}") for c in kept])
    joined = current.join(old, key, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in kept else F.col(c) for c in current.columns])


# ---- aggregates ------------------------------------------------------------------


def open_issues(issues: DataFrame, reason: str | None = None) -> DataFrame:
    """How many issues (of a reason) are not resolved; one row, 0 for none."""
    mine = issues if reason is None else issues.where(F.col("reason") == reason)
    return mine.agg(F.count_if(F.col("resolved_at").isNull()).alias("open"))


def status_breakdown(statuses: DataFrame, column: str, names: list[str]) -> DataFrame:
    """How often each of names occurs in a column of maps stage -> status; zeros included."""
    found = statuses.select(F.explode(F.map_values(column)).alias("status")).groupBy("status").agg(F.count("*").alias("n"))
    axis = statuses.sparkSession.createDataFrame([(n,) for n in names], "status string")
    return axis.join(found, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def dashboard(**tables: tuple[DataFrame, Column]) -> DataFrame:
    """One row of counters: name=(table, condition)."""
    each = [df.agg(F.count_if(condition).alias(name)) for name, (df, condition) in tables.items()]
    return reduce(lambda a, b: a.crossJoin(b), each)


def conversation_list(turns: DataFrame, key: str, seen: str, message: str, length: int = 120) -> DataFrame:
    """One row a conversation with its size, when it was last seen and its last message (cut); place is its rank by last seen, then greater key."""
    each = turns.groupBy(key).agg(F.count("*").alias("turns"), F.max(seen).alias("last_seen"), F.substring(F.max_by(message, seen), 1, length).alias("last_message"))
    # the list's own order is its result: one sort of one row a conversation
    return each.withColumn("place", F.row_number().over(Window.orderBy(F.desc("last_seen"), F.desc(key))))


def critical_subset(needles: DataFrame, hay: DataFrame, key: str) -> DataFrame:
    """(key, contained): whether every token with a digit of the needle occurs in the hay as often. Tables of (key, tokens array); a needle without such tokens is contained, a missing hay holds none."""
    count = lambda df, name: df.select(key, F.explode("tokens").alias("token")).where(F.col("token").rlike(r"\d")).groupBy(key, "token").agg(F.count("*").alias(name))
    short = count(needles, "need").join(count(hay, "have"), [key, "token"], "left").where(F.col("need") > F.coalesce("have", F.lit(0))).select(key).distinct()
    return needles.select(key).distinct().join(short.withColumn("lacks", F.lit(True)), key, "left").select(key, F.col("lacks").isNull().alias("contained"))


def junk_characters(docs: DataFrame, key: str, text: str, junk: str, least: int) -> DataFrame:
    """Documents with least or more characters of the class junk, and how many."""
    return docs.groupBy(key).agg(F.sum(F.regexp_count(text, F.lit(junk))).alias("hits")).where(F.col("hits") >= least)


def list_union(facts: DataFrame, keys: list[str], items: str = "items", raw: str = "raw_text", order: str = "ord") -> DataFrame:
    """One row a key: items (structs item_code, item_text) of all rows, one for each code, or text where there is no code (the first seen stays), numbered from 1; distinct raw texts by line, in order."""
    code = F.coalesce("i.item_code", "i.item_text")
    each = facts.select(*keys, order, F.posexplode(items).alias("at", "i")).select(*keys, order, "at", code.alias("item_code"), F.col("i.item_text").alias("item_text")).where("item_code is not null")
    first = each.groupBy(*keys, "item_code").agg(F.min(F.struct(order, "at", "item_text")).alias("f"))
    listed = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(f"f.{order}"), F.col("f.at"), "item_code", F.col("f.item_text")))).alias("l"))
    numbered = listed.select(*keys, F.transform("l", lambda x, i: F.struct((i + 1).alias("ordinal"), x["item_code"].alias("item_code"), x["item_text"].alias("item_text"))).alias(items))
    texts = facts.select(*keys, order, F.trim(raw).alias("t")).where("t <> ''").groupBy(*keys, "t").agg(F.min(order).alias("o"))
    joined = texts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]), "\n").alias(raw))
    return numbered.join(joined, keys, "left")


def criteria_counts(rows: DataFrame, criteria: dict[str, Column], key: str, product: str, most: int = 10) -> DataFrame:
    """Rows and distinct products that meet each criterion, and the most smallest keys as examples."""
    flags = F.filter(F.array(*[F.when(c, n) for n, c in criteria.items()]), lambda x: x.isNotNull())
    met = rows.select(F.col(key).alias("k"), F.col(product).alias("p"), F.explode(flags).alias("criterion"))
    ranked = met.withColumn("r", F.row_number().over(Window.partitionBy("criterion").orderBy("k")))
    counted = met.groupBy("criterion").agg(F.count("*").alias("n"), F.countDistinct("p").alias("products"))
    examples = ranked.where(F.col("r") <= most).groupBy("criterion").agg(F.array_sort(F.collect_list("k")).alias("examples"))
    return counted.join(examples, "criterion")


# ---- one of several ---------------------------------------------------------------


def representative(facts: DataFrame, keys: list[str], trust: str, order: str) -> DataFrame:
    """The row of each key with most trust, the first of equals."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(trust), order))
    return facts.withColumn("__turn", turn).where("__turn = 1").drop("__turn")


def value_signature(columns: list[str], items: str | None = None) -> Column:
    """What two facts must share to carry the same value: their slots, and their items in whatever order; nulls are equal."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns]
    return F.sha2(F.concat_ws("\x1f", *parts, *([F.array_join(F.array_sort(items), "\x1e", "\0")] if items else [])), 256)


def claimed(base: DataFrame, winners: DataFrame, keys: list[str], order: str) -> DataFrame:
    """winners with action: update for the first of each key that has a base row, insert for the others; later rows of a key are conflicting."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    known = base.select(*keys).distinct().withColumn("__base", F.lit(True))
    joined = winners.withColumn("__turn", turn).join(known, keys, "left")
    action = F.when((F.col("__turn") == 1) & F.col("__base"), "update").otherwise("insert")
    return joined.withColumn("action", action).withColumn("status", F.when(F.col("__turn") == 1, "present").otherwise("conflicting")).drop("__turn", "__base")


def reset(values: DataFrame, keys: list[str], value_id: str, blanked: list[str]) -> DataFrame:
    """The row of least value_id of each key, its payload blanked; the other rows go."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(value_id))
    kept = values.withColumn("__turn", turn).where("__turn = 1")
    return kept.select(*[F.lit(None).cast(values.schema[c].dataType).alias(c) if c in blanked else F.col(c) for c in values.columns])


def first_seen(rows: DataFrame, keys: list[str], value: str, order: str, most: int = 8) -> DataFrame:
    """Each key's first most distinct values by first appearance, with their place."""
    first = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("at"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("at", value))
    return first.withColumn("place", place).where(F.col("place") <= most)


def with_missing_dropped(facts: DataFrame, keys: list[str]) -> DataFrame:
    """facts without the not_specified rows of keys that have any value."""
    valued = F.max((F.col("status") != "not_specified").cast("int")).over(Window.partitionBy(*keys))
    return facts.withColumn("__any", valued).where("__any = 0 or status <> 'not_specified'").drop("__any")


def paragraph_starts(lines: DataFrame, keys: list[str], top: str, bottom: str, times: float = 1.6) -> DataFrame:
    """lines with paragraph: a new one begins where the gap to the line before exceeds times the median line height of the key."""
    by = Window.partitionBy(*keys).orderBy(top, bottom)
    median = F.expr(f"percentile({bottom} - {top}, 0.5)").over(Window.partitionBy(*keys))
    gap = F.col(top) - F.lag(bottom).over(by)
    marked = lines.withColumn("__m", median).withColumn("__new", F.coalesce((gap > times * F.col("__m")).cast("int"), F.lit(1)))
    return marked.withColumn("paragraph", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__m", "__new")


def boolean_fill(grid: DataFrame, documents: DataFrame, types: dict[str, str]) -> DataFrame:
    """grid with not_specified rows of keys in types made present where the product owns a document of that type; source_doc is the first such document."""
    pairs = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])
    owned = documents.groupBy("product_code", F.col("doc_type").alias("__type")).agg(F.min("doc_id").alias("__doc"))
    joined = grid.withColumn("__type", pairs[F.col("key")]).join(owned, ["product_code", "__type"], "left")
    hit = (F.col("status") == "not_specified") & F.col("__doc").isNotNull()
    return joined.select("product_code", "key", F.when(hit, "present").otherwise(F.col("status")).alias("status"), F.when(hit, F.col("__doc")).alias("source_doc"))


# ---- lifecycle ---------------------------------------------------------------------


def forgotten(evidence: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """(key, evidence, primary): each row's evidence (structs ord, doc_id) without gone documents; rows left without any go, the first left is primary."""
    left = evidence.join(gone.select("doc_id").distinct(), "doc_id", "left_anti")
    listed = left.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "doc_id"))), lambda x: x["doc_id"]).alias("evidence"))
    return listed.withColumn("primary", F.element_at("evidence", 1))


def marked_inactive(docs: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """(key, verdict) for each distinct name: changed, already_inactive or unmatched."""
    found = docs.select(key, F.coalesce("is_active", F.lit(True)).alias("active"))
    verdict = F.when(F.col("active").isNull(), "unmatched").when(F.col("active"), "changed").otherwise("already_inactive")
    return names.select(key).distinct().join(found, key, "left").select(key, verdict.alias("verdict"))


def stage_staleness(docs: DataFrame) -> DataFrame:
    """docs with chunk_stale (the chunks' hash is not the document's, null-safe) and facts_stale (extracted before chunked, or never)."""
    return docs.withColumn("chunk_stale", ~F.col("hash").eqNullSafe(F.col("chunk_hash"))).withColumn("facts_stale", F.col("extracted_at").isNull() | (F.col("extracted_at") < F.col("chunked_at")))


def cascade(runs: DataFrame, stages: list[str], stage: str, key: str) -> DataFrame:
    """Stages after stage that have already run for each key, in order."""
    later = stages[stages.index(stage) + 1 :]
    place = F.array_position(F.array(*map(F.lit, stages)), F.col("stage")).cast("int")
    return runs.where(F.col("stage").isin(later)).select(key, "stage", place.alias("place")).distinct()


def planned(stages: list[str], stage: str | None = None, from_stage: str | None = None) -> list[str]:
    """The stages to run, in order: one, those from one on, or all. An unknown name is an error."""
    for name in (stage, from_stage):
        if name is not None and name not in stages:
            raise ValueError(f"unknown stage {name}")
    return [stage] if stage else stages[stages.index(from_stage) :] if from_stage else list(stages)


# What an issue may say about itself.
SEVERITIES = ("info", "warning", "error")


def issues_from(rejected: DataFrame, stage: str, severity: str, key: str, known: DataFrame | None = None) -> DataFrame:
    """Rejected rows (key, reason) as issues; those that known holds already are left out. A severity outside the closed set is an error."""
    if severity not in SEVERITIES:
        raise ValueError(f"unknown severity {severity}")
    rows = rejected.select(F.lit(stage).alias("stage"), F.lit(severity).alias("severity"), F.col(key).alias("source_doc"), "reason").distinct()
    return rows if known is None else rows.join(known.select("stage", "source_doc", "reason").distinct(), ["stage", "source_doc", "reason"], "left_anti").select(*rows.columns)
