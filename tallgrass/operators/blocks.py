"""Rules over a document's blocks, tables and lists, surface forms in questions, and the dictionary of facts.

Windows run within one document, whose blocks are a bounded list. Unless a
docstring says otherwise a null input makes an expression null, a null key joins
nothing, and an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallgrass.functions import text as X

#: Letters of all scripts, as Java's and RE2's expressions know them.
_LETTER, _UPPER = r"\p{L}", r"\p{Lu}"

# ---- lists and headings -----------------------------------------------------------


def list_groups(blocks: DataFrame, doc: str, order: str, list_id: str = "list_id", opens: str = "opens") -> DataFrame:
    """blocks with container and item: runs of one list_id are one container, a list's further runs get #2, #3, and so on.

    An item begins with a run and at each block that opens one (null: it does
    not). Blocks outside of lists have neither. Order is total within a document.
    """
    in_doc = Window.partitionBy(doc).orderBy(order)
    first = ~F.col(list_id).eqNullSafe(F.lag(list_id).over(in_doc)) | (F.row_number().over(in_doc) == 1)
    marked = blocks.withColumn("__first", (first & F.col(list_id).isNotNull()).cast("int"))
    of_list = Window.partitionBy(doc, list_id).orderBy(order)
    turned = marked.withColumn("__turn", F.sum("__first").over(of_list))
    of_run = Window.partitionBy(doc, list_id, "__turn").orderBy(order)
    item = F.sum(F.when((F.col("__first") == 1) | F.coalesce(F.col(opens), F.lit(False)), 1).otherwise(0)).over(of_run)
    inside = F.col(list_id).isNotNull()
    container = F.when(F.col("__turn") == 1, F.col(list_id)).otherwise(F.concat(list_id, F.lit("#"), F.col("__turn").cast("string")))
    return turned.withColumn("container", F.when(inside, container)).withColumn("item", F.when(inside, item)).drop("__first", "__turn")


def list_markers(items) -> Column:
    """Numbers of a list's items (structs with level and ordered, in order): 0 for a bullet.

    A level counts on while items are of one kind; a shallower item, or one of
    the other kind at the level, begins it anew. A null array gives null.
    """
    start = F.struct(F.array().cast("array<struct<level:int,ordered:boolean,n:int>>").alias("open"), F.array().cast("array<int>").alias("numbers"))

    def step(state: Column, item: Column) -> Column:
        level, ordered = item["level"].cast("int"), item["ordered"].cast("boolean")
        same = F.filter(state["open"], lambda x: (x["level"] == level) & (x["ordered"] == ordered))
        before = F.coalesce(F.get(same, F.lit(0))["n"], F.lit(0))
        n = F.when(ordered, before + 1).otherwise(0).cast("int")
        kept = F.filter(state["open"], lambda x: x["level"] < level)
        fresh = F.array(F.struct(level.alias("level"), ordered.alias("ordered"), n.alias("n")))
        return F.struct(F.concat(kept, fresh).alias("open"), F.concat(state["numbers"], F.array(n)).alias("numbers"))

    return F.aggregate(items, start, step, lambda s: s["numbers"])


def common_prefix(paths) -> Column:
    """The longest prefix that all of an array of paths share; empty for an empty array."""
    first = F.coalesce(F.get(paths, F.lit(0)), F.array().cast("array<string>"))
    depths = F.filter(F.sequence(F.lit(0), F.size(first)), lambda n: F.forall(paths, lambda p: F.slice(p, 1, n) == F.slice(first, 1, n)))
    return F.slice(first, 1, F.greatest(F.size(depths) - 1, F.lit(0)))


def gap_fills(blocks: DataFrame, doc: str, order: str | list[str], path: str = "path", heading: str = "heading") -> DataFrame:
    """Blocks that are no headings but whose number lies between those of the numbered headings around them, in rising order.

    path: numbers as an array (null: none). Before the first numbered heading
    everything below it counts, after the last everything above; a document
    without numbered headings has none. All windows run over one order, so rows
    are sorted once, and not at all if they come sorted by doc and order.
    """
    anchor = F.when(F.col(heading) & (F.size(path) > 0), F.col(path))
    in_doc = Window.partitionBy(doc).orderBy(*([order] if isinstance(order, str) else order))
    so_far, earlier = in_doc.rowsBetween(Window.unboundedPreceding, 0), in_doc.rowsBetween(Window.unboundedPreceding, -1)
    none = F.array().cast("array<int>")
    placed = blocks.withColumns(
        {
            "__low": F.coalesce(F.last(anchor, True).over(so_far), none),
            "__high": F.first(anchor, True).over(in_doc.rowsBetween(0, Window.unboundedFollowing)),
            "__part": F.count(anchor).over(so_far),
            "__any": F.count(anchor).over(in_doc.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) > 0,
        }
    )
    below = F.col("__high").isNull() | (F.col(path) < F.col("__high"))
    fit = ~F.coalesce(F.col(heading), F.lit(False)) & (F.size(path) > 0) & F.col("__any") & below
    # parts follow one another, so the greatest (part, path) so far is of this part if the part has any
    held = placed.withColumn("__fit", F.coalesce(fit, F.lit(False))).withColumn("__held", F.max(F.when(F.col("__fit"), F.struct(F.col("__part").alias("part"), F.col(path).alias("path")))).over(earlier))
    before = F.greatest(F.coalesce(F.when(F.col("__held.part") == F.col("__part"), F.col("__held.path")), none), F.col("__low"))
    return held.where(F.col("__fit") & (F.col(path) > before)).drop("__low", "__high", "__part", "__any", "__fit", "__held")


def all_caps(text) -> Column:
    """Two letters or more, all of them capitals."""
    return F.coalesce(X._c(text).rlike(rf"(?s){_LETTER}.*{_LETTER}") & ~X._c(text).rlike(rf"(?!{_UPPER}){_LETTER}"), F.lit(False))


def title_case(text) -> Column:
    """Two words or more of over three characters that begin with a letter, each with a capital; not all in capitals."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: (F.length(w) > 3) & w.rlike(f"^{_LETTER}"))
    return F.coalesce(~all_caps(text) & (F.size(words) >= 2) & F.forall(words, lambda w: w.rlike(f"^{_UPPER}")), F.lit(False))


# ---- tables ------------------------------------------------------------------------


def flat_cells(cells) -> Column:
    """Rows of cells with '' for null cells."""
    return F.transform(cells, lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit(""))))


def worth_emitting(cells, least_fill: float = 0.15) -> Column:
    """Whether rows of cells are a table: some cell holds a letter or digit; one column is no run of prose (three filled cells of two words on average); of more columns enough cells are filled. Null cells are covered by others and do not count."""
    flat = F.filter(F.flatten(cells), lambda c: c.isNotNull())
    filled = F.filter(flat, lambda c: c.rlike(r"[\p{L}\p{N}]"))
    words = F.aggregate(filled, F.lit(0), lambda s, c: s + F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")))
    columns = F.coalesce(F.array_max(F.transform(cells, lambda r: F.size(r))), F.lit(0))
    prose = (F.size(filled) >= 3) & (words >= 2 * F.size(filled))
    return F.when(F.size(filled) == 0, False).when(columns == 1, ~prose).otherwise(F.size(filled) >= least_fill * F.size(flat))


def fact_rows(facts, rows, least: int = 2) -> Column:
    """For each fact the index (from 0) of the row whose cells (of least characters or more) it holds most of, by length; ties to the first row, null where it holds none."""

    def best(fact: Column) -> Column:
        low = F.lower(fact)
        cells = lambda r: F.filter(F.transform(r, lambda c: F.trim(c)), lambda c: (F.length(c) >= least) & F.contains(low, F.lower(c)))
        scores = F.transform(rows, lambda r: F.aggregate(cells(r), F.lit(0), lambda s, c: s + F.length(c)))
        return F.when(F.array_max(scores) > 0, F.array_position(scores, F.array_max(scores)) - 1)

    return F.transform(facts, best)


def without_nodes(nodes: DataFrame, gone: Column, doc: str, order: str, node: str) -> DataFrame:
    """nodes without those that are gone (null: stays), with prev and next of what is left."""
    in_doc = Window.partitionBy(doc).orderBy(order, node)
    return nodes.where(~F.coalesce(gone, F.lit(False))).withColumn("prev", F.lag(node).over(in_doc)).withColumn("next", F.lead(node).over(in_doc))


# ---- questions and sources -------------------------------------------------------------


def surface_form(text, forms: dict[str, list[str]]) -> Column:
    """struct(value, residual): the first value, in order, one of whose forms (in lower case) text holds; residual is text without that form, with single blanks, null if nothing is left."""
    text = X._c(text)
    residual = lambda t: F.nullif(F.trim(F.regexp_replace(t, r"\s+", " ")), F.lit(""))
    at = lambda form: F.instr(F.lower(text), form)
    without = lambda form: F.concat(F.substring(text, F.lit(1), at(form) - 1), F.substring(text, at(form) + len(form), F.length(text)))
    pair = lambda value, rest: F.struct(value.cast("string").alias("value"), rest.alias("residual"))
    tried = [(value, form) for value, listed in forms.items() for form in listed]
    return reduce(lambda rest, x: F.when(at(x[1]) > 0, pair(F.lit(x[0]), residual(without(x[1])))).otherwise(rest), reversed(tried), pair(F.lit(None), residual(text)))


def source_kind(doc_id, heading_path, page_start) -> Column:
    """DOC if one of a passage's marks is there, else SQL."""
    some = F.coalesce(F.length(X._c(doc_id).cast("string")) > 0, F.lit(False)) | F.coalesce(F.size(heading_path) > 0, F.lit(False)) | X._c(page_start).isNotNull()
    return F.when(some, "DOC").otherwise("SQL")


def source_suffix(doc_id, heading_path, page_start, page_end, images) -> Column:
    """', doc=…, section=a > b, page=1-2, images=3' with the parts that are there; paths and image names are not told."""
    name = X._c(doc_id).cast("string")
    start, end = X._c(page_start).cast("string"), X._c(page_end).cast("string")
    pages = F.concat(F.lit("page="), start, F.when(end.isNotNull() & (end != start), F.concat(F.lit("-"), end)).otherwise(""))
    bits = F.concat_ws(
        ", ", F.when(F.length(name) > 0, F.concat(F.lit("doc="), name)), F.when(F.size(heading_path) > 0, F.concat(F.lit("section="), F.concat_ws(" > ", heading_path))), pages, F.when(X._c(images) > 0, F.concat(F.lit("images="), X._c(images).cast("string"))))
    return F.when(bits == "", "").otherwise(F.concat(F.lit(", "), bits))


def normal_label(text) -> Column:
    """A table label without markup, leading numbers and signs, in lower case with single blanks."""
    out = F.lower(text)
    for pattern, by in ((r"<br\s*/?>", " "), (r"^#+\s*", ""), (r"^\d+(\.\d+)*\s+", ""), (r"[®™*:()\[\]_/\\&]", " "), (r"\s+", " "), (r"^[ .\-–—]+|[ .\-–—]+$", "")):
        out = F.regexp_replace(out, pattern, by)
    return out


# ---- facts and records -------------------------------------------------------------------


def classify_facts(facts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """facts (block, key, is_new_key, condition) with the block mended and kind, outcome and reason added.

    dictionary: block, key, kind, conditions (array). It decides, not the claim
    that a key is new: a key it has is processed; of keys it has in one other
    block only, the block is mended; the rest of the new ones are new_key. What
    is unknown without the claim, or has a condition outside the closed list, or
    none although its kind is conditional, is dropped with a reason. Both joins
    are on equal keys, so the size of the dictionary decides about a broadcast.
    """
    exact = dictionary.select("block", "key", F.col("kind").alias("__kind"), F.col("conditions").alias("__list"))
    sole = dictionary.groupBy("key").agg(F.min(F.struct("block", "kind", "conditions")).alias("__sole"), F.countDistinct("block").alias("__n")).where("__n = 1").drop("__n")
    joined = facts.join(exact, ["block", "key"], "left").join(sole, "key", "left")
    new = F.coalesce("is_new_key", F.lit(False)) & F.col("__kind").isNull()
    moved = new & F.col("__sole").isNotNull()
    joined = joined.withColumn("block", F.when(moved, F.col("__sole.block")).otherwise(F.col("block"))).withColumn("kind", F.when(moved, F.col("__sole.kind")).otherwise(F.col("__kind"))).withColumn("__list", F.when(moved, F.col("__sole.conditions")).otherwise(F.col("__list")))
    given = F.nullif("condition", F.lit(""))
    listed = F.coalesce(F.array_contains("__list", given), F.lit(False))
    queued = F.coalesce("is_new_key", F.lit(False)) & F.col("kind").isNull()
    reason = F.when(queued, None).when(F.col("kind").isNull(), "unknown key").when(given.isNotNull() & ~listed, "condition outside the closed list").when((F.col("kind") == "conditional") & given.isNull(), "conditional without condition")
    out = joined.withColumn("reason", reason).withColumn("outcome", F.when(queued, "new_key").when(F.col("reason").isNull(), "ok").otherwise("dropped"))
    return out.withColumn("condition", given).drop("__kind", "__list", "__sole")


def incremental_codes(changed: DataFrame, pending: DataFrame, owners: DataFrame, stale: DataFrame) -> DataFrame:
    """Distinct product codes to do again: owners of changed and of pending documents (doc_id), and those found stale (code)."""
    docs = changed.select("doc_id").unionByName(pending.select("doc_id"))
    return owners.join(docs, "doc_id", "left_semi").select("code").unionByName(stale.select("code")).where("code is not null").distinct()


def upserted(registry: DataFrame, seen: DataFrame, key: str, identity: str) -> DataFrame:
    """registry after seen: a known key is MODIFIED and keeps its identity, others are NEW; what was not seen stays as it is, with no verdict. Keys are unique on either side."""
    known = registry.select(key, F.col(identity).alias("__known"))
    fresh = seen.join(known, key, "left")
    verdict = F.when(F.col("__known").isNull(), "NEW").otherwise("MODIFIED")
    fresh = fresh.withColumn("verdict", verdict).withColumn(identity, F.coalesce("__known", identity)).drop("__known")
    return registry.join(seen.select(key), key, "left_anti").withColumn("verdict", F.lit(None).cast("string")).unionByName(fresh)
