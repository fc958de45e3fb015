"""Entity-attribute-value facts: grid, validity, winners, evidence, comparison and the query predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallgrass.functions import text as X

# Trust of source kinds, best first.
TRUST = {"datasheet": 4, "catalogue": 3, "brochure": 2, "manual": 1}
KEYS = ("product_code", "block", "key", "condition")


def grid(products: DataFrame, attributes: DataFrame) -> DataFrame:
    """Every product with every attribute: not_specified where the attribute applies (scope null or the product's family), else not_applicable. attributes is the small dictionary; the product count times its rows is the result itself."""
    status = F.when(F.col("scope").isNull() | F.col("scope").eqNullSafe(F.col("family")), "not_specified").otherwise("not_applicable")
    return products.join(attributes).withColumn("status", status)


ENDS = ("val_min", "val_typ", "val_max")
PAYLOAD = ("num_value", "text_value", *ENDS, "bool_value")


def invalid_reason(kind: Column) -> Column:
    """Why a fact's slots (PAYLOAD, items, source_chunk_id, status) do not fit its kind; null if they do. A null status is no known one."""
    filled = F.coalesce(*[F.col(c).cast("string") for c in PAYLOAD]).isNotNull() | (F.coalesce(F.size("items"), F.lit(0)) > 0)
    number = {s: F.col(s).cast("string").try_cast("double") for s in ENDS}
    words = [F.when(F.col(s).isNotNull() & number[s].isNull(), f"{s} is not a number") for s in ENDS]
    low, typical, high = number.values()
    absent = F.col("status") != "present"
    return (
        F.when(~F.coalesce(F.col("status").isin("present", "absent", "not_specified"), F.lit(False)), "unknown status")
        .when(absent & filled, "payload without presence")
        .when((F.col("status") == "absent") & F.col("source_chunk_id").isNull(), "absence without source")
        .when(absent, None)
        .when((kind == "single") & (F.col("num_value").isNull() == F.col("text_value").isNull()), "single without exactly one value")
        .when((kind == "boolean") & F.col("bool_value").isNull(), "boolean without value")
        .when((kind == "range") & F.col("val_min").isNull() & F.col("val_max").isNull(), "range without ends")
        .when((kind == "min_typ_max") & F.coalesce(*[F.col(s).cast("string") for s in ENDS]).isNull(), "no end")
        .when((kind == "list") & (F.coalesce(F.size("items"), F.lit(0)) <= 0), "list without items")
        .otherwise(F.coalesce(*words, F.when(low > high, "ends out of order"), F.when((typical < low) | (typical > high), "typical outside the ends")))
    )


def coerce_kind(facts: DataFrame, wanted: str = "wanted") -> DataFrame:
    """facts with their slots moved, without loss, from their kind to the wanted one, and reason: null, or kind mismatch where no lossless move exists (then nothing moves).

    Facts of equal kind have a number in the wrong slot put right; facts that are
    not present only take the kind. Moves never overwrite a filled slot.
    """
    kind, to, num, text = F.col("kind"), F.col(wanted), F.col("num_value"), F.col("text_value")
    low, typical, high = (F.col(c) for c in ENDS)
    ends = F.array_compact(F.array(*ENDS))
    empty, items = F.size(ends) == 0, F.coalesce(F.size("items"), F.lit(-1))
    span, lone = kind.isin("range", "min_typ_max"), kind.isin("single", "conditional")
    outer = low.isNotNull() | high.isNotNull()
    # (wanted kind, what must hold, the move): the first that holds
    moves = [
        ("min_typ_max", (kind == to) & num.isNotNull() & empty, "number to typical"),
        ("range", (kind == to) & num.isNotNull() & ~outer, "number to ends"),
        ("list", (kind == to) & num.isNotNull() & (items <= 0), "value to item"),
        (None, kind == to, "stay"),
        ("conditional", (kind == "single") & num.isNotNull(), "stay"),
        ("single", (kind == "conditional") & num.isNotNull(), "stay"),
        ("single", span & typical.isNotNull(), "typical to number"),
        ("single", span & (F.size(F.array_distinct(ends)) == 1), "end to number"),
        ("single", (kind == "list") & (items == 1), "item to text"),
        ("min_typ_max", (kind == "single") & num.isNotNull(), "number to typical"),
        ("min_typ_max", (kind == "range") & outer, "stay"),
        ("range", (kind == "min_typ_max") & outer, "drop typical"),
        ("range", (kind == "min_typ_max") & typical.isNotNull(), "typical to ends"),
        ("range", lone & num.isNotNull(), "number to ends"),
        ("list", lone & F.coalesce(text, num.cast("string")).isNotNull(), "value to item"),
        ("list", span & ~empty, "ends to item"),
    ]
    move = F.coalesce(F.when(F.coalesce(F.col("status") != "present", F.lit(True)), "stay"), *[F.when(holds if k is None else (to == k) & holds, name) for k, holds, name in moves])
    marked = facts.withColumn("__move", move)
    does = lambda *names: F.coalesce(F.col("__move").isin(*names), F.lit(False))
    raw = F.nullif("raw_text", F.lit(""))
    value = F.when(does("value to item"), F.coalesce(text, num.cast("string"))).otherwise(F.coalesce(raw, F.array_join(F.transform(ends, lambda x: x.cast("string")), "-")))
    item = F.array(F.struct(F.lit(1).alias("ordinal"), X.item_slug(value).alias("item_code"), F.coalesce(raw, value).alias("item_text")))
    gone = does("typical to number", "end to number", "ends to item")
    new = {
        "num_value": F.when(does("typical to number"), typical).when(does("end to number"), ends[0]).when(~does("number to typical", "number to ends", "value to item"), num),
        "text_value": F.when(does("item to text"), F.coalesce(F.get("items", F.lit(0))["item_code"], F.get("items", F.lit(0))["item_text"])).when(~does("value to item"), text),
        "val_min": F.when(does("number to ends"), num).when(does("typical to ends"), typical).when(~gone, low),
        "val_max": F.when(does("number to ends"), num).when(does("typical to ends"), typical).when(~gone, high),
        "val_typ": F.when(does("number to typical"), num).when(~gone & ~does("drop typical", "typical to ends"), typical),
        "items": F.when(does("value to item", "ends to item"), item).when(~does("item to text"), F.col("items")),
        "kind": F.when(F.col("__move").isNotNull(), to).otherwise(kind),
    }
    return marked.select(*[new[c].alias(c) if c in new else F.col(c) for c in facts.columns], F.when(F.col("__move").isNull(), "kind mismatch").alias("reason"))


def winners(facts: DataFrame, keys: list[str], signature: str, trust: str, order: str) -> DataFrame:
    """One row a key and distinct value: rank 1 (greatest trust, then most rows, then first seen) is present, others conflicting."""
    groups = facts.groupBy(*keys, signature).agg(F.max(trust).alias("trust"), F.count("*").alias("n"), F.min(order).alias("first_seen"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("trust"), F.desc("n"), "first_seen"))
    return groups.withColumn("status", F.when(rank == 1, "present").otherwise("conflicting"))


def merge_evidence(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct (doc, chunk) of each key, most trusted first; the first is primary."""
    each = facts.groupBy(*keys, "doc_id", "chunk_id").agg(F.max("trust").alias("trust"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("trust")).alias("t"), "doc_id", "chunk_id")))
    return each.groupBy(*keys).agg(F.transform(ordered, lambda e: F.struct(e["doc_id"], e["chunk_id"])).alias("evidence"))


def comparison(facts: DataFrame, products: list, least: int = 2) -> DataFrame:
    """Present values aligned by key across products; keys that least products have."""
    wide = facts.where("status = 'present'").groupBy("key").pivot("product_code", products).agg(F.min("raw_text"))
    have = sum((F.col(f"`{p}`").isNotNull().cast("int") for p in products), F.lit(0))
    return wide.where(have >= least)


def interval_merge(facts: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """(keys, status, val_min, val_typ, val_max, facts): the values of each key after halves of one interval were joined.

    Equal values are one first. Then, in order of first appearance, a value joins
    the first group of its status with which no filled end differs, of which it
    fills an end or the other way round, and whose ends stay in order; otherwise
    it opens a group. What is folded is one array of distinct values a key.
    """
    each = facts.groupBy(*keys, "status", *ENDS).agg(F.min(order).alias("o"), F.count("*").alias("n"))
    listed = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("o", "status", *ENDS, "n"))).alias("values"))
    agree = lambda x, y: x.isNull() | y.isNull() | (x == y)
    joined = lambda g, v: {e: F.coalesce(g[e], v[e]) for e in ENDS}

    def fits(g, v):
        low, typical, high = joined(g, v).values()
        ordered = ~F.coalesce(low > high, F.lit(False)) & ~F.coalesce(typical < low, F.lit(False)) & ~F.coalesce(typical > high, F.lit(False))
        same = reduce(lambda a, b: a & b, [agree(g[e], v[e]) for e in ENDS])
        fills = reduce(lambda a, b: a | b, [g[e].isNull() != v[e].isNull() for e in ENDS])
        return g["status"].eqNullSafe(v["status"]) & same & fills & ordered

    def fold(groups, v):
        at = F.array_position(F.transform(groups, lambda g: fits(g, v)), F.lit(True))
        into = F.transform(groups, lambda g, i: F.when(i + 1 == at, F.struct(g["o"].alias("o"), g["status"].alias("status"), *[x.alias(e) for e, x in joined(g, v).items()], (g["n"] + v["n"]).alias("n"))).otherwise(g))
        return F.when(at > 0, into).otherwise(F.concat(groups, F.array(v)))

    kind = facts.schema
    empty = F.array().cast(f"array<struct<o:{kind[order].dataType.simpleString()},status:string,{','.join(f'{e}:{kind[e].dataType.simpleString()}' for e in ENDS)},n:bigint>>")
    return listed.select(*keys, F.explode(F.aggregate("values", empty, fold)).alias("g")).select(*keys, "g.status", *[f"g.{e}" for e in ENDS], F.col("g.n").alias("facts"))


# ---- predicates over facts ---------------------------------------------------


def answers(with_absent: bool = False) -> Column:
    return F.col("status").isin("present", "absent") if with_absent else F.col("status") == "present"


def supported_at(x) -> Column:
    return (F.col("val_min") <= x) & (F.col("val_max") >= x)


def at_least(x) -> Column:
    return F.coalesce("val_max", "num_value") >= x


def at_most(x) -> Column:
    return F.coalesce("val_min", "num_value") <= x


def exactly(x) -> Column:
    return F.coalesce("num_value", "val_typ") == x


def display(raw, text, number, flag, low, high, typical) -> Column:
    """What to show: raw, text, number, yes or no, low–high, typical."""
    return F.coalesce(raw, text, number.cast("string"), F.when(flag, "yes").when(~flag, "no"), F.when(low.isNotNull() & high.isNotNull(), F.concat_ws("–", low, high)), typical.cast("string"))
