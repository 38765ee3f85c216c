"""How repeating and overlapping items become tables: ordered rules as conditions over one row."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.picture import sql_type
from granary.functions.text import or_null
from granary.operators.intervals import below
from granary.sources.repository import cut, dealt

# fixed values: counts at which a repetition changes its form
INLINE_MOST, SAFE_MOST, CONFIDENT_MOST = 20, 200, 100


def occurs_value(text: Column) -> Column:
    """Struct min, max, variable, unknown of a stated repetition: a number, `n TIMES`, or `n TO m DEPENDING ON x`."""
    t = F.upper(text)
    low, high = or_null(F.regexp_extract(t, r"(\d+)", 1)).cast("int"), or_null(F.regexp_extract(t, r"(\d+)\s+TO\s+(\d+)", 2)).cast("int")
    variable = F.coalesce(t.contains("DEPENDING") | high.isNotNull(), F.lit(False))
    return F.struct(low.alias("min"), F.coalesce(high, low).alias("max"), variable.alias("variable"), low.isNull().alias("unknown"))


def occurs_strategy(*, variable: Column, unknown: Column, count: Column, is_group: Column, nested: Column, has_redefines: Column, has_picture: Column, element: Column) -> Column:
    """Struct strategy, confidence, element_type of a repeating item."""
    review = variable | unknown | (nested > 0) | has_redefines | (count > SAFE_MOST) | (~is_group & (~has_picture | element.isNull()))
    strategy = F.when(review, "REVIEW_REQUIRED").when(is_group, "CHILD_TABLE").when(count <= INLINE_MOST, "INLINE_ARRAY").otherwise("CHILD_TABLE")
    confidence = F.when(review, "LOW").when(is_group, F.when(count <= CONFIDENT_MOST, "HIGH").otherwise("MEDIUM")).when(count <= INLINE_MOST, "HIGH").otherwise("MEDIUM")
    shown = F.when(~review & ~is_group, F.when(count <= INLINE_MOST, F.concat(element, F.lit("[]"))).otherwise(element))
    return F.struct(strategy.alias("strategy"), confidence.alias("confidence"), shown.alias("element_type"))


def redefines_strategy(*, original: Column, alternate: Column, parsed: Column) -> Column:
    """Struct strategy, confidence of an overlay; original and alternate are structs of `structure` (null if missing).

    parsed: whether the overlay comes from the layout parser, which knows that a repetition inside it is unresolved.
    """
    o, a = original, alternate
    overlap = F.coalesce(o["length"] == a["length"], F.lit(False))
    fits = overlap | F.coalesce(a["length"] <= o["length"], F.lit(True))
    rules = [
        (o.isNull() | a.isNull(), "REVIEW_REQUIRED", F.lit("LOW")),
        (a["redefines"] > 0, "REVIEW_REQUIRED", F.lit("LOW")),
        ((a["occurs"] > 0) & parsed, "REVIEW_REQUIRED", F.lit("LOW")),
        (a["occurs"] > 0, "SEPARATE_TABLES", F.lit("MEDIUM")),
        ((o["leaves"] <= 1) & (a["leaves"] <= 1), "SAME_TABLE", F.lit("HIGH")),
        (a["is_group"] & fits & (o["leaves"] <= 5) & (a["leaves"] <= 12) & (a["safe"] > 0), "ALTERNATE_REPRESENTATION", F.when(overlap, "HIGH").otherwise("MEDIUM")),
        ((a["leaves"] > 5) & (o["leaves"] > 5), "SEPARATE_TABLES", F.lit("MEDIUM")),
        (a["is_group"] & (o["leaves"] <= 1), "REVIEW_REQUIRED", F.lit("LOW")),
    ]
    strategy = confidence = None
    for holds, name, sure in rules:
        strategy = F.when(holds, name) if strategy is None else strategy.when(holds, name)
        confidence = F.when(holds, sure) if confidence is None else confidence.when(holds, sure)
    return F.struct(strategy.otherwise("SAME_TABLE").alias("strategy"), confidence.otherwise("HIGH").alias("confidence"))


def descendants(nodes: DataFrame) -> DataFrame:
    """(root, node_id, distance) of every node and all below it, itself included; conditions and renamings left out.

    One round a level, until a level is empty; a node that is below itself raises.
    """
    storage = nodes.where(~F.col("node_type").isin("CONDITION", "RENAMES")).select("node_id", "parent_id")
    level = storage.select(F.col("node_id").alias("root"), "node_id", F.lit(0).alias("distance"))
    out = level
    for d in itertools.count(1):
        level = level.select("root", F.col("node_id").alias("parent_id")).join(storage, "parent_id").select("root", "node_id", F.lit(d).alias("distance"))
        level = cut(level)
        if level.where("root = node_id").take(1):
            raise ValueError("a node is below itself")
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def structure(nodes: DataFrame) -> DataFrame:
    """For every storage item: leaves, repetitions and overlays below it (its own left out), safe named leaves, length.

    nodes have the intervals of their subtrees, so all of these are differences of running sums.
    """
    stores, elementary = ~F.col("node_type").isin("CONDITION", "RENAMES"), F.col("pic").isNotNull()
    safe = elementary & ~F.col("is_filler") & F.col("byte_length").isNotNull()
    found = below(
        nodes, leaves=stores & elementary, occurs=stores & F.col("occurs_min").isNotNull(), redefines=stores & F.col("redefines_target").isNotNull(),
        safe=stores & safe, _items=stores,
    ).where(stores)
    return found.withColumns({"leaves": F.col("leaves") + elementary.cast("long"), "is_group": F.col("_items") > 0}).drop("_items")


def overlays(nodes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """node_id, target_id, strategy, confidence of every overlay; its target is the last earlier sibling of that name."""
    known = known or cut(structure(nodes).select("path", "node_id", "parent_id", "seq", "name", "redefines_target", "byte_length", "leaves", "occurs", "redefines", "safe", "is_group"))
    facts = F.struct(F.col("byte_length").alias("length"), "leaves", "occurs", "redefines", "safe", "is_group")
    one = known.where("redefines_target IS NOT NULL").select("path", "node_id", "parent_id", "seq", "redefines_target", facts.alias("alternate"))
    other = known.select(F.col("path").alias("_path"), F.col("parent_id").alias("_parent"), F.col("seq").alias("_seq"), F.col("name").alias("_name"), F.col("node_id").alias("target_id"), facts.alias("original"))
    pairs = one.join(dealt(other), (F.col("path") == F.col("_path")) & F.col("parent_id").eqNullSafe(F.col("_parent")) & (F.col("redefines_target") == F.col("_name")) & (F.col("_seq") < F.col("seq")), "left")
    last = pairs.groupBy("node_id").agg(F.max_by("target_id", "_seq").alias("target_id"), F.max_by("original", "_seq").alias("original"), F.first("alternate").alias("alternate"))
    return last.select("node_id", "target_id", redefines_strategy(original=F.col("original"), alternate=F.col("alternate"), parsed=F.lit(True)).alias("r")).select("node_id", "target_id", "r.*")


def repetitions(nodes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """node_id, strategy, confidence, element_type of every repeating item."""
    known = (known or structure(nodes)).where("occurs_min IS NOT NULL")
    element = sql_type(F.col("pic_category"), F.col("precision"), F.col("scale"), F.col("logical_length"), F.col("usage"))["sql_type"]
    found = occurs_strategy(
        variable=F.col("occurs_depending_on").isNotNull(), unknown=F.lit(False), count=F.coalesce("occurs_max", "occurs_min"), is_group=F.col("is_group"),
        nested=F.col("occurs"), has_redefines=F.col("redefines") > 0, has_picture=F.col("pic").isNotNull(), element=element,
    )
    return known.select("node_id", found.alias("o")).select("node_id", "o.*")
