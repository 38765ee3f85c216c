"""Record trees as flat columns: a name for each path, running offsets, inherited repetition and inherited exclusion.

What an item has from those above it (names, repetition, overlay, the product of all repetitions, the bytes before it) is
handed down by doubling (`inherit`); what a group takes is a difference of running sums over its interval (`intervals`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.picture import legacy_type, older_length
from granary.operators.inherit import Handed, any_of, handed_down, nearest, path_of, product, total
from granary.operators.resolve import overlays, repetitions, structure
from granary.sources.repository import cut, dealt

_COLUMNS = (
    "path", "name", "source_field", "source_pic", "sql_type", "offset", "length", "source_hierarchy", "schema_status",
    "redefines_target", "is_excluded", "is_alternate_repr", "alternate_group", "occurs", "occurs_strategy",
)


def measured(nodes: DataFrame, **more: Handed) -> DataFrame:
    """Storage items of nodes (as `layout.layout` gives them) with names, times, overlay, own and byte places of the older rules.

    `times` is the repetition that holds for an item, its own or the nearest above; `size` what it takes, once for each of
    its repetitions.  A group repeats what its items take, and they repeat what they take by the same inherited count, as
    the older rules do.  What is part of an overlay takes no room, and stands where its record has come to.  A product of
    repetitions beyond 63 bits raises.  more: further values to hand down.
    """
    storage = nodes.where(~F.col("node_type").isin("CONDITION", "RENAMES"))
    own = F.nullif(F.col("occurs_min"), F.lit(0)).cast("long")
    usage = F.when(F.col("usage") != "DISPLAY", F.col("usage"))
    rows = storage.withColumn("_bytes", F.when(F.col("pic").isNotNull(), older_length(F.concat_ws(" ", "pic", usage))).otherwise(0).cast("long"))
    names, overlay = path_of(F.replace(F.col("name"), F.lit("-"), F.lit("_"))), F.col("redefines_target")
    rows = handed_down(rows, names=names, times=nearest(own), overlay=nearest(overlay), _gone=any_of(overlay.isNotNull()), **more)
    rows = handed_down(rows, _product=product(F.coalesce("times", F.lit(1)).cast("long")))
    # every item with bytes adds them to all groups above it, each time they repeat
    adds = F.when(F.col("_gone"), 0).otherwise(F.col("_bytes") * F.col("_product"))
    so_far = W.partitionBy("path").orderBy("enter").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = cut(rows.withColumn("_adds", adds).withColumn("_sum", F.sum("_adds").over(so_far)))
    # conditions and renamings have places of their own, so a subtree ends at the last storage item not after its leave
    marks = rows.select("path", F.col("enter").alias("_at"), "_sum", F.lit(None).cast("string").alias("node_id"))
    ends = rows.select("path", F.col("leave").alias("_at"), F.lit(None).cast("long").alias("_sum"), "node_id")
    order = W.partitionBy("path").orderBy("_at", F.col("node_id").isNotNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    reached = marks.unionByName(ends).withColumn("_end", F.last("_sum", True).over(order)).where("node_id IS NOT NULL").select("node_id", "_end")
    rows = rows.join(dealt(reached), "node_id")
    rows = rows.withColumn("size", F.expr("CASE WHEN _gone THEN 0L ELSE (_end - _sum + _adds) div (_product div coalesce(times, 1L)) END"))
    before = W.partitionBy("path", "parent_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long")).drop("_sum", "_end", "_adds")
    return handed_down(rows, place=total(F.col("_before")))


def flattened(nodes: DataFrame) -> DataFrame:
    """The older flat columns of layouts: one for each named elementary item, and one for each safe item of an overlay that
    stands for another view of the same bytes."""
    nodes = cut(nodes)
    known = cut(structure(nodes))
    over = overlays(nodes, known).select(F.col("node_id").alias("_over"), "target_id", F.col("strategy").alias("overlay_strategy"))
    again = repetitions(nodes, known).select(F.col("node_id").alias("_rep"), F.col("strategy").alias("_repeats"))
    decided = cut(nodes.join(dealt(again), F.col("node_id") == F.col("_rep"), "left").drop("_rep").join(dealt(over), F.col("node_id") == F.col("_over"), "left").drop("_over"))
    group = F.when(F.col("overlay_strategy") == "ALTERNATE_REPRESENTATION", F.col("node_id"))
    rows = cut(measured(decided, occurs_strategy=nearest(F.col("_repeats")), _view=nearest(group)))
    usage = F.when(F.col("usage") != "DISPLAY", F.col("usage"))
    mapped = legacy_type(F.concat_ws(" ", "pic", usage), "name")["sql_type"]
    leaf = rows.where("pic IS NOT NULL AND NOT is_filler").withColumn("sql_type", mapped)
    status = (
        F.when(F.col("times").isNotNull(), "TRANSFORMATION_REQUIRED: OCCURS")
        .when(F.col("_gone"), F.format_string("REVIEW_REQUIRED: REDEFINES (%s)", F.coalesce("overlay_strategy", F.lit("INHERITED"))))
        .otherwise("OK")
    )
    inner = F.slice("names", 1, F.size("names") - 1)
    plain = leaf.select(
        "path", F.array_join("names", "_").alias("name"), F.col("name").alias("source_field"), F.col("pic").alias("source_pic"), "sql_type", F.col("place").alias("offset"),
        F.col("_bytes").alias("length"), F.array_join(inner, ".").alias("source_hierarchy"), status.alias("schema_status"), F.col("overlay").alias("redefines_target"),
        F.col("_gone").alias("is_excluded"), F.lit(False).alias("is_alternate_repr"), F.lit(None).cast("string").alias("alternate_group"), F.col("times").alias("occurs"), "occurs_strategy",
    )
    heads = rows.where("overlay_strategy = 'ALTERNATE_REPRESENTATION'").select(
        F.col("node_id").alias("_group"), F.col("target_id").alias("_target"), F.col("names").alias("_names"), F.col("name").alias("_group_name"), F.col("redefines_target").alias("_target_name"), F.col("absolute_offset").alias("_starts"))
    places = rows.select(F.col("node_id").alias("_target"), F.col("place").alias("_target_place"))
    views = leaf.where("byte_length IS NOT NULL").join(dealt(heads), F.col("_view") == F.col("_group")).join(dealt(places), "_target")
    outer = F.slice("_names", 1, F.size("_names") - 1)
    views = views.select(
        "path", F.array_join(F.concat(outer, F.array(F.replace(F.col("name"), F.lit("-"), F.lit("_")))), "_").alias("name"), F.col("name").alias("source_field"), F.col("pic").alias("source_pic"), "sql_type",
        (F.col("_target_place") + F.col("absolute_offset") - F.col("_starts")).alias("offset"), F.col("_bytes").alias("length"), F.array_join("_names", ".").alias("source_hierarchy"),
        F.concat(F.lit("ALTERNATE_REPRESENTATION: "), F.col("_target_name")).alias("schema_status"), F.col("_target_name").alias("redefines_target"), F.lit(False).alias("is_excluded"),
        F.lit(True).alias("is_alternate_repr"), F.col("_group_name").alias("alternate_group"), F.lit(None).cast("long").alias("occurs"), F.lit(None).cast("string").alias("occurs_strategy"),
    )
    return plain.unionByName(views).select(*_COLUMNS)
