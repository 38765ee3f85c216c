"""Layouts to relational schemas: tables, columns, foreign keys, decisions and notes for review.

Each storage item belongs to the table of its nearest repeated ancestor that becomes a child table, else to the record's.
What stands inside an unresolved overlay or repetition is left out and noted.  All layouts are resolved together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.picture import sql_type
from granary.functions.text import schema_identifier, stem
from granary.operators.inherit import any_of, handed_down, nearest, path_of
from granary.operators.resolve import overlays, repetitions, structure
from granary.sources.repository import cut


@dataclass(frozen=True)
class Schema:
    tables: DataFrame
    columns: DataFrame
    foreign_keys: DataFrame
    decisions: DataFrame
    reviews: DataFrame


def decisions(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """node_id, kind (filler, overlay, repetition), strategy, confidence, element_type."""
    filler = nodes.where("is_filler").select("node_id", F.lit("filler").alias("kind"), F.lit("EXCLUDE_FILLER").alias("strategy"), F.lit("HIGH").alias("confidence"), F.lit(None).cast("string").alias("element_type"))
    over = overlays(nodes, known).select("node_id", F.lit("overlay").alias("kind"), "strategy", "confidence", F.lit(None).cast("string").alias("element_type"))
    again = repetitions(nodes, known).join(over.select("node_id"), "node_id", "left_anti").join(filler.select("node_id"), "node_id", "left_anti")
    return filler.unionByName(over.join(filler.select("node_id"), "node_id", "left_anti")).unionByName(again.select("node_id", F.lit("repetition").alias("kind"), "strategy", "confidence", "element_type"))


def generate(nodes: DataFrame) -> Schema:
    """The schema of all layouts in nodes (as `layout.layout` gives them)."""
    # each of these is used several times below
    nodes = cut(nodes)
    decided = cut(decisions(nodes, cut(structure(nodes))))
    strategies = decided.select(F.col("node_id").alias("_node"), F.col("strategy").alias("_strategy"))
    storage = nodes.where(~F.col("node_type").isin("CONDITION", "RENAMES")).join(strategies, F.col("node_id") == F.col("_node"), "left").drop("_node")
    stops = ~F.col("_strategy").isin("CHILD_TABLE", "INLINE_ARRAY", "ALTERNATE_REPRESENTATION")
    child = F.when(F.col("_strategy") == "CHILD_TABLE", F.col("node_id"))
    # the child table that an item belongs to is that of the nearest decided item above it, or its own for a scalar
    storage = handed_down(storage, names=path_of(F.col("name")), child=nearest(child), gone=any_of(stops))
    known = cut(storage.select("*", schema_identifier(stem("path")).alias("record")))
    named = known.where("_strategy = 'CHILD_TABLE'").select(F.col("node_id").alias("child"), F.concat_ws("_", "record", schema_identifier(F.array_join("names", "_"))).alias("child_name"))
    items = known.where("NOT gone").join(named, "child", "left")
    items = cut(items.withColumn("table_name", F.coalesce("child_name", "record")))
    arrays = decided.where("kind = 'repetition'").select("node_id", "strategy", "element_type")
    leaves = items.where("pic IS NOT NULL AND NOT is_filler").join(arrays, "node_id", "left")
    mapped = sql_type(F.col("pic_category"), F.col("precision"), F.col("scale"), F.col("logical_length"), F.col("usage"))
    leaves = leaves.withColumn("m", mapped)
    base = schema_identifier("name")
    whole = schema_identifier(F.array_join("names", "_"))
    # a name that the table has already is replaced by the item's whole path, then numbered
    used = F.row_number().over(W.partitionBy("table_name", "_base").orderBy("seq")) > 1
    leaves = leaves.withColumn("_base", base).withColumn("_name", F.when(used, whole).otherwise(F.col("_base")))
    nth = F.row_number().over(W.partitionBy("table_name", "_name").orderBy("seq"))
    column = F.when(nth > 1, F.concat("_name", F.lit("_"), nth.cast("string"))).otherwise(F.col("_name"))
    typed = leaves.where("m.sql_type IS NOT NULL").select(
        "path", "table_name", (F.col("seq") + 10).alias("position"), column.alias("column_name"),
        F.when(F.col("strategy") == "INLINE_ARRAY", F.col("element_type")).otherwise(F.col("m.sql_type")).alias("sql_type"), F.lit(True).alias("nullable"), F.lit(None).cast("int").alias("key_position"), "node_id",
    )
    records = known.select("path", F.col("record").alias("table_name")).distinct().select("*", F.lit(None).cast("string").alias("parent_table"))
    # a child table stands in the one that its parent belongs to
    owner = known.select(F.col("node_id").alias("_up"), F.col("child").alias("_outer"))
    parent = named.select(F.col("child").alias("_outer"), F.col("child_name").alias("_parent"))
    nested = known.where("NOT gone AND _strategy = 'CHILD_TABLE'").select("path", "record", "parent_id", F.col("node_id").alias("child")).join(named, "child")
    nested = nested.join(owner, F.col("parent_id") == F.col("_up"), "left").join(parent, "_outer", "left")
    nested = nested.select("path", F.col("child_name").alias("table_name"), F.coalesce("_parent", "record").alias("parent_table"))
    tables = records.join(typed.select("table_name"), "table_name", "left_semi").unionByName(nested)
    key = lambda rows, position, name, kind, at: rows.select("path", "table_name", F.lit(position).alias("position"), F.lit(name).alias("column_name"), F.lit(kind).alias("sql_type"), F.lit(False).alias("nullable"), F.lit(at).alias("key_position"), F.lit(None).cast("string").alias("node_id"))
    columns = typed.unionByName(key(records.join(typed.select("table_name"), "table_name", "left_semi"), 1, "RECORD_ID", "BIGSERIAL", 1)).unionByName(key(nested, 1, "PARENT_RECORD_ID", "BIGINT", 1)).unionByName(key(nested, 2, "OCCURRENCE_INDEX", "INTEGER", 2))
    foreign = nested.select("table_name", F.lit("PARENT_RECORD_ID").alias("column_name"), F.col("parent_table").alias("target_table"), F.lit("RECORD_ID").alias("target_column"))
    noted = decided.where("strategy = 'REVIEW_REQUIRED'").join(known.select("node_id", "path", F.col("record").alias("table_name"), F.array_join("names", ".").alias("source_path")), "node_id")
    unmapped = leaves.where("m.sql_type IS NULL").select("path", "table_name", F.array_join("names", ".").alias("source_path"), F.lit("unsupported picture or usage").alias("reason"))
    reviews = noted.select("path", "table_name", "source_path", F.concat(F.col("kind"), F.lit(" needs review")).alias("reason")).unionByName(unmapped)
    return Schema(tables, columns, foreign, decided, reviews)
