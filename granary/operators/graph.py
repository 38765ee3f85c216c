"""Edges between programs, jobs, datasets and layouts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.text import col
from granary.sources.repository import cut

# fixed values: names that stand for no dataset
NO_DATASET = ("UNKNOWN", "DUMMY", "INSTREAM")


def edges(rows: DataFrame, source: str, target: str, kind: str) -> DataFrame:
    return rows.where(F.col(source).isNotNull() & F.col(target).isNotNull()).select(F.col(source).cast("string").alias("source_id"), F.col(target).cast("string").alias("target_id"), F.lit(kind).alias("rel_type"))


def first_of_each(rows: DataFrame, order: str, *key: str) -> DataFrame:
    """Of rows with one key the first in the given order."""
    key = key or ("source_id", "target_id", "rel_type")
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(order))).where("_n = 1").drop("_n")


def touching(all_edges: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """Edges at either end of some nodes, as one equi-join of their ends; an edge between two of them comes twice."""
    wanted = nodes.select(F.col(node).cast("string").alias("node_id"))
    end = lambda c, d: F.struct(F.col(c).alias("node_id"), F.lit(d).alias("direction"))
    ends = all_edges.select("source_id", "target_id", "rel_type", F.inline(F.array(end("source_id", "out"), end("target_id", "in"))))
    return ends.join(wanted, "node_id").select("node_id", "source_id", "target_id", "rel_type", "direction")


def from_evidence(evidence: DataFrame) -> DataFrame:
    """Edges of evidence rows (artifact_id, evidence_type, entity_name, value, properties)."""
    of = lambda kind: evidence.where(F.col("evidence_type") == kind)
    files = edges(of("SELECT"), "artifact_id", "value", "ACCESSES")
    programs = edges(of("EXEC").where("value <> 'UNKNOWN'"), "artifact_id", "value", "EXECUTES_PROGRAM")
    named = of("DD").withColumn("dataset", F.col("properties")["dataset"]).where(~F.col("dataset").isin(*NO_DATASET))
    # both kinds from one reading of the statements
    used = edges(named, "artifact_id", "dataset", "").withColumn("rel_type", F.explode(F.array(F.lit("ALLOCATES"), F.lit("ALLOCATES_DATASET"))))
    return files.unionByName(programs).unionByName(used).distinct()


def from_lists(rows: DataFrame, source: str, targets: str, kind: str) -> DataFrame:
    """Edges from each row to every entry of its list: copied layouts (USES_COPYBOOK), rules (IMPLEMENTS_RULE), record
    layouts of a dataset (USES_RECORD_LAYOUT), child tables (OCCURS_CHILD_TABLE)."""
    return edges(rows.select(F.col(source).alias("_s"), F.explode(targets).alias("_t")), "_s", "_t", kind).distinct()


def keys(fields: DataFrame, dataset: str = "dsn", name: str = "name", is_key: str = "is_key") -> DataFrame:
    """HAS_KEY edges from datasets to those of their fields that are keys."""
    return edges(fields.where(is_key), dataset, name, "HAS_KEY").distinct()


def bucket(rel_type: str | Column) -> Column:
    """What an edge depends on, by what its type's name holds; null for other types."""
    kind = F.coalesce(col(rel_type), F.lit(""))
    has = lambda *words: reduce(Column.__or__, [kind.contains(w) for w in words])
    return F.when(has("COPYBOOK", "COPY"), "copybooks").when(has("DATASET", "READ", "WRITE"), "datasets").when(has("PROGRAM", "CALL"), "called_programs").when(has("FILE"), "files")


def dependencies(all_edges: DataFrame) -> DataFrame:
    """node_id, bucket, n_edges, n_targets: what each node refers to (bucket null: any other type) and what refers to it."""
    out = all_edges.select(F.col("source_id").alias("node_id"), F.col("target_id").alias("other"), bucket("rel_type").alias("bucket"))
    back = all_edges.select(F.col("target_id").alias("node_id"), F.col("source_id").alias("other"), F.lit("referenced_by").alias("bucket"))
    return out.unionByName(back).groupBy("node_id", "bucket").agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("other").alias("n_targets"))


def datasets_of_layouts(all_edges: DataFrame) -> DataFrame:
    """copybook, dataset: which datasets a layout describes, from USES_RECORD_LAYOUT edges."""
    return all_edges.where("rel_type = 'USES_RECORD_LAYOUT' AND source_id <> '' AND target_id <> ''").select(F.col("target_id").alias("copybook"), F.col("source_id").alias("dataset"))


def datasets_of_programs(programs: DataFrame, all_edges: DataFrame, program: str = "program") -> DataFrame:
    """program, n_datasets, first_dataset, operations: the distinct datasets that a program accesses, reads or writes.

    A program without one keeps its row, with UNKNOWN.
    """
    used = all_edges.where(F.col("rel_type").isin("ACCESSES", "READS", "WRITES")).select(F.col("source_id").alias("_p"), "target_id").distinct()
    told = used.groupBy("_p").agg(F.count("target_id").alias("_n"), F.min("target_id").alias("_first"))
    n = F.coalesce("_n", F.lit(0))
    return programs.join(told, F.col(program) == F.col("_p"), "left").select(F.col(program), n.alias("n_datasets"), F.coalesce("_first", F.lit("UNKNOWN")).alias("first_dataset"), F.when(n > 0, "READ").otherwise("").alias("operations"))


def parent_first(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """nodes with depth and place: sorted by place (an array of names) parents come before children, children by name.

    One round a level; nodes that no root reaches are left out.
    """
    level = nodes.where(F.col(parent).isNull()).select(F.col(node).alias("_node"), F.lit(0).alias("depth"), F.array(F.col(node).cast("string")).alias("place"))
    below = nodes.where(F.col(parent).isNotNull()).select(F.col(node).alias("_child"), F.col(parent).alias("_parent"))
    found = level
    while True:
        level = level.join(below, F.col("_node") == F.col("_parent")).select(F.col("_child").alias("_node"), (F.col("depth") + 1).alias("depth"), F.concat("place", F.array(F.col("_child").cast("string"))).alias("place"))
        level = cut(level)
        if level.isEmpty():
            return nodes.join(found, F.col(node) == F.col("_node")).drop("_node")
        found = found.unionByName(level)


def ancestors(paths: DataFrame, path: str) -> DataFrame:
    """Distinct folders above each path, with the number of paths below."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    n = F.size(parts)
    above = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    return paths.select(F.explode(above).alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("n_paths"))
