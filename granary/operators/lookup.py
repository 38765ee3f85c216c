"""Joins with an order of preference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.text import basename
from granary.sources.repository import dealt, parts


def best(candidates: DataFrame, key: str, *order: Column) -> DataFrame:
    """Of the candidates of a key the first in order."""
    return candidates.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def with_fallback(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], value: str) -> DataFrame:
    """left with value: from the first pair of keys that finds a row of right.  right has one row for each key."""
    out, found = left, []
    for i, (a, b) in enumerate(keys):
        side = right.select(F.col(b).alias(f"_k{i}"), F.col(value).alias(f"_v{i}")).where(F.col(f"_k{i}").isNotNull())
        out = out.join(side, F.col(a) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        found.append(f"_v{i}")
    return out.withColumn(value, F.coalesce(*found)).drop(*found)


def marked(left: DataFrame, key: str, right: DataFrame, other: str, **marks: Column) -> DataFrame:
    """The rows of left whose key right has, with marks: whether a condition holds for any row of right with that key.

    One aggregate of right by key and one join of left with it, in partitions of a counted number of rows of right.
    """
    n = parts(right)
    known = right.where(F.col(other).isNotNull()).repartition(n, other).groupBy(F.col(other).alias("_key")).agg(*[F.bool_or(F.coalesce(c, F.lit(False))).alias(k) for k, c in marks.items()])
    return left.repartition(n, key).join(dealt(known), F.col(key) == F.col("_key")).drop("_key")


def owners(rows: DataFrame, marker: Column, group: str, *order: str) -> DataFrame:
    """rows with owner: the last marker at or before each row of its group (an as-of join as one window)."""
    so_far = W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("owner", F.last(marker, True).over(so_far))


def islands(rows: DataFrame, changed: Column, group: str, *order: str) -> DataFrame:
    """rows with island: numbers of runs that begin where changed holds."""
    so_far = W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("island", F.sum(changed.cast("int")).over(so_far))


def of_repository(rows: DataFrame, files: DataFrame, repositories: DataFrame, key: str = "file_id") -> DataFrame:
    """Rows (programs, layouts: with a file's id) whose file belongs to one of repositories (repository_id)."""
    own = files.join(repositories.select("repository_id").distinct(), "repository_id", "left_semi")
    return rows.join(own.select(key), key, "left_semi")


def with_evidence(nodes: DataFrame, evidence: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """nodes (path, line_no, type, ...) with evidence_ids: those of evidence (path, source_line, evidence_type, evidence_id)
    of the same file and line whose kind belongs to the node's type; null where there is none."""
    of = F.coalesce(*[F.when(F.col("evidence_type") == k, F.lit(t)) for t, k in kinds.items()])
    known = evidence.withColumn("_type", of).where("_type IS NOT NULL AND source_line IS NOT NULL")
    known = known.groupBy(F.col("path").alias("_path"), F.col("source_line").alias("_line"), "_type").agg(F.sort_array(F.collect_list("evidence_id")).alias("evidence_ids"))
    same = (F.col("path") == F.col("_path")) & (F.col("line_no") == F.col("_line")) & (F.col("type") == F.col("_type"))
    return nodes.join(known, same, "left").drop("_path", "_line", "_type")


def evidence_by_name(artifacts: DataFrame, evidence: DataFrame) -> DataFrame:
    """evidence with the artifact_id of artifacts (artifact_id, path) whose file has the same base name, whatever its case
    and folder; evidence of several artifacts comes once for each."""
    named = artifacts.select("artifact_id", F.upper(basename("path")).alias("_name")).where("_name <> ''").distinct()
    return evidence.withColumn("_name", F.upper(basename("path"))).join(named, "_name").drop("_name")


def schema_of_artifact(artifacts: DataFrame, generated: DataFrame) -> DataFrame:
    """artifacts (artifact_id) with the generated schema (place, artifact_id, ...) of their id, whatever its case; of several
    the first by place."""
    rows = generated.select(F.upper("artifact_id").alias("_id"), F.struct(*[c for c in generated.columns if c != "artifact_id"]).alias("schema"))
    first = rows.groupBy("_id").agg(F.min_by("schema", F.col("schema.place")).alias("schema"))
    return artifacts.join(first, F.upper("artifact_id") == F.col("_id"), "left").drop("_id")


def with_validation(generated: DataFrame, validations: DataFrame) -> DataFrame:
    """generated (schema_id, ...) with the last (by place) of validations (place, schema_id, validation_status)."""
    last = validations.groupBy("schema_id").agg(F.max_by("validation_status", "place").alias("validation_status"))
    return generated.join(last, "schema_id", "left")


def folders(files: DataFrame, *by: str) -> DataFrame:
    """The distinct folders (by, folder) that files (path) stand in, with all folders above them."""
    parts = F.filter(F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")
    depth = F.size(parts) - F.endswith("path", F.lit("/")).cast("int").bitwiseXOR(1)
    every = F.when(depth > 0, F.transform(F.sequence(F.lit(1), depth), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    return files.select(*by, F.explode(every).alias("folder")).distinct()


def repository_summary(files: DataFrame, *by: str) -> DataFrame:
    """Files (path, artifact_type) of each repository, by kind, and the folders they stand in."""
    kinds = {"programs": "COBOL", "copybooks": "COPYBOOK", "jcl": "JCL", "idcams": "IDCAMS", "catalogs": "CATALOG"}
    counts = files.groupBy(*by).agg(F.count(F.lit(1)).alias("total_files"), *[F.count_if(F.upper("artifact_type") == k).alias(f"n_{n}") for n, k in kinds.items()])
    n = folders(files, *by).groupBy(*by).agg(F.count(F.lit(1)).alias("total_folders"))
    return counts.join(n, list(by), "left").withColumn("total_folders", F.coalesce("total_folders", F.lit(0)))
