"""What can be said without parsers: inventories by extension, safe paths, jobs that failed; and rows for stores of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import basename, col, extension, or_null, short_stem, stem

# fixed values: extensions of the inventory that stands in for a failed run, and what it says
EXTENSIONS = (("programs", (".cbl", ".cob", ".cobol")), ("copybooks", (".cpy", ".copy")), ("jcl_jobs", (".jcl", ".job", ".cntl")))
INVENTORY_ONLY = "Inventory generated"
REPAIRED = "Pipeline parser failed, so a fallback inventory result was generated."
SCORE = 60
# fixed values: what the view of decisions shows besides events under review
DECISION_STAGES, LOUD = ("REDEFINES", "OCCURS"), ("WARNING", "ERROR", "CRITICAL")
# fixed values: operations that are counted, each where its name is part of what a program does
OPERATIONS = ("READ", "WRITE", "REWRITE", "DELETE")
# fixed values: order of the groups in which an artifact is looked up
GROUP_ORDER = ("programs", "copybooks", "jcl_jobs", "idcams_definitions", "catalogs", "other_artifacts", "datasets")


def file_group(path: str | Column) -> Column:
    """The group of a file by its extension alone."""
    ext = extension(path)
    return F.coalesce(*[F.when(ext.isin(*exts), name) for name, exts in EXTENSIONS], F.lit("other_files"))


def inventory(files: DataFrame, *by: str) -> DataFrame:
    """What a failed run of each upload (by) still knows of its files (path): numbers by group, a stand-in dataset, a score.

    Of files with one base name in a group one counts, but for other files.
    """
    rows = files.select(*by, "path", file_group("path").alias("_group"), short_stem("path").alias("_id"))
    n = lambda g: F.countDistinct(F.when(F.col("_group") == g, F.col("_id")))
    counts = rows.groupBy(*by).agg(*[n(g).alias(f"n_{g}") for g, _ in EXTENSIONS], F.count_if(F.col("_group") == "other_files").alias("n_other_files"))
    total = F.col("n_programs") + F.col("n_copybooks") + F.col("n_jcl_jobs") + F.col("n_other_files")
    return counts.select("*", total.alias("total_files"), F.lit(1).alias("n_datasets"), F.when(total > 0, SCORE).otherwise(0).alias("health"), F.lit(INVENTORY_ONLY).alias("readiness"))


def safe_path(path: str | Column) -> Column:
    """A path below its root with slashes, without empty and `.` parts; null for one that would leave the root or has a colon."""
    p = F.replace(col(path), F.lit("\\"), F.lit("/"))
    bad = (F.trim(p) == "") | p.startswith("/") | p.rlike(r"(^|/)\.\.(/|$)") | p.contains(":")
    parts = F.filter(F.split(p, "/"), lambda x: ~x.isin("", "."))
    return F.when(~bad, F.array_join(parts, "/"))


def upload_path(requested: str | Column, filename: str | Column) -> Column:
    """Where an uploaded file goes: the requested path, else its name; null without a name or for an unsafe path."""
    named = or_null(basename(filename)).isNotNull()
    return F.when(named, safe_path(F.coalesce(or_null(requested), col(filename))))


def repaired(jobs: DataFrame, uploads: DataFrame) -> DataFrame:
    """jobs (job_id, status, error, warning): one with an error is done with a warning if its upload (job_id) is there, and
    left out otherwise."""
    kept = uploads.select(F.col("job_id").alias("_upload")).distinct()
    rows = jobs.join(kept, F.col("job_id") == F.col("_upload"), "left")
    bad, there = F.coalesce(F.col("status") == "error", F.lit(False)), F.col("_upload").isNotNull()
    none = F.lit(None).cast("string")
    fixed = {"status": F.when(bad, "done").otherwise(F.col("status")), "error": F.when(bad, none).otherwise(F.col("error")), "warning": F.when(bad, REPAIRED).otherwise(F.col("warning"))}
    return rows.where(~bad | there).withColumns(fixed).drop("_upload")


def or_placeholder(rows: DataFrame, *values: Column) -> DataFrame:
    """rows, or one row of values if there are none."""
    some = rows.limit(1).select(F.lit(1).alias("_some"))
    one = rows.sparkSession.range(1).select(*[v.cast(rows.schema[c].dataType).alias(c) for v, c in zip(values, rows.columns, strict=True)])
    return rows.unionByName(one.join(F.broadcast(some), F.lit(True), "left_anti"))  # one row at most on either side


def is_decision(stage: str | Column, status: str | Column, severity: str | Column) -> Column:
    return F.coalesce(col(status) == "REVIEW_REQUIRED", F.lit(False)) | F.coalesce(col(stage).isin(*DECISION_STAGES), F.lit(False)) | F.coalesce(col(severity).isin(*LOUD), F.lit(False))


def operation_counts(rows: DataFrame, operations: str) -> DataFrame:
    """name, value: how many of all entries of a column of lists name an operation, so REWRITE counts as WRITE, too."""
    entries = rows.select(F.explode(operations).alias("_op"))
    counts = entries.agg(*[F.count_if(F.upper("_op").contains(x)).alias(x) for x in OPERATIONS])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(x).alias("name"), F.col(x).alias("value")) for x in OPERATIONS])))


def remote_edges(evidence: DataFrame) -> DataFrame:
    """relationship_id, source_type, source_id, target_type, target_id, relationship_type of SELECT and DD evidence (path,
    evidence_type, value); equal ones once."""
    source = short_stem("path")
    rules = (("SELECT", "Program", "ACCESSES"), ("DD", "File", "ALLOCATES"))
    row = lambda kind, name: F.struct(
        F.concat_ws("_", source, "value", F.lit(name)).alias("relationship_id"), F.lit(kind).alias("source_type"), source.alias("source_id"), F.lit("Dataset").alias("target_type"), F.col("value").alias("target_id"), F.lit(name).alias("relationship_type"))
    found = F.coalesce(*[F.when(F.col("evidence_type") == e, row(kind, name)) for e, kind, name in rules])
    return evidence.where("value IS NOT NULL").select(found.alias("r")).where("r IS NOT NULL").select("r.*").distinct()


def dataset_rows(evidence: DataFrame, candidates: DataFrame) -> DataFrame:
    """dataset, organization, first_by: datasets of cluster definitions, DDs (properties: dataset) and candidates (dataset).

    A definition's organization stands, the first by path and line; a dataset without one is UNKNOWN.
    """
    p = F.col("properties")
    kind = F.when(F.col("evidence_type") == "DEFINE_CLUSTER", 0).when(F.col("evidence_type") == "DD", 1)
    named = F.when(F.col("evidence_type") == "DEFINE_CLUSTER", F.col("entity_name")).otherwise(p["dataset"])
    rows = evidence.select(kind.alias("rank"), "path", "source_line", named.alias("dataset"), F.when(kind == 0, p["organization"]).alias("organization")).where("rank IS NOT NULL")
    none = F.lit(None).cast("string")
    rows = rows.unionByName(candidates.select(F.lit(2).alias("rank"), none.alias("path"), F.lit(None).cast("int").alias("source_line"), "dataset", none.alias("organization")))
    order = F.struct("rank", "path", "source_line")
    known = rows.where("dataset IS NOT NULL").groupBy("dataset").agg(F.min_by("organization", F.when(F.col("organization").isNotNull(), order)).alias("organization"), F.min("rank").alias("_rank"))
    by = F.element_at(F.array(F.lit("DEFINE_CLUSTER"), F.lit("DD"), F.lit("CANDIDATE")), F.col("_rank") + 1)
    return known.select("dataset", F.coalesce("organization", F.lit("UNKNOWN")).alias("organization"), by.alias("first_by"))


def looked_up(asked: DataFrame, artifacts: DataFrame) -> DataFrame:
    """asked (artifact_id) with the artifact (group, key) that it means, of artifacts (group, place, key, id, name, source_file).

    A key of that very spelling comes first; else what equals it without case, or without an extension, by key, id, name or
    file.  Of several the first by group, then by place.  All steps are one equi-join.
    """
    upper = lambda c: F.upper(F.coalesce(c, F.lit("")))
    file = basename("source_file")
    whole, short = F.array(upper("key"), upper("id"), upper("name"), upper(file)), F.array(stem("key"), upper("id"), upper("name"), stem(file))
    keys = lambda n, xs: F.transform(F.array_distinct(F.filter(xs, lambda x: x != "")), lambda x: F.struct(F.lit(n).alias("kind"), x.alias("value")))
    posted = F.concat(keys(0, F.array(F.col("key"))), keys(1, whole), keys(2, short))
    rank = F.coalesce(*[F.when(F.col("group") == g, i) for i, g in enumerate(GROUP_ORDER)], F.lit(len(GROUP_ORDER)))
    rows = artifacts.select(F.struct(rank.alias("rank"), "place").alias("_order"), F.struct("group", "key").alias("_found"), F.explode(posted).alias("p")).select("_order", "_found", "p.*")
    names = asked.select("artifact_id").distinct()
    own = F.concat(keys(0, F.array(F.col("artifact_id"))), keys(1, F.array(upper("artifact_id"))), keys(2, F.array(stem("artifact_id"))))
    met = names.select("artifact_id", F.explode(own).alias("p")).select("artifact_id", "p.*").join(rows, ["kind", "value"])
    best = met.groupBy("artifact_id").agg(F.min_by("_found", F.struct((F.col("kind") > 0).alias("loose"), "_order")).alias("_found"))
    return asked.join(best, "artifact_id", "left").select(*asked.columns, F.col("_found.group").alias("group"), F.col("_found.key").alias("key"))
