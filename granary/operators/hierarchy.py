"""Hierarchies of jobs and of procedure fragments, and artifacts by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.text import code_area, col, is_comment, or_null
from granary.operators.layout import declarations

# fixed values: statements of a procedure fragment
STATEMENTS = "OPEN|READ|WRITE|REWRITE|DELETE|START|CLOSE|SORT|MERGE|PERFORM|CALL|MOVE|SET|IF|EVALUATE|STRING|COMPUTE"
# fixed values: the group in which an artifact is shown
GROUPS = {
    "COBOL": "programs", "COPYBOOK": "copybooks", "JCL": "jcl_jobs", "IDCAMS": "idcams_definitions", "CATALOG": "catalogs", "DATASET": "datasets",
    "OTHER": "other_artifacts", "PLI": "other_artifacts", "NATURAL": "other_artifacts", "RPG": "other_artifacts", "METADATA": "other_artifacts",
}


def allocations(evidence: DataFrame) -> DataFrame:
    """DD rows of evidence with the chain they belong to: a later part of a concatenation goes with the last DD before it
    that has its name in its step; one without such an owner stands for itself."""
    p = F.col("properties")
    rows = evidence.where("evidence_type = 'DD'").select(
        "path", "source_line", F.col("entity_name").alias("name"), F.coalesce(p["dataset"], F.col("value")).alias("dataset"), F.when(p["scope"] == "step", or_null(p["step_name"])).alias("step"),
        F.coalesce(p["is_concatenation"] == "true", F.lit(False)).alias("_goes_on"), "properties")
    own = W.partitionBy("path", "step", "name").orderBy("source_line")
    opens = ~F.col("_goes_on") | (F.row_number().over(own) == 1)
    rows = rows.withColumn("opens", opens).withColumn("chain", F.sum(F.col("opens").cast("int")).over(own.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return rows.drop("_goes_on")


def jobs(evidence: DataFrame) -> DataFrame:
    """One row a job: its own DDs, and its steps in the order in which they first appear, each with what it executes and
    its DDs with their concatenations.  A job's rows are gathered; a job is a file."""
    item = F.struct("source_line", "name", "dataset", "properties")
    chained = allocations(evidence).groupBy("path", "step", "name", "chain").agg(
        F.min_by(item, "source_line").alias("head"), F.array_sort(F.collect_list(F.when(~F.col("opens"), item)), lambda a, b: a["source_line"] - b["source_line"]).alias("concatenations"))
    dd = F.struct(F.col("head.source_line").alias("source_line"), F.col("head.name").alias("name"), F.col("head.dataset").alias("dataset"), F.col("head.properties").alias("properties"), "concatenations")
    dds = chained.select("path", "step", F.col("head.source_line").alias("line"), dd.alias("dd"), F.lit(None).cast("struct<source_line:int,program:string,kind:string>").alias("exec"))
    run = F.struct(F.col("source_line").cast("int").alias("source_line"), F.col("value").alias("program"), F.col("properties")["kind"].alias("kind"))
    step = F.coalesce(or_null(F.col("properties")["step_name"]), F.lit("UNASSIGNED"))
    runs = evidence.where("evidence_type = 'EXEC'").select("path", step.alias("step"), F.col("source_line").alias("line"), F.lit(None).cast(dds.schema["dd"].dataType).alias("dd"), run.alias("exec"))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col("line"), F.col(c).alias("x")))), lambda a, b: a["line"] - b["line"]), lambda s: s["x"])
    steps = dds.unionByName(runs).groupBy("path", "step").agg(F.min("line").alias("line"), in_order("exec").alias("exec"), in_order("dd").alias("dds"))
    one = F.when(F.col("step").isNotNull(), F.struct("line", F.col("step").alias("name"), "exec", "dds"))
    ordered = F.array_sort(F.collect_list(one), lambda a, b: a["line"] - b["line"])
    none = F.array().cast(steps.schema["dds"].dataType)
    return steps.groupBy("path").agg(F.coalesce(F.first(F.when(F.col("step").isNull(), F.col("dds")), True), none).alias("job_level_dds"), ordered.alias("steps"))


def fragments(lines: DataFrame) -> DataFrame:
    """(path, source_line, type, name, statement, paragraph) of layout files that declare no item: their paragraphs, and
    statements with the paragraph they stand in, below one root (line 0) a file."""
    rows = lines.join(declarations(lines).select("path").distinct(), "path", "left_anti")
    rows = rows.select("path", F.col("line_no").alias("source_line"), code_area("text").alias("text")).where(~is_comment("text"))
    label = F.upper(or_null(F.regexp_extract("text", r"(?i)^\s*([A-Z0-9][A-Z0-9-]*)\.\s*$", 1)))
    label = F.when(~label.rlike("^(END-|ELSE|WHEN)"), label)
    pattern = rf"(?i)^\s*(EXEC\s+(?:SQL|CICS)|{STATEMENTS})\b(?:\s+(.*))?"
    verb = F.when(label.isNull(), F.upper(or_null(F.regexp_extract("text", pattern, 1))))
    rest = or_null(F.rtrim(F.trim(F.regexp_extract("text", pattern, 2)), F.lit(".")))
    rows = rows.withColumns({"_label": label, "statement": verb, "_rest": rest}).where("_label IS NOT NULL OR statement IS NOT NULL")
    so_far = W.partitionBy("path").orderBy("source_line").rowsBetween(W.unboundedPreceding, W.currentRow)
    owner = F.when(F.col("statement").isNotNull(), F.last("_label", True).over(so_far))
    kind = F.when(F.col("_label").isNotNull(), "paragraph").otherwise("statement")
    found = rows.select("path", "source_line", kind.alias("type"), F.coalesce("_label", F.concat_ws(" ", "statement", "_rest")).alias("name"), "statement", owner.alias("paragraph"))
    none = F.lit(None).cast("string")
    roots = rows.select("path").distinct().select("path", F.lit(0).alias("source_line"), F.lit("copybook_fragment").alias("type"), F.lit("Procedure Fragment").alias("name"), none.alias("statement"), none.alias("paragraph"))
    return found.unionByName(roots)


def group_of(artifact_type: str | Column) -> Column:
    """The group of a type; null for one that is not shown."""
    groups = F.create_map(*[F.lit(x) for pair in GROUPS.items() for x in pair])
    return F.try_element_at(groups, F.upper(col(artifact_type)))


def grouped(canonical: DataFrame, older: DataFrame) -> DataFrame:
    """canonical rows (artifact_id, artifact_type, ...) with their group, and older rows (artifact_id, group, ...) that
    none of them replaces."""
    shown = canonical.withColumn("group", group_of("artifact_type")).where("group IS NOT NULL")
    return shown.unionByName(older.join(shown.select("group", "artifact_id").distinct(), ["group", "artifact_id"], "left_anti"), allowMissingColumns=True)
