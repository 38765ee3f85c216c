"""Program structure: divisions, sections, paragraphs, file descriptions, copies and operations, each with its owner.

Every line is at most one marker.  Owners are the last markers of each kind at or before a line, so the tree is windows
over (path, line_no): one exchange, no joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.text import code_area, is_comment, or_null
from granary.operators.lookup import best
from granary.sources.repository import spread

# fixed values: verbs that make an operation
VERBS = "OPEN|READ|WRITE|REWRITE|DELETE|START|CLOSE|SORT|MERGE|PERFORM|CALL|MOVE|IF|EVALUATE"
# fixed values: qualifiers of dataset names that say nothing about a record
IGNORED_QUALIFIERS = ("AWS", "M2", "VSAM", "KSDS", "PS", "CARDDEMO")
NAME = r"[A-Z0-9#$@-]+"


def markers(lines: DataFrame) -> DataFrame:
    """(path, line_no, division, kind, name, target) of the lines that mark structure; the first rule that holds."""
    rows = spread(lines, "path").select("path", "line_no", code_area("text").alias("text")).where(~is_comment("text"))
    of = lambda p, i=1: F.upper(or_null(F.regexp_extract("text", rf"(?i){p}", i)))
    so_far = W.partitionBy("path").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("_div", of(r"^\s*(IDENTIFICATION|ENVIRONMENT|DATA|PROCEDURE)\s+DIVISION\."))
    rows = rows.withColumn("division", F.last("_div", True).over(so_far)).where("division IS NOT NULL")
    program, section = of(rf"^\s*PROGRAM-ID\.\s*({NAME})"), of(r"^\s*([A-Z][A-Z0-9-]*)\s+SECTION\.")
    fd, copy = of(rf"^\s*FD\s+({NAME})\b"), of(rf"^\s*COPY\s+({NAME})\b")
    paragraph = of(r"^\s{0,7}([A-Z0-9][A-Z0-9-]*)\.\s*$")
    verb = F.coalesce(F.regexp_replace(of(r"^\s*(EXEC\s+(?:CICS|SQL))"), r"\s+", " "), of(rf"^\s*({VERBS})\b"))
    rest = or_null(F.btrim(F.regexp_replace(F.regexp_extract("text", rf"(?i)^\s*(?:{VERBS})\b\s*(.*)", 1), r"\.+\s*$", "")))
    data, procedure = F.col("division") == "DATA", F.col("division") == "PROCEDURE"
    kind = (
        F.when(F.col("_div").isNotNull(), "division")
        .when(program.isNotNull() & (F.col("division") == "IDENTIFICATION"), "program_id")
        .when(section.isNotNull(), "section")
        .when((F.col("division") == "ENVIRONMENT") & F.col("text").rlike(r"(?i)^\s*FILE-CONTROL\."), "file_control")
        .when(fd.isNotNull() & data, "fd")
        .when(copy.isNotNull(), "copy")
        .when(procedure & paragraph.isNotNull() & ~F.upper(F.ltrim("text")).rlike("^(END-|ELSE|WHEN)"), "paragraph")
        .when(procedure & verb.isNotNull(), "operation")
    )
    rows = rows.withColumn("kind", kind).where("kind IS NOT NULL")
    k = F.col("kind")
    name = F.when(k == "division", F.col("_div")).when(k == "program_id", program).when(k == "section", section).when(k == "file_control", "FILE-CONTROL").when(k == "fd", fd).when(k == "copy", copy).when(k == "paragraph", paragraph).otherwise(verb)
    target = F.when((k == "operation") & ~verb.startswith("EXEC"), F.upper(F.btrim(F.regexp_extract(rest, r"^(\S+)", 1), F.lit("'\""))))
    return rows.select("path", "line_no", "division", "kind", name.alias("name"), or_null(target).alias("target"))


def owned(marks: DataFrame) -> DataFrame:
    """marks with section, fd, paragraph (the open ones) and owner: what a mark hangs under."""
    order = W.partitionBy("path").orderBy("line_no")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    k = F.col("kind")
    rows = marks.withColumn("_d", F.sum((k == "division").cast("int")).over(so_far))
    section = k.isin("section", "file_control")
    rows = rows.withColumn("_s", F.sum(section.cast("int")).over(W.partitionBy("path", "_d").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)))
    in_division = W.partitionBy("path", "_d").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    in_section = W.partitionBy("path", "_d", "_s").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = lambda when, w: F.last(F.when(when, F.col("name")), True).over(w)
    implied = F.when((F.col("division") == "DATA") & (F.sum((k == "fd").cast("int")).over(in_division) > 0), "FILE")
    rows = rows.select("*", F.coalesce(last(section, in_division), implied).alias("section"), last(k == "fd", in_section).alias("fd"), last(k == "paragraph", in_section).alias("paragraph"))
    outer = F.coalesce("section", "division")
    owner = (
        F.when(k == "division", F.lit(None).cast("string"))
        .when(k.isin("program_id", "section"), F.col("division"))
        .when(k == "copy", F.coalesce("fd", outer))
        .when(k == "operation", F.coalesce("paragraph", outer))
        .when(k == "file_control", F.coalesce(F.lag(F.col("section")).over(order), F.col("division")))
        .otherwise(outer)
    )
    return rows.select("path", "line_no", "division", "section", "fd", "paragraph", "kind", "name", "target", owner.alias("owner"))


def facts(marks: DataFrame) -> DataFrame:
    """One row a program: its divisions, sections, paragraphs, operations, called programs and copied layouts, in order."""
    listed = lambda when, c="name": F.transform(F.sort_array(F.collect_list(F.when(when & F.col(c).isNotNull(), F.struct("line_no", F.col(c).alias("v"))))), lambda x: x["v"])
    k = F.col("kind")
    return marks.groupBy("path").agg(
        F.array_distinct(listed(k == "division")).alias("divisions"), listed(k == "section").alias("sections"), listed(k == "paragraph").alias("paragraphs"), listed(k == "operation").alias("operations"),
        listed((k == "operation") & (F.col("name") == "CALL"), "target").alias("called_programs"), listed(k == "copy").alias("copybooks"),
    )


def item_owners(marks: DataFrame, items: DataFrame) -> DataFrame:
    """items (path, line_no, ...) with the section and file description that they stand in: an as-of join as a window."""
    places = marks.where(F.col("kind").isin("section", "fd", "division")).select("path", "line_no", F.lit(0).alias("_item"), "kind", "name", F.lit(None).cast("string").alias("item"))
    both = places.unionByName(items.select("path", "line_no", F.lit(1).alias("_item"), F.lit("item").alias("kind"), F.lit(None).cast("string").alias("name"), F.col("name").alias("item")))
    so_far = W.partitionBy("path").orderBy("line_no", "_item").rowsBetween(W.unboundedPreceding, W.currentRow)
    section = F.last(F.when(F.col("kind").isin("section", "division"), F.when(F.col("kind") == "section", F.col("name")).otherwise("")), True).over(so_far)
    fd = F.last(F.when(F.col("kind") != "item", F.when(F.col("kind") == "fd", F.col("name")).otherwise("")), True).over(so_far)
    return both.select("path", "line_no", "_item", "item", or_null(section).alias("section"), or_null(fd).alias("fd")).where("_item = 1").drop("_item")


def locate_layouts(datasets: DataFrame, marks: DataFrame, selects: DataFrame, copybooks: DataFrame) -> DataFrame:
    """dataset to layout file by dataset name, SELECT ... ASSIGN, FD and COPY; the first program and file by path.

    datasets (dataset), marks of `owned`, selects (path, name, assign_to), copybooks (path).  All steps are equi-joins: an
    assignment matches a qualifier of the dataset's name, without a trailing DATA.
    """
    parts = datasets.select("dataset", F.explode(F.split("dataset", r"\.")).alias("part")).where(~F.col("part").isin(*IGNORED_QUALIFIERS))
    parts = parts.select("dataset", F.regexp_replace("part", "DATA$", "").alias("assign_to")).where("assign_to <> ''")
    files = selects.select("path", F.col("name").alias("file"), F.regexp_replace("assign_to", "DATA$", "").alias("assign_to"))
    copies = marks.where("kind = 'copy' AND fd IS NOT NULL").select("path", F.col("fd").alias("file"), F.col("name").alias("copybook"), "line_no")
    known = copybooks.select(F.col("path").alias("copybook_path"), F.upper(F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)).alias("copybook"))
    found = parts.join(files, "assign_to").join(copies, ["path", "file"]).join(known, "copybook")
    return best(found, "dataset", F.col("path"), F.col("line_no"), F.col("copybook_path")).select("dataset", F.col("path").alias("program"), "copybook", "copybook_path")


def dataset_facts(candidates: DataFrame, sources: list[tuple[str, float, DataFrame]]) -> DataFrame:
    """Each candidate (dataset) with what the first source that knows it says; sources: name, confidence, rows (dataset, organization)."""
    every = None
    for rank, (name, confidence, rows) in enumerate([*sources, ("unknown", 0.2, candidates.select("dataset", F.lit("UNKNOWN").alias("organization")))]):
        part = rows.select("dataset", "organization", F.lit(name).alias("source"), F.lit(confidence).alias("confidence"), F.lit(rank).alias("rank"))
        every = part if every is None else every.unionByName(part)
    return best(every.join(candidates.select("dataset").distinct(), "dataset", "left_semi"), "dataset", F.col("rank"), F.col("organization")).drop("rank")
