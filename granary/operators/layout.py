"""Record layouts: declarations, their tree, and byte offsets with overlays and repetition.

A layout is an adjacency list: one row a declaration, with node_id, parent_id and seq (its line), and the interval of its
subtree.  The tree, lengths and offsets are one ordered pass over a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.picture import meaning, physical_length
from granary.functions.text import is_comment, or_null
from granary.operators.evidence import evidence
from granary.operators.intervals import numbered, placed
from granary.sources.repository import cut, dealt, parts

DECLARATION = r"(?i)^\s*(?:\d{6}\s+)?(\d{2})\s+([A-Z0-9_-]+)\b(.*)$"
OCCURS = r"(?i)\bOCCURS\s+(\d+)(?:\s+TO\s+(\d+))?\s+TIMES?(?:\s+DEPENDING\s+ON\s+([A-Z0-9_-]+))?"
USAGE = r"(?i)\b(?:USAGE\s+(?:IS\s+)?)?(COMP(?:UTATIONAL)?(?:-[12345])?|BINARY|PACKED-DECIMAL|INDEX|DISPLAY)\b"


def declarations(lines: DataFrame) -> DataFrame:
    """One row a level-number declaration of lines (path, line_no, text)."""
    of = lambda p, i=1, c="body": or_null(F.regexp_extract(c, p, i))
    rows = lines.where(~is_comment("text") & F.col("text").rlike(DECLARATION)).select(
        "path", F.col("line_no").alias("seq"), F.regexp_extract("text", DECLARATION, 1).cast("int").alias("level"), F.upper(F.regexp_extract("text", DECLARATION, 2)).alias("name"), F.regexp_extract("text", DECLARATION, 3).alias("body"))
    rows = rows.select(
        "path", "seq", "level", "name", F.upper(of(r"(?i)\bPIC(?:TURE)?\s+(?:IS\s+)?([A-Z0-9()V+*/$-]+)")).alias("pic"), of(USAGE).alias("stated_usage"),
        of(OCCURS).cast("int").alias("occurs_min"), F.coalesce(of(OCCURS, 2), of(OCCURS)).cast("int").alias("occurs_max"), F.upper(of(OCCURS, 3)).alias("occurs_depending_on"),
        F.upper(of(r"(?i)\bREDEFINES\s+([A-Z0-9_-]+)")).alias("redefines_target"), F.trim(of(r"(?i)\bVALUE\s+(?:IS\s+)?([^.]*)")).alias("initial_value"),
    )
    kind = F.when(F.col("level") == 88, "CONDITION").when(F.col("level") == 66, "RENAMES").when(F.col("pic").isNotNull(), "ELEMENTARY").otherwise("GROUP")
    rows = rows.select("*", kind.alias("node_type"), meaning("pic", "stated_usage").alias("m"), F.concat_ws(":", "path", "seq", "name").alias("node_id"))
    return rows.select("*", "m.*", (F.col("name") == "FILLER").alias("is_filler")).drop("m", "stated_usage").withColumnRenamed("category", "pic_category")


def tree(nodes: DataFrame) -> DataFrame:
    """nodes with parent_id, depth, enter and leave, from one ordered pass over each file."""
    return nodes.join(dealt(numbered(nodes).drop("path")), "node_id")


def layout(lines: DataFrame) -> DataFrame:
    """Declarations of lines with their tree (`tree`), byte_length, span_min, span_max, relative_offset and absolute_offset.

    Bytes come from the pass that numbers a file's items.  Conditions and renamings take no room.
    """
    nodes = cut(declarations(lines))
    low = lambda c: F.when(F.coalesce(c, F.lit(0)) == 0, 1).otherwise(F.col(c))
    own = physical_length(F.col("node_type"), F.col("logical_length"), F.col("precision"), F.col("usage"))
    most = F.coalesce(F.when(F.col("occurs_max") != 0, F.col("occurs_max")), low("occurs_min"))
    places = placed(nodes, own, low("occurs_min"), most).drop("path")
    n = parts(nodes)
    return nodes.repartition(n, "node_id").join(dealt(places.repartition(n, "node_id")), "node_id")


def record_lengths(nodes: DataFrame) -> DataFrame:
    """path, record_length_min, record_length_max over the roots of a file."""
    roots = nodes.where("parent_id IS NULL")
    return roots.groupBy("path").agg(F.max(F.col("absolute_offset") + F.coalesce("span_min", F.lit(0))).alias("record_length_min"), F.max(F.col("absolute_offset") + F.coalesce("span_max", F.lit(0))).alias("record_length_max"))


def node_evidence(nodes: DataFrame) -> DataFrame:
    """One row of evidence for each storage item, with what is known of it; conditions and renamings have none."""
    known = ("node_id", "level", "pic", "usage", "occurs_min", "occurs_max", "occurs_depending_on", "redefines_target", "is_filler", "byte_length", "absolute_offset")
    properties = {c: F.col(c) for c in known if c in nodes.columns}
    storage = nodes.where(~F.col("node_type").isin("CONDITION", "RENAMES"))
    return storage.select("path", F.col("seq").alias("source_line"), *evidence("COPYBOOK_NODE", "CopybookNode", F.col("name"), F.col("node_type"), properties))
