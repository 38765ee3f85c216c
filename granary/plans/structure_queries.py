"""Queries of the structure views, links and factorised joins, each beside its SQL.

Every document states an artifact of one of nine shapes, whose JSON facts follow from its numbers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import structures
from granary.plans.registry import register, table
from granary.plans.source_queries import _D, Stated, _docs, _each, _each_sql, repr_sql


def _text(text: str) -> str:
    """A concat() of text in which <x> stands for a number."""
    parts = text.replace("<", ">").split(">")
    return f"concat({', '.join(x if i % 2 else repr_sql(x) for i, x in enumerate(parts))})"


_KIND = "CASE k % 7 WHEN 0 THEN 'cobol' WHEN 1 THEN 'COBOL' WHEN 2 THEN 'COPYBOOK' WHEN 3 THEN 'COPYBOOK' WHEN 4 THEN 'JCL' WHEN 5 THEN 'IDCAMS' ELSE CASE k % 3 WHEN 0 THEN 'CATALOG' ELSE 'DATASET' END END"
_FACTS = {
    "k % 7 = 0": '{"properties":{"divisions":["IDENTIFICATION","PROCEDURE"],"sections":["S<c>"],"paragraphs":[],"called_programs":["SUB<c>"]},"copybooks_used":["LAY<w>"],"datasets_accessed":["D<s>","D<s>"]}',
    "k % 7 = 1": '{"properties":{"cobol_hierarchy":[{"type":"division","name":"DATA","children":[{"type":"section","name":"FILE","properties":{"line":<s>},"children":[{"type":"fd","name":"F<c>"}]}]},{"name":"X<w>"}]}}',
    "k % 7 = 2": '{"fields":[{"name":"R","level":1},{"name":"A","level":5,"pic":"X(<s>)"},{"name":"G","level":5},{"name":"B<c>","level":10,"pic":"9"},{"name":"Z","level":5}]}',
    "k % 7 = 3": '{"properties":{"copybook_model_version":"1"},"fields":[{"name":"R","level":1,"children":[{"name":"A<w>","level":5,"pic":"X(<s>)"}]},{"level":77}]}',
    "k % 7 = 4": '{"properties":{"jcl_hierarchy":{"job_level_dds":[{"name":"JOBLIB","dataset":"A.B","concatenations":[{"dataset":"C<s>"},{"dataset":"dummy"}]}],'
    '"steps":[{"name":"S1","exec":[{"program":"P<w>"}],"dds":[{"dd_name":"OUT","dataset":"DUMMY"}]},{"exec":[{"program":"UNKNOWN"}],"dds":[]}]}},"executed_programs":["P<w>"],"allocated_datasets":["A.B"]}',
    "k % 14 = 5": '{"properties":{"definitions":[{"command":"DEFINE CLUSTER","name":"V<s>","index_component":{"n":<c>}}]}}',
    "k % 14 = 12": '{"defined_clusters":["V<s>"]}',
    "k % 7 = 6 AND k % 3 = 0": '{"entries":[{"entry_type":"CLUSTER","name":"E<s>"},{"size":1}]}',
    "k % 7 = 6 AND k % 3 = 1": '{"organization":"KSDS","record_length":<s>,"properties":{"copybooks":["LAY<w>"]}}',
}
_JSON = f"CASE {' '.join(f'WHEN {when} THEN {_text(text)}' for when, text in _FACTS.items())} ELSE 'no json' END"
_ID = "concat('A', k)"

_NODE = ("artifact_id", "path", "type", "name")


def _nodes(when: str, *rows: tuple[str, str, str]) -> Stated:
    return tuple((_ID, f"'{path}'", f"'{kind}'", _text(name), when) for path, kind, name in rows)


_NODES = (
    *_nodes("k % 7 = 0", ("0", "program", "N<k>"), ("0.0", "division_group", "Divisions"), ("0.0.0", "division", "IDENTIFICATION"), ("0.0.1", "division", "PROCEDURE"), ("0.1", "section_group", "Sections"), ("0.1.0", "section", "S<c>"),
            ("0.2", "copy_group", "COPY References"), ("0.2.0", "copy_reference", "LAY<w>"), ("0.3", "file_group", "File References"), ("0.3.0", "file_reference", "D<s>"), ("0.3.1", "file_reference", "D<s>")),
    *_nodes("k % 7 = 1", ("0", "program", "N<k>"), ("0.0", "division", "DATA"), ("0.0.0", "section", "FILE"), ("0.0.0.0", "fd", "F<c>"), ("0.1", "node", "X<w>")),
    *_nodes("k % 7 = 2", ("0", "field", "R"), ("0.0", "field", "A"), ("0.1", "field", "G"), ("0.1.0", "field", "B<c>"), ("0.2", "field", "Z")),
    *_nodes("k % 7 = 3", ("0", "field", "R"), ("0.0", "field", "A<w>"), ("1", "field", "UNKNOWN")),
    *_nodes("k % 7 = 4", ("0", "job", "N<k>"), ("0.0", "dd", "JOBLIB"), ("0.0.0", "dataset", "A.B"), ("0.0.1", "dataset", "C<s>"), ("0.1", "step", "S1"), ("0.1.0", "exec", "P<w> EXEC"), ("0.1.1", "dd", "OUT"), ("0.2", "step", "UNASSIGNED"), ("0.2.0", "exec", "EXEC")),
    *_nodes("k % 7 = 5", ("0", "command", "DEFINE CLUSTER")), *_nodes("k % 14 = 5", ("0.0", "index", "INDEX")),
    *_nodes("k % 7 = 6 AND k % 3 = 0", ("0", "cluster", "E<s>"), ("1", "catalog_entry", "UNKNOWN")),
    *_nodes("k % 7 = 6 AND k % 3 = 1", ("0", "dataset", "N<k>")),
)


def _artifacts(spark, sf_dir):
    rows = _docs(spark, sf_dir).select(F.expr(_ID).alias("artifact_id"), F.expr(_KIND).alias("artifact_type"), F.expr("concat('N', k)").alias("name"), F.lit(None).cast("string").alias("source_file"), F.expr(_JSON).alias("facts"))
    return structures.canonical(rows)


@register("q86_structure_nodes", f"WITH {_D} {_each_sql(_NODE, _NODES)}")
def q86(spark, sf_dir):
    return structures.view(_artifacts(spark, sf_dir)).select("artifact_id", F.array_join("path", ".").alias("path"), "type", "name")


@register("q87_structure_available", f"""WITH {_D}, n AS (SELECT artifact_id, count(*) AS n_nodes FROM ({_each_sql(_NODE, _NODES)}) GROUP BY 1)
SELECT {_ID} AS artifact_id, upper({_KIND}) AS artifact_type, n_nodes IS NOT NULL AS available, CASE WHEN n_nodes IS NULL THEN '{structures.NO_VIEW}' END AS message, coalesce(n_nodes, 0) AS n_nodes,
 CASE WHEN k % 7 IN (2, 3) THEN concat('X(', s, ')') END AS first_pic FROM p LEFT JOIN n ON n.artifact_id = {_ID}""")
def q87(spark, sf_dir):
    found = _artifacts(spark, sf_dir)
    nodes = structures.view(found)
    pics = nodes.where("type = 'field'").groupBy("artifact_id").agg(F.min_by(structures.of("properties", "$.pic", "string"), F.when(structures.of("properties", "$.pic", "string").isNotNull(), F.col("path"))).alias("first_pic"))
    return structures.availability(found, nodes).join(pics, "artifact_id", "left")


#: Relations: each artifact with one of a hundred, with its neighbour, and with itself.
_EDGE = ("place", "source_id", "target_id", "rel_type")
_EDGES = (
    ("3 * k", _ID, "concat('A', k % 100)", "CASE k % 3 WHEN 0 THEN 'USES_COPYBOOK' WHEN 1 THEN 'READS' ELSE 'CALLS' END", "true"),
    ("3 * k + 1", _ID, "concat('A', k + 1)", "'RELATES'", "k % 2 = 0"), ("3 * k + 2", _ID, _ID, "'COPY_FILE'", "k % 5 = 0"),
)
_LISTS = (
    (_ID, "'copybooks'", "concat('LAY', w)", "k % 7 = 0"), (_ID, "'datasets'", "concat('D', s)", "k % 7 = 0"), (_ID, "'called_programs'", "concat('SUB', c)", "k % 7 = 0"), (_ID, "'called_programs'", "concat('P', w)", "k % 7 = 4"),
    (_ID, "'referenced'", "'A.B'", "k % 7 = 4"), (_ID, "'referenced'", "concat('V', s)", "k % 14 = 12"), (_ID, "'copybooks'", "concat('LAY', w)", "k % 7 = 6 AND k % 3 = 1"),
)


@register("q88_structure_links", f"""WITH {_D}, e AS ({_each_sql(_EDGE, _EDGES)}),
r AS (SELECT source_id AS artifact_id, 'references' AS role, target_id AS other FROM e UNION SELECT target_id, 'referenced_by', source_id FROM e WHERE source_id <> target_id
 UNION SELECT source_id, CASE WHEN contains(rel_type, 'COPY') THEN 'copybooks' WHEN contains(rel_type, 'READ') THEN 'datasets' WHEN contains(rel_type, 'CALL') THEN 'called_programs' END, target_id FROM e
 UNION {_each_sql(('artifact_id', 'role', 'other'), _LISTS).replace('UNION ALL', 'UNION')})
SELECT * FROM r WHERE role IS NOT NULL AND artifact_id IN (SELECT {_ID} FROM p)""")
def q88(spark, sf_dir):
    edges = _each(_docs(spark, sf_dir), _EDGE, _EDGES)
    return structures.links(_artifacts(spark, sf_dir), edges).select("artifact_id", "role", "other")


@register("q89_dataset_analyses", f"""WITH {_D}, d AS (SELECT DISTINCT source AS dsn FROM documents WHERE source IS NOT NULL),
a AS (SELECT k, CASE k % 4 WHEN 0 THEN [] WHEN 1 THEN ['src1', concat('src', w), 'src1'] WHEN 2 THEN ['nowhere'] END AS related FROM p)
SELECT dsn, count(DISTINCT CASE WHEN list_contains(related, dsn) THEN k END) AS n_named, count(DISTINCT CASE WHEN coalesce(len(related), 0) = 0 THEN k END) AS n_for_all FROM d, a GROUP BY 1""")
def q89(spark, sf_dir):
    datasets = table(spark, sf_dir, "documents").select(F.col("source").alias("dsn"))
    related = F.expr("CASE k % 4 WHEN 0 THEN array() WHEN 1 THEN array('src1', concat('src', w), 'src1') WHEN 2 THEN array('nowhere') END")
    entries, members = structures.analyses_of_datasets(datasets, _docs(spark, sf_dir).select(F.col("k").alias("analysis_id"), related.alias("related")))
    return structures.analysis_counts(entries, members)
