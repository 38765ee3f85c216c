"""Queries of inventories, guards, repaired jobs, stored edges and the lookup cascade, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import evidence, inventory, layout
from granary.plans.registry import register, table
from granary.plans.source_queries import _D, _DDS, _JCL, _LINE, JOB, LAYOUT, _docs, _each, _each_sql

_PATH = "CASE k % 6 WHEN 0 THEN concat('src/A', k, '.CBL') WHEN 1 THEN concat('b', w, '.cpy') WHEN 2 THEN concat('x/C', k, '.job') WHEN 3 THEN concat('x/y/B', w, '.copy') WHEN 4 THEN 'README' ELSE concat('d', k, '.txt') END"


@register("q123_inventory", f"""WITH {_D}, f AS (SELECT s, k % 6 AS m, k, w FROM p),
n AS (SELECT s AS upload, count(DISTINCT CASE WHEN m = 0 THEN k END) AS n_programs, count(DISTINCT CASE WHEN m IN (1, 3) THEN w END) AS n_copybooks, count(DISTINCT CASE WHEN m = 2 THEN k END) AS n_jcl_jobs, count(*) FILTER (m > 3) AS n_other_files FROM f GROUP BY 1)
SELECT *, n_programs + n_copybooks + n_jcl_jobs + n_other_files AS total_files, 1 AS n_datasets, 60 AS health, 'Inventory generated' AS readiness FROM n""")
def q123(spark, sf_dir):
    return inventory.inventory(_docs(spark, sf_dir).select(F.col("s").alias("upload"), F.expr(_PATH).alias("path")), "upload")


@register("q124_upload_paths", """WITH f AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN concat('a/', source, '/f') WHEN 1 THEN '../x' WHEN 2 THEN concat('b\\', doc_id) WHEN 3 THEN 'C:/x' WHEN 4 THEN '/abs' WHEN 5 THEN './a//b/.' END AS requested,
 CASE WHEN doc_id % 5 = 0 THEN 'dir/' ELSE concat('n', doc_id) END AS filename FROM documents WHERE source IS NOT NULL)
SELECT doc_id, CASE WHEN filename = 'dir/' THEN NULL WHEN doc_id % 7 = 0 THEN requested WHEN doc_id % 7 = 2 THEN concat('b/', doc_id) WHEN doc_id % 7 = 5 THEN 'a/b' WHEN doc_id % 7 = 6 THEN filename END AS path FROM f""")
def q124(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("source IS NOT NULL")
    requested = F.expr(r"CASE doc_id % 7 WHEN 0 THEN concat('a/', source, '/f') WHEN 1 THEN '../x' WHEN 2 THEN concat('b\\', doc_id) WHEN 3 THEN 'C:/x' WHEN 4 THEN '/abs' WHEN 5 THEN './a//b/.' END")
    rows = rows.select("doc_id", requested.alias("requested"), F.expr("CASE WHEN doc_id % 5 = 0 THEN 'dir/' ELSE concat('n', doc_id) END").alias("filename"))
    return rows.select("doc_id", inventory.upload_path("requested", "filename").alias("path"))


@register("q125_repaired_jobs", f"""SELECT doc_id::VARCHAR AS job_id, CASE WHEN n_chars % 3 = 0 THEN 'done' ELSE lang END AS status, CASE WHEN n_chars % 3 <> 0 THEN source END AS error, CASE WHEN n_chars % 3 = 0 THEN '{inventory.REPAIRED}' END AS warning
FROM documents WHERE n_chars % 3 <> 0 OR doc_id IN (SELECT conv_id FROM conversations)""")
def q125(spark, sf_dir):
    jobs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("job_id"), F.when(F.col("n_chars") % 3 == 0, "error").otherwise(F.col("lang")).alias("status"), F.col("source").alias("error"), F.lit(None).cast("string").alias("warning"))
    return inventory.repaired(jobs, table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("job_id")))


@register("q126_decisions_and_operations", """WITH e AS (SELECT role, turn, text FROM conversations)
SELECT concat('view ', coalesce(role, '')) AS name, count(*) FILTER (turn % 4 = 1 OR turn % 5 = 2 OR role = 'user') AS value FROM e GROUP BY role
UNION ALL SELECT 'READ', count(*) FROM e WHERE turn % 3 = 0 UNION ALL SELECT 'WRITE', count(*) FROM e WHERE turn % 3 > 0 UNION ALL SELECT 'REWRITE', count(*) FROM e WHERE turn % 3 = 2 UNION ALL SELECT 'DELETE', 0""")
def q126(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    shown = inventory.is_decision(F.expr("CASE WHEN turn % 4 = 1 THEN 'OCCURS' END"), F.expr("CASE WHEN turn % 5 = 2 THEN 'REVIEW_REQUIRED' ELSE 'SUCCESS' END"), F.expr("CASE WHEN role = 'user' THEN 'ERROR' ELSE 'INFO' END"))
    views = rows.groupBy("role").agg(F.count_if(shown).alias("value")).select(F.concat(F.lit("view "), F.coalesce("role", F.lit(""))).alias("name"), "value")
    operations = rows.select(F.expr("array(CASE turn % 3 WHEN 0 THEN 'read file' WHEN 1 THEN 'WRITE' ELSE 'Rewrite' END)").alias("ops"))
    return views.unionByName(inventory.operation_counts(operations, "ops"))


_EDGE = ("relationship_id", "source_id", "target_id", "relationship_type")


@register("q127_remote_edges", f"""WITH {_D}, e AS ({_each_sql(('path', 'source_line', 'dd', 'value', 'scope', 'position'), _DDS)})
SELECT DISTINCT concat(upper(replace(path, '.jcl', '')), '_', value, '_ALLOCATES') AS relationship_id, upper(replace(path, '.jcl', '')) AS source_id, value AS target_id, 'ALLOCATES' AS relationship_type FROM e""")
def q127(spark, sf_dir):
    found = evidence.data_definitions(_each(_docs(spark, sf_dir), _LINE, JOB))
    return inventory.remote_edges(found).select(*_EDGE)


@register("q128_dataset_rows", f"""WITH {_D}, d AS (SELECT concat('D', k) AS dataset, k, s FROM p)
SELECT dataset, CASE WHEN k % 2 = 0 AND k % 3 <> 0 THEN 'KSDS' ELSE 'UNKNOWN' END AS organization, CASE WHEN k % 2 = 0 THEN 'DEFINE_CLUSTER' WHEN k % 5 = 0 THEN 'DD' ELSE 'CANDIDATE' END AS first_by FROM d""")
def q128(spark, sf_dir):
    p = _docs(spark, sf_dir)
    rows = p.select(F.expr(_JCL).alias("path"), F.lit(1).alias("source_line"), F.expr("""inline(array_compact(array(
      CASE WHEN k % 2 = 0 THEN named_struct('evidence_type', 'DEFINE_CLUSTER', 'entity_name', concat('D', k), 'properties', CASE WHEN k % 3 <> 0 THEN map('organization', 'KSDS') ELSE map('x', 'y') END) END,
      CASE WHEN k % 5 = 0 THEN named_struct('evidence_type', 'DD', 'entity_name', 'IN', 'properties', map('dataset', concat('D', k), 'organization', 'NO')) END)))"""))
    return inventory.dataset_rows(rows, p.select(F.expr("concat('D', k)").alias("dataset")))


@register("q129_lookup_cascade", f"""WITH {_D} SELECT CASE k % 4 WHEN 0 THEN concat('A', k) WHEN 1 THEN concat('a', k) WHEN 2 THEN concat('file', k, '.XYZ') ELSE concat('none', k) END AS artifact_id,
 CASE k % 4 WHEN 0 THEN 'copybooks' WHEN 1 THEN 'programs' WHEN 2 THEN 'datasets' END AS "group", CASE k % 4 WHEN 0 THEN concat('A', k) WHEN 1 THEN concat('P', k) WHEN 2 THEN concat('D', k) END AS key FROM p""")
def q129(spark, sf_dir):
    p = _docs(spark, sf_dir)
    columns = ("group", "place", "key", "id", "name", "source_file")
    artifacts = _each(p, columns, (
        ("'copybooks'", "k", "concat('A', k)", "NULL", "NULL", "NULL", "k % 4 IN (0, 1)"), ("'programs'", "k", "concat('P', k)", "NULL", "concat('a', k)", "NULL", "k % 4 IN (0, 1)"),
        ("'datasets'", "k", "concat('D', k)", "NULL", "NULL", "concat('src/FILE', k, '.cbl')", "k % 4 = 2"), ("'other_artifacts'", "1000000 + k", "concat('P', k, '.old')", "''", "'x'", "''", "true"),
    ))
    asked = p.select(F.expr("CASE k % 4 WHEN 0 THEN concat('A', k) WHEN 1 THEN concat('a', k) WHEN 2 THEN concat('file', k, '.XYZ') ELSE concat('none', k) END").alias("artifact_id"))
    return inventory.looked_up(asked, artifacts)


@register("q130_layout_evidence", rf"""WITH {_D}, l AS ({_each_sql(_LINE, LAYOUT)}), d AS (SELECT *, regexp_extract(text, '^\s*(\d\d)\s+([A-Z0-9_-]+)', 1)::INTEGER AS level, regexp_extract(text, '^\s*(\d\d)\s+([A-Z0-9_-]+)', 2) AS name FROM l)
SELECT path, line_no AS source_line, name AS entity_name, CASE WHEN contains(text, ' PIC ') THEN 'ELEMENTARY' ELSE 'GROUP' END AS value, level::VARCHAR AS level, CASE WHEN contains(text, 'OCCURS') THEN 'yes' ELSE 'no' END AS repeats FROM d WHERE level <> 88""")
def q130(spark, sf_dir):
    found, p = layout.node_evidence(layout.tree(layout.declarations(_each(_docs(spark, sf_dir), _LINE, LAYOUT)))), F.col("properties")
    return found.select("path", "source_line", "entity_name", "value", p["level"].alias("level"), F.when(F.map_contains_key(p, F.lit("occurs_min")), "yes").otherwise("no").alias("repeats"))
