"""Queries of lookups between artifacts, evidence and schemas, of summaries and of derived schemas, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import dialects, lookup, program, structures
from granary.plans.registry import register, table
from granary.plans.source_queries import _CBL, _D, _LINE, PROGRAM, _docs, _each
from granary.plans.structure_queries import _text


@register("q113_programs_of_repository", """SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT doc_id FROM documents WHERE source IN (SELECT source FROM documents GROUP BY 1 HAVING count(*) % 2 = 0))""")
def q113(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), F.col("source").alias("repository_id"))
    even = files.groupBy("repository_id").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 0")
    return lookup.of_repository(table(spark, sf_dir, "conversations").select("conv_id", "turn"), files, even, "conv_id")


_EVIDENCE = ("path", "source_line", "evidence_type", "evidence_id")
_FOUND = (
    (_CBL, "9", "'FD'", "concat('E', k, 'b')", "true"), (_CBL, "9", "'FD'", "concat('E', k, 'a')", "k % 2 = 0"), (_CBL, "10", "'FD'", "'WRONG'", "true"), (_CBL, "5", "'SELECT'", "concat('S', k)", "k % 3 = 0"), (_CBL, "CAST(NULL AS INTEGER)", "'FD'", "'NONE'", "true"),
)


@register("q114_nodes_with_evidence", f"""WITH {_D} SELECT {_CBL} AS path, 9 AS line_no, 'fd' AS type, CASE WHEN k % 2 = 0 THEN concat('E', k, 'a,E', k, 'b') ELSE concat('E', k, 'b') END AS evidence_ids FROM p
UNION ALL SELECT {_CBL}, 5, 'file_control', CASE WHEN k % 3 = 0 THEN concat('S', k) END FROM p UNION ALL SELECT {_CBL}, 10, 'copy', NULL FROM p""")
def q114(spark, sf_dir):
    p = _docs(spark, sf_dir)
    nodes = program.markers(_each(p, _LINE, PROGRAM)).where("kind IN ('fd', 'file_control', 'copy')").select("path", "line_no", F.col("kind").alias("type"))
    found = lookup.with_evidence(nodes, _each(p, _EVIDENCE, _FOUND), {"fd": "FD", "file_control": "SELECT"})
    return found.withColumn("evidence_ids", F.array_join("evidence_ids", ","))


@register("q115_evidence_by_name", f"""WITH {_D} SELECT DISTINCT concat('A', a.k) AS artifact_id, b.k AS evidence_id FROM p a JOIN p b ON concat('F', a.k % 1000, '.', a.c) = concat('F', b.k % 1000, '.', b.c)""")
def q115(spark, sf_dir):
    p = _docs(spark, sf_dir)
    artifacts = p.select(F.expr("concat('A', k)").alias("artifact_id"), F.expr("concat('src/F', k % 1000, '.', c)").alias("path"))
    evidence = p.select(F.col("k").alias("evidence_id"), F.expr("concat('other/deep/f', k % 1000, '.', c)").alias("path"))
    return lookup.evidence_by_name(artifacts, evidence).select("artifact_id", "evidence_id")


@register("q116_schemas_with_validation", f"""WITH {_D} SELECT concat('a', k) AS artifact_id, CASE WHEN k % 4 <> 3 THEN concat('S', k) END AS schema_id, CASE WHEN k % 4 = 3 THEN NULL WHEN k % 2 = 0 THEN 'VALIDATED' WHEN k % 3 = 0 THEN 'FAILED_VALIDATION' END AS validation_status FROM p""")
def q116(spark, sf_dir):
    p = _docs(spark, sf_dir)
    generated = _each(p, ("place", "artifact_id", "schema_id"), (("2 * k", "concat('A', k)", "concat('S', k)", "k % 4 <> 3"), ("2 * k + 1", "concat('a', k)", "'LATER'", "k % 4 = 1")))
    validations = _each(p, ("place", "schema_id", "validation_status"), (("1", "concat('S', k)", "'FAILED_VALIDATION'", "k % 3 = 0"), ("2", "concat('S', k)", "'VALIDATED'", "k % 2 = 0")))
    found = lookup.schema_of_artifact(p.select(F.expr("concat('a', k)").alias("artifact_id")), generated).select("artifact_id", "schema.schema_id")
    return lookup.with_validation(found, validations).select("artifact_id", "schema_id", "validation_status")


_FILE = "CASE k % 5 WHEN 0 THEN concat('top', k, '.cbl') WHEN 1 THEN concat('a/b', w, '/f', k) WHEN 2 THEN concat('/a\\\\c/', 'f', k) WHEN 3 THEN concat('a/b', w, '/c/f', k) ELSE NULL END"
_FILE_SQL = _FILE.replace("\\\\", "\\")
_TYPE = "CASE k % 6 WHEN 0 THEN 'cobol' WHEN 1 THEN 'COPYBOOK' WHEN 2 THEN 'JCL' WHEN 3 THEN 'IDCAMS' WHEN 4 THEN 'CATALOG' END"


@register("q117_repository_summary", f"""WITH {_D}, f AS (SELECT s % 10 AS repository, k, w, {_TYPE} AS t FROM p),
d AS (SELECT repository, 'a' AS folder FROM f WHERE k % 5 IN (1, 2, 3) UNION SELECT repository, concat('a/b', w) FROM f WHERE k % 5 IN (1, 3) UNION SELECT repository, 'a/c' FROM f WHERE k % 5 = 2 UNION SELECT repository, concat('a/b', w, '/c') FROM f WHERE k % 5 = 3),
n AS (SELECT repository, count(*) AS total_folders FROM d GROUP BY 1)
SELECT f.repository, count(*) AS total_files, count(*) FILTER (upper(t) = 'COBOL') AS n_programs, count(*) FILTER (t = 'COPYBOOK') AS n_copybooks, count(*) FILTER (t = 'JCL') AS n_jcl, count(*) FILTER (t = 'IDCAMS') AS n_idcams,
 count(*) FILTER (t = 'CATALOG') AS n_catalogs, coalesce(any_value(total_folders), 0) AS total_folders FROM f LEFT JOIN n USING (repository) GROUP BY 1""")
def q117(spark, sf_dir):
    files = _docs(spark, sf_dir).select(F.expr("s % 10").alias("repository"), F.expr(_FILE).alias("path"), F.expr(_TYPE).alias("artifact_type"))
    return lookup.repository_summary(files, "repository")


@register("q118_detected_language", "SELECT source, CASE WHEN bool_or(n_chars % 50 = 7) THEN 'COBOL' ELSE 'Mixed' END AS language FROM documents GROUP BY 1")
def q118(spark, sf_dir):
    return dialects.detected_language(table(spark, sf_dir, "documents").select("source", F.expr("CASE WHEN n_chars % 50 = 7 THEN 'Cobol' WHEN n_chars % 3 = 0 THEN 'pli' END").alias("artifact_type")), "source")


@register("q119_relevant_source", rf"""WITH {_D}, t AS (SELECT k, CASE WHEN k % 3 = 0 THEN '' ELSE repeat(concat('    FILL ', k, chr(10)), 800) END AS fill, concat('    READ F', k, chr(10), '    INTO X.', chr(10)) AS hit FROM p),
c AS (SELECT k, concat(fill, CASE WHEN k % 2 = 0 THEN hit ELSE '' END, '    STOP RUN.', chr(10)) AS content FROM t)
SELECT concat('P', k, '.cbl') AS path, length(source) AS n, sha256(source) AS digest FROM (SELECT k, CASE WHEN length(content) <= 6000 THEN content WHEN k % 2 = 0 THEN concat('    READ F', k, chr(10), '    INTO X.') ELSE left(content, 6000) END AS source FROM c)""")
def q119(spark, sf_dir):
    content = F.expr(r"concat(CASE WHEN k % 3 = 0 THEN '' ELSE repeat(concat('    FILL ', k, '\n'), 800) END, CASE WHEN k % 2 = 0 THEN concat('    READ F', k, '\n', '    INTO X.\n') ELSE '' END, '    STOP RUN.\n')")
    files = _docs(spark, sf_dir).select(F.expr("concat('P', k, '.cbl')").alias("path"), content.alias("content"))
    found = dialects.relevant_source(files, F.col("text").contains("READ"))
    return found.select("path", F.length("source").cast("long").alias("n"), F.sha2("source", 256).alias("digest"))


_PROGRAM = '{"general_information":{"program_name":"PRG<k>","copybooks":["C<w>"]},"metadata":{"operations":["READ"],"copybooks":["NOT"]},"dependencies":{"datasets":["D<s>","E"],"copybooks":[]},"structure":{"data_structures":[{"n":1}]}}'
_DATASET = '{"general_information":{"key_length":<c>},"metadata":{"organization":"KSDS"},"semantic_structure":{"dataset":{"key_length":99,"record_length":<s>,"alternate_keys":["K<w>"]}}}'
_JOB = '{"semantic_structure":{"workflow":{"job":{"job_card":{"class":"A"}},"steps":[]}},"structure":{"job":{"steps":[{"name":"S<c>"},{}]}}}'


@register("q120_schemas_of_artifacts", f"""WITH {_D} SELECT concat('a', k) AS artifact_id, CASE k % 4 WHEN 0 THEN 'PROGRAM_SCHEMA' WHEN 1 THEN 'JOB_SCHEMA' ELSE 'DATASET_SCHEMA' END AS schema_type, CASE k % 4 WHEN 0 THEN concat('PRG', k) WHEN 1 THEN concat('A', k) ELSE concat('a', k) END AS schema_name,
 CASE k % 4 WHEN 0 THEN concat('READ|D', s, ',E|C', w) WHEN 1 THEN concat('S', c, '|2') WHEN 2 THEN concat('KSDS|', c, '|', s, '|K', w) ELSE '' END AS parts FROM p""")
def q120(spark, sf_dir):
    facts = F.expr(f"CASE k % 4 WHEN 0 THEN {_text(_PROGRAM)} WHEN 1 THEN {_text(_JOB)} WHEN 2 THEN {_text(_DATASET)} END")
    kind = F.expr("CASE k % 4 WHEN 0 THEN 'cobol' WHEN 1 THEN 'jcl' WHEN 2 THEN 'idcams' ELSE 'dataset' END")
    rows = _docs(spark, sf_dir).select(F.expr("concat('a', k)").alias("artifact_id"), kind.alias("artifact_type"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("source_file"), facts.alias("facts"))
    found = structures.schemas(structures.canonical(rows))
    of = lambda path, t: structures.of("parts", path, t)
    listed = lambda path: F.array_join(of(path, "array<string>"), ",")
    shown = (
        F.when(F.col("schema_type") == "PROGRAM_SCHEMA", F.concat_ws("|", listed("$.operations"), listed("$.datasets_accessed"), listed("$.copybooks")))
        .when(F.col("schema_type") == "JOB_SCHEMA", F.concat_ws("|", of("$.steps[0].name", "string"), F.size(of("$.steps", "array<variant>")).cast("string")))
        .otherwise(F.concat_ws("|", of("$.organization", "string"), of("$.key_length", "string"), of("$.record_length", "string"), F.nullif(listed("$.alternate_keys"), F.lit(""))))
    )
    return found.select("artifact_id", "schema_type", "schema_name", shown.alias("parts"))


@register("q121_schema_readiness", f"""WITH {_D} SELECT concat('L', k) AS artifact_id, CASE WHEN k % 5 = 0 THEN 'NOT_MIGRATABLE' WHEN k % 3 = 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN k % 2 = 0 THEN 'REVIEW_REQUIRED' ELSE 'READY' END AS readiness,
 CASE WHEN k % 3 <> 0 THEN concat('FIRST', k) END AS mapped_dataset, CASE WHEN k % 5 = 0 THEN 0 ELSE 2 END AS n_columns FROM p""")
def q121(spark, sf_dir):
    p = _docs(spark, sf_dir)
    columns = _each(p, ("artifact_id", "needs_review"), (("concat('L', k)", "k % 2 = 0", "k % 5 <> 0"), ("concat('L', k)", "CAST(NULL AS BOOLEAN)", "k % 5 <> 0")))
    edges = _each(p, ("place", "source_id", "target_id", "rel_type"), (("1", "concat('FIRST', k)", "concat('L', k)", "'USES_RECORD_LAYOUT'", "k % 3 <> 0"), ("2", "'SECOND'", "concat('L', k)", "'USES_RECORD_LAYOUT'", "k % 3 = 1"), ("0", "'OTHER'", "concat('L', k)", "'READS'", "true")))
    return structures.readiness(p.select(F.expr("concat('L', k)").alias("artifact_id")), columns, edges)
