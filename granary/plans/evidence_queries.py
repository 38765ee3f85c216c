"""Queries of the evidence extractors and of the edges and facts that follow from them, each beside its SQL.

Every document states its sources: a program, a job, cluster definitions and a catalog listing; the expected rows are
computed from the same numbers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import picture
from granary.operators import assess, audit, classify, evidence, graph, program, relational
from granary.plans.registry import register, table
from granary.plans.source_queries import _CBL, _D, _JCL, _LINE, PROGRAM, _card, _docs, _each, _each_sql
from granary.sources import repository

SOURCE = tuple(_card(*x, path=_CBL) for x in (
    (1, "000100     SELECT F{c} ASSIGN TO DD{w}. SELECT g{c} assign to EE{s}", "k % 2 = 0"), (2, "000200     SELECT ONLY-NAME"), (3, "FD  F{c}"), (4, "000400 FD  OTHER{w}", "k % 3 = 0"),
    (5, "    IF BAL > {s}"), (6, "    evaluate TRUE", "k % 5 <> 0"), (7, "    PERFORM UNTIL DONE = {c}  "), (8, "    READ F{c} INTO X"), (9, "    rewrite rec{w}", "k % 4 = 1"), (10, "    MOVE READ TO X"),
))
_ROW = ("path", "source_line", "evidence_type", "entity_name", "value")
_FOUND = tuple((_CBL, *x) for x in (
    ("1", "'SELECT'", "concat('F', c)", "concat('DD', w)", "k % 2 = 0"), ("1", "'SELECT'", "concat('G', c)", "concat('EE', s)", "k % 2 = 0"), ("3", "'FD'", "concat('F', c)", "'true'", "true"), ("4", "'FD'", "concat('OTHER', w)", "'true'", "k % 3 = 0"),
    ("5", "'BUSINESS_RULE'", "'IF'", "concat('BAL > ', s)", "true"), ("6", "'BUSINESS_RULE'", "'EVALUATE'", "'TRUE'", "k % 5 <> 0"), ("7", "'BUSINESS_RULE'", "'PERFORM UNTIL'", "concat('DONE = ', c)", "true"),
    ("8", "'ACCESS_PATTERN'", "concat('F', c)", "'READ'", "true"), ("9", "'ACCESS_PATTERN'", "concat('REC', w)", "'REWRITE'", "k % 4 = 1"),
))


@register("q97_cobol_evidence", f"WITH {_D} {_each_sql(_ROW, _FOUND)}")
def q97(spark, sf_dir):
    return evidence.extract("cobol", _each(_docs(spark, sf_dir), _LINE, SOURCE)).select(*_ROW)


@register("q98_select_clauses", f"""WITH {_D} SELECT {_CBL} AS path, concat('F', k) AS name, concat('DD', w) AS assign_to, CASE WHEN k % 2 = 0 THEN 'INDEXED' END AS organization, CASE WHEN k % 2 = 0 THEN 'DYNAMIC' END AS access_mode,
 CASE WHEN k % 3 = 0 THEN concat('KEY-', c) END AS record_key, CASE WHEN k % 3 = 0 THEN 'ST' END AS file_status FROM p UNION ALL SELECT {_CBL}, 'LAST', NULL, NULL, NULL, NULL, NULL FROM p WHERE k % 5 = 0""")
def q98(spark, sf_dir):
    content = F.expr(r"""concat('FILE-CONTROL.\n  SELECT F', k, '\n    assign to DD', w, CASE WHEN k % 2 = 0 THEN '\n    ORGANIZATION IS INDEXED\n    ACCESS MODE DYNAMIC' ELSE '' END,
      CASE WHEN k % 3 = 0 THEN concat('\n    RECORD KEY KEY-', c, '\n    FILE STATUS IS ST') ELSE '' END, '.\n', CASE WHEN k % 5 = 0 THEN '  SELECT LAST\n' ELSE '' END, 'DATA DIVISION.\n')""")
    return evidence.select_clauses(_docs(spark, sf_dir).select(F.expr(_CBL).alias("path"), content.alias("content")))


CARDS = tuple(_card(*x, path=_JCL) for x in (
    (1, "//* comment"), (2, "//JOB{k} JOB (ACCT{c}),"), (3, "//         CLASS={w}"), (4, "//LATER JOB X", "k % 2 = 0"), (5, "//S1 EXEC PGM=P{s},PARM='&RUN,&Run.&DAY{c}'"), (6, "//D DD DSN=A.&RUN.B", "k % 3 = 0"),
))
_CARDS = (
    (_JCL, "2", "'JOB'", "concat('JOB', k)", "concat('(ACCT', c, '), CLASS=', w)", "true"), *((_JCL, "5", "'SYMBOL'", name, name, "true") for name in ("'RUN'", "'RUN'", "concat('DAY', c)")), (_JCL, "6", "'SYMBOL'", "'RUN'", "'RUN'", "k % 3 = 0"),
)


@register("q99_job_cards", f"WITH {_D} {_each_sql(_ROW, _CARDS)}")
def q99(spark, sf_dir):
    lines = _each(_docs(spark, sf_dir), _LINE, CARDS)
    return evidence.job_cards(lines).unionByName(evidence.symbols(lines)).select(*_ROW)


_LST = "concat('P', k, '.lst')"
LISTING = tuple(_card(*x, path=_LST) for x in (
    (1, "LISTING FROM CATALOG"), (2, "0CLUSTER ------- PROD.K{k}.KSDS"), (3, "   KEYLEN-----------------{c}     AVGLRECL-------{s}"), (4, "   RKP--------------------0  MAXLRECL-----{w}", "k % 2 = 0"), (5, " DATA ---------- PROD.K{k}.DATA"),
    (6, "   CISIZE-----------------4096", "k % 3 = 0"), (7, "   REC-TOTAL----------{o}"), (8, " NONVSAM ------- PROD.N{c}", "k % 5 = 0"),
))
_ENTRY = ("path", "source_line", "entity_name", "value", "organization", "key_length", "record_length", "control_interval")
_ENTRIES = (
    (_LST, "2", "concat('PROD.K', k, '.KSDS')", "'CLUSTER'", "'KSDS'", "c", "CASE WHEN k % 2 = 0 THEN w END", "NULL", "true"), (_LST, "5", "concat('PROD.K', k, '.DATA')", "'DATA'", "NULL", "NULL", "NULL", "CASE WHEN k % 3 = 0 THEN 4096 END", "true"),
    (_LST, "8", "concat('PROD.N', c)", "'NONVSAM'", "NULL", "NULL", "NULL", "NULL", "k % 5 = 0"),
)


@register("q100_catalog_listing", f"WITH {_D} {_each_sql(_ENTRY, _ENTRIES)}")
def q100(spark, sf_dir):
    found, p = evidence.catalog_entries(_each(_docs(spark, sf_dir), _LINE, LISTING)), F.col("properties")
    of = lambda k: F.try_element_at(p, F.lit(k))
    return found.select("path", "source_line", "entity_name", "value", of("organization").alias("organization"), *[of(k).cast("int").alias(k) for k in ("key_length", "record_length", "control_interval")])


@register("q101_listing_hints", f"""WITH {_D} SELECT {_LST} AS path, (CASE WHEN k % 2 = 0 THEN w ELSE s END)::VARCHAR AS record_length, c::VARCHAR AS key_length, CASE WHEN k % 2 = 0 THEN '0' END AS key_offset,
 CASE WHEN k % 3 = 0 THEN '4096' END AS control_interval, o::VARCHAR AS records, 'KSDS' AS organization FROM p""")
def q101(spark, sf_dir):
    return evidence.listing_hints(_each(_docs(spark, sf_dir), _LINE, LISTING))


@register("q102_clusters", f"""WITH {_D}, n AS (SELECT k, concat('P', k, '.ams') AS path, CASE k % 4 WHEN 0 THEN 'KSDS' WHEN 1 THEN 'ESDS' WHEN 2 THEN 'RRDS' END AS organization FROM p)
SELECT path, concat('PROD.K', k) AS entity_name, organization FROM n UNION ALL SELECT path, 'PROD.SECOND', organization FROM n WHERE k % 3 = 0""")
def q102(spark, sf_dir):
    content = F.expr(r"""concat(' define cluster (\n  NAME(PROD.K', k, ') -\n  ', CASE k % 4 WHEN 0 THEN 'INDEXED' WHEN 1 THEN 'NonIndexed' WHEN 2 THEN 'NUMBERED' ELSE 'X' END, ')\n', CASE WHEN k % 3 = 0 THEN ' DEFINE CLUSTER(NAME (PROD.SECOND) LINEAR)' ELSE '' END)""")
    # LINEAR stands last, so it counts only where no word came before
    found = evidence.clusters(_docs(spark, sf_dir).select(F.expr("concat('P', k, '.ams')").alias("path"), content.alias("content"), "k").where("k % 4 <> 3 OR k % 3 <> 0"))
    more = evidence.clusters(_docs(spark, sf_dir).where("k % 4 = 3 AND k % 3 = 0").select(F.expr("concat('P', k, '.ams')").alias("path"), F.replace(content, F.lit("LINEAR"), F.lit("Y")).alias("content")))
    return found.unionByName(more).select("path", "entity_name", F.try_element_at("properties", F.lit("organization")).alias("organization"))


@register("q103_dataset_candidates", f"""WITH {_D} SELECT concat('PROD.J', k) AS dataset FROM p WHERE k % 3 = 0 UNION SELECT concat('TEMP.W', w) FROM p WHERE k % 3 = 0 UNION SELECT concat('CAT.C', c) FROM p WHERE k % 3 = 1 UNION SELECT concat('META.A.B', s) FROM p WHERE k % 3 = 2""")
def q103(spark, sf_dir):
    kind = "CASE k % 3 WHEN 0 THEN 'jcl' WHEN 1 THEN 'listcat' ELSE 'metadata' END"
    content = "CASE k % 3 WHEN 0 THEN concat('//D DD DSN=PROD.J', k, ',DISP=SHR,DSNAME=temp.w', w) WHEN 1 THEN concat('CLUSTER ----- CAT.C', c) ELSE concat('name,META.A.B', s, ',1.2.3.4') END"
    return evidence.dataset_candidates(_docs(spark, sf_dir).select(F.expr("concat('F', k)").alias("path"), F.expr(content).alias("content"), F.expr(kind).alias("artifact_type")))


_EDGE = ("source_id", "target_id", "rel_type")
_LIST_EDGES = (
    (_CBL, "concat('DD', w)", "'ACCESSES'", "k % 2 = 0"), (_CBL, "concat('EE', s)", "'ACCESSES'", "k % 2 = 0"), (_CBL, "concat('LAY', w)", "'USES_COPYBOOK'", "true"),
    *((_CBL, name, "'IMPLEMENTS_RULE'", when) for name, when in (("concat('BAL > ', s)", "true"), ("'TRUE'", "k % 5 <> 0"), ("concat('DONE = ', c)", "true"))),
    ("concat('PROD.K', k)", "concat('LAY', c)", "'USES_RECORD_LAYOUT'", "true"), ("concat('PROD.K', k)", "concat('KEY', c)", "'HAS_KEY'", "k % 4 = 0"), ("concat('T', k)", "concat('T', k, '_TAG')", "'OCCURS_CHILD_TABLE'", "k % 3 = 0"),
)


@register("q104_list_edges", f"WITH {_D} {_each_sql(_EDGE, _LIST_EDGES)}")
def q104(spark, sf_dir):
    p = _docs(spark, sf_dir)
    found = evidence.extract("cobol", _each(p, _LINE, SOURCE))
    copies = program.facts(program.markers(_each(p, _LINE, PROGRAM)))
    rules = found.where("evidence_type = 'BUSINESS_RULE'").groupBy("path").agg(F.collect_list("value").alias("rules"))
    lists = p.select(F.expr("concat('PROD.K', k)").alias("dsn"), F.expr("array(concat('LAY', c), concat('LAY', c))").alias("layouts"), F.expr("concat('T', k)").alias("t"), F.expr("CASE WHEN k % 3 = 0 THEN array(concat('T', k, '_TAG')) END").alias("children"))
    fields = _each(p, ("dsn", "name", "is_key"), (("concat('PROD.K', k)", "concat('KEY', c)", "k % 4 = 0", "true"), ("concat('PROD.K', k)", "'PLAIN'", "CAST(NULL AS BOOLEAN)", "true")))
    edges = [
        graph.from_evidence(found.withColumnRenamed("path", "artifact_id")), graph.from_lists(copies, "path", "copybooks", "USES_COPYBOOK"), graph.from_lists(rules, "path", "rules", "IMPLEMENTS_RULE"),
        graph.from_lists(lists, "dsn", "layouts", "USES_RECORD_LAYOUT"), graph.keys(fields), graph.from_lists(lists, "t", "children", "OCCURS_CHILD_TABLE"),
    ]
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out


ITEMS = tuple(_card(*x, path=_CBL) for x in (
    (1, "DATA DIVISION."), (2, "FILE SECTION.", "k % 2 = 0"), (3, "FD  IN-FILE."), (5, "FD  OUT{w}.", "k % 3 = 0"), (7, "WORKING-STORAGE SECTION."), (9, "PROCEDURE DIVISION."),
))
_ITEM = ("path", "line_no", "item", "section", "fd")
_FILE = "CASE WHEN k % 2 = 0 THEN 'FILE' END"
_OWNED = ((_CBL, "4", "concat('A', s)", _FILE, "'IN-FILE'", "true"), (_CBL, "6", "'B'", _FILE, "CASE WHEN k % 3 = 0 THEN concat('OUT', w) ELSE 'IN-FILE' END", "true"), (_CBL, "8", "'C'", "'WORKING-STORAGE'", "NULL", "true"))


@register("q105_item_owners", f"WITH {_D} {_each_sql(_ITEM, _OWNED)}")
def q105(spark, sf_dir):
    p = _docs(spark, sf_dir)
    items = _each(p, ("path", "line_no", "name"), tuple((x[0], x[1], x[2], x[-1]) for x in _OWNED))
    return program.item_owners(program.markers(_each(p, _LINE, ITEMS)), items).select(*_ITEM)


@register("q106_dataset_facts", f"""WITH {_D}, n AS (SELECT k, concat('D', k) AS dataset FROM p)
SELECT dataset, CASE WHEN k % 2 = 0 THEN 'KSDS' WHEN k % 3 = 0 THEN 'ESDS' WHEN k % 5 = 0 THEN 'RRDS' ELSE 'UNKNOWN' END AS organization, CASE WHEN k % 2 = 0 THEN 'listcat' WHEN k % 3 = 0 THEN 'metadata' WHEN k % 5 = 0 THEN 'jcl' ELSE 'unknown' END AS source,
 CASE WHEN k % 2 = 0 THEN 1.0 WHEN k % 3 = 0 THEN 0.9 WHEN k % 5 = 0 THEN 0.6 ELSE 0.2 END::DOUBLE AS confidence FROM n""")
def q106(spark, sf_dir):
    p = _docs(spark, sf_dir)
    known = lambda when, what: p.where(when).select(F.expr("concat('D', k)").alias("dataset"), F.lit(what).alias("organization"))
    return program.dataset_facts(p.select(F.expr("concat('D', k)").alias("dataset")), [("listcat", 1.0, known("k % 2 = 0", "KSDS")), ("metadata", 0.9, known("k % 3 = 0", "ESDS")), ("jcl", 0.6, known("k % 5 = 0", "RRDS"))])


@register("q107_artifact_ids", """WITH f AS (SELECT doc_id, concat('dir', lpad(doc_id::VARCHAR, 12, '0'), '/', source, CASE doc_id % 3 WHEN 0 THEN '.cpy' WHEN 1 THEN '.cbl' ELSE '.copy' END) AS path, CASE WHEN doc_id % 3 = 1 THEN 'cobol' ELSE 'copybook' END AS artifact_type, upper(source) AS stem FROM documents WHERE source IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY artifact_type, stem ORDER BY path) AS n FROM f)
SELECT path, artifact_type, CASE WHEN n > 1 THEN concat(stem, '__', n) ELSE stem END AS artifact_id FROM n""")
def q107(spark, sf_dir):
    name = F.expr("concat('dir', lpad(CAST(doc_id AS STRING), 12, '0'), '/', source, CASE doc_id % 3 WHEN 0 THEN '.cpy' WHEN 1 THEN '.cbl' ELSE '.copy' END)")
    files = table(spark, sf_dir, "documents").where("source IS NOT NULL").select(name.alias("path"), F.lit("").alias("content"))
    return classify.artifacts(files).select("path", "artifact_type", "artifact_id")


@register("q108_first_edges", """SELECT source AS source_id, lang AS target_id, CASE WHEN n_chars % 2 = 0 THEN 'READS' ELSE 'WRITES' END AS rel_type, min(doc_id) AS first_id FROM documents GROUP BY 1, 2, 3""")
def q108(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), F.col("lang").alias("target_id"), F.expr("CASE WHEN n_chars % 2 = 0 THEN 'READS' ELSE 'WRITES' END").alias("rel_type"), F.col("doc_id").alias("first_id"))
    return graph.first_of_each(rows, "first_id")


@register("q109_run_of_each", """WITH r AS (SELECT arg_max(concat('run', conv_id), conv_id * 1000 + turn) AS run_id FROM conversations WHERE role = 'user'), c AS (SELECT avg(x) AS confidence FROM (SELECT CASE role WHEN 'user' THEN 100.0 ELSE turn * 1.0 END AS x FROM conversations))
SELECT run_id, confidence::DOUBLE AS confidence, (SELECT count(*) FROM conversations) AS total FROM r, c""")
def q109(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    events = rows.select(F.expr("CASE WHEN role = 'user' THEN concat('run', conv_id) END").alias("run_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("timestamp"))
    sure = assess.repository_confidence(rows.where("role = 'user'").select(F.lit(100.0)), rows.where("role <> 'user' OR role IS NULL").select(F.col("turn").cast("double")))
    return audit.latest_run(events).join(F.broadcast(sure)).join(F.broadcast(audit.counted(events)))  # one row each


@register("q110_types_and_dates", """WITH t AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN concat('VARCHAR(', n_chars * 500, ')') WHEN 1 THEN concat('NUMERIC(', n_chars % 1500, ',', doc_id % 9, ')') WHEN 2 THEN 'BIGINT' WHEN 3 THEN 'BLOB' WHEN 4 THEN 'NUMERIC' END AS sql_type,
 CASE doc_id % 4 WHEN 0 THEN 'SHIP-DATE' WHEN 1 THEN 'POST-DT' WHEN 2 THEN 'DTX' ELSE 'UPDATED' END AS name, CASE WHEN n_chars % 3 = 0 THEN '9(8)' WHEN n_chars % 3 = 1 THEN '999999' ELSE 'X(8)' END AS pic, n_chars FROM documents)
SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN n_chars * 500 <= 10485760 WHEN doc_id % 6 = 1 THEN n_chars % 1500 <= 1000 AND doc_id % 9 <= n_chars % 1500 WHEN doc_id % 6 = 5 THEN NULL ELSE doc_id % 6 <> 3 END AS valid,
 pic IN ('9(8)', '999999') AND regexp_matches(name, 'DATE|-DT') AS is_date FROM t""")
def q110(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr("CASE doc_id % 6 WHEN 0 THEN concat('VARCHAR(', n_chars * 500, ')') WHEN 1 THEN concat('NUMERIC(', n_chars % 1500, ',', doc_id % 9, ')') WHEN 2 THEN 'BIGINT' WHEN 3 THEN 'BLOB' WHEN 4 THEN 'NUMERIC' END").alias("sql_type"),
        F.expr("CASE doc_id % 4 WHEN 0 THEN 'SHIP-DATE' WHEN 1 THEN 'POST-DT' WHEN 2 THEN 'DTX' ELSE 'UPDATED' END").alias("name"), F.expr("CASE WHEN n_chars % 3 = 0 THEN '9(8)' WHEN n_chars % 3 = 1 THEN '999999' ELSE 'X(8)' END").alias("pic"))
    return rows.select("doc_id", picture.is_valid_type("sql_type").alias("valid"), picture.looks_like_date("name", "pic").alias("is_date"))


@register("q111_generated_schemas", f"""WITH {_D} SELECT concat('T', k) AS table_name, CASE WHEN k % 3 = 0 THEN 'FAILED' WHEN k % 2 = 0 THEN 'REVIEW_REQUIRED' ELSE 'GENERATED' END AS status, CASE WHEN k % 3 = 0 THEN '' ELSE concat('text ', s) END AS ddl,
 CASE WHEN k % 3 <> 0 THEN sha256(concat('text ', s)) END AS ddl_hash, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 5 = 0 THEN 'a,b' ELSE 'b' END END AS issues, CASE WHEN k % 2 = 0 THEN 'r' END AS warnings FROM p""")
def q111(spark, sf_dir):
    p = _docs(spark, sf_dir)
    made = p.select(F.expr("concat('T', k)").alias("table_name"), F.expr("concat('text ', s)").alias("ddl")).withColumn("ddl_hash", F.sha2("ddl", 256))
    issues = _each(p, ("table_name", "issue"), (("concat('T', k)", "'b'", "k % 3 = 0"), ("concat('T', k)", "'a'", "k % 15 = 0")))
    warnings = _each(p, ("table_name", "reason"), (("concat('T', k)", "'r'", "k % 2 = 0"), ("concat('T', k)", "'r'", "k % 4 = 0")))
    out = relational.generated(made, issues, warnings)
    return out.withColumns({c: F.array_join(c, ",") for c in ("issues", "warnings")})


@register("q112_saved_tables", """SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'new', n_chars FROM documents WHERE doc_id % 2 = 1""")
def q112(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    path = f"{repository.shared_dir(spark)}/granary/saved"
    path = f"{path}-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}"
    repository.save({"knowledge": rows.where("doc_id % 2 = 0"), "more": rows.withColumn("lang", F.lit("new"))}, path)
    return repository.append_new(repository.load(spark, path, "more"), repository.load(spark, path, "knowledge"), "doc_id")
