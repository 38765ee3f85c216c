"""Queries of older lengths and types, dialects, hierarchies and catalogs, each beside its SQL.

As in `source_queries`, rows of whole tables state the sources, and SQL computes the results from the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import picture
from granary.operators import catalogs, dialects, evidence, hierarchy, relational
from granary.plans.queries import EXT_SQL
from granary.plans.registry import register, table
from granary.plans.source_queries import _JCL, _LINE, _P, _PIC, _PIC_SQL, _USAGE, _card, _each, _each_sql, _jobs, _parts, _pictures
from granary.sources import repository


def _total(text: str, symbols: str) -> str:
    return rf"coalesce(list_sum(list_transform(regexp_extract_all({text}, '[{symbols}](\((\d+)\))?', 2), lambda x : coalesce(nullif(x, '')::INTEGER, 1))), 0)"


def _first(text: str, symbol: str) -> str:
    return rf"coalesce(nullif(regexp_extract({text}, '[{symbol}]\((\d+)\)', 1), '')::INTEGER, length({text}) - length(replace({text}, '{symbol}', '')))"


# ------------------------------------------------------------------ lengths and types

_SPELT = f"concat({_PIC}, CASE WHEN {_USAGE} IS NULL THEN '' ELSE concat(' ', {_USAGE}) END)"


@register("q58_older_lengths", rf"""WITH i AS (SELECT *, CAST(l_quantity AS INTEGER) AS q FROM lineitem), r AS (SELECT l_orderkey, l_linenumber, {_PIC} AS pic, {_SPELT} AS p FROM i),
n AS (SELECT *, {_total("regexp_replace(p, '[SV]', '', 'g')", '9')} AS d, {_total('p', 'XA')} AS a, {_first("string_split(p, 'V')[1]", '9')} + coalesce({_first("string_split(p, 'V')[2]", '9')}, 0) AS f, {_first('p', 'X')} AS x, {_first('p', 'A')} AS y FROM r)
SELECT l_orderkey, l_linenumber, p, (CASE WHEN contains(p, 'COMP-1') THEN 4 WHEN contains(p, 'COMP-2') THEN 8 WHEN contains(p, 'COMP-3') THEN ceil((d + 1) / 2.0) WHEN regexp_matches(p, 'COMP|BINARY') THEN CASE WHEN d <= 4 THEN 2 WHEN d <= 9 THEN 4 ELSE 8 END WHEN a > 0 THEN a ELSE d END)::INTEGER AS storage,
 (CASE WHEN contains(p, 'COMP-1') THEN 4 WHEN contains(p, 'COMP-2') THEN 8 WHEN contains(p, 'COMP-3') THEN ceil((f + 1) / 2.0) WHEN regexp_matches(p, 'COMP|BINARY') THEN CASE WHEN f <= 4 THEN 2 WHEN f <= 9 THEN 4 ELSE 8 END WHEN contains(p, 'X') THEN x WHEN contains(p, 'A') THEN y ELSE f END)::INTEGER AS stated,
 nullif({_total("regexp_replace(pic, 'V|S|CR|DB', '', 'g')", 'X9AZB0*/+-')}, 0)::INTEGER AS symbols FROM n""")
def q58(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"), F.expr("l_orderkey % 8").alias("_u"))
    rows = rows.select("l_orderkey", "l_linenumber", F.expr(_PIC).alias("pic"), F.expr(_SPELT).alias("p"))
    return rows.select("l_orderkey", "l_linenumber", "p", picture.older_storage("p").alias("storage"), picture.older_length("p").alias("stated"), picture.symbol_length("pic").alias("symbols"))


_FLAT = "CASE l_linenumber WHEN 1 THEN concat('X(', q, ').') WHEN 2 THEN concat('S9(', q, ')V99') WHEN 3 THEN concat('9(', q, ')') WHEN 4 THEN 'GROUP' WHEN 5 THEN concat('9(', q, ')V9(3)') WHEN 6 THEN 'XX' ELSE '999' END"


@register("q59_flat_types", f"""WITH i AS (SELECT *, CAST(l_quantity AS INTEGER) AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, {_FLAT} AS data_type, CASE l_linenumber WHEN 1 THEN concat('VARCHAR(', q, ')') WHEN 2 THEN concat('NUMERIC(', q + 2, ',2)') WHEN 3 THEN CASE WHEN q <= 9 THEN 'INTEGER' ELSE 'BIGINT' END WHEN 4 THEN 'TEXT'
 WHEN 5 THEN concat('NUMERIC(', q + 3, ',3)') WHEN 6 THEN 'TEXT' ELSE 'NUMERIC' END AS sql_type FROM i""")
def q59(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"))
    return rows.select("l_orderkey", "l_linenumber", F.expr(_FLAT).alias("data_type")).withColumn("sql_type", picture.flat_type("data_type"))


_WANTED = "CASE l_linenumber WHEN 1 THEN concat('VARCHAR(', q, ')') WHEN 2 THEN concat('NUMERIC(', q, ',2)') WHEN 3 THEN 'INTEGER[]' WHEN 4 THEN 'BIGSERIAL' WHEN 5 THEN 'integer' WHEN 6 THEN 'NUMERIC' END"
_SHOWN = "CASE l_orderkey % 5 WHEN 0 THEN 'character varying' WHEN 1 THEN 'numeric' WHEN 2 THEN 'ARRAY' WHEN 3 THEN 'bigint' ELSE 'integer' END"


@register("q60_catalog_types", f"""WITH i AS (SELECT *, CAST(l_quantity AS INTEGER) AS q, l_orderkey % 5 AS m FROM lineitem)
SELECT l_orderkey, l_linenumber, {_WANTED} AS expected, {_SHOWN} AS data_type, CASE l_linenumber WHEN 1 THEN m = 0 WHEN 2 THEN m = 1 AND q % 2 = 0 WHEN 3 THEN m = 2 WHEN 4 THEN m = 3 WHEN 5 THEN m = 4 OR m = 3 WHEN 6 THEN m = 1 ELSE false END AS matches FROM i""")
def q60(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"))
    rows = rows.select("*", F.expr(_WANTED).alias("expected"), F.expr(_SHOWN).alias("data_type"))
    udt = F.when(F.col("data_type") == "bigint", "INTEGER").otherwise("int8")
    same = picture.catalog_type_matches("expected", "data_type", udt, F.when(F.col("q") % 2 == 0, F.col("q")).otherwise(0), F.lit(2))
    return rows.select("l_orderkey", "l_linenumber", "expected", "data_type", same.alias("matches"))


# ------------------------------------------------------------------ dialects

_ENDS = (".txt", ".jcl", ".cpy", ".cbl", ".csv", ".pli", ".inc", ".nsn", ".rpg", ".ddm", ".h")
_FILE = f"concat(source, '/', doc_id, CASE doc_id % {len(_ENDS)} {' '.join(f'WHEN {i} THEN ' + repr(x) for i, x in enumerate(_ENDS))} END)"
_CONTENT = "concat(text, CASE doc_id % 7 WHEN 0 THEN ' LISTCAT VOLSER' WHEN 1 THEN ' DCL X' WHEN 2 THEN ' Define Data Parameter' WHEN 3 THEN ' dcl-ds Y' WHEN 4 THEN ' procedure options(main)' WHEN 5 THEN ' DSECT' ELSE '' END)"
_SNIFF = f"""SELECT source, doc_id, path, e, CASE WHEN e IN ('.txt', '.lst', '.log', '.out') AND regexp_matches(u, 'CLUSTER|NONVSAM|IDCAMS|LISTCAT') AND regexp_matches(u, 'LISTING FROM CATALOG|REC-TOTAL|VOLSER') THEN 'listcat'
 WHEN e IN ('.jcl', '.job', '.cntl') OR starts_with(c, '//') OR contains(u, 'EXEC PGM=') THEN 'jcl' WHEN e IN ('.cpy', '.copy') THEN 'copybook' WHEN e IN ('.cbl', '.cob', '.cobol') OR regexp_matches(u, '(IDENTIFICATION|PROCEDURE|DATA) DIVISION') THEN 'cobol'
 WHEN e IN ('.pli', '.pl1', '.inc', '.dcl') OR regexp_matches(u, 'PROCEDURE OPTIONS\\(MAIN\\)|DCL |DECLARE ') THEN CASE WHEN regexp_matches(u, 'DCL |DECLARE ') THEN 'copybook' ELSE 'pli' END
 WHEN e IN ('.nsl', '.nsn', '.nsp', '.nsa', '.ddm') OR contains(u, 'DEFINE DATA') THEN CASE WHEN e = '.ddm' OR contains(u, 'DEFINE DATA PARAMETER') THEN 'copybook' ELSE 'natural' END
 WHEN e IN ('.rpg', '.rpgle', '.sqlrpgle') OR regexp_matches(u, 'DCL-(S|F|DS|PROC) ') THEN 'rpg' WHEN e = '.h' THEN 'copybook' ELSE 'other' END AS artifact_type
 FROM (SELECT source, doc_id, {_FILE} AS path, {EXT_SQL.format(p=_FILE)} AS e, {_CONTENT} AS c, upper({_CONTENT}) AS u FROM documents)"""


def _sniffed(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select("source", "doc_id", F.expr(_FILE).alias("path"), F.expr(_CONTENT).alias("content"))
    return dialects.sniffed(files)


@register("q61_sniffed_types", f"SELECT doc_id, path, artifact_type FROM ({_SNIFF})")
def q61(spark, sf_dir):
    return _sniffed(spark, sf_dir).select("doc_id", "path", "artifact_type")


_LANGUAGE = """count(*) FILTER (artifact_type = 'cobol') AS c, count(*) FILTER (artifact_type = 'pli') AS p, count(*) FILTER (artifact_type = 'natural') AS n, count(*) FILTER (artifact_type = 'rpg') AS r,
 count(*) FILTER (artifact_type = 'copybook') AS b, count(*) FILTER (artifact_type = 'copybook' AND e IN ('.pli', '.inc', '.dcl')) AS bp, count(*) FILTER (artifact_type = 'copybook' AND e IN ('.ddm', '.nsl')) AS bn"""


@register("q62_repository_languages", f"""WITH s AS ({_SNIFF}), g AS (SELECT doc_id // 5 AS repository, {_LANGUAGE} FROM s GROUP BY 1)
SELECT repository, c + p + n + r AS n_programs, CASE WHEN c + p + n + r = 0 THEN CASE WHEN b = 0 THEN 'Mixed' WHEN bp > 0 THEN 'PL/I' WHEN bn > 0 THEN 'Natural' ELSE 'COBOL' END
 WHEN c >= 0.8 * (c + p + n + r) THEN 'COBOL' WHEN p >= 0.8 * (c + p + n + r) THEN 'PL/I' WHEN n >= 0.8 * (c + p + n + r) THEN 'Natural' WHEN r >= 0.8 * (c + p + n + r) THEN 'RPG' ELSE 'Mixed' END AS language FROM g""")
def q62(spark, sf_dir):
    return dialects.repository_language(_sniffed(spark, sf_dir).withColumn("repository", F.expr("doc_id div 5")), "repository")


@register("q63_copybook_dialects", f"""SELECT doc_id, CASE WHEN e IN ('.pli', '.pl1', '.inc', '.dcl') OR regexp_matches(u, 'DCL |DECLARE ') THEN 'PL/I' WHEN e IN ('.nsl', '.ddm') OR contains(u, 'DEFINE DATA') THEN 'Natural'
 WHEN e IN ('.rpg', '.rpgle') OR contains(u, 'DCL-DS') THEN 'RPG' WHEN e IN ('.asm', '.s') OR contains(u, 'DSECT') THEN 'Assembler' ELSE 'COBOL' END AS dialect FROM (SELECT doc_id, {EXT_SQL.format(p=_FILE)} AS e, upper({_CONTENT}) AS u FROM documents)""")
def q63(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select("doc_id", F.expr(_FILE).alias("path"), F.expr(_CONTENT).alias("content"))
    return files.select("doc_id", dialects.copybook_dialect("path", "content").alias("dialect"))


_TONGUE = "CASE k % 4 WHEN 0 THEN 'COBOL' WHEN 1 THEN 'PL/I' WHEN 2 THEN 'Natural' ELSE 'RPG' END"
_NAMED = "CASE k % 4 WHEN 0 THEN concat('program-id. prog', k) WHEN 1 THEN concat('Main_', k, ' : procedure') WHEN 2 THEN concat('PROGRAM-ID N', k) ELSE concat('ctl-opt dftactgrp(*no) actgrp(''G', k, ''')') END"
_SOURCE = f"concat(CASE WHEN k % 3 = 0 THEN '' ELSE {_NAMED} END, chr(10), '   READ FILE X', chr(10), CASE WHEN k % 5 = 0 THEN 'exec  cics  rewrite' ELSE 'x update y' END)"


@register("q64_names_and_verbs", f"""WITH {_P} SELECT k, {_TONGUE} AS language, CASE WHEN k % 3 = 0 THEN concat('P', k) ELSE CASE k % 4 WHEN 0 THEN concat('PROG', k) WHEN 1 THEN concat('MAIN_', k) WHEN 2 THEN concat('N', k) ELSE concat('G', k) END END AS name,
 concat(CASE WHEN k % 5 = 0 THEN 'EXEC CICS REWRITE,' ELSE '' END, CASE k % 4 WHEN 0 THEN 'READ' WHEN 1 THEN 'READ FILE' ELSE CASE WHEN k % 5 = 0 THEN 'READ' ELSE 'READ,UPDATE' END END) AS verbs FROM p""")
def q64(spark, sf_dir):
    rows = _parts(spark, sf_dir).select("k", F.expr("concat('src/P', k, '.x')").alias("path"), F.expr(_TONGUE).alias("language"), F.expr(_SOURCE).alias("content"))
    return rows.select("k", "language", dialects.program_name("path", "content", "language").alias("name"), F.array_join(dialects.file_verbs("content", "language"), ",").alias("verbs"))


@register("q65_slices", r"""
WITH s AS (SELECT doc_id, CASE WHEN text = '' THEN [] ELSE regexp_split_to_array(regexp_replace(text, '(\r\n|\n|\r)$', ''), '\r\n|\n|\r') END AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS text FROM s), h AS (SELECT *, contains(lower(text), 'ing') AS hit FROM l WHERE NOT regexp_matches(text, '^\s*($|\*)')),
e AS (SELECT *, NOT hit AND regexp_matches(text, '\.\s*$') AS stop FROM h), p AS (SELECT *, coalesce(sum(stop::INTEGER) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM e),
w AS (SELECT *, min(CASE WHEN hit THEN line_no END) OVER (PARTITION BY doc_id, part) AS first_line, bool_or(stop) OVER (PARTITION BY doc_id, part) AS ended FROM p)
SELECT doc_id, part::BIGINT AS part, count(*) AS n_lines, min(line_no)::INTEGER AS first_line, max(line_no)::INTEGER AS last_line FROM w WHERE ended AND line_no >= first_line GROUP BY 1, 2""")
def q65(spark, sf_dir):
    lines = repository.lines(table(spark, sf_dir, "documents"), "text", "doc_id").withColumnRenamed("doc_id", "path")
    kept = dialects.slices(lines, F.lower("text").contains("ing"))
    return kept.groupBy(F.col("path").alias("doc_id"), "part").agg(F.count(F.lit(1)).alias("n_lines"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


_SECOND = "concat(CASE WHEN k % 3 <> 0 THEN '|STEP2:MYPROC:' ELSE ',' END, 'IN=INSTREAM,OUT=DUMMY,TMP=&&W', k)"


@register("q66_job_hierarchy", f"""WITH {_P} SELECT {_JCL} AS path, concat('JOBLIB=A.K', k, CASE WHEN k % 2 = 0 THEN '+B' ELSE '' END) AS job_dds, concat('STEP1:AAA', w, ':STEPLIB=C+D', k, ',SYSPRINT=*', {_SECOND}) AS steps FROM p""")
def q66(spark, sf_dir):
    dds = lambda xs: F.array_join(F.transform(xs, lambda d: F.array_join(F.concat(F.array(F.concat(d["name"], F.lit("="), d["dataset"])), F.transform(d["concatenations"], lambda c: c["dataset"])), "+")), ",")
    rows = hierarchy.jobs(evidence.extract("jcl", _jobs(spark, sf_dir)))
    steps = F.transform("steps", lambda s: F.concat_ws(":", s["name"], F.array_join(F.transform(s["exec"], lambda e: e["program"]), "+"), dds(s["dds"])))
    return rows.select("path", dds(F.col("job_level_dds")).alias("job_dds"), F.array_join(steps, "|").alias("steps"))


_CPY = "concat('F', k, '.cpy')"
FRAGMENT = tuple(_card(*x, path=_CPY) for x in (
    (1, "    OPEN INPUT F{w}."), (2, "MAIN-PARA."), (3, "    MOVE 1 TO A{k}."), (4, "    END-IF.", "k % 2 = 0"), (5, "* READ nothing"), (6, "000600 NEXT-{c}.", "k % 3 = 0"), (7, "    exec  cics READ FILE{s}"), (8, "01 DATA-ITEM PIC X.", "k % 4 = 0"),
))
_FRAGMENT = ("path", "source_line", "type", "name", "statement", "paragraph")
_FRAGMENTS = tuple((_CPY, *x, f"k % 4 <> 0{' AND k % 3 = 0' if x[0] == '6' else ''}") for x in (
    ("0", "'copybook_fragment'", "'Procedure Fragment'", "NULL", "NULL"), ("1", "'statement'", "concat('OPEN INPUT F', w)", "'OPEN'", "NULL"), ("2", "'paragraph'", "'MAIN-PARA'", "NULL", "NULL"), ("3", "'statement'", "concat('MOVE 1 TO A', k)", "'MOVE'", "'MAIN-PARA'"),
    ("6", "'paragraph'", "concat('NEXT-', c)", "NULL", "NULL"), ("7", "'statement'", "concat('EXEC  CICS READ FILE', s)", "'EXEC  CICS'", "CASE WHEN k % 3 = 0 THEN concat('NEXT-', c) ELSE 'MAIN-PARA' END"),
))


@register("q67_fragments", f"WITH {_P} {_each_sql(_FRAGMENT, _FRAGMENTS)}")
def q67(spark, sf_dir):
    return hierarchy.fragments(_each(_parts(spark, sf_dir), _LINE, FRAGMENT))


@register("q68_grouped_artifacts", f"""WITH s AS ({_SNIFF}), c AS (SELECT doc_id, CASE WHEN artifact_type = 'copybook' THEN 'copybooks' WHEN artifact_type = 'jcl' THEN 'jcl_jobs' WHEN artifact_type = 'cobol' THEN 'programs' ELSE 'other_artifacts' END AS "group" FROM s WHERE artifact_type <> 'listcat' AND doc_id % 3 <> 0)
SELECT doc_id AS artifact_id, "group", true AS canonical FROM c UNION ALL SELECT doc_id, 'copybooks', false FROM documents WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = documents.doc_id AND c."group" = 'copybooks')""")
def q68(spark, sf_dir):
    canonical = _sniffed(spark, sf_dir).where("doc_id % 3 <> 0").select(F.col("doc_id").alias("artifact_id"), "artifact_type", F.lit(True).alias("canonical"))
    older = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("artifact_id"), F.lit("copybooks").alias("group"), F.lit(False).alias("canonical"))
    return hierarchy.grouped(canonical, older).select("artifact_id", "group", "canonical")


# ------------------------------------------------------------------ datasets and schemas

_USER = "concat('SELECT F ASSIGN TO CUST', w, 'FILE.', chr(10), ' copy lay', c, '.', chr(10), ' MOVE X TO ORDER', s, '.')"


@register("q69_dataset_users", f"""WITH {_P}, d AS (SELECT n_nationkey AS n, concat('PROD.ORDER', n_nationkey, '.CUST', n_nationkey, 'DATA.RG', n_nationkey) AS dsn FROM nation)
SELECT {_JCL} AS path, dsn FROM p, d WHERE contains(concat('PRG', k % 50), concat('RG', n)) OR starts_with(concat('CUST', w, 'FILE'), concat('CUST', n)) OR s = n OR c = n % 9""")
def q69(spark, sf_dir):
    programs = _parts(spark, sf_dir).select(F.expr(_JCL).alias("path"), F.expr("concat('Prg', k % 50)").alias("name"), F.expr(_USER).alias("content"))
    datasets = table(spark, sf_dir, "nation").select(F.expr("concat('PROD.ORDER', n_nationkey, '.CUST', n_nationkey, 'DATA.RG', n_nationkey)").alias("dsn"), F.expr("concat('cpy/LAY', n_nationkey % 9, '.cpy')").alias("copybook"))
    return dialects.uses_dataset(programs, datasets)


@register("q70_flat_ddl", f"""WITH {_P}, b AS (SELECT k, concat('T', k) AS t, k % 2 = 0 AS has_key, s, w FROM p)
SELECT t AS table_name, concat('CREATE TABLE "t', k, '" (', chr(10), '    "id" BIGINT,', chr(10), '    "name" VARCHAR(', s, ')', CASE WHEN has_key THEN concat(',', chr(10), '    PRIMARY KEY ("id")') ELSE '' END, chr(10), ');') AS ddl FROM b
UNION ALL SELECT concat(t, '_TAG'), concat('CREATE TABLE "t', k, '_tag" (', chr(10), CASE WHEN has_key THEN concat('    "parent_id" BIGINT NOT NULL,', chr(10), '    "occurrence_index" INTEGER NOT NULL,', chr(10)) ELSE '' END, '    "value" VARCHAR(', w, ')',
 CASE WHEN has_key THEN concat(',', chr(10), '    PRIMARY KEY ("parent_id", "occurrence_index"),', chr(10), '    FOREIGN KEY ("parent_id") REFERENCES "t', k, '" ("id")') ELSE '' END, chr(10), ');') FROM b WHERE k % 3 = 0""")
def q70(spark, sf_dir):
    p = _parts(spark, sf_dir)
    columns = _each(p, ("table_name", "position", "column_name", "sql_type", "is_primary"), (("concat('T', k)", "1", "'ID'", "'BIGINT'", "k % 2 = 0", "true"), ("concat('T', k)", "2", "'NAME'", "concat('VARCHAR(', s, ')')", "false", "true")))
    children = _each(p, ("table_name", "child", "position", "column_name", "sql_type"), (("concat('T', k)", "'TAG'", "1", "'VALUE'", "concat('VARCHAR(', w, ')')", "k % 3 = 0"),))
    return relational.emit(*catalogs.flat_tables(columns, children)).select("table_name", "ddl")


_ONE = "concat('{{\"dsn\": \"A.B', k, '\", \"organization\": \"KSDS\", \"type\": \"CLUSTER\", \"size\": ', s, '}}')".replace("{{", "{").replace("}}", "}")
_JSON = f"CASE WHEN k % 2 = 0 THEN {_ONE} ELSE concat('[', {_ONE}, ', {{\"dsn\": \"LOST\"}}, {{\"dsn\": \"C.D', k, '\", \"organization\": \"ESDS\"}}]') END"


@register("q71_json_catalogs", f"WITH {_P} SELECT k, 1 AS source_line, concat('A.B', k) AS dsn, 'CLUSTER' AS entry_type, 'KSDS' AS organization, CAST(s AS VARCHAR) AS size FROM p UNION ALL SELECT k, 3, concat('C.D', k), 'DATASET', 'ESDS', NULL FROM p WHERE k % 2 <> 0")
def q71(spark, sf_dir):
    found = catalogs.json_entries(_parts(spark, sf_dir).select(F.col("k").alias("path"), F.expr(_JSON).alias("content")))
    p = F.col("properties")
    return found.select(F.col("path").alias("k"), "source_line", F.col("entity_name").alias("dsn"), p["entry_type"].alias("entry_type"), p["organization"].alias("organization"), p["size"].alias("size"))


_ROW = "concat('L', l_orderkey, '-', l_suppkey, '-', l_linenumber)"


@register("q72_listing_facts", f"""WITH r AS (SELECT concat('PROD.PART', l_partkey) AS dsn, {_ROW} AS path, CAST(round(l_extendedprice * 100) AS BIGINT) AS row_no, CAST(l_quantity AS BIGINT) AS q, l_linenumber AS n FROM lineitem),
f AS (SELECT *, row_number() OVER (PARTITION BY dsn ORDER BY path, row_no) AS nth FROM r)
SELECT dsn, path, row_no, q AS record_length, CASE WHEN n % 2 = 0 THEN n END::BIGINT AS key_length, 0::BIGINT AS key_offset, 4096::BIGINT AS control_interval, q * 10 AS records, CASE n % 3 WHEN 0 THEN 'KSDS' WHEN 1 THEN 'RRDS' ELSE 'UNKNOWN' END AS organization FROM f WHERE nth = 1 AND dsn IN (SELECT concat('PROD.PART', p_partkey) FROM part)""")
def q72(spark, sf_dir):
    q, n = F.col("l_quantity").cast("long").cast("string"), F.col("l_linenumber")
    cells = {
        "DATASET NAME": F.concat(F.lit("see prod.part"), F.col("l_partkey").cast("string"), F.lit(" here")), "MAX LRECL": F.concat(q, F.lit(" bytes")), "KEYLEN": F.when(n % 2 == 0, n.cast("string")).otherwise("none"), "KEYOFF": F.lit("0"),
        "CISIZE": F.lit("4,096"), "RECORD COUNT": F.concat(q, F.lit("0")), "DS TYPE": F.when(n % 3 == 0, "vsam ksds").when(n % 3 == 1, "rrds").otherwise("ps"),
    }
    rows = table(spark, sf_dir, "lineitem").select(F.expr(_ROW).alias("path"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("row_no"), F.create_map(*[x for k, v in cells.items() for x in (F.lit(k), v)]).alias("cells"))
    return catalogs.listing_facts(rows, table(spark, sf_dir, "part").select(F.concat(F.lit("PROD.PART"), F.col("p_partkey").cast("string")).alias("dsn")), whole=True).drop("confidence")


@register("q73_mapping_summary", _PIC_SQL + """, t AS (SELECT *, l_orderkey % 11 <> 0 AS a, CASE WHEN category IN ('ALPHANUMERIC', 'ALPHABETIC') THEN 'String' WHEN "precision" IS NULL THEN 'Unknown' ELSE 'number' END AS l FROM m)
SELECT l_linenumber, count(*) AS total_fields, count(*) FILTER (a AND l <> 'Unknown') AS postgres_compatible, count(*) FILTER (a AND (l = 'Unknown' OR l_orderkey % 17 = 0)) AS requires_review, count(*) FILTER (a AND l = 'Unknown') AS unsupported, count(*) FILTER (a AND l = 'number') AS numeric_conversions,
 count(*) FILTER (a AND l = 'String') AS character_conversions, 0 AS date_conversions, count(*) FILTER (NOT a) AS redefines_handled, count(*) FILTER (l_orderkey % 13 = 0) AS alternate_repr_fields, count(*) FILTER (a AND l_orderkey % 4 <> 3) AS occurs_fields,
 count(*) FILTER (a AND l_orderkey % 4 = 0) AS occurs_needs_review, count(*) FILTER (a AND l_orderkey % 4 = 1) AS occurs_inline_array, count(*) FILTER (a AND l_orderkey % 4 = 2) AS occurs_child_table FROM t GROUP BY 1""")
def q73(spark, sf_dir):
    k, none = F.col("l_orderkey"), F.lit(None)
    mapped = picture.sql_type(F.col("category"), F.col("precision"), F.col("scale"), F.col("logical_length"), F.col("usage"))
    strategy = F.when(k % 4 == 0, "REVIEW_REQUIRED").when(k % 4 == 1, "INLINE_ARRAY").when(k % 4 == 2, "CHILD_TABLE")
    rows = _pictures(spark, sf_dir).select(
        "l_linenumber", mapped.alias("t"), (k % 11 == 0).alias("is_excluded"), (k % 13 == 0).alias("is_alternate"), F.when(k % 17 == 0, "REVIEW_REQUIRED").otherwise("MAPPED").alias("schema_status"),
        F.when(k % 4 != 3, F.lit(5)).otherwise(none).alias("occurs"), strategy.alias("occurs_strategy"))
    return catalogs.mapping_summary(rows.select("*", "t.*"), "l_linenumber")


@register("q74_table_differences", """(SELECT c_custkey AS key, 'MISSING' AS status FROM customer EXCEPT SELECT o_custkey + 5, 'MISSING' FROM orders) UNION ALL (SELECT o_custkey + 5, 'UNEXPECTED' FROM orders EXCEPT SELECT c_custkey, 'UNEXPECTED' FROM customer)""")
def q74(spark, sf_dir):
    return catalogs.differences(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), table(spark, sf_dir, "orders").select((F.col("o_custkey") + 5).alias("key")))


@register("q75_canonical_names", "SELECT p_partkey, CASE WHEN contains(upper(p_name), 'COLD') THEN 'PROD.COLD.MASTER' WHEN contains(upper(p_name), 'WIDGET') THEN 'PROD.WIDGET' ELSE p_name END AS canonical FROM part")
def q75(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", catalogs.canonical_name("p_name", {"cold": "PROD.COLD.MASTER", "WIDGET": "PROD.WIDGET"}).alias("canonical"))


@register("q76_recorded_events", r"""SELECT 'run-1' AS run_id, event_id, concat('password:[REDACTED] of ', user_id) AS summary, '[LOCAL_PATH]' AS source_file, '[REDACTED]' AS key, concat('kind ', event_type) AS note FROM events""")
def q76(spark, sf_dir):
    of = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    details = F.create_map(F.lit("api_key"), F.col("props"), F.lit("note"), of("kind ", F.col("event_type")))
    rows = catalogs.recorded(table(spark, sf_dir, "events"), "run-1", event_id=F.col("event_id"), summary=of("password: ", F.col("event_type"), " of ", F.col("user_id")), source_file=of("C:\\work\\", F.col("user_id")), details=details)
    return rows.select("run_id", "event_id", "summary", "source_file", F.col("details")["api_key"].alias("key"), F.col("details")["note"].alias("note"))


@register("q77_stale_artifacts", "SELECT CASE event_type WHEN 'view' THEN 'JCL' ELSE 'COPYBOOK' END AS artifact_type, count(*) AS n_stale FROM events WHERE event_type IN ('view', 'click') AND (event_type = 'click' OR event_id % 3 = 0) GROUP BY 1")
def q77(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "JCL").when(F.col("event_type") == "click", "COPYBOOK").otherwise("OTHER")
    rows = table(spark, sf_dir, "events").select(kind.alias("artifact_type"), F.when(F.col("event_id") % 3 != 0, F.create_map(F.lit("jcl_hierarchy"), F.lit("1"))).otherwise(F.create_map(F.lit("jcl_hierarchy"), F.lit(""))).alias("properties"))
    return catalogs.stale(rows, {"JCL": "jcl_hierarchy", "COPYBOOK": "copybook_model_version"})
