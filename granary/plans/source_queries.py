"""Queries of the source operators: layouts, pictures, schemas, programs and jobs, each beside its SQL.

The driver's tables hold no such sources, so every row of a table states one: its numbers become lengths, repetitions and
names, and its key decides which lines stand.  Expressions that state them are SQL that both engines read; the expected
results are computed from the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import picture
from granary.operators import evidence, graph, layout, program, relational, resolve, schema
from granary.plans.registry import register, table
from granary.sources.repository import spread

#: Numbers of a source: its key, a length, digits, a repetition, a width.
_NUMBERS = {"k": "p_partkey", "s": "CAST(p_size AS INTEGER)", "c": "CAST(p_size % 9 + 1 AS INTEGER)", "o": "CAST(p_size * 5 AS INTEGER)", "w": "CAST(p_partkey % 20 + 1 AS INTEGER)"}
_P = f"p AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _NUMBERS.items())} FROM part)"
Stated = tuple[tuple[str, ...], ...]
#: A row of a few numbers becomes a source of many lines.
_SOURCES_A_TASK = 16_384


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "part").select(*[F.expr(v).alias(k) for k, v in _NUMBERS.items()]), rows=_SOURCES_A_TASK)


#: The same numbers from documents, which grow with the data: ids, lengths.
_DOC_NUMBERS = {
    "k": "doc_id", "s": "CAST(doc_id % 50 + 1 AS INTEGER)", "c": "CAST(n_chars % 9 + 1 AS INTEGER)", "o": "CAST((doc_id % 50 + 1) * 5 AS INTEGER)",
    "w": "CAST(n_chars % 20 + 1 AS INTEGER)",
}
_D = f"p AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _DOC_NUMBERS.items())} FROM documents)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(*[F.expr(v).alias(k) for k, v in _DOC_NUMBERS.items()]), rows=_SOURCES_A_TASK)


def _each(rows: DataFrame, names: tuple[str, ...], stated: Stated) -> DataFrame:
    """For every row the stated rows: expressions by name, then the condition under which they stand."""
    one = lambda r: F.when(F.expr(r[-1]), F.struct(*[F.expr(x).alias(n) for n, x in zip(names, r[:-1], strict=True)]))
    return rows.select(F.explode(F.array_compact(F.array(*[one(r) for r in stated]))).alias("r")).select("r.*")


def _each_sql(names: tuple[str, ...], stated: Stated, source: str = "p") -> str:
    return " UNION ALL ".join(f"SELECT {', '.join(f'{x} AS {n}' for n, x in zip(names, r[:-1], strict=True))} FROM {source} WHERE {r[-1]}" for r in stated)


def _card(no: int, text: str, when: str = "true", path: str = "concat('P', k, '.cpy')") -> tuple[str, ...]:
    """A line of a source; {x} stands for a number."""
    parts = text.replace("'", "''").replace("{", "}").split("}")
    return (path, str(no), f"concat({', '.join(x if i % 2 else repr_sql(x) for i, x in enumerate(parts))})", when)


def repr_sql(text: str) -> str:
    return f"'{text}'"


_LINE = ("path", "line_no", "text")

# ------------------------------------------------------------------ layouts

LAYOUT = (
    _card(1, "01 RECORD."), _card(2, " 05 ID PIC X({s})."), _card(3, " 05 SPLIT REDEFINES ID."), _card(4, "  10 HEAD PIC X({c})."),
    _card(5, "  10 TAIL PIC 9({c}).", "k % 7 <> 0"), _card(5, "  10 TAIL PIC 9({c}) OCCURS 2 TIMES.", "k % 7 = 0"), _card(6, " 05 PLAIN REDEFINES ID PIC X({w})."),
    _card(7, " 05 LOST REDEFINES NOWHERE PIC X.", "k % 4 = 0"), _card(8, " 05 COST PIC S9({c})V99 COMP-3."), _card(9, "  88 FREE VALUE 0.", "k % 5 <> 0"),
    _card(10, " 05 TAGS PIC X({w}) OCCURS {o} TIMES."), _card(11, " 05 SIZES OCCURS {s} TIMES.", "k % 3 <> 0"), _card(12, "  10 CODE PIC 9({c}) COMP.", "k % 3 <> 0"),
    _card(13, "  10 TITLE PIC X({w}).", "k % 3 <> 0"), _card(14, "77 COUNTER PIC 9({c})."),
)
# bytes of the packed and the binary item, repetitions of TAIL, of SIZES, and where the record ends
_M = f"""{_P}, n AS (SELECT *, concat('P', k, '.cpy') AS path, CAST(ceil((c + 3) / 2.0) AS INTEGER) AS cost, CASE WHEN c <= 4 THEN 2 ELSE 4 END AS code, CASE WHEN k % 7 = 0 THEN 2 ELSE 1 END AS t, CASE WHEN k % 3 <> 0 THEN s ELSE 0 END AS z FROM p),
m AS (SELECT *, greatest(s + cost + w * o + z * (code + w), c + c * t, w) AS total FROM n)"""


def _declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(_parts(spark, sf_dir), _LINE, LAYOUT)


def _layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.layout(_declared(spark, sf_dir))


@register("q13_level_tree", rf"""WITH {_P}, l AS ({_each_sql(_LINE, LAYOUT)}),
d AS (SELECT path, line_no AS seq, regexp_extract(text, '^\s*(\d\d)\s+([A-Z0-9_-]+)', 1)::INTEGER AS level, regexp_extract(text, '^\s*(\d\d)\s+([A-Z0-9_-]+)', 2) AS name FROM l),
t AS (SELECT d.*, sum((level = 77)::INTEGER) OVER (PARTITION BY path ORDER BY seq) AS part FROM d),
a AS (SELECT c.path, c.seq, max(q.seq) AS parent FROM t c JOIN t q ON q.path = c.path AND q.part = c.part AND q.seq < c.seq AND q.level NOT IN (66, 88) AND (c.level = 88 OR q.level < c.level) WHERE c.level <> 77 GROUP BY 1, 2)
SELECT path, seq, level, name, parent FROM t LEFT JOIN a USING (path, seq)""")
def q13(spark, sf_dir):
    return layout.tree(layout.declarations(_declared(spark, sf_dir))).select("path", "seq", "level", "name", F.split_part("parent_id", F.lit(":"), F.lit(2)).cast("int").alias("parent"))


# pictures with their stated usage, one a line item
_PIC = "CASE l_linenumber WHEN 1 THEN concat('X(', q, ')') WHEN 2 THEN concat('S9(', q, ')V99') WHEN 3 THEN concat('9(', q, ')') WHEN 4 THEN concat('A(', q, ')') WHEN 5 THEN concat('ZZ9(', q, ')') WHEN 6 THEN concat('9(', q, ')V9(3)') ELSE CASE WHEN q % 2 = 0 THEN '$$$' ELSE concat('X(', q, ')9(2)') END END"
_USAGE = "CASE l_orderkey % 8 WHEN 0 THEN 'COMP-3' WHEN 1 THEN 'COMP' WHEN 2 THEN 'COMP-1' WHEN 3 THEN 'COMP-2' WHEN 4 THEN 'BINARY' WHEN 5 THEN 'COMPUTATIONAL-3' END"
_PIC_SQL = rf"""WITH i AS (SELECT *, CAST(l_quantity AS INTEGER) AS q FROM lineitem), r AS (SELECT l_orderkey, l_linenumber, {_PIC} AS pic, {_USAGE} AS stated FROM i),
n AS (SELECT *, coalesce(list_sum(list_transform(regexp_extract_all(pic, '[XA](\((\d+)\))?', 2), lambda x : coalesce(nullif(x, '')::INTEGER, 1))), 0) AS alpha,
  coalesce(list_sum(list_transform(regexp_extract_all(string_split(pic, 'V')[1], '[9Z](\((\d+)\))?', 2), lambda x : coalesce(nullif(x, '')::INTEGER, 1))), 0) AS whole,
  coalesce(list_sum(list_transform(regexp_extract_all(coalesce(string_split(pic, 'V')[2], ''), '[9Z](\((\d+)\))?', 2), lambda x : coalesce(nullif(x, '')::INTEGER, 1))), 0) AS fraction,
  CASE stated WHEN 'COMPUTATIONAL-3' THEN 'COMP-3' ELSE coalesce(stated, 'DISPLAY') END AS usage FROM r),
m AS (SELECT l_orderkey, l_linenumber, pic, usage, CASE WHEN alpha > 0 AND contains(pic, 'X') THEN 'ALPHANUMERIC' WHEN alpha > 0 THEN 'ALPHABETIC' WHEN whole + fraction > 0 THEN 'NUMERIC' ELSE 'UNSUPPORTED' END AS category,
  CASE WHEN alpha = 0 THEN nullif(whole + fraction, 0) END::INTEGER AS "precision", fraction::INTEGER AS scale, CASE WHEN alpha > 0 THEN alpha ELSE nullif(whole + fraction, 0) END::INTEGER AS logical FROM n)"""


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"))
    rows = rows.select("l_orderkey", "l_linenumber", F.expr(_PIC).alias("pic"), F.expr(_USAGE).alias("stated"))
    return rows.select("l_orderkey", "l_linenumber", "pic", picture.meaning("pic", "stated").alias("m")).select("l_orderkey", "l_linenumber", "pic", "m.*")


@register("q14_pictures", _PIC_SQL + """ SELECT l_orderkey, l_linenumber, pic, usage, category, "precision", scale, logical, CASE WHEN logical IS NULL THEN NULL WHEN usage = 'DISPLAY' THEN logical WHEN usage = 'COMP-3' THEN ceil((coalesce("precision", 0) + 1) / 2.0)
  WHEN usage IN ('COMP', 'BINARY') AND coalesce("precision", 0) <= 4 THEN 2 WHEN usage IN ('COMP', 'BINARY') AND "precision" <= 9 THEN 4 WHEN usage IN ('COMP', 'BINARY') AND "precision" <= 18 THEN 8 WHEN usage = 'COMP-1' THEN 4 WHEN usage = 'COMP-2' THEN 8 END::INTEGER AS n_bytes FROM m""")
def q14(spark, sf_dir):
    n = picture.physical_length(F.lit("ELEMENTARY"), F.col("logical_length"), F.col("precision"), F.col("usage"))
    return _pictures(spark, sf_dir).select("l_orderkey", "l_linenumber", "pic", "usage", "category", "precision", "scale", F.col("logical_length").alias("logical"), n.cast("int").alias("n_bytes"))


_PLACED = ("path", "name", "begins", "n_bytes", "span")
_PLACES = (
    ("path", "'RECORD'", "0", "total", "total", "true"), ("path", "'ID'", "0", "s", "s", "true"), ("path", "'SPLIT'", "0", "c + c * t", "c + c * t", "true"), ("path", "'HEAD'", "0", "c", "c", "true"), ("path", "'TAIL'", "c", "c", "c * t", "true"),
    ("path", "'PLAIN'", "0", "w", "w", "true"), ("path", "'LOST'", "s", "1", "1", "k % 4 = 0"), ("path", "'COST'", "s", "cost", "cost", "true"), ("path", "'TAGS'", "s + cost", "w", "w * o", "true"),
    ("path", "'SIZES'", "s + cost + w * o", "code + w", "(code + w) * s", "z > 0"), ("path", "'CODE'", "s + cost + w * o", "code", "code", "z > 0"), ("path", "'TITLE'", "s + cost + w * o + code", "w", "w", "z > 0"), ("path", "'COUNTER'", "total", "c", "c", "true"),
)


@register("q15_layout", f"WITH {_M} {_each_sql(_PLACED, _PLACES, 'm')}")
def q15(spark, sf_dir):
    return _layouts(spark, sf_dir).where("NOT is_filler AND node_type <> 'CONDITION'").select("path", "name", F.col("absolute_offset").alias("begins"), F.col("byte_length").alias("n_bytes"), F.col("span_max").alias("span"))


@register("q16_type_map", _PIC_SQL + """ SELECT l_orderkey, l_linenumber, pic, usage, CASE WHEN category IN ('ALPHANUMERIC', 'ALPHABETIC') THEN concat('VARCHAR(', logical, ')') WHEN "precision" IS NULL THEN NULL WHEN usage = 'COMP-1' THEN 'REAL' WHEN usage = 'COMP-2' THEN 'DOUBLE PRECISION'
  WHEN scale > 0 THEN concat('NUMERIC(', "precision", ',', scale, ')') WHEN "precision" <= 4 THEN 'SMALLINT' WHEN "precision" <= 9 THEN 'INTEGER' WHEN "precision" <= 18 THEN 'BIGINT' ELSE concat('NUMERIC(', "precision", ', 0)') END AS sql_type FROM m""")
def q16(spark, sf_dir):
    t = picture.sql_type(F.col("category"), F.col("precision"), F.col("scale"), F.col("logical_length"), F.col("usage"))
    return _pictures(spark, sf_dir).select("l_orderkey", "l_linenumber", "pic", "usage", t["sql_type"].alias("sql_type"))


_name = lambda c: F.split_part(c, F.lit(":"), F.lit(3))


@register("q17_overlays", f"""WITH {_M}
SELECT path, 'SPLIT' AS name, 'ID' AS target, CASE WHEN t = 1 AND 2 * c <= s THEN 'ALTERNATE_REPRESENTATION' ELSE 'REVIEW_REQUIRED' END AS strategy, CASE WHEN t = 1 AND 2 * c = s THEN 'HIGH' WHEN t = 1 AND 2 * c < s THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM m
UNION ALL SELECT path, 'PLAIN', 'ID', 'SAME_TABLE', 'HIGH' FROM m UNION ALL SELECT path, 'LOST', NULL, 'REVIEW_REQUIRED', 'LOW' FROM m WHERE k % 4 = 0""")
def q17(spark, sf_dir):
    return resolve.overlays(_layouts(spark, sf_dir)).select(F.split_part("node_id", F.lit(":"), F.lit(1)).alias("path"), _name(F.col("node_id")).alias("name"), _name(F.col("target_id")).alias("target"), "strategy", "confidence")


# stated repetitions, one a line item; groups by key
_TIMES = "CASE l_linenumber WHEN 1 THEN concat(q, ' TIMES') WHEN 2 THEN concat('', q) WHEN 3 THEN concat('1 TO ', q, ' TIMES DEPENDING ON ITEM-COUNT') WHEN 4 THEN 'TIMES' WHEN 5 THEN concat('', q * 10) WHEN 6 THEN concat('2 to ', q) ELSE concat(q * 5, ' times') END"


@register("q18_repetitions", rf"""WITH i AS (SELECT *, CAST(l_quantity AS INTEGER) AS q FROM lineitem), v AS (SELECT l_orderkey, l_linenumber, upper({_TIMES}) AS text, l_orderkey % 2 = 0 AS is_group FROM i),
n AS (SELECT *, regexp_matches(text, '\d+\s+TO\s+\d+') AS ranged, nullif(regexp_extract(text, '(\d+)', 1), '')::INTEGER AS n FROM v)
SELECT l_orderkey, l_linenumber, CASE WHEN contains(text, 'DEPENDING') OR ranged OR n IS NULL OR n > 200 THEN 'REVIEW_REQUIRED' WHEN is_group THEN 'CHILD_TABLE' WHEN n <= 20 THEN 'INLINE_ARRAY' ELSE 'CHILD_TABLE' END AS strategy FROM n""")
def q18(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"))
    rows = rows.select("l_orderkey", "l_linenumber", resolve.occurs_value(F.expr(_TIMES)).alias("o"), (F.col("l_orderkey") % 2 == 0).alias("is_group"))
    s = resolve.occurs_strategy(variable=F.col("o.variable"), unknown=F.col("o.unknown"), count=F.col("o.max"), is_group=F.col("is_group"), nested=F.lit(0), has_redefines=F.lit(False), has_picture=F.lit(True), element=F.lit("VARCHAR(10)"))
    return rows.select("l_orderkey", "l_linenumber", s["strategy"].alias("strategy"))


# ------------------------------------------------------------------ schemas

_TABLE, _COLUMN, _KEY = ("table_name", "parent_table"), ("table_name", "position", "column_name", "sql_type", "nullable", "key_position"), ("table_name", "column_name", "target_table", "target_column")
TABLES = (("concat('PART-', k)", "CAST(NULL AS STRING)", "true"), ("concat('PART-', k, '-TAG')", "concat('PART-', k)", "k % 2 = 0"))
COLUMNS = (
    ("concat('PART-', k)", "1", "'RECORD-ID'", "'BIGSERIAL'", "false", "1", "true"), ("concat('PART-', k)", "2", "'Name'", "concat('VARCHAR(', s, ')')", "true", "CAST(NULL AS INTEGER)", "true"), ("concat('PART-', k)", "3", "'Type'", "'INTEGER'", "k % 3 <> 0", "CAST(NULL AS INTEGER)", "true"),
    ("concat('PART-', k, '-TAG')", "1", "'PARENT_RECORD_ID'", "'BIGINT'", "false", "1", "k % 2 = 0"), ("concat('PART-', k, '-TAG')", "2", "'OCCURRENCE_INDEX'", "'INTEGER'", "false", "2", "k % 2 = 0"),
)
KEYS = (("concat('PART-', k, '-TAG')", "'PARENT_RECORD_ID'", "concat('PART-', k)", "'RECORD-ID'", "k % 2 = 0"),)
# what is wrong with some of them
BAD_TABLES = (("concat('PART_', k)", "CAST(NULL AS STRING)", "k % 9 = 0"),)
BAD_COLUMNS = (("concat('PART-', k)", "4", "'NAME'", "'DATE'", "true", "CAST(NULL AS INTEGER)", "k % 5 = 0"), ("concat('PART-', k)", "5", "'Unknown'", "CAST(NULL AS STRING)", "true", "CAST(NULL AS INTEGER)", "k % 7 = 0"))
BAD_KEYS = (("concat('PART-', k)", "'NOWHERE'", "concat('PART-', k)", "'RECORD-ID'", "k % 6 = 0"), ("concat('PART-', k)", "'Name'", "'MISSING'", "'ID'", "k % 10 = 0"))


def _schema(spark: SparkSession, sf_dir: str, tables: Stated = (), columns: Stated = (), keys: Stated = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = _parts(spark, sf_dir)
    return _each(p, _TABLE, TABLES + tables), _each(p, _COLUMN, COLUMNS + columns), _each(p, _KEY, KEYS + keys)


@register("q19_ddl_hash", f"""WITH {_P}, d AS (
 SELECT concat('PART-', k) AS table_name, concat('CREATE TABLE "part_', k, '" (', chr(10), '    "record_id" BIGSERIAL NOT NULL,', chr(10), '    "name" VARCHAR(', s, '),', chr(10), '    "type" INTEGER', CASE WHEN k % 3 = 0 THEN ' NOT NULL' ELSE '' END, ',', chr(10), '    PRIMARY KEY ("record_id")', chr(10), ');') AS ddl FROM p
 UNION ALL SELECT concat('PART-', k, '-TAG'), concat('CREATE TABLE "part_', k, '_tag" (', chr(10), '    "parent_record_id" BIGINT NOT NULL,', chr(10), '    "occurrence_index" INTEGER NOT NULL,', chr(10), '    PRIMARY KEY ("parent_record_id", "occurrence_index"),', chr(10),
  '    FOREIGN KEY ("parent_record_id") REFERENCES "part_', k, '" ("record_id")', chr(10), ');') FROM p WHERE k % 2 = 0)
SELECT table_name, ddl, sha256(ddl) AS ddl_hash FROM d""")
def q19(spark, sf_dir):
    return relational.emit(*_schema(spark, sf_dir))


@register("q26_key_match", f"""WITH {_M}, v AS (SELECT *, 1 + (CASE WHEN c + c * t = s THEN 1 ELSE 0 END) + (CASE WHEN w = s THEN 1 ELSE 0 END) AS n_at FROM m)
SELECT path AS dataset, CASE k % 4 WHEN 2 THEN s + cost WHEN 3 THEN 1000000 ELSE 0 END AS key_offset, CASE k % 4 WHEN 0 THEN s WHEN 1 THEN 99999 WHEN 2 THEN w ELSE 1 END AS key_length,
 CASE k % 4 WHEN 0 THEN CASE WHEN n_at = 1 THEN 'PRIMARY_KEY' ELSE 'AMBIGUOUS' END WHEN 1 THEN 'UNRESOLVED_LENGTH_MISMATCH' WHEN 2 THEN 'PRIMARY_KEY' ELSE 'UNRESOLVED' END AS status,
 CASE k % 4 WHEN 0 THEN CASE WHEN n_at = 1 THEN 'ID' END WHEN 2 THEN 'TAGS' END AS column_name FROM v""")
def q26(spark, sf_dir):
    fields = _layouts(spark, sf_dir).where("level = 5 AND NOT is_filler").select(F.col("path").alias("dataset"), "name", "absolute_offset", "byte_length")
    offset, length = F.expr("CASE k % 4 WHEN 2 THEN s + CAST(ceil((c + 3) / 2.0) AS INTEGER) WHEN 3 THEN 1000000 ELSE 0 END"), F.expr("CASE k % 4 WHEN 0 THEN s WHEN 1 THEN 99999 WHEN 2 THEN w ELSE 1 END")
    return relational.match_keys(fields, _parts(spark, sf_dir).select(F.expr("concat('P', k, '.cpy')").alias("dataset"), offset.alias("key_offset"), length.alias("key_length")))


@register("q27_preflight", f"""WITH {_P} SELECT concat('PART_', k) AS table_name, 'duplicate table' AS issue FROM p WHERE k % 9 = 0 UNION ALL SELECT concat('PART-', k), 'duplicate column' FROM p WHERE k % 5 = 0
UNION ALL SELECT concat('PART-', k), 'missing type' FROM p WHERE k % 7 = 0 UNION ALL SELECT concat('PART-', k), 'foreign key column missing' FROM p WHERE k % 6 = 0 UNION ALL SELECT concat('PART-', k), 'foreign key target missing' FROM p WHERE k % 10 = 0""")
def q27(spark, sf_dir):
    return relational.preflight(*_schema(spark, sf_dir, BAD_TABLES, BAD_COLUMNS, BAD_KEYS))


@register("q37_validation_summary", _PIC_SQL + """ SELECT count(*) AS n, count(*) FILTER (category = 'NUMERIC') AS numeric, count(*) FILTER (category = 'UNSUPPORTED') AS unsupported, count(*) FILTER (scale > 0) AS scaled, count(DISTINCT usage) AS usages FROM m""")
def q37(spark, sf_dir):
    return _pictures(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("category") == "NUMERIC").alias("numeric"), F.count_if(F.col("category") == "UNSUPPORTED").alias("unsupported"), F.count_if(F.col("scale") > 0).alias("scaled"), F.countDistinct("usage").alias("usages"))


# ------------------------------------------------------------------ programs and jobs

_CBL, _JCL = "concat('P', k, '.cbl')", "concat('P', k, '.jcl')"
PROGRAM = tuple(_card(*x, path=_CBL) for x in (
    (1, "000100 IDENTIFICATION DIVISION."), (2, "000200 PROGRAM-ID. PROG{k}."), (3, "000300 ENVIRONMENT DIVISION."), (4, "000400 INPUT-OUTPUT SECTION."), (5, "000500 FILE-CONTROL."), (6, "000600     SELECT IN-FILE ASSIGN TO IN{k}."),
    (7, "000700 DATA DIVISION."), (8, "000800 FILE SECTION.", "k % 2 = 0"), (9, "000900 FD  IN-FILE."), (10, "001000     COPY LAY{w}."), (11, "001100 PROCEDURE DIVISION."), (12, "001200 MAIN-PARA.", "k % 3 <> 0"),
    (13, "001300     MOVE 1 TO WS-COUNT."), (14, "001400     CALL 'SUB{c}' USING WS-COUNT."), (15, "001500     IF WS-COUNT > {s}"), (16, "001600     END-IF."),
))
JOB = tuple(_card(*x, path=_JCL) for x in (
    (1, "//JOB{k} JOB CLASS=A"), (2, "//JOBLIB DD DSN=A.K{k},DISP=SHR"), (3, "//       DD DSN=B,DISP=SHR", "k % 2 = 0"), (4, "//* a comment"), (5, "//STEP1 EXEC PGM=AAA{w}"), (6, "//STEPLIB DD DSN=C,DISP=SHR"), (7, "//        DD DSN=D{k},"), (8, "//        DISP=(NEW,CATLG)"),
    (9, "//SYSPRINT DD SYSOUT=*"), (10, "//STEP2 EXEC PROC=MYPROC", "k % 3 <> 0"), (11, "//IN DD *"), (12, "data"), (13, "//OUT DD DUMMY"), (14, "//TMP DD DSN=&&W{k},DISP=OLD"),
))

_MARK = ("path", "line_no", "kind", "name", "owner")
_MARKS = tuple((_CBL, no, f"'{kind}'", name, owner, when) for no, kind, name, owner, when in (
    ("1", "division", "'IDENTIFICATION'", "NULL", "true"), ("2", "program_id", "concat('PROG', k)", "'IDENTIFICATION'", "true"), ("3", "division", "'ENVIRONMENT'", "NULL", "true"), ("4", "section", "'INPUT-OUTPUT'", "'ENVIRONMENT'", "true"),
    ("5", "file_control", "'FILE-CONTROL'", "'INPUT-OUTPUT'", "true"), ("7", "division", "'DATA'", "NULL", "true"), ("8", "section", "'FILE'", "'DATA'", "k % 2 = 0"), ("9", "fd", "'IN-FILE'", "'FILE'", "true"), ("10", "copy", "concat('LAY', w)", "'IN-FILE'", "true"),
    ("11", "division", "'PROCEDURE'", "NULL", "true"), ("12", "paragraph", "'MAIN-PARA'", "'PROCEDURE'", "k % 3 <> 0"), *((no, "operation", f"'{verb}'", "CASE WHEN k % 3 <> 0 THEN 'MAIN-PARA' ELSE 'PROCEDURE' END", "true") for no, verb in (("13", "MOVE"), ("14", "CALL"), ("15", "IF"))),
))


def _markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return program.markers(_each(_parts(spark, sf_dir), _LINE, PROGRAM))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(_parts(spark, sf_dir), _LINE, JOB)


@register("q41_program_tree", f"WITH {_P} {_each_sql(_MARK, _MARKS)}")
def q41(spark, sf_dir):
    return program.owned(_markers(spark, sf_dir)).select(*_MARK)


_DD = ("path", "source_line", "dd", "value", "scope", "position")
_LAST_STEP = "CASE WHEN k % 3 <> 0 THEN 'STEP2' ELSE 'STEP1' END"
_DDS = tuple((_JCL, *x) for x in (
    ("2", "'JOBLIB'", "concat('A.K', k)", "'job'", "0", "true"), ("3", "'JOBLIB'", "'B'", "'job'", "1", "k % 2 = 0"), ("6", "'STEPLIB'", "'C'", "'STEP1'", "0", "true"), ("7", "'STEPLIB'", "concat('D', k)", "'STEP1'", "1", "true"), ("9", "'SYSPRINT'", "'*'", "'STEP1'", "0", "true"),
    ("11", "'IN'", "'INSTREAM'", _LAST_STEP, "0", "true"), ("13", "'OUT'", "'DUMMY'", _LAST_STEP, "0", "true"), ("14", "'TMP'", "concat('&&W', k)", _LAST_STEP, "0", "true"),
))


@register("q42_job_allocations", f"WITH {_P} {_each_sql(_DD, _DDS)}")
def q42(spark, sf_dir):
    p = F.col("properties")
    return evidence.data_definitions(_jobs(spark, sf_dir)).select("path", "source_line", F.col("entity_name").alias("dd"), "value", F.coalesce(p["step_name"], F.lit("job")).alias("scope"), p["position"].cast("int").alias("position"))


_WHOLE = "CASE WHEN c <= 4 THEN 'SMALLINT' ELSE 'INTEGER' END"
_OWN, _TAGS, _SIZES = "concat('P', k)", "concat('P', k, '_RECORD_TAGS')", "concat('P', k, '_RECORD_SIZES')"
_MANY, _BOTH = "o > 20 AND o <= 200", "t = 1 AND 2 * c <= s"
_FIELDS = (
    (_OWN, "'RECORD_ID'", "'BIGSERIAL'", "true"), (_OWN, "'ID'", "concat('VARCHAR(', s, ')')", "true"), (_OWN, "'HEAD'", "concat('VARCHAR(', c, ')')", _BOTH), (_OWN, "'TAIL'", _WHOLE, _BOTH), (_OWN, "'COST'", "concat('NUMERIC(', c + 2, ',2)')", "true"),
    (_OWN, "'TAGS'", "concat('VARCHAR(', w, ')[]')", "o <= 20"), (_OWN, "'COUNTER'", _WHOLE, "true"), (_TAGS, "'PARENT_RECORD_ID'", "'BIGINT'", _MANY), (_TAGS, "'OCCURRENCE_INDEX'", "'INTEGER'", _MANY), (_TAGS, "'TAGS'", "concat('VARCHAR(', w, ')')", _MANY),
    (_SIZES, "'PARENT_RECORD_ID'", "'BIGINT'", "z > 0"), (_SIZES, "'OCCURRENCE_INDEX'", "'INTEGER'", "z > 0"), (_SIZES, "'CODE'", _WHOLE, "z > 0"), (_SIZES, "'TITLE'", "concat('VARCHAR(', w, ')')", "z > 0"),
)


@register("q43_schema_columns", f"WITH {_M} {_each_sql(('table_name', 'column_name', 'sql_type'), _FIELDS, 'm')}")
def q43(spark, sf_dir):
    return schema.generate(_layouts(spark, sf_dir)).columns.select("table_name", "column_name", "sql_type")


@register("q54_layout_repetitions", f"""WITH {_M}
SELECT path, 'TAIL' AS name, 'INLINE_ARRAY' AS strategy, 'HIGH' AS confidence, concat({_WHOLE}, '[]') AS element_type FROM m WHERE t = 2
UNION ALL SELECT path, 'TAGS', CASE WHEN o > 200 THEN 'REVIEW_REQUIRED' WHEN o <= 20 THEN 'INLINE_ARRAY' ELSE 'CHILD_TABLE' END, CASE WHEN o > 200 THEN 'LOW' WHEN o <= 20 THEN 'HIGH' ELSE 'MEDIUM' END,
 CASE WHEN o <= 20 THEN concat('VARCHAR(', w, ')[]') WHEN o <= 200 THEN concat('VARCHAR(', w, ')') END FROM m UNION ALL SELECT path, 'SIZES', 'CHILD_TABLE', 'HIGH', NULL FROM m WHERE z > 0""")
def q54(spark, sf_dir):
    return resolve.repetitions(_layouts(spark, sf_dir)).select(F.split_part("node_id", F.lit(":"), F.lit(1)).alias("path"), _name(F.col("node_id")).alias("name"), "strategy", "confidence", "element_type")


@register("q55_record_lengths", f"WITH {_M} SELECT path, total + c AS record_length_min, total + c AS record_length_max FROM m")
def q55(spark, sf_dir):
    return layout.record_lengths(_layouts(spark, sf_dir))


@register("q56_program_facts", f"""WITH {_P} SELECT {_CBL} AS path, 'IDENTIFICATION,ENVIRONMENT,DATA,PROCEDURE' AS divisions, CASE WHEN k % 2 = 0 THEN 'INPUT-OUTPUT,FILE' ELSE 'INPUT-OUTPUT' END AS sections, CASE WHEN k % 3 <> 0 THEN 'MAIN-PARA' ELSE '' END AS paragraphs,
 'MOVE,CALL,IF' AS operations, concat('SUB', c) AS called_programs, concat('LAY', w) AS copybooks FROM p""")
def q56(spark, sf_dir):
    return program.facts(_markers(spark, sf_dir)).select("path", *[F.array_join(c, ",").alias(c) for c in ("divisions", "sections", "paragraphs", "operations", "called_programs", "copybooks")])


_EDGE = ("source_id", "target_id", "rel_type")
_EDGES = (
    (_JCL, "concat('AAA', w)", "'EXECUTES_PROGRAM'", "true"), (_JCL, "'MYPROC'", "'EXECUTES_PROGRAM'", "k % 3 <> 0"),
    *((_JCL, name, f"'{kind}'", when) for kind in ("ALLOCATES", "ALLOCATES_DATASET") for name, when in (("concat('A.K', k)", "true"), ("'B'", "k % 2 = 0"), ("'C'", "true"), ("concat('D', k)", "true"), ("concat('&&W', k)", "true"))),
)


@register("q57_job_edges", f"WITH {_P} {_each_sql(_EDGE, _EDGES)}")
def q57(spark, sf_dir):
    return graph.from_evidence(evidence.extract("jcl", _jobs(spark, sf_dir)).withColumnRenamed("path", "artifact_id"))
