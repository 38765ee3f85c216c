"""Queries of DDL that is read back, and of plug-in extractors, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import ddl, plugins, relational
from granary.plans.registry import register
from granary.plans.source_queries import _CBL, _COLUMN, _D, _KEY, _LINE, _TABLE, COLUMNS, KEYS, PROGRAM, TABLES, _docs, _each, _each_sql

_MORE = (
    ("concat('PART-', k)", "4", "'Price'", "concat('NUMERIC(', c + 5, ',2)')", "true", "CAST(NULL AS INTEGER)", "true"),
    ("concat('PART-', k)", "5", "'Tags'", "concat('VARCHAR(', w, ')[]')", "true", "CAST(NULL AS INTEGER)", "k % 3 = 1"),
)


def _made(spark, sf_dir):
    p = _docs(spark, sf_dir)
    return _each(p, _TABLE, TABLES), _each(p, _COLUMN, COLUMNS + _MORE), _each(p, _KEY, KEYS)


_NAMED = f"""t AS ({_each_sql(_TABLE, TABLES)}), c AS ({_each_sql(_COLUMN, COLUMNS + _MORE)})"""
_SHOWN = """CASE WHEN sql_type LIKE '%[]' THEN 'ARRAY' WHEN sql_type LIKE 'VARCHAR%' THEN 'character varying' WHEN sql_type LIKE 'NUMERIC%' THEN 'numeric' WHEN sql_type = 'INTEGER' THEN 'integer' ELSE 'bigint' END"""


@register("q94_ddl_catalog", rf"""WITH {_D}, {_NAMED}
SELECT table_name AS id, lower(replace(table_name, '-', '_')) AS table_name, row_number() OVER (PARTITION BY table_name ORDER BY position) AS position, lower(replace(column_name, '-', '_')) AS column_name, {_SHOWN} AS data_type,
 CASE WHEN sql_type LIKE 'NUMERIC%' THEN regexp_extract(sql_type, '\((\d+)', 1)::INTEGER WHEN sql_type = 'INTEGER' THEN 32 WHEN sql_type LIKE 'BIG%' THEN 64 END AS "precision",
 CASE WHEN sql_type LIKE 'NUMERIC%' THEN 2 WHEN sql_type = 'INTEGER' OR sql_type LIKE 'BIG%' THEN 0 END AS scale, nullable FROM c""")
def q94(spark, sf_dir):
    scripts = relational.emit(*_made(spark, sf_dir)).select(F.col("table_name").alias("id"), "ddl")
    return ddl.read(scripts).columns.drop("udt_name")


#: What is done to the text of some schemas after it was made.
_DAMAGE = "CASE WHEN k % 17 = 0 THEN 'failed' WHEN k % 13 = 0 THEN 'empty' WHEN k % 11 = 0 THEN 'altered' WHEN k % 7 = 0 THEN 'retyped' WHEN k % 5 = 0 THEN 'no key' WHEN k % 3 = 0 THEN 'review' END"


@register("q95_ddl_validation", f"""WITH {_D}, d AS (SELECT k, concat('PART-', k) AS id, {_DAMAGE} AS damage FROM p UNION ALL SELECT k, concat('PART-', k, '-TAG'), {_DAMAGE} FROM p WHERE k % 2 = 0)
SELECT id, CASE WHEN damage = 'failed' THEN 'NOT_EXECUTED_GENERATION_FAILED' WHEN damage IN ('empty', 'altered', 'no key') OR damage = 'retyped' AND NOT contains(id, 'TAG') THEN 'FAILED_VALIDATION'
 WHEN damage = 'review' THEN 'REVIEW_REQUIRED_VALIDATED_SAFE_SUBSET' ELSE 'VALIDATED' END AS validation_status,
 CASE WHEN damage IN ('failed', 'empty', 'altered') THEN NULL WHEN damage = 'retyped' AND NOT contains(id, 'TAG') THEN concat('column:part_', k, '.name') WHEN damage = 'no key' THEN concat('pk:', lower(replace(id, '-', '_'))) ELSE '' END AS failed,
 CASE WHEN damage IN ('failed', 'empty', 'altered') THEN NULL WHEN contains(id, 'TAG') THEN 5 ELSE 6 + (k % 3 = 1)::INTEGER END AS n_checks FROM d""")
def q95(spark, sf_dir):
    tables, columns, keys = _made(spark, sf_dir)
    number = F.regexp_extract("id", r"(\d+)", 1).cast("long")
    rows = relational.emit(tables, columns, keys).withColumnRenamed("table_name", "id").withColumn("k", number).withColumn("damage", F.expr(_DAMAGE))
    is_ = lambda x: F.coalesce(F.col("damage") == x, F.lit(False))
    text = F.when(is_("empty"), "").when(is_("retyped"), F.regexp_replace("ddl", r"VARCHAR\(\d+\)(?!\[)", "TEXT")).when(is_("no key"), F.regexp_replace("ddl", r",\n    PRIMARY KEY \([^)]*\)", "")).otherwise(F.col("ddl"))
    rows = rows.select("id", F.when(is_("failed"), "FAILED").when(is_("review"), "REVIEW_REQUIRED").otherwise("GENERATED").alias("status"), text.alias("ddl"), F.when(is_("altered"), "other").otherwise(F.sha2(text, 256)).alias("ddl_hash"))
    own = lambda df: df.withColumn("id", F.col("table_name"))
    return ddl.validated(rows, own(tables), own(columns), own(keys)).select("id", "validation_status", F.array_join("failed", ",").alias("failed"), "n_checks")


class Paragraphs:
    """How many statements stand in each paragraph of a procedure division."""

    def start(self, path):
        self.open, self.name, self.at, self.n = False, None, None, 0

    def _closed(self):
        if self.open and self.n:
            yield self.at, "PARAGRAPH_SIZE", self.name, str(self.n)

    def line(self, line_no, text):
        code = text[7:] if text[:6].isdigit() else text
        if "PROCEDURE DIVISION" in code:
            self.open, self.at = True, line_no
        elif self.open and not code.startswith(" ") and code.endswith("."):
            yield from self._closed()
            self.name, self.at, self.n = code[:-1], line_no, 0
        elif self.open:
            self.n += 1

    def end(self):
        yield from self._closed()


@register("q96_plugin_evidence", f"""WITH {_D} SELECT {_CBL} AS path, CASE WHEN k % 3 <> 0 THEN 12 ELSE 11 END AS source_line, 'PARAGRAPH_SIZE' AS evidence_type, CASE WHEN k % 3 <> 0 THEN 'MAIN-PARA' END AS entity_name, '4' AS value FROM p""")
def q96(spark, sf_dir):
    return plugins.evidence_of(_each(_docs(spark, sf_dir), _LINE, PROGRAM), Paragraphs)
