"""Queries of the operators that search texts for names, each beside its SQL, which looks for them by `contains`."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import catalogs, layout, program, substrings
from granary.plans.registry import register, table
from granary.plans.source_queries import _D, _LINE, LAYOUT, PROGRAM, _docs, _each, _each_sql

#: Evidence of some fields: one with two lines, one without a line.
_EVIDENCE = ("path", "entity_name", "evidence_id", "source_line")
_FOUND = (
    ("concat('P', k, '.cpy')", "'COST'", "concat('E', k, 'a')", "8", "k % 2 = 0"),
    ("concat('P', k, '.cpy')", "'COST'", "concat('E', k, 'b')", "20", "k % 4 = 0"),
    ("concat('P', k, '.cpy')", "'TAGS'", "concat('E', k, 'c')", "CAST(NULL AS INTEGER)", "k % 3 = 0"),
)


@register("q78_field_evidence", rf"""WITH {_D}, l AS ({_each_sql(_LINE, LAYOUT)}), e AS ({_each_sql(_EVIDENCE, _FOUND)}),
f AS (SELECT path, line_no AS seq, regexp_extract(text, '^\s*\d\d\s+([A-Z0-9_-]+)', 1) AS name FROM l),
t AS (SELECT f.path, f.name, min(l.line_no) AS told FROM (SELECT DISTINCT path, name FROM f) f
  JOIN l ON l.path = f.path AND contains(upper(l.text), f.name) AND regexp_matches(upper(l.text), concat('\b', f.name, '\b')) GROUP BY 1, 2),
g AS (SELECT path, entity_name AS name, string_agg(evidence_id, ',' ORDER BY evidence_id) AS ids, min(source_line) AS a, max(source_line) AS b FROM e GROUP BY 1, 2)
SELECT f.path, f.seq, f.name, coalesce(ids, '') AS evidence_ids, coalesce(a, told) AS source_line, coalesce(b, told) AS source_end_line
FROM f LEFT JOIN t USING (path, name) LEFT JOIN g USING (path, name)""")
def q78(spark, sf_dir):
    lines = _each(_docs(spark, sf_dir), _LINE, LAYOUT)
    fields = layout.declarations(lines).select("path", "seq", "name")
    evidence = _each(_docs(spark, sf_dir), _EVIDENCE, _FOUND)
    found = substrings.field_evidence(fields, evidence, lines)
    return found.withColumn("evidence_ids", F.array_join("evidence_ids", ","))


#: What to look for in the addresses of all pages: names of hosts, parts of paths, and ids that most addresses lack.
_TARGETS = r"SELECT regexp_extract(url, '://([^/.]+)', 1) AS target FROM {pages} UNION SELECT concat('/En/', page_id % 100) FROM {pages} UNION SELECT concat('/', page_id) FROM {pages}"


@register("q79_datasets_like", f"""WITH t AS ({_TARGETS.format(pages='pages')}), c AS (SELECT DISTINCT url AS dsn FROM pages)
SELECT target, coalesce(dsn, upper(target)) AS dsn FROM t LEFT JOIN c ON contains(upper(dsn), upper(target)) WHERE target <> ''""")
def q79(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return substrings.datasets_like(spark.sql(_TARGETS, pages=pages), pages.select(F.col("url").alias("dsn")))


@register("q80_locate_copybooks", f"""WITH {_D}, d AS (SELECT concat('PROD.IN', k % 500, CASE WHEN k % 2 = 0 THEN 'DATA' ELSE '' END, '.VSAM') AS dsn, concat('IN', k % 500) AS q FROM p GROUP BY ALL),
f AS (SELECT k, concat('P', k, '.cbl') AS program, concat('LAY', w) AS copybook FROM p),
b AS (SELECT concat('cpy/LAY', w, '-', s, '.cpy') AS copybook_path FROM p GROUP BY ALL), x AS (SELECT copybook, min(copybook_path) AS copybook_path FROM (SELECT DISTINCT copybook FROM f) JOIN b ON contains(upper(copybook_path), copybook) GROUP BY 1),
h AS (SELECT dsn, min(program) AS program FROM d JOIN f ON contains(concat('IN', k), q) SEMI JOIN x USING (copybook) GROUP BY 1)
SELECT dsn, program, copybook, copybook_path FROM h JOIN f USING (program) JOIN x USING (copybook)""")
def q80(spark, sf_dir):
    lines = _each(_docs(spark, sf_dir), _LINE, PROGRAM)
    in_order = F.array_sort(F.collect_list(F.struct("line_no", "text")), lambda a, b: a["line_no"] - b["line_no"])
    programs = lines.groupBy("path").agg(F.array_join(F.transform(in_order, lambda x: x["text"]), "\n").alias("content"))
    p = _docs(spark, sf_dir)
    datasets = p.select(F.expr("concat('PROD.IN', k % 500, CASE WHEN k % 2 = 0 THEN 'DATA' ELSE '' END, '.VSAM')").alias("dsn")).distinct()
    copybooks = p.select(F.expr("concat('cpy/LAY', w, '-', s, '.cpy')").alias("path")).distinct()
    return substrings.locate_copybooks(datasets, programs, copybooks, program.IGNORED_QUALIFIERS)


_HOSTS = r"SELECT upper(regexp_extract(url, '://([^/]+)', 1)) AS dsn FROM {pages} UNION SELECT upper(regexp_extract(url, '://([^/.]+)', 1)) FROM {pages}"


@register("q81_listing_mentions", f"""WITH r AS (SELECT concat('L', page_id % 100) AS path, page_id AS row_no, page_id % 500 AS q, upper(concat('see ', url, ' here')) AS cell FROM pages),
d AS ({_HOSTS.format(pages='pages')}), f AS (SELECT dsn, r.*, row_number() OVER (PARTITION BY dsn ORDER BY path, row_no) AS nth FROM d JOIN r ON contains(cell, dsn) WHERE dsn <> '')
SELECT dsn, path, row_no, q AS record_length, 'ESDS' AS organization FROM f WHERE nth = 1""")
def q81(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    cells = {"NAME": F.concat(F.lit("see "), F.col("url"), F.lit(" here")), "MAX LRECL": F.concat((F.col("page_id") % 500).cast("string"), F.lit(" bytes")), "TYPE": F.lit("esds")}
    rows = pages.select(F.expr("concat('L', page_id % 100)").alias("path"), F.col("page_id").alias("row_no"), F.create_map(*[x for k, v in cells.items() for x in (F.lit(k), v)]).alias("cells"))
    return catalogs.listing_facts(rows, spark.sql(_HOSTS, pages=pages)).select("dsn", "path", "row_no", "record_length", "organization")
