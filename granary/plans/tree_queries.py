"""Queries of the operators on trees: walks, searches, older trees, flat columns, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import flatten, intervals, layout
from granary.plans.registry import register, table
from granary.plans.source_queries import _BOTH, _D, _LINE, _M, _P, _WHOLE, LAYOUT, _docs, _each, _each_sql


def _tree(spark, sf_dir):
    """The layouts that documents state."""
    return layout.layout(_each(_docs(spark, sf_dir), _LINE, LAYOUT))


#: In SQL, the places of layout items: an item's subtree ends before the next one that is not deeper.
_PLACES = rf"""{_D}, l AS ({_each_sql(_LINE, LAYOUT)}),
d AS (SELECT path, line_no AS seq, regexp_extract(text, '^\s*(\d\d)\s+([A-Z0-9_-]+)', 1)::INTEGER AS level, regexp_extract(text, '^\s*(\d\d)\s+([A-Z0-9_-]+)', 2) AS name, text FROM l),
e AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq) AS place, count(*) OVER (PARTITION BY path) AS n FROM d),
s AS (SELECT a.path, a.place, min(b.place) AS stop FROM e a JOIN e b ON b.path = a.path AND b.place > a.place AND (b.level = 77 OR b.level <> 88 AND b.level <= a.level) GROUP BY 1, 2),
t AS (SELECT e.*, CASE WHEN level = 88 THEN 0 ELSE coalesce(stop, n + 1) - e.place - 1 END AS n_below FROM e LEFT JOIN s USING (path, place))"""


@register("q82_walk", f"""WITH {_PLACES}
SELECT a.path, a.place, a.name, a.n_below, count(b.place) AS depth FROM t a LEFT JOIN t b ON b.path = a.path AND b.place < a.place AND b.place + b.n_below >= a.place GROUP BY ALL""")
def q82(spark, sf_dir):
    return intervals.walk(_tree(spark, sf_dir)).select("path", "place", "name", (F.col("leave") - F.col("enter")).alias("n_below"), F.col("depth").cast("long").alias("depth"))


_ASKED = "CASE CAST(regexp_extract(path, '(\\d+)', 1) AS INTEGER) % 4 WHEN 0 THEN 'TITL' WHEN 1 THEN 'HEAD' WHEN 2 THEN 'FREE' ELSE 'COMP-3' END"


@register("q83_tree_search", f"""WITH {_PLACES}, h AS (SELECT path, place FROM t WHERE contains(text, {_ASKED}))
SELECT DISTINCT t.path, t.place, t.name FROM t JOIN h ON h.path = t.path AND h.place BETWEEN t.place AND t.place + t.n_below""")
def q83(spark, sf_dir):
    shown = F.concat_ws(" ", "name", "pic", "usage")
    asked = F.expr(_ASKED.replace("\\", "\\\\"))
    return intervals.search(_tree(spark, sf_dir), shown.contains(asked)).select("path", (F.col("enter") + 1).alias("place"), "name")


@register("q84_older_trees", """WITH l AS (SELECT conv_id AS path, turn AS seq, length(text) % 7 AS level FROM conversations)
SELECT a.path::VARCHAR AS path, a.seq, a.level, max(b.seq) AS parent FROM l a LEFT JOIN l b ON b.path = a.path AND b.seq < a.seq AND b.level < a.level GROUP BY ALL""")
def q84(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("path"), F.col("turn").cast("long").alias("seq"), (F.length("text") % 7).alias("level"))
    items = rows.withColumn("node_id", F.concat_ws(":", "path", "seq"))
    return intervals.older_tree(items).select("path", "seq", "level", F.split_part("parent_id", F.lit(":"), F.lit(2)).cast("long").alias("parent"))


_REPEATS = "CASE WHEN o > 200 THEN 'REVIEW_REQUIRED' WHEN o <= 20 THEN 'INLINE_ARRAY' ELSE 'CHILD_TABLE' END"
_OCCURS, _IN_SPLIT = "'TRANSFORMATION_REQUIRED: OCCURS'", "'REVIEW_REQUIRED: REDEFINES (INHERITED)'"
_FLAT = ("path", "name", "offset", "length", "sql_type", "schema_status", "redefines_target", "is_excluded", "is_alternate_repr", "occurs", "occurs_strategy")
_NONE = ("NULL", "false", "false", "NULL", "NULL")
_FLATS = (
    ("path", "'RECORD_ID'", "0", "s", "concat('VARCHAR(', s, ')')", "'OK'", *_NONE, "true"),
    ("path", "'RECORD_SPLIT_HEAD'", "s", "c", "concat('VARCHAR(', c, ')')", _IN_SPLIT, "'ID'", "true", "false", "NULL", "NULL", "true"),
    ("path", "'RECORD_SPLIT_TAIL'", "s", "c", _WHOLE, _IN_SPLIT, "'ID'", "true", "false", "NULL", "NULL", "k % 7 <> 0"),
    ("path", "'RECORD_SPLIT_TAIL'", "s", "c", _WHOLE, _OCCURS, "'ID'", "true", "false", "2", "'INLINE_ARRAY'", "k % 7 = 0"),
    ("path", "'RECORD_PLAIN'", "s", "w", "concat('VARCHAR(', w, ')')", "'REVIEW_REQUIRED: REDEFINES (SAME_TABLE)'", "'ID'", "true", "false", "NULL", "NULL", "true"),
    ("path", "'RECORD_LOST'", "s", "1", "'VARCHAR(1)'", "'REVIEW_REQUIRED: REDEFINES (REVIEW_REQUIRED)'", "'NOWHERE'", "true", "false", "NULL", "NULL", "k % 4 = 0"),
    ("path", "'RECORD_COST'", "s", "cost", "concat('NUMERIC(', c + 2, ', 2)')", "'OK'", *_NONE, "true"),
    ("path", "'RECORD_TAGS'", "s + cost", "w", "concat('VARCHAR(', w, ')')", _OCCURS, "NULL", "false", "false", "o", _REPEATS, "true"),
    ("path", "'RECORD_SIZES_CODE'", "s + cost + w * o", "code", _WHOLE, _OCCURS, "NULL", "false", "false", "s", "'CHILD_TABLE'", "z > 0"),
    ("path", "'RECORD_SIZES_TITLE'", "s + cost + w * o + code * s", "w", "concat('VARCHAR(', w, ')')", _OCCURS, "NULL", "false", "false", "s", "'CHILD_TABLE'", "z > 0"),
    ("path", "'COUNTER'", "s + cost + w * o + z * z * (code + w)", "c", _WHOLE, "'OK'", *_NONE, "true"),
    ("path", "'RECORD_HEAD'", "0", "c", "concat('VARCHAR(', c, ')')", "'ALTERNATE_REPRESENTATION: ID'", "'ID'", "false", "true", "NULL", "NULL", _BOTH),
    ("path", "'RECORD_TAIL'", "c", "c", _WHOLE, "'ALTERNATE_REPRESENTATION: ID'", "'ID'", "false", "true", "NULL", "NULL", _BOTH),
)


@register("q85_flat_columns", f"WITH {_M.replace(_P, _D)} {_each_sql(_FLAT, _FLATS, 'm')}")
def q85(spark, sf_dir):
    return flatten.flattened(_tree(spark, sf_dir)).select(*_FLAT)
