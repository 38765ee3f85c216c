"""Queries of stored tables, stage runs and events, each beside its SQL; what they store goes to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from granary.operators import evidence, intervals, layout, resolve, stages
from granary.plans.registry import register
from granary.plans.source_queries import _D, _DD, _DDS, _JCL, _LINE, _M, _P, JOB, LAYOUT, _docs, _each, _each_sql
from granary.sources import snapshots
from granary.sources.repository import shared_dir
from granary.streaming import uploads


def _folder(spark, label: str) -> str:
    return f"{shared_dir(spark)}/granary/{label}-{uuid.uuid4().hex}"


@register("q90_job_states", f"""WITH {_D}, j AS (SELECT concat('J', k) AS job_id, CASE WHEN k % 3 = 0 THEN 'COMPLETED' WHEN k % 2 = 0 THEN 'REPLACED' ELSE 'RUNNING' END AS status,
 CASE WHEN k % 2 = 0 THEN w ELSE s END AS n, CASE WHEN k % 3 = 0 THEN c END AS code FROM p)
SELECT job_id, status, n::VARCHAR AS n, code::VARCHAR AS code, 3 AS versions, (SELECT count(*) FROM p) AS n_at_first FROM j
UNION ALL SELECT concat('LOST', k), 'FAILED', NULL, c::VARCHAR, 3, (SELECT count(*) FROM p) FROM p WHERE k % 50 = 7""")
def q90(spark, sf_dir):
    jobs = snapshots.Table(spark, _folder(spark, "jobs"), snapshots.JOBS)
    none = F.lit(None).cast("timestamp")
    of = lambda rows, name, status, **facts: rows.select(F.concat(F.lit(name), F.col("k")).alias("job_id"), F.lit(status).alias("status"), none.alias("completed_at"), F.create_map(*[x for k, v in facts.items() for x in (F.lit(k), F.col(v).cast("string"))]).alias("facts"))
    p = _docs(spark, sf_dir)
    first = jobs.insert(of(p, "J", "RUNNING", n="s"))
    jobs.upsert(of(p.where("k % 2 = 0"), "J", "REPLACED", n="w"), "job_id")
    snapshots.set_status(jobs, of(p.where("k % 3 = 0"), "J", "COMPLETED", code="c").unionByName(of(p.where("k % 50 = 7"), "LOST", "FAILED", code="c")))
    n = jobs.read(first).agg(F.count(F.lit(1)).alias("n_at_first"))
    fact = lambda k: F.try_element_at("facts", F.lit(k)).alias(k)
    return jobs.read().select("job_id", "status", fact("n"), fact("code"), F.lit(jobs.version()).alias("versions")).crossJoin(F.broadcast(n))  # one row


_DECLARED = rf"l AS ({_each_sql(_LINE, LAYOUT)}), d AS (SELECT *, regexp_extract(text, '^\s*(\d\d)\s', 1)::INTEGER AS level FROM l)"


@register("q91_stage_metrics", f"""WITH {_D}, {_DECLARED},
v(stage, metric, value) AS (SELECT 'lines', 'rows', count(*) FROM l UNION ALL SELECT 'lines', 'last_line', max(line_no) FROM l UNION ALL SELECT 'declarations', 'rows', count(*) FROM d
 UNION ALL SELECT 'declarations', 'pictures', count(*) FILTER (contains(text, ' PIC ')) FROM d UNION ALL SELECT 'declarations', 'overlays', count(*) FILTER (contains(text, 'REDEFINES')) FROM d
 UNION ALL SELECT 'trees', 'rows', count(*) FROM d UNION ALL SELECT 'trees', 'roots', count(*) FILTER (level IN (1, 77)) FROM d UNION ALL SELECT 'trees', 'deepest', max(CASE WHEN level = 10 THEN 2 WHEN level = 88 THEN 2 ELSE 1 END) FROM d)
SELECT stage, metric, value::BIGINT AS value FROM v""")
def q91(spark, sf_dir):
    steps = [
        stages.Stage("lines", lambda p: _each(p, _LINE, LAYOUT), {"last_line": F.max("line_no")}),
        stages.Stage("declarations", layout.declarations, {"pictures": F.count_if(F.col("pic").isNotNull()), "overlays": F.count_if(F.col("redefines_target").isNotNull())}),
        stages.Stage("trees", intervals.numbered, {"roots": F.count_if(F.col("parent_id").isNull()), "deepest": F.max("depth")}),
    ]
    run = stages.Run(spark, _folder(spark, "run"), "r1")
    run.run(steps, _docs(spark, sf_dir))
    return run.metrics()


_EVENT = ("path", "event_type", "status", "source_line", "source_end_line", "told")


@register("q92_parser_events", f"""WITH {_D}, e AS ({_each_sql(_DD, _DDS)}), n AS (SELECT path, count(*) AS n, min(source_line) AS a, max(source_line) AS b FROM e GROUP BY 1), f AS (SELECT {_JCL} AS path, k % 10 = 3 AS bad FROM p)
SELECT path, 'parser_selected' AS event_type, 'SUCCESS' AS status, NULL AS source_line, NULL AS source_end_line, NULL AS told FROM f UNION ALL SELECT path, 'parser_started', 'SUCCESS', NULL, NULL, NULL FROM f
UNION ALL SELECT path, 'parser_failed', 'FAILED', NULL, NULL, 'damaged' FROM f WHERE bad UNION ALL SELECT path, 'parser_completed', 'SUCCESS', a, b, n::VARCHAR FROM f JOIN n USING (path) WHERE NOT bad
UNION ALL SELECT path, 'evidence_extracted', 'SUCCESS', a, b, 'DD' FROM f JOIN n USING (path) WHERE NOT bad""")
def q92(spark, sf_dir):
    p = _docs(spark, sf_dir)
    files = p.select(F.expr(_JCL).alias("path"), F.lit("jcl").alias("artifact_type"))
    found = evidence.data_definitions(_each(p, _LINE, JOB)).select("path", F.lit("DD").alias("evidence_type"), "source_line")
    failures = p.where("k % 10 = 3").select(F.expr(_JCL).alias("path"), F.lit("damaged").alias("reason"))
    events = stages.parser_events(files, found, "JclParser", failures)
    told = F.coalesce(*[F.try_element_at("details", F.lit(k)) for k in ("evidence_count", "evidence_types", "reason")])
    return events.withColumn("told", told).select(*_EVENT)


@register("q93_decision_events", f"""WITH {_M.replace(_P, _D)},
r AS (SELECT path, 'SPLIT' AS name, 'REDEFINES' AS stage, CASE WHEN t = 1 AND 2 * c <= s THEN 'ALTERNATE_REPRESENTATION' ELSE 'REVIEW_REQUIRED' END AS strategy FROM m UNION ALL SELECT path, 'PLAIN', 'REDEFINES', 'SAME_TABLE' FROM m
 UNION ALL SELECT path, 'LOST', 'REDEFINES', 'REVIEW_REQUIRED' FROM m WHERE k % 4 = 0 UNION ALL SELECT path, 'TAIL', 'OCCURS', 'INLINE_ARRAY' FROM m WHERE t = 2
 UNION ALL SELECT path, 'TAGS', 'OCCURS', CASE WHEN o > 200 THEN 'REVIEW_REQUIRED' WHEN o <= 20 THEN 'INLINE_ARRAY' ELSE 'CHILD_TABLE' END FROM m UNION ALL SELECT path, 'SIZES', 'OCCURS', 'CHILD_TABLE' FROM m WHERE z > 0)
SELECT path, name, concat(lower(stage), '_detected') AS event_type, 'SUCCESS' AS status, NULL AS strategy FROM r
UNION ALL SELECT path, name, concat(lower(stage), CASE WHEN strategy = 'REVIEW_REQUIRED' THEN '_review_required' ELSE '_resolved' END), CASE WHEN strategy = 'REVIEW_REQUIRED' THEN strategy ELSE 'SUCCESS' END, strategy FROM r""")
def q93(spark, sf_dir):
    nodes = resolve.cut(layout.layout(_each(_docs(spark, sf_dir), _LINE, LAYOUT)))
    known = resolve.cut(resolve.structure(nodes))
    events = stages.decision_events(resolve.overlays(nodes, known), resolve.repetitions(nodes, known), nodes.select("node_id", "path", "name", "redefines_target", "occurs_min"))
    return events.select("path", "name", "event_type", "status", "strategy")


@register("q122_uploads", """WITH f AS (SELECT source AS upload, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE n_chars END AS size FROM documents WHERE source IS NOT NULL),
n AS (SELECT upload, count(*) FILTER (size > 0) AS n_files, count(*) FILTER (size = 0) AS n_empty, sum(size) AS n_bytes, max(size) AS largest FROM f GROUP BY 1)
SELECT upload, n_files, n_empty, n_bytes::BIGINT AS n_bytes, CASE WHEN largest > 20000 THEN 'file too large' WHEN n_files > 40 THEN 'too many files' WHEN n_files = 0 THEN 'no file' END AS reason FROM n""")
def q122(spark, sf_dir):
    rows = spark.readStream.schema("doc_id long, text string, lang string, source string, n_chars long").parquet(f"{sf_dir}/documents.parque[t]")  # a pattern, as the table may be one file
    files = rows.select(F.col("source").alias("upload"), F.concat_ws("/", "lang", "doc_id").alias("path"), F.when(F.col("doc_id") % 7 == 0, 0).otherwise(F.col("n_chars")).cast("long").alias("size"))
    return uploads.latest(files, most_bytes=20_000, most_files=40)
