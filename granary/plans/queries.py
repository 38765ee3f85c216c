"""The registered queries over the driver's tables, each beside its SQL; those of sources are in `source_queries`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from granary.functions import picture, text
from granary.operators import assess, audit, classify, graph, lookup
from granary.plans.registry import register, table
from granary.sources import repository

EXT_SQL = r"regexp_extract(lower({p}), '([.][^./]*)$', 1)"
CLASSIFY_SQL = r"""CASE
  WHEN {e} IN ('.csv', '.xlsx', '.xls') THEN 'metadata'
  WHEN {e} IN ('.txt', '.lst', '.log', '.out') AND regexp_matches(upper({c}), 'CLUSTER|NONVSAM|IDCAMS|LISTCAT') THEN 'listcat'
  WHEN {e} IN ('.idcams', '.ams') OR contains(upper({c}), 'DEFINE CLUSTER') OR (contains(upper({c}), 'IDCAMS') AND contains(upper({c}), 'DEFINE ')) THEN 'idcams'
  WHEN {e} IN ('.jcl', '.job', '.cntl') OR starts_with({c}, '//') OR contains(upper({c}), 'EXEC PGM=') THEN 'jcl'
  WHEN {e} IN ('.cpy', '.copy') THEN 'copybook'
  WHEN {e} IN ('.cbl', '.cob', '.cobol') OR regexp_matches(upper({c}), 'IDENTIFICATION DIVISION|PROCEDURE DIVISION|DATA DIVISION') THEN 'cobol'
  WHEN {e} = '.h' THEN 'copybook' ELSE 'other' END"""
_P = "concat(source, '/', doc_id, CASE doc_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.jcl' WHEN 2 THEN '.cpy' WHEN 3 THEN '.cbl' ELSE '.csv' END)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of five kinds."""
    ends = F.element_at(F.array(*[F.lit(x) for x in (".txt", ".jcl", ".cpy", ".cbl", ".csv")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), ends).alias("path"), F.col("text").alias("content"))


@register("q01_classify_counts", f"SELECT artifact_type, count(*) AS n FROM (SELECT {CLASSIFY_SQL.format(e=EXT_SQL.format(p=_P), c='text')} AS artifact_type FROM documents) GROUP BY 1")
def q01(spark, sf_dir):
    return _files(spark, sf_dir).groupBy(classify.artifact_type("path", "content").alias("artifact_type")).agg(F.count(F.lit(1)).alias("n"))


@register("q02_classify_pages", f"SELECT page_id, {CLASSIFY_SQL.format(e=EXT_SQL.format(p='url'), c='html')} AS artifact_type FROM pages")
def q02(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", classify.artifact_type("url", "html").alias("artifact_type"))


@register("q03_dominant_language", """
WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT source, CASE WHEN max(n) >= 0.8 * sum(n) THEN arg_max(lang, (n, lang)) ELSE 'Mixed' END AS dominant, sum(n)::BIGINT AS n_rows FROM c GROUP BY 1""")
def q03(spark, sf_dir):
    return classify.dominant(table(spark, sf_dir, "documents"), "lang", "source")


@register("q04_lines", r"""
WITH s AS (SELECT doc_id, CASE WHEN text = '' THEN [] ELSE regexp_split_to_array(regexp_replace(text, '(\r\n|\n|\r)$', ''), '\r\n|\n|\r') END AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS text FROM s)
SELECT doc_id, line_no::INTEGER AS line_no, length(text)::INTEGER AS n_chars, md5(text) AS digest FROM l WHERE NOT regexp_matches(ltrim(text), '^($|[*]|/[*])')""")
def q04(spark, sf_dir):
    rows = repository.lines(table(spark, sf_dir, "documents"), "text", "doc_id")
    return rows.where(~text.is_comment("text")).select("doc_id", "line_no", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@register("q05_keyword_lines", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, upper(regexp_extract(line, '(?i)^\s*(the|of|released|licensed)\b(.+)', 1)) AS statement, count(*) AS n FROM l
WHERE regexp_matches(line, '(?i)^\s*(the|of|released|licensed)\b(.+)') GROUP BY ALL""")
def q05(spark, sf_dir):
    pattern = r"(?i)^\s*(the|of|released|licensed)\b(.+)"
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return rows.where(F.col("line").rlike(pattern)).groupBy("doc_id", F.upper(F.regexp_extract("line", pattern, 1)).alias("statement")).agg(F.count(F.lit(1)).alias("n"))


@register("q06_regex_explode", """
SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages) GROUP BY ALL""")
def q06(spark, sf_dir):
    links = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link")
    return table(spark, sf_dir, "pages").select("page_id", links).groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("n"))


@register("q07_redact", r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(password|passwd|secret|token|api[_-]?key|authorization)\s*([:=])\s*([^\s,;]+)', '\1\2[REDACTED]', 'gi'), '[a-z]:\\[^\r\n]*', '[LOCAL_PATH]', 'gi')) AS digest FROM documents""")
def q07(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.redacted("text")).alias("digest"))


@register("q08_keyword_value", r"""
SELECT page_id, nullif(regexp_extract(url, '(?i)\bpage\s*=\s*(''[^'']*''|\([^)]*\)|[^,\s]+)', 1), '') AS value FROM pages""")
def q08(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.keyword_value("url", "page").alias("value"))


@register("q09_json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def q09(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@register("q10_first_last", """
SELECT conv_id, arg_min(text, turn) AS first_text, arg_max(role, turn) AS last_role, max(turn) AS last_turn FROM conversations GROUP BY 1""")
def q10(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("first_text"), F.max_by("role", "turn").alias("last_role"), F.max("turn").alias("last_turn"))


@register("q11_running_owner", """
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS owner FROM conversations""")
def q11(spark, sf_dir):
    return lookup.owners(table(spark, sf_dir, "conversations"), F.when(F.col("role") == "user", F.col("turn")), "conv_id", "turn").select("conv_id", "turn", "owner")


@register("q12_islands", """
WITH c AS (SELECT *, coalesce(event_type <> lag(event_type) OVER w, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(new::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM c)
SELECT user_id, island::BIGINT AS island, min(event_type) AS event_type, count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS ids FROM i GROUP BY 1, 2""")
def q12(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    before = F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = lookup.islands(events.withColumn("_new", F.coalesce(F.col("event_type") != before, F.lit(True))), F.col("_new"), "user_id", "ts", "event_id")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: x["event_id"].cast("string")), ",")
    return rows.groupBy("user_id", "island").agg(F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"), ids.alias("ids"))


_EDGES = """
 SELECT concat('c', o_custkey) AS source_id, concat('o', o_orderkey) AS target_id, 'PLACES' AS rel_type FROM orders
 UNION SELECT concat('o', l_orderkey), concat('p', l_partkey), 'CONTAINS' FROM lineitem
 UNION SELECT concat('p', l_partkey), concat('s', l_suppkey), 'SUPPLIED_BY' FROM lineitem"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    rows = orders.select(name("c", "o_custkey").alias("s"), name("o", "o_orderkey").alias("t"), F.lit("PLACES").alias("k"))
    rows = rows.unionByName(items.select(name("o", "l_orderkey").alias("s"), name("p", "l_partkey").alias("t"), F.lit("CONTAINS").alias("k")))
    rows = rows.unionByName(items.select(name("p", "l_partkey").alias("s"), name("s", "l_suppkey").alias("t"), F.lit("SUPPLIED_BY").alias("k")))
    return rows.select(F.col("s").alias("source_id"), F.col("t").alias("target_id"), F.col("k").alias("rel_type")).distinct()


@register("q20_edges", _EDGES)
def q20(spark, sf_dir):
    return _edges(spark, sf_dir)


@register("q21_either_end", f"""
WITH e AS ({_EDGES}), n AS (SELECT concat('p', p_partkey) AS node_id FROM part WHERE p_size = 7)
SELECT node_id, source_id, target_id, rel_type, 'out' AS direction FROM e JOIN n ON source_id = node_id
UNION ALL SELECT node_id, source_id, target_id, rel_type, 'in' FROM e JOIN n ON target_id = node_id""")
def q21(spark, sf_dir):
    nodes = table(spark, sf_dir, "part").where("p_size = 7").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node_id"))
    return graph.touching(_edges(spark, sf_dir), nodes, "node_id")


@register("q22_priority_lookup", """
SELECT d.doc_id, coalesce(CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 0 THEN 'poor' WHEN l.quality = 1 THEN 'good' END, 'unlabelled') AS label,
 CASE WHEN l.doc_id IS NULL THEN 0.2 ELSE 1.0 END::DOUBLE AS confidence FROM documents d LEFT JOIN labels l USING (doc_id)""")
def q22(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    labelled = labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "good").otherwise("unlabelled").alias("label"), F.lit(1.0).alias("confidence"), F.lit(1).alias("rank"))
    every = labelled.unionByName(docs.select("doc_id", F.lit("unlabelled").alias("label"), F.lit(0.2).alias("confidence"), F.lit(2).alias("rank")))
    return lookup.best(every, "doc_id", F.col("rank")).select("doc_id", "label", "confidence")


@register("q23_fallback_join", """
SELECT c.c_custkey, coalesce(s.s_name, n.n_name) AS partner FROM customer c LEFT JOIN supplier s ON c.c_custkey = s.s_suppkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def q23(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("by_id"), F.lit(None).cast("int").alias("by_nation"), F.col("s_name").alias("partner"))
    names = names.unionByName(table(spark, sf_dir, "nation").select(F.lit(None).cast("long").alias("by_id"), F.col("n_nationkey").alias("by_nation"), F.col("n_name").alias("partner")))
    return lookup.with_fallback(customers, names, [("c_custkey", "by_id"), ("c_nationkey", "by_nation")], "partner").select("c_custkey", "partner")


@register("q24_semi_anti", """
SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS returned FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def q24(spark, sf_dir):
    orders, items = table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag")
    return lookup.marked(orders, "o_orderkey", items, "l_orderkey", returned=F.col("l_returnflag") == "R")


@register("q25_asof_owner", """
SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS signup FROM events""")
def q25(spark, sf_dir):
    return lookup.owners(table(spark, sf_dir, "events"), F.when(F.col("event_type") == "signup", F.col("event_id")), "user_id", "ts", "event_id").select("event_id", F.col("owner").alias("signup"))


@register("q28_folders", r"""
WITH p AS (SELECT list_filter(string_split(regexp_replace(url, '\?.*$', ''), '/'), lambda x : x <> '') AS ps FROM pages),
a AS (SELECT unnest(list_transform(range(1, len(ps)), lambda i : array_to_string(ps[1:i], '/'))) AS folder FROM p)
SELECT folder, count(*) AS n_paths FROM a GROUP BY 1""")
def q28(spark, sf_dir):
    return graph.ancestors(table(spark, sf_dir, "pages").select(F.regexp_replace("url", r"\?.*$", "").alias("path")), "path")


@register("q29_suffix_keys", """
SELECT p_partkey, CASE WHEN n > 1 THEN concat(upper(p_name), '__', n) ELSE upper(p_name) END AS artifact_id FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)""")
def q29(spark, sf_dir):
    n = F.row_number().over(W.partitionBy("p_name").orderBy("p_partkey"))
    key = F.when(n > 1, F.concat(F.upper("p_name"), F.lit("__"), n.cast("string"))).otherwise(F.upper("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", key.alias("artifact_id"))


_AUDIT = """SELECT event_id, ts, concat('stage', user_id % 7) AS stage, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'REVIEW_REQUIRED' WHEN 'view' THEN 'SKIPPED' ELSE 'SUCCESS' END AS status,
 CASE WHEN value > 40 THEN 'WARNING' ELSE 'INFO' END AS severity, event_type FROM events"""


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "error", "FAILED").when(kind == "signup", "REVIEW_REQUIRED").when(kind == "view", "SKIPPED").otherwise("SUCCESS")
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("timestamp"), F.concat(F.lit("stage"), (F.col("user_id") % 7).cast("string")).alias("stage"), status.alias("status"), F.when(F.col("value") > 40, "WARNING").otherwise("INFO").alias("severity"), "event_type")


@register("q30_audit_summary", f"""
WITH a AS ({_AUDIT}), b AS (SELECT stage, CASE WHEN status = 'FAILED' THEN 'f' WHEN status = 'REVIEW_REQUIRED' THEN 'r' WHEN severity IN ('WARNING', 'ERROR', 'CRITICAL') THEN 'w' WHEN status = 'SUCCESS' THEN 's' END AS b FROM a)
SELECT stage, count(*) AS total, count(*) FILTER (b = 's') AS success, count(*) FILTER (b = 'w') AS warnings, count(*) FILTER (b = 'r') AS review_required, count(*) FILTER (b = 'f') AS failed FROM b GROUP BY ROLLUP (stage)""")
def q30(spark, sf_dir):
    return audit.summary(_audit(spark, sf_dir))


@register("q31_audit_latest", f"WITH a AS ({_AUDIT}) SELECT event_id, stage, status, severity FROM a WHERE stage = 'stage3' AND status = 'FAILED' ORDER BY ts DESC, event_id LIMIT 250")
def q31(spark, sf_dir):
    found = audit.select(_audit(spark, sf_dir), stage="STAGE3", status="failed")
    return audit.latest(found, "timestamp", "event_id").select("event_id", "stage", "status", "severity")


@register("q32_latest_of_user", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def q32(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@register("q33_health", """
SELECT n_nationkey, least(100, 20 + 15 + CASE WHEN c > 0 THEN 20 ELSE 0 END + CASE WHEN s > 0 THEN 15 ELSE 0 END + CASE WHEN bal > 0 THEN 10 ELSE 0 END) AS score FROM (
 SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS c, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS s, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000) AS bal FROM nation)""")
def q33(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("c"))
    suppliers = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("s"), F.count_if(F.col("s_acctbal") > 9000).alias("b"))
    rows = table(spark, sf_dir, "nation").join(customers, "n_nationkey", "left").join(suppliers, "n_nationkey", "left").fillna(0)
    return rows.select("n_nationkey", audit.health({"files": F.lit(1), "copybooks": F.col("c"), "programs": F.col("s"), "jobs": F.col("b"), "datasets": F.lit(0), "edges": F.lit(0)}).alias("score"))


@register("q34_confidence", """
SELECT doc_id, score, CASE WHEN score >= 90 THEN 'PASS' WHEN score >= 70 THEN 'WARNING' ELSE 'FAIL' END AS level FROM (
 SELECT d.doc_id, 40 + CASE WHEN l.quality = 1 THEN 40 ELSE 0 END + CASE WHEN l.toxic = 0 THEN 20 ELSE 0 END AS score FROM documents d LEFT JOIN labels l USING (doc_id))""")
def q34(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    score = 40 + F.when(F.col("quality") == 1, 40).otherwise(0) + F.when(F.col("toxic") == 0, 20).otherwise(0)
    return rows.select("doc_id", score.alias("score")).select("*", audit.level(F.col("score")).alias("level"))


@register("q35_validator", """
SELECT c_custkey, CASE WHEN c_name IS NULL OR c_nationkey < 0 THEN 'FAIL' WHEN c_acctbal < 0 OR c_mktsegment = 'MACHINERY' THEN 'WARNING' ELSE 'PASS' END AS status FROM customer""")
def q35(spark, sf_dir):
    errors = F.array_compact(F.array(F.when(F.col("c_name").isNull(), "no name"), F.when(F.col("c_nationkey") < 0, "bad nation")))
    warnings = F.array_compact(F.array(F.when(F.col("c_acctbal") < 0, "negative"), F.when(F.col("c_mktsegment") == "MACHINERY", "segment")))
    return table(spark, sf_dir, "customer").select("c_custkey", audit.verdict(errors, warnings).alias("status"))


@register("q36_op_counts", "SELECT user_id, count(*) FILTER (contains(event_type, 'i')) AS with_i, count(*) FILTER (contains(event_type, 'er')) AS with_er, count(*) AS n FROM events GROUP BY 1")
def q36(spark, sf_dir):
    has = lambda s: F.count_if(F.col("event_type").contains(s))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(has("i").alias("with_i"), has("er").alias("with_er"), F.count(F.lit(1)).alias("n"))


@register("q38_duplicate_names", "SELECT p_name, count(*) AS n, min(p_partkey) AS first_key FROM part GROUP BY 1 HAVING count(*) > 1")
def q38(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_key")).where("n > 1")


@register("q39_distinct_union", "SELECT regexp_extract(url, '//([^/]+)', 1) AS name FROM pages UNION SELECT source FROM documents")
def q39(spark, sf_dir):
    hosts = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "//([^/]+)", 1).alias("name"))
    return hosts.union(table(spark, sf_dir, "documents").select("source")).distinct()


@register("q40_context", """
SELECT n_name, count(DISTINCT c_custkey) AS customers, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1""")
def q40(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations at every size
    return rows.groupBy("n_name").agg(F.countDistinct("c_custkey").alias("customers"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("segments"))


_INTENT_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in words) + f" THEN '{name}'" for name, words in text.INTENTS) + " ELSE 'Unknown' END"


@register("q44_intents", f"SELECT conv_id, turn, {_INTENT_SQL} AS intent FROM conversations")
def q44(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.intent("text").alias("intent"))


_DATASETS = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'UNKNOWN' WHEN o_orderkey % 13 = 0 THEN '' ELSE concat('O', o_orderkey) END AS dsn,
 CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderpriority END AS vsam_type, CASE WHEN o_orderstatus = 'F' THEN 'JOB' END AS jcl,
 CASE WHEN o_orderpriority LIKE '1%' THEN 'from ListCat' END AS notes, (o_custkey % 100) / 100.0::DOUBLE AS own, (o_orderkey % 5 - 1)::INTEGER AS reclen FROM orders"""


def _datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as datasets, of every kind that the rules tell apart."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("id"), F.when(key % 11 == 0, "UNKNOWN").when(key % 13 == 0, "").otherwise(F.concat(F.lit("O"), key.cast("string"))).alias("dsn"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).alias("vsam_type"),
        F.when(F.col("o_orderstatus") == "F", "JOB").alias("jcl"), F.when(F.col("o_orderpriority").startswith("1"), "from ListCat").alias("notes"), ((F.col("o_custkey") % 100) / F.lit(100.0)).alias("own"), (key % 5 - 1).cast("int").alias("reclen"))


@register("q45_dataset_confidence", f"""
WITH d AS ({_DATASETS}), p AS (SELECT *, (CASE WHEN jcl IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN contains(upper(coalesce(notes, '')), 'LISTCAT') THEN 40 ELSE 0 END)::DOUBLE AS points FROM d),
s AS (SELECT *, CASE WHEN points = 0 THEN own * 100.0 ELSE points END AS score FROM p)
SELECT id, round(score, 6) AS score, CASE WHEN score >= 90 THEN 'PASS' WHEN score >= 70 THEN 'WARNING' ELSE 'FAIL' END AS level,
 concat_ws('; ', CASE WHEN jcl IS NOT NULL THEN 'Found in JCL DD statement' END, CASE WHEN contains(upper(coalesce(notes, '')), 'LISTCAT') THEN 'Found in LISTCAT catalog' END,
 CASE WHEN points = 0 AND score < 50 THEN 'Dataset metadata inferred solely by AI (low confidence)' END) AS reasons FROM s""")
def q45(spark, sf_dir):
    found = _datasets(spark, sf_dir).select("id", assess.dataset_confidence("jcl", "notes", "own").alias("c"))
    return found.select("id", F.round("c.score", 6).alias("score"), "c.level", F.array_join("c.reasons", "; ").alias("reasons"))


@register("q46_validate_datasets", f"""
WITH d AS ({_DATASETS}), m AS (SELECT id, (CASE WHEN dsn IN ('', 'UNKNOWN') THEN 1 ELSE 0 END + CASE WHEN vsam_type IS NULL THEN 1 ELSE 0 END)::INTEGER AS n_errors, (reclen <= 0)::INTEGER AS n_warnings,
 ((dsn NOT IN ('', 'UNKNOWN'))::INTEGER + (jcl IS NOT NULL)::INTEGER + (notes IS NOT NULL)::INTEGER)::INTEGER AS n_evidence FROM d)
SELECT *, CASE WHEN n_errors > 0 THEN 'FAIL' WHEN n_warnings > 0 THEN 'WARNING' ELSE 'PASS' END AS status FROM m""")
def q46(spark, sf_dir):
    found = _datasets(spark, sf_dir).select("id", assess.validate_dataset("dsn", "vsam_type", "reclen", "jcl", "notes").alias("v"))
    return found.select("id", *[F.size(f"v.{c}").alias(f"n_{c}") for c in ("errors", "warnings", "evidence")], "v.status")


_KINDS = ("USES_COPYBOOK", "READS", "CALLS", "USES_FILE", "ACCESSES", "USES_RECORD_LAYOUT", "WRITES")
_TYPED = "SELECT concat('o', l_orderkey) AS source_id, concat('p', l_partkey) AS target_id, [" + ", ".join(f"'{k}'" for k in _KINDS) + "][l_linenumber] AS rel_type FROM lineitem"


def _typed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as edges of seven types."""
    kind = F.get(F.array(*[F.lit(k) for k in _KINDS]), F.col("l_linenumber") - 1)
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("source_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target_id"), kind.alias("rel_type"))


@register("q47_dependencies", f"""
WITH e AS ({_TYPED}), b AS (SELECT source_id AS node_id, target_id AS other, CASE WHEN contains(rel_type, 'COPY') THEN 'copybooks' WHEN contains(rel_type, 'DATASET') OR contains(rel_type, 'READ') OR contains(rel_type, 'WRITE') THEN 'datasets'
 WHEN contains(rel_type, 'PROGRAM') OR contains(rel_type, 'CALL') THEN 'called_programs' WHEN contains(rel_type, 'FILE') THEN 'files' END AS bucket FROM e
 UNION ALL SELECT target_id, source_id, 'referenced_by' FROM e)
SELECT node_id, bucket, count(*) AS n_edges, count(DISTINCT other) AS n_targets FROM b GROUP BY 1, 2""")
def q47(spark, sf_dir):
    return graph.dependencies(_typed_edges(spark, sf_dir))


@register("q48_layout_datasets", f"WITH e AS ({_TYPED}) SELECT target_id AS copybook, count(*) AS n, min(source_id) AS first_dataset FROM e WHERE rel_type = 'USES_RECORD_LAYOUT' GROUP BY 1")
def q48(spark, sf_dir):
    return graph.datasets_of_layouts(_typed_edges(spark, sf_dir)).groupBy("copybook").agg(F.count(F.lit(1)).alias("n"), F.min("dataset").alias("first_dataset"))


@register("q49_program_datasets", f"""
WITH e AS (SELECT DISTINCT source_id, target_id FROM ({_TYPED}) WHERE rel_type IN ('ACCESSES', 'READS', 'WRITES'))
SELECT concat('o', o_orderkey) AS program, count(target_id) AS n_datasets, coalesce(min(target_id), 'UNKNOWN') AS first_dataset, CASE WHEN count(target_id) > 0 THEN 'READ' ELSE '' END AS operations
FROM orders LEFT JOIN e ON source_id = concat('o', o_orderkey) GROUP BY 1""")
def q49(spark, sf_dir):
    programs = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("program"))
    return graph.datasets_of_programs(programs, _typed_edges(spark, sf_dir))


@register("q50_parent_first", """
WITH RECURSIVE t AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 4 THEN p_partkey // 4 END AS parent FROM part),
r AS (SELECT id, 0 AS depth, id::VARCHAR AS place FROM t WHERE parent IS NULL UNION ALL SELECT t.id, r.depth + 1, concat(r.place, '/', t.id) FROM t JOIN r ON t.parent = r.id)
SELECT id, depth, place FROM r""")
def q50(spark, sf_dir):
    key = F.col("p_partkey")
    nodes = table(spark, sf_dir, "part").select(key.alias("id"), F.when(key > 4, F.floor(key / 4)).alias("parent"))
    return graph.parent_first(nodes, "id", "parent").select("id", "depth", F.array_join("place", "/").alias("place"))


@register("q51_readiness", f"""
WITH f AS (SELECT source, {CLASSIFY_SQL.format(e=EXT_SQL.format(p=_P), c='text')} AS t FROM documents),
c AS (SELECT source, count(*) AS n_files, count(*) FILTER (t = 'idcams') AS d, count(*) FILTER (t = 'copybook') AS b, count(*) FILTER (t = 'cobol') AS p, count(*) FILTER (t = 'jcl') AS j FROM f GROUP BY 1)
SELECT source, n_files, CASE WHEN d > 0 AND b > 0 AND (p > 0 OR j > 0) THEN 'Ready for modernization review' WHEN b > 0 AND d = 0 THEN 'Copybooks inventoried - upload JCL, LISTCAT, or COBOL to map datasets'
 WHEN d > 0 THEN 'Datasets inventoried - add copybooks for schema design' WHEN n_files > 0 THEN 'Inventory complete - more mainframe context needed' ELSE 'No repository artifacts found' END AS readiness FROM c""")
def q51(spark, sf_dir):
    kind = classify.artifact_type("path", "content")
    typed = _files(spark, sf_dir).select(F.split_part("path", F.lit("/"), F.lit(1)).alias("source"), kind.alias("t"))
    n = typed.groupBy("source").agg(F.count(F.lit(1)).alias("n_files"), *[F.count_if(F.col("t") == k).alias(f"n_{k}") for k in ("idcams", "copybook", "cobol", "jcl")])
    return n.select("source", "n_files", assess.readiness(F.col("n_files"), F.col("n_idcams"), F.col("n_copybook"), F.col("n_cobol"), F.col("n_jcl")).alias("readiness"))


@register("q52_legacy_types", """
WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity::INTEGER AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN concat('VARCHAR(', q, ')') WHEN 2 THEN CASE WHEN q <= 4 THEN 'SMALLINT' WHEN q <= 9 THEN 'INTEGER' WHEN q <= 18 THEN 'BIGINT' ELSE concat('NUMERIC(', q, ', 0)') END
 WHEN 3 THEN concat('NUMERIC(', q + 2, ', 2)') WHEN 4 THEN concat('NUMERIC(', q, ', 0)') WHEN 5 THEN 'REAL' WHEN 6 THEN CASE WHEN q IN (6, 8) THEN 'DATE' WHEN q <= 4 THEN 'SMALLINT' WHEN q <= 9 THEN 'INTEGER' WHEN q <= 18 THEN 'BIGINT' ELSE concat('NUMERIC(', q, ', 0)') END
 ELSE 'TEXT' END AS sql_type FROM p""")
def q52(spark, sf_dir):
    q = F.col("l_quantity").cast("int").cast("string")
    forms = ("X(%s)", "S9(%s)", "s9(%s)V99", "9(%s) COMP-3", "9(%s) COMP-1", "9(%s)", "B/%s/")
    forms = [F.replace(F.lit(f.replace("%s", "?")), F.lit("?"), F.lit("") if f.startswith("B") else q) for f in forms]
    pic = F.get(F.array(*forms), F.col("l_linenumber") - 1)
    name = F.when(F.col("l_linenumber") == 6, "SHIP-DATE").otherwise("OTHER")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", pic.alias("pic"), name.alias("name"))
    return rows.select("l_orderkey", "l_linenumber", picture.legacy_type("pic", "name")["sql_type"].alias("sql_type"))


@register("q53_validate_schemas", """
WITH f AS (SELECT p_brand AS file, p_name AS name, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'X' END AS pic, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS n_children FROM part),
n AS (SELECT file, count(DISTINCT name) AS n_names, (count(*) - count(DISTINCT name))::BIGINT AS n_errors, count(*) FILTER (pic = '' AND n_children = 0) AS n_warnings FROM f GROUP BY 1)
SELECT *, CASE WHEN n_errors > 0 THEN 'FAIL' WHEN n_warnings > 0 THEN 'WARNING' ELSE 'PASS' END AS status FROM n""")
def q53(spark, sf_dir):
    fields = table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 3 == 0, "").otherwise("X").alias("pic"), F.when(F.col("p_size") % 2 == 0, 1).otherwise(0).alias("n_children"))
    return assess.validate_schema(fields)
