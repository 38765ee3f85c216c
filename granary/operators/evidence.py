"""Extractors: from source lines to rows of evidence.

All take lines (path, line_no, text) and return path, source_line, evidence_type, entity_type, entity_name, value,
properties.  Those that need neighbours use windows partitioned by path, so one exchange serves a whole family.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.text import keyword_value, or_null
from granary.sources.repository import spread

NAME = r"[A-Z0-9#$@-]+"
JCL_NAME = r"[A-Z0-9#$@]"
Extractor = Callable[[DataFrame], DataFrame]
#: Extractors by the kind of file they read; users may add their own.
EXTRACTORS: dict[str, list[Extractor]] = {"cobol": [], "jcl": [], "idcams": [], "listcat": []}


def extractor(kind: str) -> Callable[[Extractor], Extractor]:
    def put(f: Extractor) -> Extractor:
        EXTRACTORS.setdefault(kind, []).append(f)
        return f

    return put


def evidence(kind: str, entity: str, name: Column, value: Column, properties: dict[str, Column] | None = None) -> list[Column]:
    entries = [x for k, v in (properties or {}).items() for x in (F.lit(k), v.cast("string"))]
    found = F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
    return [
        F.lit(kind).alias("evidence_type"), F.lit(entity).alias("entity_type"), name.alias("entity_name"), value.cast("string").alias("value"),
        F.map_filter(found, lambda k, v: v.isNotNull()).alias("properties"),
    ]


def with_ids(rows: DataFrame) -> DataFrame:
    """evidence_id from place, kind and name, so that a second run gives the same ids; repeated ones are numbered."""
    key = ["path", "source_line", "evidence_type", "entity_name"]
    nth = F.row_number().over(W.partitionBy(*key).orderBy("value"))
    return rows.withColumn("evidence_id", F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in key], nth.cast("string")), 256))


@extractor("cobol")
def selects(lines: DataFrame) -> DataFrame:
    pattern = rf"(?i)SELECT\s+({NAME})\s+ASSIGN\s+TO\s+({NAME})"
    pairs = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(pattern), F.lit(i)).alias(n) for i, n in ((1, "a"), (2, "b"))])
    found = lines.select("path", F.col("line_no").alias("source_line"), F.explode(pairs).alias("m"))
    return found.select("path", "source_line", *evidence("SELECT", "LogicalFile", F.upper("m.a"), F.upper("m.b")))


@extractor("cobol")
def file_descriptions(lines: DataFrame) -> DataFrame:
    name = F.regexp_extract("text", rf"(?i)^.{{0,6}}\s*FD\s+({NAME})", 1)
    return lines.where(name != "").select("path", F.col("line_no").alias("source_line"), *evidence("FD", "LogicalFile", F.upper(name), F.lit("true")))


@extractor("cobol")
def business_rules(lines: DataFrame) -> DataFrame:
    pattern = r"(?i)^\s*(IF|EVALUATE|PERFORM\s+UNTIL|WHEN)\b(.+)"
    statement, condition = F.upper(F.trim(F.regexp_extract("text", pattern, 1))), F.btrim(F.regexp_extract("text", pattern, 2), F.lit(" \t\r\n\x0b\x0c"))
    return lines.where(F.col("text").rlike(pattern)).select("path", F.col("line_no").alias("source_line"), *evidence("BUSINESS_RULE", "BusinessRule", statement, condition, {"statement": statement, "condition": condition}))


@extractor("cobol")
def access_patterns(lines: DataFrame) -> DataFrame:
    pattern = rf"(?i)^\s*(READ|WRITE|REWRITE|DELETE|START)\s+({NAME})"
    verb, name = F.upper(F.regexp_extract("text", pattern, 1)), F.upper(F.regexp_extract("text", pattern, 2))
    return lines.where(F.col("text").rlike(pattern)).select("path", F.col("line_no").alias("source_line"), *evidence("ACCESS_PATTERN", "AccessPattern", name, verb, {"operation": verb, "file": name}))


def select_clauses(files: DataFrame) -> DataFrame:
    """Whole SELECT entries, over several lines: assignment, organization, access mode, key and status."""
    pattern = rf"(?is)\bSELECT\s+({NAME})(.*?)(?=\bSELECT\s|\bDATA\s+DIVISION\b|\.|\z)"
    pairs = F.arrays_zip(*[F.regexp_extract_all("content", F.lit(pattern), F.lit(i)).alias(n) for i, n in ((1, "name"), (2, "body"))])
    found = files.select("path", F.explode(pairs).alias("m"))
    of = lambda p: F.upper(or_null(F.regexp_extract("m.body", rf"(?is){p}", 1)))
    return found.select(
        "path", F.upper("m.name").alias("name"), of(rf"ASSIGN\s+(?:TO\s+)?({NAME})").alias("assign_to"), of(r"ORGANIZATION\s+(?:IS\s+)?([A-Z]+)").alias("organization"),
        of(r"ACCESS\s+(?:MODE\s+)?(?:IS\s+)?([A-Z]+)").alias("access_mode"), of(rf"RECORD\s+KEY\s+(?:IS\s+)?({NAME})").alias("record_key"), of(rf"FILE\s+STATUS\s+(?:IS\s+)?({NAME})").alias("file_status"),
    )


# ------------------------------------------------------------------ jobs

def logical_lines(lines: DataFrame) -> DataFrame:
    """Cards joined while they end with a comma; the line number of the first card; comment cards are left out.

    A card that is no control card ends what is open and stands alone.
    """
    rows = spread(lines, "path").select("path", "line_no", F.rtrim("text").alias("text")).where(~F.col("text").startswith("//*"))
    order = W.partitionBy("path").orderBy("line_no")
    control = F.col("text").startswith("//")
    rows = rows.withColumn("_goes_on", control & F.rtrim("text").endswith(","))
    follows = F.coalesce(F.lag("_goes_on").over(order), F.lit(False)) & control
    rows = rows.withColumn("_follows", follows).withColumn("_group", F.sum(F.when(follows, 0).otherwise(1)).over(order))
    part = F.when(F.col("_follows"), F.ltrim(F.substr("text", F.lit(3)))).otherwise(F.col("text"))
    cards = F.transform(F.sort_array(F.collect_list(F.struct("line_no", part.alias("text")))), lambda x: x["text"])
    return rows.groupBy("path", "_group").agg(F.min("line_no").alias("line_no"), F.array_join(cards, " ").alias("text")).drop("_group")


@extractor("jcl")
def steps(lines: DataFrame) -> DataFrame:
    pattern = rf"(?i)^//({JCL_NAME}+)?\s+EXEC\s+(.*)"
    rest = F.regexp_extract("text", pattern, 2)
    name = F.coalesce(F.upper(or_null(F.regexp_extract("text", pattern, 1))), F.lit("UNASSIGNED"))
    program = F.coalesce(F.upper(or_null(F.regexp_extract(rest, rf"(?i)(?:PGM|PROC)\s*=\s*({JCL_NAME}+)", 1))), F.lit("UNKNOWN"))
    kind = F.when(F.upper(rest).contains("PROC="), "PROC").otherwise("PGM")
    props = {"step_name": name, "kind": kind} | {k.lower(): keyword_value("text", k) for k in ("PARM", "COND", "REGION")}
    return logical_lines(lines).where(F.col("text").rlike(pattern)).select("path", F.col("line_no").alias("source_line"), *evidence("EXEC", "Program", program, program, props))


@extractor("jcl")
def job_cards(lines: DataFrame) -> DataFrame:
    pattern = rf"(?i)^//({JCL_NAME}+)\s+JOB\s+(.*)"
    first = logical_lines(lines).where(F.col("text").rlike(pattern)).groupBy("path").agg(F.min("line_no").alias("source_line"), F.min_by("text", "line_no").alias("text"))
    card = F.trim(F.regexp_extract("text", pattern, 2))
    return first.select("path", "source_line", *evidence("JOB", "Job", F.upper(F.regexp_extract("text", pattern, 1)), card, {"job_card": card}))


@extractor("jcl")
def symbols(lines: DataFrame) -> DataFrame:
    names = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(rf"(?i)&([A-Z]{JCL_NAME}*)"), F.lit(1))))
    found = logical_lines(lines).select("path", F.col("line_no").alias("source_line"), F.explode(names).alias("name"))
    return found.select("path", "source_line", *evidence("SYMBOL", "SymbolicParameter", F.upper("name"), F.upper("name")))


@extractor("jcl")
def data_definitions(lines: DataFrame) -> DataFrame:
    """DD statements with their continuation cards, owning step, and place in a concatenation."""
    order = W.partitionBy("path").orderBy("line_no")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = spread(lines, "path").select("path", "line_no", F.rtrim("text").alias("text"))
    control = F.col("text").startswith("//") & ~F.col("text").startswith("//*")
    dd = rf"(?i)^//({JCL_NAME}{{0,8}})\s+DD\b(.*)"
    kind = (
        F.when(~control, "other")
        .when(F.col("text").rlike(rf"(?i)^//{JCL_NAME}+\s+JOB\b"), "job")
        .when(F.col("text").rlike(rf"(?i)^//{JCL_NAME}+\s+EXEC\b"), "exec")
        .when(F.col("text").rlike(dd), "dd")
        .otherwise("card")
    )
    rows = rows.withColumn("kind", kind)
    # a card goes on with the DD before it if all cards between end with a comma and it is indented
    more = (F.col("kind") == "card") & F.col("text").rlike(r"^//\s") & F.lag(F.rtrim("text").endswith(",")).over(order) & F.lag(F.col("kind").isin("dd", "card")).over(order)
    rows = rows.withColumn("_more", F.coalesce(more, F.lit(False)))
    rows = rows.withColumn("_run", F.sum(F.when(F.col("_more"), 0).otherwise(1)).over(so_far))
    body = F.when(F.col("_more"), F.trim(F.substr("text", F.lit(3)))).otherwise(F.trim(F.regexp_extract("text", dd, 2)))
    in_run = W.partitionBy("path", "_run")
    rows = rows.withColumn("_head", F.first("kind").over(in_run.orderBy("line_no")))
    step = F.last(F.when(F.col("kind") == "job", "").when(F.col("kind") == "exec", F.upper(F.regexp_extract("text", rf"(?i)^//({JCL_NAME}+)", 1))), True).over(so_far)
    rows = rows.withColumn("step_name", or_null(step))
    name = F.upper(F.trim(F.regexp_extract("text", dd, 1)))
    # what ends a chain of unnamed DDs: a job or step, or a control card that is no continuation and not blank
    ends = F.col("kind").isin("job", "exec") | ((F.col("kind") == "card") & ~(F.col("_more") & (F.col("_head") == "dd")) & (F.trim(F.substr("text", F.lit(3))) != ""))
    rows = rows.withColumn("_part", F.sum(F.when(ends, 1).otherwise(0)).over(so_far))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", body.alias("body")))), lambda x: x["body"]), " ")
    cards = rows.where(F.col("_head") == "dd").groupBy("path", "_run").agg(F.min("line_no").alias("source_line"), F.min_by(name, "line_no").alias("name"), F.min_by("step_name", "line_no").alias("step_name"), F.min_by("_part", "line_no").alias("_part"), F.trim(text).alias("params"))
    chain = W.partitionBy("path", "_part").orderBy("source_line").rowsBetween(W.unboundedPreceding, W.currentRow)
    # the first DD of a part opens a chain even without a name
    opens = (F.col("name") != "") | (F.row_number().over(W.partitionBy("path", "_part").orderBy("source_line")) == 1)
    cards = cards.withColumn("_opens", opens).withColumn("_chain", F.sum(F.col("_opens").cast("int")).over(chain))
    own = W.partitionBy("path", "_part", "_chain").orderBy("source_line")
    position = F.row_number().over(own) - 1
    dd_name = F.coalesce(or_null(F.first("name").over(own)), F.lit("UNNAMED"))
    cards = cards.withColumn("position", position).withColumn("dd_name", dd_name)
    p = F.col("params")
    dsn = F.coalesce(keyword_value(p, "DSN"), keyword_value(p, "DSNAME"))
    disp = keyword_value(p, "DISP")
    sysout = F.when(F.upper(p).contains("SYSOUT="), F.coalesce(keyword_value(p, "SYSOUT"), F.lit("*")))
    dummy, instream = F.upper(p).contains("DUMMY"), p == "*"
    use = F.when(F.upper(disp).rlike("NEW|MOD"), "OUTPUT").when(F.upper(disp).rlike("SHR|OLD"), "INPUT")
    value = F.coalesce(dsn, sysout, F.when(dummy, "DUMMY").when(instream, "INSTREAM").otherwise("UNKNOWN"))
    yes = lambda c: F.when(c, "true")
    props = {
        "dd_name": F.col("dd_name"), "scope": F.when(F.col("step_name").isNotNull(), "step").otherwise("job"), "step_name": F.col("step_name"),
        "is_concatenation": (F.col("position") > 0), "position": F.col("position"), "dataset": dsn, "temporary": yes(dsn.startswith("&&")), "disp": disp, "type": use,
        "space": keyword_value(p, "SPACE"), "unit": keyword_value(p, "UNIT"), "dcb": keyword_value(p, "DCB"), "volume": keyword_value(p, "VOL"), "sysout": sysout, "dummy": yes(dummy), "instream": yes(instream),
    }
    return cards.select("path", "source_line", *evidence("DD", "DatasetBinding", F.col("dd_name"), value, props))


# ------------------------------------------------------------------ catalogs

def clusters(files: DataFrame) -> DataFrame:
    """DEFINE CLUSTER names of whole files; the first organization word of a file holds for all of them."""
    text = F.translate("content", "\n", " ")
    word = F.upper(F.regexp_extract(text, r"(?i)\b(INDEXED|NONINDEXED|NUMBERED|LINEAR)\b", 1))
    organization = F.when(word == "INDEXED", "KSDS").when(word == "NONINDEXED", "ESDS").when(word == "NUMBERED", "RRDS").when(word == "LINEAR", "LDS")
    names = F.regexp_extract_all(text, F.lit(r"(?i)DEFINE\s+CLUSTER\s*\(\s*NAME\s*\(\s*([A-Z0-9.#$@]+)\s*\)"), F.lit(1))
    found = files.select("path", organization.alias("organization"), F.explode(names).alias("name"))
    return found.select("path", F.lit(1).alias("source_line"), *evidence("DEFINE_CLUSTER", "Cluster", F.col("name"), F.lit("true"), {"organization": F.col("organization")}))


@extractor("listcat")
def catalog_entries(lines: DataFrame) -> DataFrame:
    """Entries of a catalog listing: a header names type and dataset, what follows up to the next header describes it."""
    header = r"^\s*[01]?\s*(CLUSTER|NONVSAM|DATA|INDEX|PATH|GDG BASE|AIX)\s*-+\s*([A-Z0-9.#$@]+)"
    order = W.partitionBy("path").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = lines.withColumn("_entry", F.sum(F.col("text").rlike(header).cast("int")).over(order)).where("_entry > 0")
    number = lambda k: F.last(or_null(F.regexp_extract("text", rf"{k}-+\s*(\d+)", 1)), True)
    inner = W.partitionBy("path", "_entry").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    names = {"key_length": "KEYLEN", "average_length": "AVGLRECL", "record_length": "MAXLRECL", "key_offset": "RKP", "control_interval": "CISIZE"}
    rows = rows.select("path", "line_no", "text", "_entry", *[number(v).over(inner).alias(k) for k, v in names.items()])
    heads = rows.where(F.col("text").rlike(header))
    kind, name = F.regexp_extract("text", header, 1), F.regexp_extract("text", header, 2)
    organization = F.when((kind == "CLUSTER") & name.contains(".KSDS"), "KSDS")
    return heads.select("path", F.col("line_no").alias("source_line"), *evidence("CATALOG_ENTRY", "Dataset", name, kind, {"organization": organization} | {k: F.col(k) for k in names}))


def listing_hints(lines: DataFrame) -> DataFrame:
    """One row a listing: the last record length, key length and offset, interval size, record count and organization."""
    patterns = {"record_length": r"(?:LRECL|MAXLRECL|AVGLRECL)\s*-+\s*(\d+)", "key_length": r"KEYLEN\s*-+\s*(\d+)", "key_offset": r"(?:RKP|KEYOFF)\s*-+\s*(\d+)", "control_interval": r"CISIZE\s*-+\s*(\d+)", "records": r"REC-TOTAL\s*-+\s*(\d+)", "organization": r"\b(KSDS|ESDS|RRDS|LDS)\b"}
    found = lambda p: or_null(F.regexp_extract("text", p, 1))
    return lines.groupBy("path").agg(*[F.max_by(found(p), F.when(found(p).isNotNull(), F.col("line_no"))).alias(k) for k, p in patterns.items()])


def dataset_candidates(files: DataFrame) -> DataFrame:
    """Dataset names that jobs, listings and metadata of (path, content, artifact_type) mention; distinct."""
    text = F.upper("content")
    of = lambda kind, p: files.where(F.col("artifact_type") == kind).select(F.explode(F.regexp_extract_all(text, F.lit(p), F.lit(1))).alias("dataset"))
    jobs = of("jcl", r"\bDSN(?:AME)?=([A-Z0-9#$@.\-]+)")
    listed = of("listcat", r"CLUSTER\s*-+\s*([A-Z0-9#$@.\-]+)")
    named = of("metadata", r"\b([A-Z0-9#$@]{1,8}(?:\.[A-Z0-9#$@]{1,8}){2,5})\b").where(F.col("dataset").rlike("[A-Z]"))
    return jobs.unionByName(listed).unionByName(named).distinct()


def extract(kind: str, lines: DataFrame) -> DataFrame:
    """Everything that the registered extractors of a kind find."""
    out = None
    for f in EXTRACTORS[kind]:
        out = f(lines) if out is None else out.unionByName(f(lines))
    return with_ids(out)
