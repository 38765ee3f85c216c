"""How sure a finding is, and whether it holds: scores, levels, validators and readiness, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import col, or_null
from granary.operators.audit import level, verdict

# fixed values: points and reasons of the rules; other ones may be passed
DATASET_RULES = {"jcl": (20.0, "Found in JCL DD statement"), "listcat": (40.0, "Found in LISTCAT catalog"), "inferred": (20.0, "Dataset metadata inferred solely by AI (low confidence)")}
COPYBOOK_RULES = {"copied": (80.0, "Direct COPY/INCLUDE statement found inside mapped FD"), "fields": (20.0, "Layout fields parsed successfully"), "none": (0.0, "No copybook matched.")}
EDGE_RULES = {"found": (100.0, "Evidence traces relationship"), "missing": (0.0, "Missing evidence")}


def _messages(*pairs: tuple[Column, Column | str]) -> Column:
    """The messages whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(when, text if isinstance(text, Column) else F.lit(text)) for when, text in pairs]))


def _graded(score: Column, reasons: Column) -> Column:
    capped = F.least(score, F.lit(100.0))
    return F.struct(capped.alias("score"), level(capped).alias("level"), reasons.alias("reasons"))


def in_listcat(notes: str | Column) -> Column:
    return F.upper(F.coalesce(col(notes), F.lit(""))).contains("LISTCAT")


def dataset_confidence(source_jcl: str | Column, notes: str | Column, confidence: str | Column, rules: dict = DATASET_RULES) -> Column:
    """score, level, reasons: points for job and catalog; without either 100 times the strategy's own confidence."""
    jcl, listed = or_null(source_jcl).isNotNull(), in_listcat(notes)
    points = F.when(jcl, rules["jcl"][0]).otherwise(0.0) + F.when(listed, rules["listcat"][0]).otherwise(0.0)
    own = col(confidence) * 100.0
    return _graded(F.when(points == 0, own).otherwise(points), _messages((jcl, rules["jcl"][1]), (listed, rules["listcat"][1]), ((points == 0) & (own < 50), rules["inferred"][1])))


def copybook_confidence(filename: str | Column, n_fields: str | Column, rules: dict = COPYBOOK_RULES) -> Column:
    found = col(filename) != "NOT_FOUND"
    parsed = found & (col(n_fields) > 0)
    score = F.when(found, rules["copied"][0]).otherwise(0.0) + F.when(parsed, rules["fields"][0]).otherwise(0.0)
    return _graded(score, _messages((found, rules["copied"][1]), (parsed, rules["fields"][1]), (~found, rules["none"][1])))


def edge_confidence(state: str | Column, rules: dict = EDGE_RULES) -> Column:
    open_ = F.coalesce(col(state) == "UNVERIFIED", F.lit(False))
    return _graded(F.when(open_, rules["missing"][0]).otherwise(rules["found"][0]), _messages((open_, rules["missing"][1]), (~open_, rules["found"][1])))


def repository_confidence(*scores: DataFrame) -> DataFrame:
    """The mean of all scores (one column each) of datasets, layouts and edges; 0 without any."""
    every = scores[0]
    for s in scores[1:]:
        every = every.union(s)
    return every.toDF("score").agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("confidence"))


def _judged(errors: Column, warnings: Column, evidence: Column, by: str) -> Column:
    return F.struct(verdict(errors, warnings).alias("status"), errors.alias("errors"), warnings.alias("warnings"), evidence.alias("evidence"), F.lit(by).alias("validator"))


def validate_dataset(dsn: str | Column, vsam_type: str | Column, record_length: str | Column, source_jcl: str | Column, notes: str | Column) -> Column:
    """status, errors, warnings, evidence and validator of a dataset."""
    name, jcl = or_null(dsn), or_null(source_jcl)
    named = name.isNotNull() & (name != "UNKNOWN")
    errors = _messages((~F.coalesce(named, F.lit(False)), "Dataset name (dsn) is missing or UNKNOWN."), (or_null(vsam_type).isNull(), "Organization (vsam_type) is missing."))
    warnings = _messages((F.coalesce(col(record_length) <= 0, F.lit(True)), "Record length is missing or invalid."))
    evidence = _messages((named, F.concat(F.lit("Valid dataset name: "), name)), (jcl.isNotNull(), F.concat(F.lit("Discovered via JCL: "), jcl)), (in_listcat(notes), "Discovered via LISTCAT catalog."))
    return _judged(errors, warnings, evidence, "DatasetValidator")


def validate_copybook(filename: str | Column, n_fields: str | Column, dsn_match: str | Column) -> Column:
    found = F.coalesce(col(filename) != "NOT_FOUND", F.lit(False))
    n, dsn = F.coalesce(col(n_fields), F.lit(0)), or_null(dsn_match)
    errors = _messages((~found, "No matched copybook found."))
    warnings = _messages((found & (n == 0), "Copybook parsed but no fields were extracted."), (found & dsn.isNull(), "DSN match not explicit in copybook mapping."))
    evidence = _messages((found, F.concat(F.lit("Copybook resolved: "), col(filename))), (found & (n > 0), F.concat(F.lit("Parsed "), n.cast("string"), F.lit(" fields."))), (found & dsn.isNotNull(), F.concat(F.lit("Mapped to DSN: "), dsn)))
    return _judged(errors, warnings, evidence, "CopybookValidator")


def validate_edge(source_id: str | Column, target_id: str | Column, rel_type: str | Column, state: str | Column) -> Column:
    source, target, kind = or_null(source_id), or_null(target_id), or_null(rel_type)
    open_ = F.coalesce(col(state) == "UNVERIFIED", F.lit(False))
    shown = lambda c: F.coalesce(c, F.lit(""))
    errors = _messages((source.isNull() | target.isNull(), "Relationship missing source or target ID."), (kind.isNull(), "Relationship missing type."))
    warnings = _messages((open_, F.concat(F.lit("Relationship "), shown(source), F.lit(" -> "), shown(target), F.lit(" lacks concrete evidence."))))
    return _judged(errors, warnings, _messages((~open_, F.concat(F.lit("Relationship "), shown(kind), F.lit(" verified.")))), "RelationshipValidator")


def validate_schema(fields: DataFrame, file: str = "file") -> DataFrame:
    """file, n_names, n_errors, n_warnings, status of the fields of each file (name, pic, n_children): an error for each
    repeated name other than FILLER, a warning for each field without a picture and children."""
    named = or_null("name").isNotNull() & (F.upper("name") != "FILLER")
    bare = or_null("pic").isNull() & (F.coalesce("n_children", F.lit(0)) == 0)
    # names are counted before a file's rows meet, so a name in a third of all rows is one row a task
    by_name = fields.groupBy(file, F.when(named, F.col("name")).alias("_name")).agg(F.count(F.lit(1)).alias("_n"), F.count_if(bare).alias("_bare"))
    counts = by_name.groupBy(file).agg(F.count("_name").alias("n_names"), F.sum(F.when(F.col("_name").isNotNull(), F.col("_n") - 1).otherwise(0)).alias("n_errors"), F.sum("_bare").alias("n_warnings"))
    return counts.withColumn("status", F.when(F.col("n_errors") > 0, "FAIL").when(F.col("n_warnings") > 0, "WARNING").otherwise("PASS"))


def readiness(files: Column, datasets: Column, copybooks: Column, programs: Column, jobs: Column) -> Column:
    """What an inventory with these counts is ready for."""
    return (
        F.when((datasets > 0) & (copybooks > 0) & ((programs > 0) | (jobs > 0)), "Ready for modernization review")
        .when((copybooks > 0) & (datasets == 0), "Copybooks inventoried - upload JCL, LISTCAT, or COBOL to map datasets")
        .when(datasets > 0, "Datasets inventoried - add copybooks for schema design")
        .when(files > 0, "Inventory complete - more mainframe context needed")
        .otherwise("No repository artifacts found")
    )
