"""Lookups, summaries and derived schemas on nulls, ties, repeated rows and no rows."""

from pyspark.sql import functions as F

from granary.operators import dialects, lookup, structures


def rows(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def got(df, *columns):
    return sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))


def test_of_repository(spark):
    files = rows(spark, "file_id int, repository_id string", (1, "a"), (1, "a"), (2, "b"), (3, None), (None, "a"))
    programs = rows(spark, "file_id int, n int", (1, 1), (1, 1), (2, 2), (3, 3), (None, 4))
    wanted = rows(spark, "repository_id string", ("a",), ("a",), (None,))
    assert got(lookup.of_repository(programs, files, wanted), "n") == ["(1,)", "(1,)"]
    assert lookup.of_repository(programs, files, wanted.limit(0)).count() == 0


def test_nodes_with_evidence(spark):
    nodes = rows(spark, "path string, line_no int, type string", ("a", 1, "fd"), ("a", 1, "select"), ("a", 2, "fd"), (None, 1, "fd"), ("a", None, "fd"))
    found = rows(spark, "path string, source_line int, evidence_type string, evidence_id string", ("a", 1, "FD", "y"), ("a", 1, "FD", "x"), ("a", None, "FD", "z"), (None, 1, "FD", "q"), ("a", 1, "DD", "d"))
    shown = {(r.path, r.line_no, r.type): r.evidence_ids for r in lookup.with_evidence(nodes, found, {"fd": "FD", "select": "SELECT"}).collect()}
    assert shown == {("a", 1, "fd"): ["x", "y"], ("a", 1, "select"): None, ("a", 2, "fd"): None, (None, 1, "fd"): None, ("a", None, "fd"): None}


def test_evidence_by_name_and_schemas(spark):
    artifacts = rows(spark, "artifact_id string, path string", ("A", "src/x.CBL"), ("B", "lib/X.cbl"), ("C", None), ("D", ""))
    found = rows(spark, "path string, n int", ("other/x.cbl", 1), (None, 2), ("", 3), ("y", 4))
    assert got(lookup.evidence_by_name(artifacts, found), "artifact_id", "n") == ["('A', 1)", "('B', 1)"]
    generated = rows(spark, "place int, artifact_id string, schema_id string", (2, "a", "late"), (1, "A", "first"), (1, None, "lost"))
    assert got(lookup.schema_of_artifact(artifacts.select("artifact_id"), generated), "artifact_id", "schema.schema_id") == ["('A', 'first')", "('B', None)", "('C', None)", "('D', None)"]
    told = rows(spark, "place int, schema_id string, validation_status string", (1, "s", "old"), (2, "s", "new"), (3, None, "x"))
    assert got(lookup.with_validation(rows(spark, "schema_id string", ("s",), ("t",), (None,)), told), "schema_id", "validation_status") == ["('s', 'new')", "('t', None)", "(None, None)"]


def test_folders(spark):
    files = rows(spark, "r int, path string, artifact_type string", (1, "a/b/f", "cobol"), (1, "a\\b\\g", None), (1, "/a/f", "JCL"), (1, "f", "jcl"), (2, None, "x"), (2, "", "x"), (3, "d/e/", "x"))
    assert got(lookup.folders(files, "r"), "r", "folder") == ["(1, 'a')", "(1, 'a/b')", "(3, 'd')", "(3, 'd/e')"]
    summary = {r.r: (r.total_files, r.n_programs, r.n_jcl, r.total_folders) for r in lookup.repository_summary(files, "r").collect()}
    assert summary == {1: (4, 1, 2, 2), 2: (2, 0, 0, 0), 3: (1, 0, 0, 2)}


def test_sources_and_language(spark):
    long = "\n".join(["x" * 99] * 80)
    files = rows(spark, "path string, content string", ("short", "A.\nREAD B."), ("null", None), ("none", long), ("hit", long + "\nREAD F\nINTO X.\nDONE."))
    found = {r.path: r.source for r in dialects.relevant_source(files, F.col("text").contains("READ")).collect()}
    assert found == {"short": "A.\nREAD B.", "null": None, "none": long[:6000], "hit": "READ F\nINTO X."}
    artifacts = rows(spark, "r int, artifact_type string", (1, "COBOL"), (1, None), (2, None), (3, "pli"))
    assert got(dialects.detected_language(artifacts, "r"), "r", "language") == ["(1, 'COBOL')", "(2, 'Mixed')", "(3, 'Mixed')"]
    assert dialects.detected_language(artifacts.limit(0), "r").count() == 0


def test_schemas_of_odd_artifacts(spark):
    schema = "artifact_id string, artifact_type string, name string, source_file string, facts string"
    found = structures.canonical(rows(spark, schema, ("c", "COBOL", None, None, None), ("j", "JCL", None, None, "{}"), ("d", "DATASET", None, None, '{"key_length":"7","organization":""}'), ("x", "COPYBOOK", None, None, "{}")))
    made = {r.artifact_id: (r.schema_type, r.schema_name, r.parts.toPython()) for r in structures.schemas(found).collect()}
    assert made["c"] == ("PROGRAM_SCHEMA", "C", {"operations": [], "datasets_accessed": [], "copybooks": [], "called_programs": [], "data_structures": []})
    assert made["j"] == ("JOB_SCHEMA", "J", {"steps": []}) and made["d"] == ("DATASET_SCHEMA", "d", {"key_length": 7, "alternate_keys": []})
    assert set(made) == {"c", "j", "d"}


def test_readiness(spark):
    layouts = rows(spark, "artifact_id string", ("a",), ("b",), ("c",), ("d",), (None,))
    columns = rows(spark, "artifact_id string, needs_review boolean", ("a", None), ("b", True), ("b", False), ("d", False), (None, False))
    edges = rows(spark, "place int, source_id string, target_id string, rel_type string", (2, "late", "a", "USES_RECORD_LAYOUT"), (1, "first", "a", "USES_RECORD_LAYOUT"), (1, "x", "b", "USES_RECORD_LAYOUT"), (1, None, "d", "USES_RECORD_LAYOUT"), (1, "x", "d", "READS"))
    ready = {r.artifact_id: (r.readiness, r.mapped_dataset, r.n_columns) for r in structures.readiness(layouts, columns, edges).collect()}
    assert ready == {"a": ("READY", "first", 1), "b": ("REVIEW_REQUIRED", "x", 2), "c": ("NOT_MIGRATABLE", None, 0), "d": ("INSUFFICIENT_EVIDENCE", None, 1), None: ("NOT_MIGRATABLE", None, 0)}


def test_marked_rows(spark):
    left = rows(spark, "k long, n int", (1, 1), (1, 2), (2, 3), (3, 4), (None, 5))
    right = rows(spark, "o long, f string", (1, "R"), (1, "A"), (2, None), (2, "A"), (None, "R"), (4, "R"))
    found = lookup.marked(left, "k", right, "o", back=F.col("f") == "R")
    assert got(found, "k", "n", "back") == ["(1, 1, True)", "(1, 2, True)", "(2, 3, False)"]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert lookup.marked(left, "k", right.limit(0), "o", back=F.col("f") == "R").count() == 0
