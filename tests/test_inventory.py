"""Inventories, guards and look-ups on nulls, ties, repeated rows and no rows."""

import pytest
from pyspark.sql import functions as F

from granary.operators import inventory


def rows(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


@pytest.mark.parametrize(("path", "safe"), [
    ("a/b.cbl", "a/b.cbl"), ("a\\b", "a/b"), ("./a//b/.", "a/b"), ("../x", None), ("a/../x", None), ("/abs", None), ("C:\\x", None), ("a:b", None), ("", None), ("  ", None), (None, None), ("..a", "..a"),
])
def test_safe_path(spark, path, safe):
    assert rows(spark, "p string", (path,)).select(inventory.safe_path("p")).first()[0] == safe


def test_upload_path(spark):
    got = rows(spark, "r string, f string", (None, "x.cbl"), ("", "y"), ("a/b", None), ("a/b", "d/"), ("../x", "z")).select(inventory.upload_path("r", "f").alias("p")).collect()
    assert [r.p for r in got] == ["x.cbl", "y", None, None, None]


def test_inventory_counts_names_once(spark):
    files = rows(spark, "u string, path string", ("a", "x/P.cbl"), ("a", "y/p.COB"), ("a", "B.cpy"), ("a", "z"), ("a", "z"), ("a", None), ("b", "j.jcl"))
    got = {r.u: (r.n_programs, r.n_copybooks, r.n_jcl_jobs, r.n_other_files, r.total_files, r.health) for r in inventory.inventory(files, "u").collect()}
    assert got == {"a": (1, 1, 0, 3, 5, 60), "b": (0, 0, 1, 0, 1, 60)}
    assert inventory.inventory(files.limit(0), "u").count() == 0


def test_repaired_jobs(spark):
    jobs = rows(spark, "job_id string, status string, error string, warning string", ("a", "error", "x", None), ("b", "error", "y", None), ("c", "done", None, "w"), (None, "error", "z", None), ("d", None, None, None))
    got = {r.job_id: tuple(r)[1:] for r in inventory.repaired(jobs, rows(spark, "job_id string", ("a",), ("a",), ("c",), (None,))).collect()}
    assert got == {"a": ("done", None, inventory.REPAIRED), "c": ("done", None, "w"), "d": (None, None, None)}


def test_placeholder(spark):
    some = rows(spark, "dsn string, n int", ("A", 1))
    assert [tuple(r) for r in inventory.or_placeholder(some, F.lit("X"), F.lit(0)).collect()] == [("A", 1)]
    assert [tuple(r) for r in inventory.or_placeholder(some.limit(0), F.lit("X"), F.lit(0)).collect()] == [("X", 0)]


def test_decisions_and_operations(spark):
    events = rows(spark, "stage string, status string, severity string", ("OCCURS", None, None), (None, "REVIEW_REQUIRED", None), (None, None, "ERROR"), ("DDL", "SUCCESS", "INFO"), (None, None, None))
    assert [r[0] for r in events.select(inventory.is_decision("stage", "status", "severity")).collect()] == [True, True, True, False, False]
    ops = rows(spark, "ops array<string>", (["Rewrite", "READ FILE", None],), ([],), (None,))
    assert {r.name: r.value for r in inventory.operation_counts(ops, "ops").collect()} == {"READ": 1, "WRITE": 1, "REWRITE": 1, "DELETE": 0}
    assert {r.value for r in inventory.operation_counts(ops.limit(0), "ops").collect()} == {0}


def test_edges_and_datasets(spark):
    schema = "path string, source_line int, evidence_type string, entity_name string, value string, properties map<string,string>"
    found = rows(
        spark, schema, ("src/p1.cbl", 1, "SELECT", "F", "DD1", {}), ("src/p1.cbl", 9, "SELECT", "F", "DD1", {}), ("j.jcl", 2, "DD", "IN", "A.B", {"dataset": "A.B"}), ("j.jcl", 3, "DD", "X", None, {}), ("z.ams", 1, "DEFINE_CLUSTER", "A.B", "true", {"organization": "ESDS"}),
        ("a.ams", 1, "DEFINE_CLUSTER", "A.B", "true", {"organization": "KSDS"}), ("b.ams", 1, "DEFINE_CLUSTER", "C", "true", {}), ("x", 1, "OTHER", "E", "v", {}))
    edges = sorted(tuple(r) for r in inventory.remote_edges(found).collect())
    assert edges == [("J_A.B_ALLOCATES", "File", "J", "Dataset", "A.B", "ALLOCATES"), ("P1_DD1_ACCESSES", "Program", "P1", "Dataset", "DD1", "ACCESSES")]
    got = {r.dataset: (r.organization, r.first_by) for r in inventory.dataset_rows(found, rows(spark, "dataset string", ("A.B",), ("Z",), (None,))).collect()}
    assert got == {"A.B": ("KSDS", "DEFINE_CLUSTER"), "C": ("UNKNOWN", "DEFINE_CLUSTER"), "Z": ("UNKNOWN", "CANDIDATE")}


def test_lookup_cascade(spark):
    schema = "group string, place int, key string, id string, name string, source_file string"
    artifacts = rows(spark, schema, ("datasets", 1, "ACCT", None, None, None), ("programs", 2, "acct", None, None, "src/Main.cbl"), ("programs", 1, "P.old", "i", "n", ""), (None, 0, "P", None, None, None))
    asked = ("ACCT", "Acct", "acct", "main", "MAIN.CBL", "p.new", "N", "none", None, "ACCT")
    got = [(r.artifact_id, r.group, r.key) for r in inventory.looked_up(rows(spark, "artifact_id string", *[(x,) for x in asked]), artifacts).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [
        ("ACCT", "datasets", "ACCT"), ("ACCT", "datasets", "ACCT"), ("Acct", "programs", "acct"), ("acct", "programs", "acct"), ("main", "programs", "acct"), ("MAIN.CBL", "programs", "acct"),
        ("p.new", "programs", "P.old"), ("N", "programs", "P.old"), ("none", None, None), (None, None, None),
    ]))
