"""What a task reads does not grow with the input, and nothing is read more often than needed: by the plans."""

from pyspark.sql import functions as F

from granary.operators import catalogs, dialects, evidence, graph, program


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_dealt_by_counted_numbers(spark, monkeypatch):
    lines = spark.createDataFrame([("a", 1, "//S EXEC PGM=X"), ("a", 2, "//D DD DSN=Y"), ("b", 1, "//* no")], "path string, line_no int, text string")
    for found in (evidence.data_definitions(lines), evidence.logical_lines(lines), program.markers(lines)):
        assert "REPARTITION_BY_NUM" in plan(found)
    monkeypatch.setattr(dialects, "CHARACTERS_A_TASK", 10)
    files = spark.createDataFrame([("a", "x" * 35), ("b", None)], "path string, content string")
    found = dialects.relevant_source(files, F.col("text").contains("READ"))
    assert ", 4), REPARTITION_BY_NUM" in plan(found) and {r.path: r.source for r in found.collect()} == {"a": "x" * 35, "b": None}


def test_statements_are_read_once_for_both_kinds_of_edges(spark):
    rows = spark.createDataFrame([("j", "DD", "D", "Y", {"dataset": "Y"}), ("j", "DD", "E", "*", {"dataset": "DUMMY"})], "artifact_id string, evidence_type string, entity_name string, value string, properties map<string,string>")
    found = graph.from_evidence(rows)
    assert sorted(tuple(r) for r in found.collect()) == [("j", "Y", "ALLOCATES"), ("j", "Y", "ALLOCATES_DATASET")]
    assert found._jdf.queryExecution().analyzed().toString().count("LogicalRDD") == 3


def test_digits_of_a_cell_are_read_once(spark):
    rows = spark.createDataFrame([("p", 1, {"Dsn": "A.B", "max lrecl": "80 bytes", "Rec-Total": "1,200", "ci": "none"})], "path string, row_no long, cells map<string,string>")
    found = catalogs.listing_facts(rows, spark.createDataFrame([("A.B",)], "dsn string"), whole=True)
    r = found.first()
    assert (r.record_length, r.records, r.control_interval, r.key_length) == (80, 1200, None, None)
    assert found._jdf.queryExecution().analyzed().toString().count("regexp_replace") <= 2
