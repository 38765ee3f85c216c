"""Edge cases of dialects, hierarchies and catalogs on small stated sources."""

from pyspark.sql import functions as F

from granary.functions import picture
from granary.operators import catalogs, dialects, evidence, hierarchy


def lines(spark, path, *rows):
    return spark.createDataFrame([(path, i, s) for i, s in enumerate(rows, 1)], "path string, line_no int, text string")


def test_lengths(spark):
    rows = spark.createDataFrame([(None,), ("",), ("GROUP",), ("x(9)",), ("S9(4) COMP",), ("S9(9)V99 PACKED-DECIMAL",), ("AAA",), ("$$$",)], "p string")
    got = [tuple(r) for r in rows.select(picture.older_storage("p"), picture.older_length("p"), picture.symbol_length("p")).collect()]
    # the last column takes a picture without usage; letters of the usage count there
    assert [r[:2] for r in got] == [(0, 0), (0, 0), (0, 0), (9, 9), (2, 2), (6, 6), (3, 3), (0, 0)]
    assert [got[i][2] for i in (0, 1, 3, 6, 7)] == [None, None, 9, 3, None]


def test_types_of_missing_values(spark):
    rows = spark.createDataFrame([(None, None, None), ("X", "text", None), ("NUMERIC(5,2)", "numeric", None)], "t string, d string, p int")
    got = rows.select(picture.flat_type("t"), picture.catalog_type_matches("t", "d", "d", "p", "p")).collect()
    assert [tuple(r) for r in got] == [("TEXT", False), ("TEXT", False), ("TEXT", False)]


def test_slices(spark):
    source = lines(spark, "a", "ADD 1.", "READ F", "AT END", "MOVE 1.", "", "* READ G.", "ADD 2.", "READ H.", "ADD 3.", "READ I")
    kept = dialects.slices(source, F.col("text").contains("READ")).orderBy("line_no").select("part", "line_no").collect()
    # a relevant line never ends a slice, an open end is left out, blank and comment lines do not count
    assert [tuple(r) for r in kept] == [(1, 2), (1, 3), (1, 4), (3, 8), (3, 9)]
    assert dialects.slices(source.limit(0), F.col("text").contains("READ")).isEmpty()


def test_users_of_datasets(spark):
    programs = spark.createDataFrame([("a", "ACCTUPD", ""), ("b", "X", " SELECT F ASSIGN TO CARDFILE."), ("c", "Y", "copy\n layout1."), ("d", "Z", "MOVE CARD-X"), ("e", "W", None), ("f", None, "MOVE ACCT")], "path string, name string, content string")
    datasets = spark.createDataFrame([("VSAM.ACCT", "NOT_FOUND"), ("P.CARDDATA", "cpy/LAYOUT1.cpy"), ("VSAM.KSDS", None)], "dsn string, copybook string")
    got = {tuple(r) for r in dialects.uses_dataset(programs, datasets).collect()}
    assert got >= {("a", "VSAM.ACCT"), ("b", "P.CARDDATA"), ("c", "P.CARDDATA"), ("f", "VSAM.ACCT")}
    assert not {x for x in got if x[0] in "de" or x[1] == "VSAM.KSDS"}


def test_job_without_owner_of_a_concatenation(spark):
    job = lines(spark, "J", "//J JOB A", "//S1 EXEC PGM=P1", "//A DD DSN=X", "//  DD DSN=Y", "//A DD DSN=Z", "//  DD DSN=W", "//S1 EXEC PGM=P2")
    row = hierarchy.jobs(evidence.extract("jcl", job)).first()
    (step,) = row.steps
    assert row.job_level_dds == [] and step.name == "S1" and [x.program for x in step.exec] == ["P1", "P2"]
    assert [(d.dataset, [c.dataset for c in d.concatenations]) for d in step.dds] == [("X", ["Y"]), ("Z", ["W"])]
    rows = spark.createDataFrame([("J", 3, "DD", "Dataset", "A", "X", {"scope": "step", "step_name": "S", "is_concatenation": "true"})], "path string, source_line int, evidence_type string, entity_type string, entity_name string, value string, properties map<string,string>")
    row = hierarchy.jobs(rows).first()
    assert [(s.name, [(d.dataset, d.concatenations) for d in s.dds]) for s in row.steps] == [("S", [("X", [])])]


def test_fragments(spark):
    got = hierarchy.fragments(lines(spark, "a.cpy", "END-IF.", "ELSE.", "* MOVE 1 TO B.", "NOTHING")).collect()
    assert got == []
    got = hierarchy.fragments(lines(spark, "a.cpy", "MOVE 1 TO A..").unionByName(lines(spark, "b.cpy", "01 A PIC X.", "MOVE B TO C."))).where("source_line > 0").collect()
    assert [(r.path, r.name, r.paragraph) for r in got] == [("a.cpy", "MOVE 1 TO A", None)]


def test_groups(spark):
    canonical = spark.createDataFrame([("A", "Cobol"), ("B", "unheard"), ("C", None)], "artifact_id string, artifact_type string")
    older = spark.createDataFrame([("A", "programs"), ("A", "datasets"), ("B", "programs")], "artifact_id string, group string")
    got = {(r.artifact_id, r.group, r.artifact_type) for r in hierarchy.grouped(canonical, older).collect()}
    assert got == {("A", "programs", "Cobol"), ("A", "datasets", None), ("B", "programs", None)}


def test_json_catalogs(spark):
    files = spark.createDataFrame([("a", '{"dsn": "A.B", "organization": "KSDS", "entry_type": "AIX"}'), ("b", "no json"), ("c", ""), ("d", None), ("e", "[]"), ("f", '[{"dsn": "", "organization": "KSDS"}]')], "path string, content string")
    (row,) = catalogs.json_entries(files).collect()
    assert (row.path, row.entity_name, row.value, row.properties) == ("a", "A.B", "AIX", {"dsn": "A.B", "organization": "KSDS", "entry_type": "AIX"})


def test_listing_facts(spark):
    cells = [{"NAME": "A.B", "LRECL": "none", "RECORD LENGTH": "80"}, {"NAME": "A.B", "LRECL": "90"}, {"NAME": None, "LRECL": None}]
    rows = spark.createDataFrame([("l", i, c) for i, c in enumerate(cells)], "path string, row_no int, cells map<string,string>")
    wanted = spark.createDataFrame([("A.B",), ("A.B",), ("C.D",)], "dsn string")
    (row,) = catalogs.listing_facts(rows, wanted).collect()
    assert (row.dsn, row.row_no, row.record_length, row.key_length, row.organization) == ("A.B", 0, 80, None, "UNKNOWN")


def test_differences_take_sets(spark):
    one = spark.createDataFrame([("a",), ("a",), (None,)], "name string")
    two = spark.createDataFrame([("b",), (None,)], "name string")
    assert {tuple(r) for r in catalogs.differences(one, two).collect()} == {("a", "MISSING"), ("b", "UNEXPECTED")}


def test_preflight_broadcasts_nothing_that_grows(spark):
    from granary.operators import relational

    columns = spark.createDataFrame([("A", 1, "X", "INT", True, 1), ("A", 2, "x", None, True, None)], "table_name string, position int, column_name string, sql_type string, nullable boolean, key_position int")
    keys = spark.createDataFrame([("A", "Y", "A", "X"), ("A", "X", "B", "X"), ("A", "X", "A", "x")], "table_name string, column_name string, target_table string, target_column string")
    found = relational.preflight(spark.createDataFrame([("A", None), ("a", None)], "table_name string, parent_table string"), columns, keys)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.issue for r in found.collect()) == ["duplicate column", "duplicate table", "foreign key column missing", "foreign key target missing", "missing type"]
