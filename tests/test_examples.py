"""Small stated sources with their expected structure: layouts, overlays, schemas, programs and jobs."""

from pyspark.sql import functions as F

from granary.operators import evidence, layout, program, relational, resolve, schema

LAYOUT = (
    "01 CUSTOMER.", " 05 CUSTOMER-ID PIC X(10).", " 05 BIRTHDATE PIC X(10).", " 05 BIRTH-PARTS REDEFINES BIRTHDATE.", "  10 B-M PIC 99.", "  10 FILLER PIC X.",
    "  10 B-D PIC 99.", "  10 FILLER PIC X.", "  10 B-Y PIC 9(4).", " 05 FLAG PIC X.", "  88 ACTIVE VALUE 'A'.", " 05 PHONE PIC X(10) OCCURS 3 TIMES.", " 05 BALANCE PIC S9(10)V99 COMP-3.",
    " 05 LINES OCCURS 2 TIMES.", "  10 LINE-NO PIC 9(4) COMP.", "  10 LINE-TEXT PIC X(20).", "77 COUNTER PIC 9(5).",
)
JOB = (
    "//TESTJOB JOB CLASS=A", "//JOBLIB DD DSN=A,DISP=SHR", "//       DD DSN=B,DISP=SHR", "//* a comment", "//STEP1 EXEC PGM=AAA", "//STEPLIB DD DSN=C,DISP=SHR", "//        DD DSN=D,", "//        DISP=(NEW,CATLG)", "//SYSPRINT DD SYSOUT=*",
    "//STEP2 EXEC PROC=MYPROC", "//IN DD *", "data", "//OUT DD DUMMY", "//TMP DD DSN=&&WORK,DISP=OLD",
)


def lines(spark, path, rows):
    return spark.createDataFrame([(path, i, s) for i, s in enumerate(rows, 1)], "path string, line_no int, text string")


def test_layout(spark):
    nodes = layout.layout(lines(spark, "CUSTOMER.cpy", LAYOUT))
    found = nodes.where("NOT is_filler AND node_type <> 'CONDITION'").select("name", "absolute_offset", "byte_length", "span_max").collect()
    assert {tuple(r) for r in found} == {
        ("CUSTOMER", 0, 102, 102), ("CUSTOMER-ID", 0, 10, 10), ("BIRTHDATE", 10, 10, 10), ("BIRTH-PARTS", 10, 10, 10), ("B-M", 10, 2, 2), ("B-D", 13, 2, 2), ("B-Y", 16, 4, 4),
        ("FLAG", 20, 1, 1), ("PHONE", 21, 10, 30), ("BALANCE", 51, 7, 7), ("LINES", 58, 22, 44), ("LINE-NO", 58, 2, 2), ("LINE-TEXT", 60, 20, 20), ("COUNTER", 102, 5, 5),
    }
    over = resolve.overlays(nodes).select("strategy", "confidence").collect()
    assert [tuple(r) for r in over] == [("ALTERNATE_REPRESENTATION", "HIGH")]
    fields = nodes.where("level = 5 AND NOT is_filler").select(F.lit("A").alias("dataset"), "name", "absolute_offset", "byte_length")
    keys = spark.createDataFrame([("A", 0, 10), ("A", 10, 10), ("A", 20, 9), ("A", 500, 1)], "dataset string, key_offset int, key_length int")
    matched = relational.match_keys(fields, keys).select("key_offset", "status", "column_name").collect()
    assert {tuple(r) for r in matched} == {(0, "PRIMARY_KEY", "CUSTOMER-ID"), (10, "AMBIGUOUS", None), (20, "UNRESOLVED_LENGTH_MISMATCH", None), (500, "UNRESOLVED", None)}


def test_schema_of_layout(spark):
    columns = schema.generate(layout.layout(lines(spark, "CUSTOMER.cpy", LAYOUT))).columns.select("table_name", "column_name", "sql_type").collect()
    assert {tuple(r)[1:] for r in columns if r.table_name == "CUSTOMER"} == {
        ("RECORD_ID", "BIGSERIAL"), ("CUSTOMER_ID", "VARCHAR(10)"), ("BIRTHDATE", "VARCHAR(10)"), ("B_M", "SMALLINT"), ("B_D", "SMALLINT"), ("B_Y", "SMALLINT"), ("FLAG", "VARCHAR(1)"), ("PHONE", "VARCHAR(10)[]"), ("BALANCE", "NUMERIC(12,2)"), ("COUNTER", "INTEGER"),
    }
    assert {tuple(r)[1:] for r in columns if r.table_name == "CUSTOMER_CUSTOMER_LINES"} == {("PARENT_RECORD_ID", "BIGINT"), ("OCCURRENCE_INDEX", "INTEGER"), ("LINE_NO", "SMALLINT"), ("LINE_TEXT", "VARCHAR(20)")}


def test_job(spark):
    p = F.col("properties")
    found = evidence.data_definitions(lines(spark, "JOB.jcl", JOB)).select("source_line", "entity_name", "value", p["step_name"], p["position"].cast("int")).collect()
    assert {tuple(r) for r in found} == {
        (2, "JOBLIB", "A", None, 0), (3, "JOBLIB", "B", None, 1), (6, "STEPLIB", "C", "STEP1", 0), (7, "STEPLIB", "D", "STEP1", 1), (9, "SYSPRINT", "*", "STEP1", 0),
        (11, "IN", "INSTREAM", "STEP2", 0), (13, "OUT", "DUMMY", "STEP2", 0), (14, "TMP", "&&WORK", "STEP2", 0),
    }


def test_owner_without_section(spark):
    rows = lines(spark, "A.cbl", ("       DATA DIVISION.", "       FD  IN-FILE.", "           COPY LAY.", "       PROCEDURE DIVISION.", "           MOVE 1 TO X."))
    assert [tuple(r) for r in program.owned(program.markers(rows)).orderBy("line_no").select("kind", "name", "owner").collect()] == [("division", "DATA", None), ("fd", "IN-FILE", "FILE"), ("copy", "LAY", "IN-FILE"), ("division", "PROCEDURE", None), ("operation", "MOVE", "PROCEDURE")]
