"""DDL that is read back and validated, and plug-in extractors, on odd input."""

from hashlib import sha256

from granary.operators import ddl, plugins

ACCOUNT = 'CREATE TABLE "account" (\n    "record_id" BIGSERIAL NOT NULL,\n    "bal" NUMERIC(12,2),\n    "n" NUMERIC(20, 0),\n    "tags" VARCHAR(5)[],\n    PRIMARY KEY ("record_id", "bal"),\n    FOREIGN KEY ("bal") REFERENCES "other" ("id")\n);\nCREATE TABLE "empty" (\n    -- no automatically mappable columns, none\n);'
TABLES, KEYS = "id string, table_name string", "id string, table_name string, column_name string, target_table string, target_column string"
COLUMNS = "id string, table_name string, column_name string, sql_type string, key_position int"


def test_text_becomes_a_catalog(spark):
    found = ddl.read(spark.createDataFrame([("a", ACCOUNT), ("b", "DROP TABLE x;"), ("c", None), ("d", "")], "id string, ddl string"))
    assert sorted(tuple(r) for r in found.tables.collect()) == [("a", "account"), ("a", "empty")]
    got = [tuple(r)[2:] for r in found.columns.orderBy("position").collect()]
    assert got == [(1, "record_id", "bigint", "int8", 64, 0, False), (2, "bal", "numeric", "numeric", 12, 2, True), (3, "n", "numeric", "numeric", 20, 0, True), (4, "tags", "ARRAY", "_varchar", None, None, True)]
    assert [tuple(r) for r in found.primary_keys.collect()] == [("a", "account", ["record_id", "bal"])]
    assert [tuple(r) for r in found.foreign_keys.collect()] == [("a", "account", "bal", "other", "id")]


def test_states_of_validation(spark):
    digest = sha256(ACCOUNT.encode()).hexdigest()
    rows = [("ok", "GENERATED", ACCOUNT, digest), ("failed", "FAILED", "", None), ("empty", "GENERATED", "", digest), ("null", None, None, None), ("altered", "GENERATED", ACCOUNT, "not-the-hash"), ("review", "REVIEW_REQUIRED", ACCOUNT, digest), ("more", "GENERATED", ACCOUNT, digest)]
    ids = [r[0] for r in rows]
    tables = spark.createDataFrame([(i, t) for i in ids for t in ("ACCOUNT", "EMPTY", *(["GONE"] if i == "more" else []))], TABLES)
    columns = spark.createDataFrame([(i, "ACCOUNT", *c) for i in ids for c in (("RECORD-ID", "BIGSERIAL", 1), ("BAL", "NUMERIC(12,2)", 2), ("N", "NUMERIC(20, 0)", None), ("TAGS", "VARCHAR(5)[]", None))], COLUMNS)
    keys = spark.createDataFrame([(i, "ACCOUNT", "BAL", "OTHER", "ID") for i in ids], KEYS)
    got = {r.id: (r.validation_status, r.failed) for r in ddl.validated(spark.createDataFrame(rows, "id string, status string, ddl string, ddl_hash string"), tables, columns, keys).collect()}
    assert got == {
        "ok": ("VALIDATED", []), "failed": ("NOT_EXECUTED_GENERATION_FAILED", None), "empty": ("FAILED_VALIDATION", None), "null": ("FAILED_VALIDATION", None),
        "altered": ("FAILED_VALIDATION", None), "review": ("REVIEW_REQUIRED_VALIDATED_SAFE_SUBSET", []), "more": ("FAILED_VALIDATION", ["tables"]),
    }


class Longest:
    def start(self, path):
        self.best = (0, "")

    def line(self, line_no, text):
        self.best = max(self.best, (len(text), text))
        if not text:
            yield line_no, "EMPTY", None, None

    def end(self):
        yield None, "LONGEST", self.best[1], str(self.best[0])


def test_plugins_see_one_file_after_the_other(spark):
    rows = [("a", 2, "xyz"), ("a", 1, "x"), ("b", 1, None), ("b", 2, "longer"), ("b", 3, "z"), (None, 1, "q")]
    lines = spark.createDataFrame(rows, "path string, line_no int, text string").repartition(4)
    got = sorted((repr(r.path), r.source_line or 0, r.evidence_type, r.entity_name) for r in plugins.evidence_of(lines, Longest).collect())
    assert got == [("'a'", 0, "LONGEST", "xyz"), ("'b'", 0, "LONGEST", "longer"), ("'b'", 1, "EMPTY", None), ("None", 0, "LONGEST", "q")]
    assert plugins.evidence_of(lines.limit(0), Longest).count() == 0
