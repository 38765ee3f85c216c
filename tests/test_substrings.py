"""Substring joins against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from granary.operators import catalogs, dialects, substrings

TEXTS = "place long, text string, file string"


def joined(spark, texts, needles, scope=()):
    t = spark.createDataFrame(texts, TEXTS)
    n = spark.createDataFrame(needles, "needle string, file string")
    return sorted((r.place, r.needle) for r in substrings.substring_join(t, "text", n, "needle", scope).collect())


def all_pairs(texts, needles, scope=False):
    found = {(p, n) for p, t, f in texts for n, g in needles if t is not None and n and n in t and (not scope or f == g)}
    return sorted(found)


def test_against_all_pairs(spark):
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abé-") for _ in range(n))
    texts = [(i, word(r.randint(0, 12)), f"f{i % 3}") for i in range(300)] + [(300, None, "f1"), (301, "", "f1"), (302, "abab" * 50, "f2")]
    needles = [(word(r.randint(0, 6)), f"f{i % 3}") for i in range(80)] + [(None, "f1"), ("", "f0"), ("abab", "f2"), ("abab", "f2"), ("zzz", "f1"), ("abz", "f0")]
    assert joined(spark, texts, needles) == all_pairs(texts, needles)
    assert joined(spark, texts, needles, ("file",)) == all_pairs(texts, needles, True)


def test_beyond_what_is_broadcast(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SMALL", 0)
    texts = [(i, f"line {i} of PART-{i % 7}", "f") for i in range(60)]
    needles = [(f"PART-{i}", "f") for i in range(9)] + [("e 1", "f"), ("f", "f")]
    assert joined(spark, texts, needles) == all_pairs(texts, needles)


def test_words(spark, monkeypatch):
    texts = [(1, "MOVE A-B TO C", "f"), (2, "MOVE XA-B", "f"), (3, "A-BC", "g"), (4, "(A-B)", "g"), (5, None, "f"), (6, "#K# -- A", "f")]
    t, n = spark.createDataFrame(texts, TEXTS), spark.createDataFrame([("A-B",), ("TO",), ("--",), ("",), (None,), ("K",), ("GONE",)], "needle string")
    want = [(1, "A-B"), (1, "TO"), (4, "A-B"), (6, "K")]
    assert sorted((r.place, r.needle) for r in substrings.word_join(t, "text", n, "needle").collect()) == want
    monkeypatch.setattr(substrings, "SMALL", 0)
    assert sorted((r.place, r.needle) for r in substrings.word_join(t, "text", n, "needle").collect()) == want


def test_terms_dealt_to_parts(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SMALL", 5)
    monkeypatch.setattr(substrings, "PER_PART", 10)
    texts = [(i, f"MOVE A{i} TO B", "f") for i in range(200)]
    needles = [("MOVE", "f"), ("OVE", "f"), *((f"A{i}", "f") for i in range(20))]
    assert joined(spark, texts, needles) == all_pairs(texts, needles)


def test_one_gram_in_all_texts(spark):
    texts = [(i, "MOVE A TO B", "f") for i in range(5000)]
    assert joined(spark, texts, [("MOVE", "f"), ("MOVED", "f")]) == [(i, "MOVE") for i in range(5000)]


@pytest.mark.parametrize(("texts", "needles"), [([], [("a", "f")]), ([(1, "a", "f")], []), ([(1, "a", "f")], [("", "f"), (None, "f")]), ([], [])])
def test_nothing_to_join(spark, texts, needles):
    assert joined(spark, texts, needles) == []


def test_field_evidence(spark):
    lines = spark.createDataFrame([("A.cpy", 1, "01 ACCOUNT."), ("A.cpy", 2, "  05 ACCOUNT-ID PIC X(10)."), ("A.cpy", 3, "  05 phone PIC X OCCURS 3."), ("B.cpy", 1, "05 ACCOUNT-IDS.")], "path string, line_no int, text string")
    fields = [("A.cpy", "ACCOUNT-ID"), ("A.cpy", "PHONE"), ("A.cpy", "PHONE"), ("A.cpy", "GONE"), ("B.cpy", "ACCOUNT-ID"), (None, "X"), ("A.cpy", None)]
    known = [("A.cpy", "PHONE", "e2", 9), ("A.cpy", "PHONE", "e1", 7), ("A.cpy", "ACCOUNT-ID", "e3", None)]
    got = substrings.field_evidence(spark.createDataFrame(fields, "path string, name string"), spark.createDataFrame(known, "path string, entity_name string, evidence_id string, source_line int"), lines)
    assert sorted((repr(r.path), repr(r.name), r.evidence_ids, r.source_line, r.source_end_line) for r in got.collect()) == [
        ("'A.cpy'", "'ACCOUNT-ID'", ["e3"], 2, 2), ("'A.cpy'", "'GONE'", [], None, None), ("'A.cpy'", "'PHONE'", ["e1", "e2"], 7, 9),
        ("'A.cpy'", "'PHONE'", ["e1", "e2"], 7, 9), ("'A.cpy'", "None", [], None, None), ("'B.cpy'", "'ACCOUNT-ID'", [], None, None), ("None", "'X'", [], None, None),
    ]


def test_datasets_like(spark):
    targets = spark.createDataFrame([("acct",), ("acct",), ("none",), (None,), ("",)], "target string")
    candidates = spark.createDataFrame([("PROD.ACCT.VSAM",), ("prod.acct.vsam",), ("PROD.CUST",), (None,)], "dsn string")
    got = sorted(tuple(r) for r in substrings.datasets_like(targets, candidates).collect())
    assert got == [("acct", "PROD.ACCT.VSAM"), ("acct", "prod.acct.vsam"), ("none", "NONE")]


def test_locate_copybooks(spark):
    one = "SELECT ACCT-FILE ASSIGN TO ACCTFILE.\n SELECT OTHER ASSIGN TO XX.\nFD  ACCT-FILE.\n COPY CVACT01Y.\nFD OTHER.\n COPY OTHER1."
    programs = [("b.cbl", one), ("a.cbl", "select x assign to ACCT-MASTER\nfd y.\n copy z."), ("c.cbl", "no files"), ("d.cbl", None)]
    datasets = spark.createDataFrame([("AWS.CARDDEMO.ACCTDATA.VSAM",), ("PROD.XX",), ("PROD.NONE",), (None,)], "dsn string")
    books = spark.createDataFrame([("cpy/cvact01y.cpy",), ("cpy/OLD-CVACT01Y.cpy",), (None,)], "path string")
    got = substrings.locate_copybooks(datasets, spark.createDataFrame(programs, "path string, content string"), books, ("AWS", "VSAM", "PROD")).collect()
    # the first SELECT stands for its program, whatever file the qualifier belongs to
    assert sorted(tuple(r) for r in got) == [("AWS.CARDDEMO.ACCTDATA.VSAM", "b.cbl", "CVACT01Y", "cpy/OLD-CVACT01Y.cpy"), ("PROD.XX", "b.cbl", "CVACT01Y", "cpy/OLD-CVACT01Y.cpy")]


def test_uses_dataset_by_parts_and_boundaries(spark):
    programs = [
        ("word", "P", "move k#1 to x"), ("inside", "P", "move ak#12"), ("name", "MYACCTS", ""), ("copy", "P", "COPY LAY-OLD."), ("longer", "P", "COPY LAYER."),
        ("assign", "P", "ASSIGN TO ORDFILE"), ("null", None, None),
    ]
    datasets = [("X.K#1", "NOT_FOUND"), ("X.ACCT", "NOT_FOUND"), ("X.Z9", "cpy/LAY.cpy"), ("X.ORDDATA", "NOT_FOUND")]
    got = dialects.uses_dataset(spark.createDataFrame(programs, "path string, name string, content string"), spark.createDataFrame(datasets, "dsn string, copybook string"), ("X",))
    assert sorted(tuple(r) for r in got.collect()) == [("assign", "X.ORDDATA"), ("copy", "X.Z9"), ("name", "X.ACCT"), ("word", "X.K#1")]


def test_cells_that_contain_a_name(spark):
    rows = spark.createDataFrame([("a", 1, {"NAME": "x prod.acct2", "LRECL": "80"}), ("a", 0, {"NAME": None, "LRECL": "9"}), ("b", 1, {"NAME": "PROD.ACCT"})], "path string, row_no int, cells map<string,string>")
    datasets = spark.createDataFrame([("PROD.ACCT",), ("PROD.ACCT",), ("D.ACC",), (None,)], "dsn string")
    got = {r.dsn: (r.path, r.row_no, r.record_length) for r in catalogs.listing_facts(rows, datasets).collect()}
    assert got == {"PROD.ACCT": ("a", 1, 80), "D.ACC": ("a", 1, 80)}
    assert catalogs.listing_facts(rows, datasets, whole=True).select(F.col("path")).first().path == "b"
