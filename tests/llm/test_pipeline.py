"""The pipeline against a plain version of its stages on the smallest table."""

import zlib
from collections import Counter

import corpus_pipeline
from granary.llm import entropy_mix

from .conftest import DOCS
from .test_operators import plain_rules, similar_by_hand

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = corpus_pipeline.written(stage(spark, left, SF), "test")
        assert left.columns == docs.columns, name
        seen.append({r.doc_id: r.text for r in left.collect()})
    good, distinct, clean, mixed = seen
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i, t in texts.items():
        n, _, symbols, _, again = plain_rules(t)
        if n < 50 or 100 * again > 50 * n or 10 * symbols > n:
            assert i not in good
    ids = sorted(good)
    roots = similar_by_hand([good[i] for i in ids])
    want = {i for n, i in enumerate(ids) if roots[n] == n}
    assert want <= set(distinct) and len(set(distinct) - want) <= 0.1 * (len(ids) - len(want))
    for i, t in distinct.items():
        if any(b[:80] in t or b[-80:] in t for b in bench if len(b) > 120):
            assert i not in clean
    assert set(mixed) <= set(clean)
    copies = Counter(r.doc_id for r in left.collect())
    assert max(copies.values()) <= 3
    out = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in out) == copies
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert entropy_mix.MAX_RATE == 3 and zlib.crc32(b"") == 0


def test_stages_on_odd_tables(spark):
    """Nulls in every column, repeated ids and rows, empty and long texts, extra columns, and no rows at all."""
    prose = lambda k: " ".join(f"word{k}{chr(97 + i % 26)}{i * 7 % 97} the" for i in range(60))
    rows = [(1, prose(1), None, "a", 5), (1, prose(2), "en", None, None), (None, prose(3), "en", "a", 3), (None, None, None, None, None), (2, "", "en", "b", 0), (3, prose(1), "en", "b", 1), (4, prose(4) * 300, "de", "b", 2), (4, prose(5), "de", "b", 2), (4, prose(5), "de", "b", 2)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' AS kind", "1 AS size", "2L AS row", "'y' AS bucket_no")
    for table in (docs, docs.limit(0)):
        left = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            left = corpus_pipeline.written(stage(spark, left, SF), "odd")
            assert left.columns == docs.columns, name
            assert {r.doc_id for r in left.collect()} <= {1, 2, 3, 4, None}, name
        out = corpus_pipeline.STAGES[-1][1](spark, left, SF)
        assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == left.count()
