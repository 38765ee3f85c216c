"""Merkle manifest, exact duplicates and importance resampling against brute force, on awkward tables."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import exact_dedup, importance_resampling, merkle_manifest, queries

from .conftest import DOCS

SF = "/root/testdata/sf0.001"
BLANK = re.compile(r"[\x20\x09-\x0d]")


@pytest.fixture(scope="module")
def rows(odd):
    """The odd texts, ids that repeat or are missing, null fields, repeated rows."""
    out = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(odd)]
    out += [(None, "no id", None, None, None), (None, "no id", None, None, None), (3, "word", None, None, 4), (3, "word", None, None, 4), (3, "wo rd", "de", "s1", 5), (50, "é  ü\n\n", "de", "", 6), (51, "line\nend\n", "", "ü", 9)]
    return out + [(100 + i, f"t{i % 17}  x\n" * (i % 4), "en", "many" if i % 3 else None, i) for i in range(400)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names the operators use themselves."""
    shuffled = random.Random(3).sample(rows, len(rows))
    clash = [("tree", "a"), ("idx", 1), ("keep_id", 7), ("block", 2), ("score", 0.5), ("shared", True), ("digest", "x")]
    return spark.createDataFrame(shuffled, DOCS).repartition(5).select("*", *[F.lit(v).alias(k) for k, v in clash])


def same_as_sql(got, sql, tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame.select([c for c in frame.columns if c in ("doc_id", "item_id", "text", "lang", "source", "n_chars")]).toArrow())
    want = con.execute(sql)
    columns = [x[0] for x in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(repr([r[c] for c in columns]) for r in got.collect()) == sorted(repr(list(r)) for r in want.fetchall())


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_exact_dedup", "op13_importance_resampling"])
def test_same_as_sql_on_the_tables(spark, name):
    tables = {f[:-8]: spark.read.parquet(f"{SF}/{f}") for f in os.listdir(SF) if f[:-8] in ("documents", "benchmark")}
    same_as_sql(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], tables)


def test_no_rows(spark):
    none, bench = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert merkle_manifest.verify(none).count() == 0
    assert exact_dedup.duplicates(none).count() == 0
    assert importance_resampling.resample(none, bench).count() == 0


# ---------------------------------------------------------------- manifest

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """Its top, and for each leaf the siblings left and right of it, level by level."""
    sides, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        runs = [level[i : i + 3] for i in range(0, len(level), 3)]
        for k, i in enumerate(at):
            run = runs[i // 3]
            sides[k].append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
            at[k] = i // 3
        level = [h(*run) for run in runs]
    return level[0], sides


def plain_manifest(rows):
    state = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: h(*(state(x) for x in (r[0], r[3], r[2], r[4], text)))
    trees = defaultdict(list)
    for r in rows:
        strikes = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
        trees[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, r[1].replace("\n", "")) if strikes else leaf(r, r[1])))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    tops = {s: plain_tree([x[2] for x in sorted(trees[s])]) for s in order}
    root, above = plain_tree([tops[s][0] for s in order])
    out = []
    for s, over in zip(order, above, strict=True):
        for (has_id, doc_id, own, now), sides in zip(sorted(trees[s]), tops[s][1], strict=True):
            steps = sides + over
            for left, right in steps:
                now = h(left, now, right)
            out.append((doc_id if has_id else None, own, tops[s][0], root, h(*(x for y in steps for x in y)), now, now == root))
    return sorted(map(repr, out))


def test_manifest(docs, rows):
    got = merkle_manifest.verify(docs).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain_manifest(rows)
    assert {r.verified for r in got} == {True, False}


def test_manifest_sql_on_odd_tables(docs):
    same_as_sql(merkle_manifest.verify(docs), queries.OP11_SQL, {"documents": docs})


def test_manifest_of_trees_of_many_blocks(spark):
    """Trees of one leaf, of a block but one, of a block, of a block and one, of three blocks and some: a hot source."""
    n = merkle_manifest.BLOCK
    sizes = {"a": 1, "b": n - 1, "c": n, "d": n + 1, None: 3 * n + 5, "e": 3, "f": 2}
    made = [(k * 100_000 + i, f"x\n{i}" if i % 5 else None, "en", s, i) for k, (s, size) in enumerate(sizes.items()) for i in range(size)]
    got = merkle_manifest.verify(spark.createDataFrame(made, DOCS).repartition(7)).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain_manifest(made)


def test_store_has_a_level_a_folder(spark, docs, tmp_path):
    found = merkle_manifest.build(docs, f"file://{tmp_path}")
    kept = os.listdir(tmp_path / "documents" / "nodes" / "top=false")
    assert "level=1" in kept and "level=0" not in kept
    assert found.sources.tops().count() == 1


# ---------------------------------------------------------------- exact duplicates

def plain_groups(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[BLANK.sub("", r[1] or "")].append(r)
    out = []
    for bare, same in groups.items():
        best = min(same, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        out += [(r[0], best[0], len(same), hashlib.sha256(bare.encode()).hexdigest()) for r in same]
    return sorted(map(repr, out)), len(groups)


@pytest.mark.parametrize(("chunk_bytes", "per_bucket", "print_bits"), [(16_000_000, 1_000_000, 64), (500, 40, 64), (300, 10, 14), (200, 400, 10)])
def test_duplicates(docs, rows, chunk_bytes, per_bucket, print_bits):
    """Also with many chunks and buckets, and with prints so short that different texts share them."""
    got = exact_dedup.duplicates(docs, chunk_bytes, per_bucket, print_bits).collect()
    want, n_groups = plain_groups(rows)
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == n_groups and all(r.doc_id == r.keep_id for r in kept)


def test_duplicates_sql_on_odd_tables(docs):
    got = exact_dedup.duplicates(docs).where("doc_id <> 3 OR doc_id IS NULL")  # which of equal rows stays is free
    sql = f"SELECT * FROM ({queries.OP12_SQL}) WHERE doc_id <> 3 OR doc_id IS NULL"
    drop = "kept"
    same_as_sql(got.drop(drop), f"SELECT * EXCLUDE ({drop}) FROM ({sql})", {"documents": docs})


@pytest.mark.parametrize("head", [0, 3])
@pytest.mark.parametrize("n", [0, 1, 2, 500, 5000])
def test_filter_gives_back_its_fingerprints(n, head):
    r = np.random.default_rng(n + head)
    keys = np.unique(r.integers(0, 1 << 64, n, dtype=np.uint64) >> np.uint64(head))
    if n > 2:  # a crowd in one quotient, whose run pushes the next ones on
        keys = np.unique(np.concatenate([keys, np.arange(1, 300, dtype=np.uint64) + (keys[-1] >> np.uint64(1))]))
    counts = r.integers(1, 1000, len(keys)).astype(np.uint64)
    bits = 5 if head else 0
    keys |= np.uint64(bits) << np.uint64(64 - head) if head else np.uint64(0)
    found = exact_dedup.QuotientFilter.from_bytes(exact_dedup.QuotientFilter.build(keys, counts, head).to_bytes())
    assert np.array_equal(found.keys(bits), keys) and np.array_equal(found.counts, counts)


def test_filters_add_up():
    r = np.random.default_rng(1)
    parts = [np.unique(r.integers(0, 3000, 1000, dtype=np.uint64), return_counts=True) for _ in range(5)]
    keys, counts = exact_dedup.merge(parts)
    want = Counter()
    for k, c in parts:
        want.update(dict(zip(k.tolist(), c.tolist(), strict=True)))
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == want


# ---------------------------------------------------------------- importance resampling

def plain_features(text):
    lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return [zlib.crc32(x.encode()) % 10000 for x in [*w, *map(" ".join, zip(w, w[1:], strict=False))]], len(w)


def plain_resampling(rows, bench):
    of = [plain_features(r[1]) for r in rows]
    s, t = Counter(b for x, _ in of for b in x), Counter(b for x in bench for b in plain_features(x)[0])
    n_s, n_t = sum(s.values()), sum(t.values())
    out = []
    for (doc_id, *_), (found, n_words) in zip(rows, of, strict=True):
        gains = [math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000)))) for b in found]
        weight = sum(gains) // len(gains) if gains else 0
        x = int(hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((x + 0.5) / 2**32))), n_words])
    fit = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(fit[: 25 * len(fit) // 100])}
    return sorted(repr((*r[:4], ranks.get(id(r)))) for r in out)


def test_resampling(spark, docs, rows):
    r = random.Random(8)
    bench = [None, "", "word word", *(" ".join(r.choice(["line", "one", "here", "Éa", "x9"]) for _ in range(30)) for _ in range(20))]
    more = [(1000 + i, " ".join(r.choice(["line", "One", "b", "here", "éa", "q-r"]) for _ in range(i)), "en", "s", 1) for i in range(120)]
    every = [*rows, *more, more[50], more[50]]
    table = spark.createDataFrame(bench, "string").toDF("text").withColumn("item_id", F.lit(1).cast("long"))
    both = docs.unionByName(spark.createDataFrame([*more, more[50], more[50]], DOCS), allowMissingColumns=True)
    got = importance_resampling.resample(both, table)
    assert sorted(repr(tuple(x)) for x in got.collect()) == plain_resampling(every, bench)
    same_as_sql(got, queries.OP13_SQL, {"documents": both, "benchmark": table})


def test_weights_do_not_depend_on_blocks(spark, docs):
    bench = spark.createDataFrame([(1, "word line one")], "item_id long, text string")
    small = importance_resampling.weights(docs, bench, block_features=300, blocks_a_part=2)
    large = importance_resampling.weights(docs, bench)
    columns = ["doc_id", "n_features", "n_words", "weight"]
    assert sorted(map(repr, small.select(columns).collect())) == sorted(map(repr, large.select(columns).collect()))


def test_no_target(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert importance_resampling.resample(docs, none).where("rank IS NOT NULL").count() > 0
