"""Every operator on awkward tables, against brute force, round trips or held-out accuracy."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from granary.llm import backoff_lm, chunks, decontaminate, entropy_mix, gru_langid, license_scan, quality_rules, queries, repair_tokens, rindex_dedup, simhash_dedup, warc_store
from granary.llm.common import scratch_path

from .conftest import DOCS, words_of

LOWER = {i: i + 32 for i in range(65, 91)}


def test_empty_tables(spark, make):
    none = spark.createDataFrame([], DOCS)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert quality_rules.ledger(none).count() == 0
    assert license_scan.scan(none).count() == 0
    assert decontaminate.overlaps(none, bench).count() == 0
    assert simhash_dedup.near_duplicates(none).count() == 0
    assert entropy_mix.mix(none).count() == 0
    assert backoff_lm.score(none, F.lit(False)).count() == 0
    assert gru_langid.identify(none, F.lit(True)).count() == 0
    assert repair_tokens.round_trip(none).count() == 0
    assert rindex_dedup.mark(none).count() == 0
    assert warc_store.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---------------------------------------------------------------- 10

def plain_rules(text):
    w = words_of(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(make, odd):
    texts = [*odd, " ".join("a b c d".split() * 400), "x# y* z| " * 30, "\n".join(f"w{i % 40} v{i % 40} u{i % 40} t" for i in range(400))]
    rows = {r.doc_id: r for r in quality_rules.ledger(make(texts)).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_rules(t)


def test_policies(make, odd, spark):
    docs = make(odd).withColumn("n_words", F.lit("clash")).withColumn("fail_bits", F.lit(1))
    kept = quality_rules.apply_policy(docs)
    assert kept.columns == docs.columns
    entries = quality_rules.ledger(docs)
    assert kept.count() == entries.where(quality_rules.kept_by(quality_rules.STRICT)).count()
    found = {(r.policy, r.version, r.rule): r for r in quality_rules.ablations(entries).collect()}
    total = entries.count()
    few = found[("prose", 1, "too_few_words")]
    assert few.n_kept_without - few.n_kept == few.n_removed_alone and few.n_failing <= total


# ---------------------------------------------------------------- 4

def plain_print(text):
    w = words_of((text or "").translate(LOWER))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    prints = sorted(root)
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if bin(a ^ b).count("1") <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in prints}


def test_simhash(make, odd):
    rows = {r.doc_id: r for r in simhash_dedup.near_duplicates(make(odd)).collect()}
    prints = [plain_print(t) for t in odd]
    assert [rows[i].fp & (2**64 - 1) for i in range(len(odd))] == prints
    roots = plain_components(prints)
    first = {}
    for i, p in enumerate(prints):
        first.setdefault(roots[p], i)
    assert [rows[i].component_id for i in range(len(odd))] == [first[roots[p]] for p in prints]
    kept = sorted(r.doc_id for r in simhash_dedup.keep_first(make(odd)).collect())
    assert kept == sorted(first.values())


@pytest.mark.parametrize("crowd", [2, 32])
def test_links_are_exact(spark, crowd):
    r = np.random.default_rng(4)
    base = r.integers(0, 2**63, 6, dtype=np.int64).tolist()
    prints = set(base)
    for b in base:
        for _ in range(25):
            x = b
            for _ in range(int(r.integers(1, 5))):
                x ^= 1 << int(r.integers(0, 63))
            prints.add(x)
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    got = simhash_dedup.components(simhash_dedup.links(df, crowd=crowd)).collect()
    roots = plain_components(prints)
    groups = Counter(roots.values())
    assert {(x.node, x.root) for x in got if x.node != x.root} == {(p, q) for p, q in roots.items() if p != q and groups[q] > 1}


def similar_by_hand(texts):
    """Smallest index reachable by pairs of five-word Jaccard coefficient 0.8 or more."""
    sets = [set(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else {tuple(w)} if w else set() for w in (words_of((t or "").translate(LOWER)) for t in texts)]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both >= 0.8 * (len(a) + len(sets[j]) - both):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


@pytest.mark.parametrize("crowd", [2, 32])
def test_similar_texts(make, odd, crowd, monkeypatch):
    import random

    monkeypatch.setattr(simhash_dedup, "CROWD", crowd)
    monkeypatch.setattr(simhash_dedup.similar_pairs, "__defaults__", (simhash_dedup.WORDS, simhash_dedup.LEAST_SIMILARITY, crowd))
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7)))
    texts = list(odd)
    for _ in range(12):
        base = [word() for _ in range(r.randint(60, 400))]
        for edits in (0, 1, 2, len(base) // 60, len(base) // 20):
            copy = list(base)
            for k in r.sample(range(len(copy)), min(edits, len(copy) // 60 + 1)):
                copy[k] = word()
            texts.append(" ".join(copy))
    docs = make(texts).withColumn("kind", F.lit("clash"))
    got = {x.doc_id: x.component_id for x in simhash_dedup.similar_groups(docs).collect()}
    want = similar_by_hand(texts)
    caught = [got[i] == want[i] for i in range(len(texts)) if want[i] != i]
    assert sum(caught) >= 0.9 * len(caught) and all(got[i] in (want[i], i) or want[got[i]] == want[i] for i in got)
    kept = simhash_dedup.keep_similar(docs)
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == sorted(i for i in got if got[i] == i)


def test_similar_texts_of_odd_tables(spark):
    text = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(None, text, 1), (7, text, 2), (7, "other words of the same id", 3), (3, text + " more", 4), (3, None, 5), (4, "", 6)], "doc_id long, text string, row long")
    kept = simhash_dedup.keep_similar(df)
    assert sorted(x.row for x in kept.collect()) == [1, 3, 4, 5]
    assert simhash_dedup.keep_similar(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 2

def test_decontamination(spark, make):
    r = np.random.default_rng(2)
    word = lambda: "".join(r.choice(list("abcdefgh"), int(r.integers(2, 8))))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [text(40) for _ in range(8)] + ["", None]
    swapped = items[1].split()
    swapped[8], swapped[20], swapped[33] = "zz", "yy", "xx"
    docs = [text(200), text(50) + " " + items[0] + ". " + text(30), text(30) + "\n" + " ".join(swapped) + " " + text(9), " ".join(items[2].split()[:20]) + " " + text(20), " ".join(items[3].split()[:7]) + " " + text(50), None, "", items[4].upper()]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for small in (10**6, 0):
        got = {(x.doc_id, x.item_id): x for x in decontaminate.overlaps(make(docs), bench, small=small).collect()}
        assert set(got) == {(1, 0), (2, 1), (3, 2), (7, 4)}
        assert (got[(2, 1)].n_tokens, got[(2, 1)].n_equal, got[(2, 1)].first_token) == (40, 37, 30)
    kept = decontaminate.clean(make(docs).withColumn("item_id", F.lit(0)), bench)
    assert sorted(x.doc_id for x in kept.collect()) == [0, 4, 5, 6] and "item_id" in kept.columns


def test_short_items_null_and_repeated_ids(spark):
    r = np.random.default_rng(3)
    made = lambda n: [f"w{x}" for x in r.integers(0, 10**6, n)]
    items, rows = [], []
    for n in (1, 3, 5, 7, 9, 10, 12, 13, 15, 20):
        item = made(n)
        items.append(" ".join(item))
        copy = list(item)
        for k in r.choice(np.arange(1, max(2, n - 1)), n // 5, replace=False):
            copy[int(k)] = "other"
        rows.append((len(rows), " ".join(made(20) + copy + made(20))))
    hit = rows[-1][1]
    rows += [(None, hit), (50, hit), (50, "clean text of the same id"), (50, "more " * 3), (None, "clean too")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {(i, i) for i in range(len(items))} | {(None, len(items) - 1), (50, len(items) - 1)}
    found = [sorted(map(str, decontaminate.overlaps(docs, bench, small=small).collect())) for small in (10**6, 0)]
    assert found[0] == found[1]
    assert {(x.doc_id, x.item_id) for x in decontaminate.overlaps(docs, bench).collect()} == want
    assert sorted((x.doc_id or -1, x.text) for x in decontaminate.clean(docs, bench).collect()) == [(-1, "clean too"), (50, "clean text of the same id"), (50, "more " * 3)]


# ---------------------------------------------------------------- 3

def test_warc(spark, tmp_path):
    big, small = "<p>ü</p>" * 300, "<p>tiny</p>"
    pages = [(1, "http://a/\n1", big), (2, "http://a/2", big), (3, None, small), (4, "http://a/4", small), (5, "http://a/5", None), (9, "http://a/9", "WARC/1.1\r\n\r\n" * 200), (7, "http://b", big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("sha256", F.lit("clash"))
    archive = warc_store.store(df, f"file://{tmp_path}/a")
    assert archive.payloads.count() == 4
    rows = {r.page_id: r for r in warc_store.read_back(archive).collect()}
    for i, _, html in pages:
        raw = (html or "").encode()
        assert (rows[i].payload_bytes, rows[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert {i: (r.record_type, r.refers_to) for i, r in rows.items()} == {1: ("revisit", 7), 2: ("revisit", 7), 7: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), 9: ("response", None)}
    whole = {r.page_id: bytes(r.payload) for r in warc_store.reconstruct(archive).collect()}
    assert whole == {i: (h or "").encode() for i, _, h in pages}
    warc_store.export(archive, f"file://{tmp_path}/files")
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "files").glob("*.txt")))
    found = {}
    while data:  # a plain reader of the format
        head, _, rest = data.partition(b"\r\n\r\n")
        n = int(re.search(rb"^Content-Length: (\d+)", head, re.M)[1])
        found[int(re.search(rb"<urn:page:(\d+)>", head)[1])] = rest[:n].partition(b"\r\n\r\n")[2]
        assert rest[n : n + 4] == b"\r\n\r\n"
        data = rest[n + 4 :]
    assert found[7] == big.encode() and found[1] == b"" and found[9] == pages[5][2].encode() and len(found) == 7
    again = warc_store.import_files(spark, f"file://{tmp_path}/files/*.txt", f"file://{tmp_path}/again")
    for part in ("records", "payloads"):
        assert Counter(map(tuple, getattr(again, part).collect())) == Counter(map(tuple, getattr(archive, part).collect()))
    assert Counter(warc_store.read_back(again).collect()) == Counter(rows.values())


def test_damaged_archive(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>" * 300), (2, "v", "<p>b</p>")], "page_id long, url string, html string")
    archive = warc_store.store(pages, f"file://{tmp_path}/a")
    lost = warc_store.Archive(archive.records, archive.payloads.limit(1))
    with pytest.raises(Exception, match="record without its payload"):
        warc_store.read_back(lost).collect()


def test_warc_repeated_and_null_ids(spark, tmp_path):
    big, other, third, small = "<p>H</p>" * 300, "<p>K</p>" * 300, "<p>L</p>" * 300, "<p>s</p>"
    pages = [(5, "u", big), (5, "u", big), (4, "r", big), (None, "n", other), (None, "m", other), (None, "o", big), (None, "p", third), (8, "v", third), (5, "w", other), (6, "x", small), (6, "x", small), (None, "y", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    archive = warc_store.store(df, f"file://{tmp_path}/a")
    assert archive.payloads.count() == archive.payloads.select("sha256").distinct().count() == len({h or "" for _, _, h in pages})
    whole = Counter((r.page_id, bytes(r.payload).decode()) for r in warc_store.reconstruct(archive).collect())
    assert whole == Counter((i, h or "") for i, _, h in pages)
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    want = con.execute(queries.OP3_SQL)
    columns = [c[0] for c in want.description]
    assert Counter(tuple(r[c] for c in columns) for r in warc_store.read_back(archive).collect()) == Counter(want.fetchall())


# ---------------------------------------------------------------- 5

def test_scores(spark, make, odd):
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7) == 2
    texts = odd * 3
    rows = {r.doc_id: r for r in backoff_lm.score(make(texts), held).collect()}
    tok = [words_of((t or "").translate(LOWER)) + [None] for t in texts]
    learned = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))]
    one, two = Counter(), Counter()
    for w, ok in zip(tok, learned, strict=True):
        if ok:
            one.update(w)
            two.update(zip(["<s>", *w], w, strict=False))
    n, v, starts, mu = sum(one.values()), len(one), sum(learned), backoff_lm.MU
    for i, w in enumerate(tok):
        p1 = [(one[x] + 1) / (n + v + 1) for x in w]
        score, before = 0.0, "<s>"
        for x, p in zip(w, p1, strict=True):
            c = starts if before == "<s>" else one[before]
            score += math.log10((two[(before, x)] + mu * p) / (c + mu)) if c else math.log10(p)
            before = x
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(one[x] > 0 for x in w), n, not learned[i])
        assert math.isclose(r.base_score, sum(map(math.log10, p1)), rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)


# ---------------------------------------------------------------- 6

def plain_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        if not free:
            return {s: 3.0 * sizes[s] for s in names}
        level = (total - sum(3 * sizes[s] for s in full)) / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else w[s] * level for s in names}
        full |= over


def test_mix(spark):
    r = np.random.default_rng(8)
    texts, sources = [], []
    for s, n in (("b", 300), ("a", 40), (None, 3), ("é", 5), ("z", 500), ("B", 60)):
        for _ in range(n):
            texts.append(" ".join(["w"] * int(r.integers(0, 60))))
            sources.append(s)
    df = spark.createDataFrame([(i, t or None, s) for i, (t, s) in enumerate(zip(texts, sources, strict=True))], "doc_id long, text string, source string").withColumn("size", F.lit(3))
    rows = entropy_mix.mix(df).collect()
    again = entropy_mix.mix(df).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == len(texts)
    sizes, taken = Counter(), Counter()
    for x in rows:
        sizes[x.source] += x.size
        taken[x.source] += x.taken
        assert x.size == len(words_of(texts[x.doc_id])) and x.taken <= 3 * x.size
    want = plain_targets(sizes)
    for x in rows:
        assert math.isclose(x.target, want[x.source], rel_tol=1e-9) and x.source_size == sizes[x.source]
    assert all(abs(taken[s] - want[s]) <= 70 for s in sizes)
    copies = entropy_mix.apply_mix(df).groupBy("doc_id").count().collect()
    assert {c.doc_id: c["count"] for c in copies} == {x.doc_id: x.copies for x in rows if x.copies}


def test_mix_of_repeated_ids(spark):
    rows = [(i % 3 if i % 2 else None, "w " * (1 + i % 4), "ab"[i % 2], f"n{i}") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, place string").repartition(4)
    found = entropy_mix.mix(df).collect()
    out = entropy_mix.apply_mix(df)
    assert out.columns == df.columns and len(found) == 90
    taken = Counter(r.place for r in out.collect())
    assert sum(taken.values()) == sum(r.copies for r in found) and max(taken.values()) <= 3
    size = {r[3]: len(words_of(r[1])) for r in rows}
    assert sum(size[p] * n for p, n in taken.items()) == sum(r.taken for r in found)


def test_rates_are_tilts(spark):
    """log(rate) is a source's exponent times the size, unless cut off: the form of least relative entropy."""
    r = np.random.default_rng(9)
    df = spark.createDataFrame([(i, "w " * int(r.integers(1, 80)), "abc"[i % 5 % 3]) for i in range(400)], "doc_id long, text string, source string")
    tilt = {}
    for x in entropy_mix.mix(df).collect():
        if x.size and x.rate < 3 - 1e-9:
            t = tilt.setdefault(x.source, math.log(x.rate) / x.size)
            assert math.isclose(math.log(x.rate), t * x.size, rel_tol=1e-6, abs_tol=1e-9)
    assert tilt


def test_mix_that_does_not_settle(spark, monkeypatch):
    monkeypatch.setattr(entropy_mix, "MOST_STEPS", 1)
    df = spark.createDataFrame([(i, "w " * (i % 9 + 1), "ab"[i % 3 % 2]) for i in range(50)], "doc_id long, text string, source string")
    with pytest.raises(RuntimeError, match="did not settle"):
        entropy_mix.mix(df).count()


# ---------------------------------------------------------------- 7

def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.coalesce((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4) == 2, F.lit(False))
    more = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "12 34 !?", "en", "s", 0), (10**6 + 2, "", None, "s", 0)], DOCS)
    rows = gru_langid.identify(docs.unionByName(more), ~held).join(docs.select("doc_id", "lang", held.alias("held")), "doc_id", "left").collect()
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id >= 10**6)
    own = [r for r in rows if r.held]
    assert sum(r.lang == r.lang_pred for r in own) >= 0.97 * len(own)
    assert all(0 <= r.score <= 1 for r in rows)
    assert gru_langid.identify(docs.limit(3), F.lit(False)).select("lang_pred").distinct().collect()[0][0] == "und"


def test_language_samples_whole_texts(spark, make):
    header = "shared header of every text " * 40
    texts = [header + f"{'abc' if i % 2 else 'xyz'} " * 3000 for i in range(40)]
    rows = gru_langid.sample(make(texts, langs=["ab" if i % 2 else "xy" for i in range(40)]), F.lit(True)).collect()
    seen = [np.frombuffer(bytes(r.windows), np.int16).reshape(-1, gru_langid.WINDOW + 2 * gru_langid.MARGIN) for r in rows]
    assert len(rows) == 40 and all(len(w) == gru_langid.WINDOWS_PER_ROW for w in seen)
    body = [any(ord("b" if r.lang == "ab" else "y") in x and ord("h") not in x for x in w) for r, w in zip(rows, seen, strict=True)]
    assert all(body)
    many = make(["some words"] * 230, langs=[f"l{i}" for i in range(230)])
    assert gru_langid.sample(many, F.lit(True)).select("lang").distinct().count() == 230


# ---------------------------------------------------------------- 8

def test_tokens(spark, make, odd):
    """Against the tokenizer library as it comes, added tokens included."""
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [*odd, "a  b   c", "x \n y\n z", " lead trail ", "<|endoftext|> it's 12.5%", "a <|endoftext|> b c d", "naïve café straße", "hi there<|endoftext|>"]
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = [np.array([*tk.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in texts]
    rows = sorted(repair_tokens.round_trip(make(texts).withColumn("shard", F.lit("clash"))).collect(), key=lambda r: r.doc_id)
    at = 0
    for r, ids in zip(rows, own, strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    path = scratch_path(spark, "test")
    repair_tokens.write(make(texts), path, shard_ids=50, range_bytes=5000)
    assert repair_tokens.read(spark, path).count() > 5 and repair_tokens.read(spark, path).select("shard").distinct().count() > 2
    many = sorted(repair_tokens.documents(spark, path).collect(), key=lambda r: r.doc_id)
    assert [tuple(r) for r in many] == [tuple(r) for r in rows]
    for i in (4, 7, len(texts) - 2):
        assert repair_tokens.fetch(spark, path, i).collect() == [(i, own[i].tolist())]


def test_tokens_of_repeated_ids(spark):
    rows = [(1, f"text {n % 7}") for n in range(60)] + [(None, "none"), (None, "other"), (2, "two"), (0, None)]
    got = sorted(repair_tokens.round_trip(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 0] + [1] * 60 + [2]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False)) and got[0].start == 0


# ---------------------------------------------------------------- 9

@pytest.mark.parametrize(("hot", "block"), [(10**6, 1 << 19), (3, 777)])
def test_repeats(spark, odd, monkeypatch, hot, block):
    """Against plain search, with negative, repeated and null ids, a clashing column, hot minimizers and small blocks."""
    import random

    r = random.Random(1)
    base = ["".join(r.choice("ab cdeé\n") for _ in range(r.randint(30, 400))) for _ in range(12)]
    texts = odd + ["".join(r.choice(base)[r.randint(0, 20) :][: r.randint(20, 300)] for _ in range(r.randint(0, 4))) for _ in range(80)]
    ids = [None if i % 17 == 3 else i // 2 - 20 for i in range(len(texts))]
    rows = [(i, n, (t or "").encode()) for n, (i, t) in enumerate(zip(ids, texts, strict=True))]
    rank = lambda i: math.inf if i is None else i
    first = {}
    for i, _, t in rows:
        for p in range(len(t) - 49):
            first[t[p : p + 50]] = min(first.get(t[p : p + 50], math.inf), rank(i))
    pack = chunks.pack
    monkeypatch.setattr(rindex_dedup, "pack", lambda d: pack(d, chunk_bytes=5000))
    monkeypatch.setattr(rindex_dedup, "BLOCK", block)
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(zip(ids, texts, strict=True))], "doc_id long, text string, bucket long").repartition(3)
    got = Counter(tuple(x)[:5] for x in rindex_dedup.mark(docs, hot).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    want = Counter()
    for i, _, t in rows:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < rank(i):
                gone[p : p + 50] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        want[i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    assert got == want


# ---------------------------------------------------------------- shared

def test_null_ids(spark):
    text = "some words that are repeated here and there until fifty bytes are full of them"
    df = spark.createDataFrame([(None, text, None, None, None), (2, text, "en", "s", 1), (2, text, "en", "s", 1)], DOCS)
    got = sorted((r.doc_id or -1, r.n_removed) for r in rindex_dedup.mark(df).collect())
    assert got == [(-1, len(text)), (2, 0), (2, 0)]
    assert sorted(r.component_id for r in simhash_dedup.near_duplicates(df).collect()) == [2, 2, 2]
    assert simhash_dedup.keep_first(df).count() == 3
    assert backoff_lm.score(df, F.lit(None).cast("boolean")).where("doc_id IS NULL AND NOT held_out").count() == 1
    assert repair_tokens.round_trip(df).where("doc_id IS NULL AND start = 0").count() == 1
    assert entropy_mix.mix(df).count() == 3
    assert quality_rules.ledger(df).count() == 3 and license_scan.scan(df).count() == 3


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    import os

    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(repr([r[c] for c in columns]) for r in got.collect()) == sorted(repr(list(r)) for r in want.fetchall())
