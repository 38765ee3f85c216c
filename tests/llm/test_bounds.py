"""Bounds that hold whatever ids rows have."""

from collections import Counter

from pyspark.sql import functions as F

from granary.llm import gru_langid, repair_tokens, simhash_dedup

from .conftest import DOCS


def test_sample_is_bounded_by_rows(spark):
    """One id on many rows, no id at all, equal rows: never more than the bound, and every language has its rows."""
    rows = [(7, f"one id text {i}", "en", "s", 1) for i in range(500)] + [(None, f"kein Name {i}", "de", "s", 1) for i in range(300)]
    rows += [(8, "encore une fois", "fr", "s", 1)] * 200 + [(9, "solo", "es", "s", 1), (None, None, "it", "s", 1), (10, "...", "it", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = Counter(r.lang for r in gru_langid.sample(docs, F.lit(True), 10).collect())
    assert got == {"en": 10, "de": 10, "fr": 10, "es": 1}


def test_sample_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i % 40 if i % 3 else None, f"text {i % 60} abc", "en" if i % 2 else "de", "s", 1) for i in range(400)], DOCS)
    one, two = (sorted(map(repr, gru_langid.sample(d, F.lit(True), 15).collect())) for d in (docs.repartition(1), docs.repartition(7)))
    assert one == two and len(one) == 30


def test_a_language_of_rows_without_an_id_is_learned(spark):
    rows = [(None, f"aaa bab aab {i}", "de", "s", 1) for i in range(30)] + [(i, f"xyz zzy xxz {i}", "en", "s", 1) for i in range(30)]
    found = gru_langid.identify(spark.createDataFrame(rows, DOCS), F.lit(True))
    assert {r.lang_pred for r in found.select("lang_pred").distinct().collect()} == {"de", "en"}


def test_no_table_of_all_shards_is_broadcast(spark, make, tmp_path):
    repair_tokens.write(make(["a b c", "d e", None, "f"] * 10), f"{tmp_path}/c", shard_ids=5, range_bytes=40)
    plan = repair_tokens.read(spark, f"{tmp_path}/c")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("strategy=broadcast") == 1 and plan.count() > 4


def test_similar_pairs_do_not_depend_on_other_texts(spark):
    import random

    r = random.Random(5)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    row = lambda kind, bits: (kind, *[signed(bits >> 64 * k & (1 << 64) - 1) for k in range(simhash_dedup.WORDS)])
    pairs = []
    for i in range(200):
        one = r.getrandbits(512)
        pairs += [row(2 * i, one), row(2 * i + 1, one ^ sum(1 << b for b in r.sample(range(512), 80)))]
    schema = "kind long, " + ", ".join(f"w{k} long" for k in range(simhash_dedup.WORDS))
    found = []
    for rows, crowd in ((pairs, 32), (pairs, 2), (pairs + [row(1000 + i, r.getrandbits(512)) for i in range(20_000)], 32)):
        links = simhash_dedup.similar_pairs(spark.createDataFrame(rows, schema), lambda pairs: pairs, crowd=crowd)
        found.append({(x.a, x.b) for x in links.collect()})
    assert found[0] == found[1] == found[2] and len(found[0]) > 100


def test_similar_groups_do_not_depend_on_the_crowd(spark, monkeypatch):
    # texts that drift: neighbours are similar, those further apart are not, so members of a key follow different leaders
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[: i * 8] + [f"v{j}" for j in range(i * 8, i * 8 + 8)] + words[i * 8 + 8 :]) for i in range(20)]
    drift = [" ".join([f"x{j}" for j in range(i * 6)] + words[i * 6 :]) for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts + drift)), "doc_id long, text string")
    got = []
    for crowd in (1, 2, 1_000_000):
        monkeypatch.setattr(simhash_dedup.similar_pairs, "__defaults__", (simhash_dedup.WORDS, simhash_dedup.LEAST_SIMILARITY, crowd))
        got.append({x.doc_id: x.component_id for x in simhash_dedup.similar_groups(docs).collect()})
    assert got[0] == got[1] == got[2] and len(set(got[0].values())) == 1


def test_unrelated_texts_share_no_key_of_similar_texts(spark, monkeypatch):
    import random

    r = random.Random(11)
    texts = [" ".join(r.choices([f"w{i}" for i in range(3000)], k=60)) for _ in range(1500)]
    rows = {}

    def counted(df, label):
        out = written(df, label)
        rows[label] = max(rows.get(label, 0), out.count())
        return out

    written = simhash_dedup.written
    monkeypatch.setattr(simhash_dedup, "written", counted)
    docs = spark.createDataFrame(list(enumerate(texts + [texts[0] + " more"])), "doc_id long, text string")
    found = {x.doc_id: x.component_id for x in simhash_dedup.similar_groups(docs).collect()}
    assert found.pop(1500) == 0 and all(i == c for i, c in found.items())
    assert rows["similar-kinds"] == 1501 and rows["similar-keys"] <= 2 * 144 and rows["similar-pairs"] == 1


def test_pairs_at_the_least_similarity_share_a_key():
    import numpy as np

    r = np.random.default_rng(2)
    shared = 0
    for _ in range(300):  # 160 of 180 hashes each: a coefficient of 0.8
        x = r.integers(0, 2**63, 200, dtype=np.int64).astype(np.uint64) * np.uint64(2)
        one, two = simhash_dedup.keys_of(np.stack([simhash_dedup.minima(x[:180]), simhash_dedup.minima(x[20:])]))
        shared += bool((one == two).any())
    assert shared >= 270
