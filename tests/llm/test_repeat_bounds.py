"""The work of op9's tasks stays small whatever the number of texts."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd
import zstandard

from granary.llm import rindex_dedup
from granary.llm.chunks import Chunk, bucket_of, squeezed


def chunk_of(texts):
    ids, lengths, data = np.arange(len(texts)), np.array([len(t) for t in texts]), b"".join(texts)
    return Chunk(SimpleNamespace(chunk_id=0, doc_ids=ids.tobytes(), flags=bytes(len(texts)), lengths=lengths.tobytes(), n_bytes=len(data), data=zstandard.compress(data)))


def some_texts(n, size, seed=1):
    r = np.random.default_rng(seed)
    return [r.integers(97, 123, size).astype(np.uint8).tobytes() for _ in range(n)]


def test_minimizers_are_spread_evenly():
    keys, _, _ = rindex_dedup.Anchored(chunk_of(some_texts(40, 10_000))).minimizers()
    found = np.bincount(bucket_of(keys, 64).astype(np.int64), minlength=64)
    assert len(keys) > 20_000 and found.max() < 1.5 * found.mean()


def test_a_chunk_needs_little_memory():
    """Every text is there twice, so all its strings are sent and all of the second is cut."""
    texts = some_texts(2000, 1000) * 2
    chunk = chunk_of(texts)
    keys, _, _ = rindex_dedup.Anchored(chunk).minimizers()
    got = pd.DataFrame({"bucket": [0], "answer": [squeezed(np.ones(len(keys), np.uint8))]})
    tracemalloc.start()
    try:
        own = rindex_dedup.Shared(chunk, got)
        shared = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        out = rindex_dedup._cut(chunk, own, np.zeros(int(own.sent_count.sum()), bool))
        cut = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # without the index's marks, stretches that a block's end has cut in one copy only are not found
    assert not out["n_removed"][:2000].any() and out["n_removed"][2000:].sum() > 0.99 * 2_000_000
    assert max(shared, cut) < 12 * len(chunk.data)


def test_many_surroundings_of_one_minimizer(monkeypatch):
    r = np.random.default_rng(2)
    texts = [t[:40] + b"in the middle of it all" + t[40:] for t in some_texts(150, 57)]
    texts += [texts[i][: r.integers(60, 80)] + b"x" * (80 - 60) for i in range(60)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    counts, owners = np.array([len(t) - 49 for t in texts]), r.integers(0, 50, len(texts))
    want = rindex_dedup.repeated(data, counts, owners)
    sizes, plain = [], rindex_dedup.repeated
    monkeypatch.setattr(rindex_dedup, "repeated", lambda data, *x: sizes.append(len(data)) or plain(data, *x))
    monkeypatch.setattr(rindex_dedup, "INDEX_BYTES", 2000)
    monkeypatch.setattr(rindex_dedup, "MOST_INDEX_BYTES", 8000)
    got = rindex_dedup.repeated_in_parts(data, counts, owners, np.zeros(len(texts), np.uint8))
    assert got.tolist() == want.tolist() and 0 < want.sum() < len(want)
    assert len(sizes) > 10 and max(sizes) < 8000


def test_chunks_and_buckets_stay_small(spark, make, monkeypatch):
    texts = [t.decode() for t in some_texts(30, 900)]
    docs = make(texts + [t[100:700] + u[:200] for t, u in zip(texts, texts[5:], strict=False)])
    mark = lambda: sorted(tuple(x) for x in rindex_dedup.mark(docs).drop("spans").collect())
    want = mark()
    monkeypatch.setattr(rindex_dedup, "MOST_CHUNK_BYTES", 3000)
    monkeypatch.setattr(rindex_dedup, "BUCKET_BYTES", 5000)
    sizes, plain = spark.sparkContext.accumulator(0), rindex_dedup.repeated_in_parts
    assert rindex_dedup.pack(docs).agg({"n_bytes": "max"}).first()[0] <= 3000

    def told(data, *x):
        sizes.add(1)
        return plain(data, *x)

    monkeypatch.setattr(rindex_dedup, "repeated_in_parts", told)
    assert mark() == want and sum(x[2] for x in want) > 10_000
    assert sizes.value > 20
