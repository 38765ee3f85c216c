"""Resampling by importance: documents whose features a target corpus prefers are drawn more often.

Features are single words and pairs of neighbours, hashed into N_BUCKETS buckets.  The corpus becomes an inverted index
that is partitioned by bucket: a task packs blocks of documents into postings (bucket, document, count), sorted, one row
for each of RANGES ranges of buckets.  A range then meets the totals of both corpora for its buckets (they are co-grouped
by range and part, totals first), computes the gain of each bucket on the spot, and sends what its postings add to each
document; contributions are added up by block of documents.  So no task needs all buckets or all documents, the work of
a frequent bucket is split over parts, and the exchange has RANGES rows for each block.

The draw is a race: each document gets its weight plus Gumbel noise from a hash of its id, and the highest scores win.
Places are found from sorted runs, so no task sees all documents.

Defined results: a null or empty text has no features and weighs 0; a null id hashes as `null` and loses ties; repeated
rows are drawn one by one and get ranks of their own; other columns are ignored; an empty target prefers rare buckets; an
empty table gives an empty one.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import placed, written

N_BUCKETS = 10_000
RANGES = 16
#: Features in a block of documents; a single longer document is a block of its own.
BLOCK_FEATURES = 1_000_000
#: Blocks that one part of a range is meant for.
BLOCKS_A_PART = 64
SEED, PERCENT, LEAST_WORDS = 7, 25, 20

#: Other bytes than digits, small letters and those of characters beyond ASCII part words; capitals become small.
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_POSTINGS = "block long, range int, docs binary, totals binary, gaps binary, counts binary"
_ARROW = pa.schema([("block", pa.int64()), ("range", pa.int32()), ("docs", pa.binary()), ("totals", pa.binary()), ("gaps", pa.binary()), ("counts", pa.binary())])
#: The row of a block that names its documents stands in this range.
HEADS = -1


def features(text: bytes, n_buckets: int = N_BUCKETS) -> tuple[list[int], int]:
    """Bucket of every feature of a text, and the number of its words."""
    words = text.translate(_FOLDED).split(b" ")
    words = [w for w in words if w]
    crc32 = zlib.crc32
    single = [crc32(w) for w in words]
    pairs = [crc32(b" " + w, c) for w, c in zip(words[1:], single, strict=False)]  # the checksum of a pair goes on from its first word's
    return [c % n_buckets for c in single] + [c % n_buckets for c in pairs], len(words)


def _squeezed(values: np.ndarray) -> bytes:
    """Small numbers by planes of their bytes."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _restored(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def bounds(n_buckets: int) -> list[int]:
    """Where the ranges of buckets begin; one more, the end."""
    return [n_buckets * k // RANGES for k in range(RANGES + 1)]


def _block_rows(number: int, ids: list, sizes: list[int], words: list[int], found: list[list[int]], n_buckets: int) -> list[dict]:
    n = len(ids)
    buckets = np.concatenate([np.array(x, np.uint64) for x in found])
    owner = np.repeat(np.arange(n, dtype=np.uint64), sizes)
    keys, counts = np.unique(buckets * np.uint64(n) + owner, return_counts=True)
    at = (keys // np.uint64(n)).astype(np.int64)
    totals = np.bincount(buckets.astype(np.int64), minlength=n_buckets)
    none = np.array([i is None for i in ids])
    table = np.stack([np.array([0 if i is None else i for i in ids], np.int64), np.array(sizes, np.int64), np.array(words, np.int64), none.astype(np.int64)])
    rows = [{"block": number, "range": HEADS, "docs": table.tobytes(), "totals": None, "gaps": None, "counts": None}]
    for k, (low, high) in enumerate(zip(bounds(n_buckets)[:-1], bounds(n_buckets)[1:], strict=True)):
        a, b = np.searchsorted(at, (low, high))
        if a == b:
            continue
        local = (keys[a:b] - np.uint64(low * n)).astype(np.int64)
        rows.append({"block": number, "range": k, "docs": np.int64(n).tobytes(), "totals": totals[low:high].astype(np.int64).tobytes(), "gaps": _squeezed(np.diff(local, prepend=0)), "counts": _squeezed(counts[a:b])})
    return rows


def _packed(n_buckets: int, block_features: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, sizes, words, found, size = [], [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own, n_words = features(text or b"", n_buckets)
                if ids and size + len(own) > block_features or len(ids) >= block_features:
                    yield pa.RecordBatch.from_pylist(_block_rows(number, ids, sizes, words, found, n_buckets), schema=_ARROW)
                    number += 1
                    ids, sizes, words, found, size = [], [], [], [], 0
                ids.append(doc_id)
                sizes.append(len(own))
                words.append(n_words)
                found.append(own)
                size += len(own)
        if ids:
            yield pa.RecordBatch.from_pylist(_block_rows(number, ids, sizes, words, found, n_buckets), schema=_ARROW)

    return run


def postings(docs: DataFrame, doc_id: str, label: str, n_buckets: int = N_BUCKETS, block_features: int = BLOCK_FEATURES) -> DataFrame:
    """The inverted index of docs (doc_id, text), written in the shared folder."""
    rows = docs.select(F.col(doc_id).cast("long"), F.col("text").cast("binary"))
    return written(rows.mapInArrow(_packed(n_buckets, block_features), _POSTINGS), label)


_TOTALS = "range int, totals binary, n long"


def totals(index: DataFrame) -> DataFrame:
    """How often each bucket occurs: a row for each range, summed in each task before they are shuffled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(blob, np.int64)
                sums[k] = sums[k] + part if k in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary()), pa.array([int(x.sum()) for x in sums.values()], pa.int64())], names=["range", "totals", "n"])

    once = index.where(F.col("range") != HEADS).select("range", "totals").mapInArrow(run, _TOTALS)
    return once.select("range", "totals").repartition("range").mapInArrow(run, _TOTALS)


def gain(s: int, t: int, of_s: int, of_t: int, n_buckets: int = N_BUCKETS) -> int:
    """A thousand times the logarithm of how much the target prefers a bucket, both smoothed by one a bucket."""
    return math.floor(1000 * math.log(float(t + 1) * float(of_s + n_buckets) / (float(s + 1) * float(of_t + n_buckets))))


_ADDED = "block long, added binary"


def contributions(index: DataFrame, target: DataFrame, n_blocks: int, n_buckets: int = N_BUCKETS, blocks_a_part: int = BLOCKS_A_PART) -> DataFrame:
    """What each range of buckets adds to the documents of each block.

    index and target are postings.  The totals are RANGES rows of N_BUCKETS numbers in all; they go to each part of a range.
    """
    n_parts = max(1, -(-n_blocks // blocks_a_part))
    sums = written(totals(index).withColumn("kind", F.lit(0)).unionByName(totals(target).withColumn("kind", F.lit(1))), "resampling-totals")
    size = {r.kind: r.n for r in sums.groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # two numbers
    of_s, of_t = size.get(0) or 0, size.get(1) or 0
    per_part = sums.select("range", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part"), "kind", F.lit(-1).cast("long").alias("block"), F.lit(None).cast("binary").alias("docs"), F.col("totals").alias("gaps"), F.lit(None).cast("binary").alias("counts"))
    lists = index.where(F.col("range") != HEADS).select("range", F.pmod(F.xxhash64("block"), F.lit(n_parts)).cast("int").alias("part"), F.lit(2).alias("kind"), "block", "docs", "gaps", "counts")
    rows = lists.unionByName(per_part).repartition("range", "part").sortWithinPartitions("range", "part", "kind", "block")
    edges = bounds(n_buckets)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for (k, _), group in groupby(stream, key=itemgetter(0, 1)):
            known = {0: np.zeros(edges[k + 1] - edges[k], np.int64), 1: np.zeros(edges[k + 1] - edges[k], np.int64)}
            gains = None
            for _, _, kind, block, docs, gaps, counts in group:
                if kind < 2:
                    known[kind] = np.frombuffer(gaps, np.int64)
                    continue
                if gains is None:
                    gains = np.array([gain(s, t, of_s, of_t, n_buckets) for s, t in zip(known[0].tolist(), known[1].tolist(), strict=True)], np.int64)
                n = int(np.frombuffer(docs, np.int64)[0])
                keys = np.cumsum(_restored(gaps).astype(np.int64))
                added = np.zeros(n, np.int64)
                np.add.at(added, keys % n, gains[keys // n] * _restored(counts).astype(np.int64))
                blob = zstandard.ZstdCompressor(level=1).compress(added.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([blob], pa.binary())], names=["block", "added"])

    return rows.mapInArrow(run, _ADDED)


_WEIGHTS = "doc_id long, n_features long, n_words long, weight long, block long, at long"


def weights(docs: DataFrame, target: DataFrame, target_id: str = "item_id", n_buckets: int = N_BUCKETS, block_features: int = BLOCK_FEATURES, blocks_a_part: int = BLOCKS_A_PART) -> DataFrame:
    """doc_id, n_features, n_words, weight (the floored mean gain of its features) and place in the index (block, at) of
    every row of docs (doc_id, text)."""
    index = postings(docs, "doc_id", "resampling-index", n_buckets, block_features)
    wanted = postings(target, target_id, "resampling-target", n_buckets, block_features)
    heads = index.where(F.col("range") == HEADS).select("block", F.lit(0).alias("kind"), F.col("docs").alias("data"))
    added = contributions(index, wanted, heads.count(), n_buckets, blocks_a_part)
    rows = heads.unionByName(added.select("block", F.lit(1).alias("kind"), F.col("added").alias("data"))).repartition("block").sortWithinPartitions("block", "kind")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for block, group in groupby(stream, key=itemgetter(0)):
            ids, sizes, words, none = np.frombuffer(next(group)[2], np.int64).reshape(4, -1)
            total = np.zeros(len(ids), np.int64)
            for _, _, data in group:
                total += np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int64)
            mean = np.where(sizes > 0, total // np.maximum(sizes, 1), 0)
            at = np.arange(len(ids))  # with the block it tells equal rows apart
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=none > 0), pa.array(sizes), pa.array(words), pa.array(mean), pa.array(np.full(len(ids), block)), pa.array(at)], names=["doc_id", "n_features", "n_words", "weight", "block", "at"])

    return rows.mapInArrow(run, _WEIGHTS)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs; rank is null where the row is not drawn.

    Of the rows with least_words words or more, percent of a hundred are drawn, those with the highest scores.
    """
    scored = weights(docs, target).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    fit = F.col("n_words") >= least_words
    # rows that are too short come last, and so change no place
    order = [(~fit).cast("int"), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("block"), F.col("at")]
    ranked = placed(written(scored, "resampling-scores"), order, "resampling-places")
    n = ranked.where(fit).count()
    place = F.col("place") + 1
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(fit & (place <= percent * n // 100), place).alias("rank"))
