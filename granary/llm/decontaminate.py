"""Benchmark decontamination by spaced seeds.

A mask of ones and zeros slides over the tokens of a text; a seed is the hash of the tokens under its ones, so that
substituted tokens under its zeros do not matter.  Seeds of the benchmark are joined with seeds of the documents.  Each
hit fixes a diagonal (a place in the item set against a place in the document), along which the tokens around the hit are
compared: an overlap is the best stretch of LEAST tokens or more of which at least AGREE of 100 agree and whose ends
agree.  Items shorter than LEAST must be matched as a whole.

No overlap is without a seed.  A stretch of 26 tokens or more falls into stretches of LEAST to 25, one of which agrees as
well as the whole; MASKS hold a mask for every way in which at most a fifth of 13 to 25 tokens can differ (the tests go
through all ways).  A shorter item has masks of its own length, for every way in which its inner tokens can differ.

The benchmark's seeds go to the tasks as a broadcast only if their counted number is at most SMALL; beyond that the
documents' seeds are joined with them by a shuffle, and only documents with a hit are compared.

Defined results: null and blank texts have no tokens and match nothing; equal items are all reported; rows are told apart
by id and text, so rows that repeat an id are judged one by one and rows without an id like others; `overlaps` reports the
best of an id's rows (null is one id), `clean` removes single rows; other columns are left alone; an empty table on either
side gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.bytes_np import LOWER_TABLE, Rolling, joined, mixed, word_spans

#: One of them fits wherever 80 of 100 tokens agree over LEAST tokens or more.
MASKS = ("11010111", "11100010011", "1011000001011", "111111")
LEAST = 13
AGREE = 80
#: Seeds of the benchmark that may be broadcast: some 30 bytes each.
SMALL = 2_000_000

_STRIP = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
_BY_BLANK = bytes(32 if b in _STRIP else b for b in LOWER_TABLE)


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts in a row (lower case, ASCII punctuation as blanks), and each text's first token."""
    raw = [(t or "").lower().encode("utf-8", "surrogatepass").translate(_BY_BLANK) for t in texts]
    data, starts = joined(raw)
    begin, end, first = word_spans(data, starts)
    return Rolling(data).spans(begin, end), first


def short_masks(n: int, agree: int = AGREE) -> tuple[str, ...]:
    """Masks as long as an item of n tokens: its inner tokens in blocks, of which as many are left out as may differ."""
    errors = n * (100 - agree) // 100
    if not errors:
        return ("1" * n,)
    blocks = np.array_split(np.arange(1, n - 1), min(2 * errors + (errors == 1), n - 2))
    masks = []
    for gone in combinations(blocks, min(errors, len(blocks))):
        zeros = {int(i) for b in gone for i in b}
        masks.append("".join("0" if i in zeros else "1" for i in range(n)))
    return tuple(masks)


def seeds(toks: np.ndarray, first: np.ndarray, masks: tuple[str, ...] = MASKS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each mask the hash and the place of every seed that lies inside one text."""
    text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for mask in masks:
        n = len(toks) - len(mask) + 1
        if n <= 0:
            yield np.empty(0, np.uint64), np.empty(0, np.int64)
            continue
        h = np.full(n, int("1" + mask, 2), np.uint64)
        for k, bit in enumerate(mask):
            if bit == "1":
                h = mixed(h) + toks[k : k + n]
        inside = text_of[:n] == text_of[len(mask) - 1 :]
        yield mixed(h)[inside], np.flatnonzero(inside)


def overlap(a: np.ndarray, b: np.ndarray, at_a: int, at_b: int, least: int = LEAST, agree: int = AGREE) -> tuple[int, int, int] | None:
    """Along the diagonal through (at_a, at_b): start in b, length and agreeing tokens of the longest valid stretch.

    a is the item.  Linear: with s = sum of (100 * equal - agree) a stretch is valid if s does not fall over it; the
    longest one is found from running minima and maxima.
    """
    back = min(at_a, at_b)
    i, j = at_a - back, at_b - back
    n = min(len(a) - i, len(b) - j)
    need = min(least, len(a))
    if n < need:
        return None
    same = a[i : i + n] == b[j : j + n]
    if not same.any():
        return None
    total = np.concatenate([[0], np.cumsum(100 * same.astype(np.int64) - agree)])
    low = np.minimum.accumulate(total)
    high = np.maximum.accumulate(total[::-1])[::-1]
    # for each start that is a new low, the last end whose sum is not lower
    ends = len(high) - 1 - np.searchsorted(high[::-1], low, side="left")
    begins = np.arange(len(low))
    length = np.where(total == low, ends - begins, 0)
    best = int(length.argmax())
    stop = best + int(length[best])
    inside = np.flatnonzero(same[best:stop])
    if not len(inside):
        return None
    begin, stop = best + int(inside[0]), best + int(inside[-1]) + 1
    found = int(same[begin:stop].sum())
    if stop - begin < need or 100 * found < agree * (stop - begin):
        return None
    return j + begin, stop - begin, found


def _items(bench: DataFrame) -> DataFrame:
    """item_key, item_id, item (token hashes as bytes): each distinct item once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toks, first = tokens(batch.column(2).to_pylist())
            own = [toks[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.binary())], ["item_key", "item_id", "item"])

    keyed = bench.where("item_id IS NOT NULL").select(F.xxhash64("item_id", "text").alias("item_key"), "item_id", "text").distinct()
    return keyed.mapInArrow(run, "item_key long, item_id long, item binary")


def _seeds(items: DataFrame) -> DataFrame:
    """seed, item_key, place: one row for each seed of each item; a short item has those of its own length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            first = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
            toks = np.concatenate([*own, np.empty(0, np.uint64)])
            item_of = np.repeat(np.arange(len(own)), np.diff(first))
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            size = np.diff(first)
            for n in [LEAST, *sorted({int(x) for x in size if 0 < x < LEAST})]:
                for h, at in seeds(toks, first, MASKS if n == LEAST else short_masks(n)):
                    own = size[item_of[at]] >= n if n == LEAST else size[item_of[at]] == n
                    h, at, item = h[own], at[own], item_of[at[own]]
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(keys[item], pa.int64()), pa.array(at - first[item], pa.int32())], ["seed", "item_key", "place"])

    return items.select("item_key", "item").mapInArrow(run, "seed long, item_key long, place int")


def _masks(items: DataFrame) -> tuple[str, ...]:
    """The masks that the documents need: MASKS, and those of the lengths below LEAST that items have."""
    size = (F.octet_length("item") / 8).cast("int")
    lengths = [r[0] for r in items.select(size.alias("n")).where(f"n > 0 AND n < {LEAST}").distinct().collect()]  # at most LEAST numbers
    return (*MASKS, *(m for n in sorted(lengths) for m in short_masks(n)))


_OUT = "row long, doc_id long, item_id long, first_token long, n_tokens long, n_equal long"


def _compare(rows_of, doc_ids, toks, first, doc_of, place, item, item_place, item_ids, tokens_of) -> pa.RecordBatch:
    """The verified overlaps of some hits of items with documents (both by number), each diagonal once."""
    rows, seen, whole = [], set(), {}
    for d, p, i, q in zip(doc_of.tolist(), place.tolist(), item.tolist(), item_place.tolist(), strict=True):
        key = (d, i, p - q)
        # after a copy of the whole item only an earlier one could be better
        if key in seen or p - q > whole.get((d, i), p - q):
            continue
        seen.add(key)
        own = np.frombuffer(tokens_of[i], np.uint64)
        hit = overlap(own, toks[first[d] : first[d + 1]], q, p - int(first[d]))
        if hit:
            rows.append((rows_of[d], doc_ids[d], int(item_ids[i]), *hit))
            if hit[2] == len(own):
                whole[d, i] = p - q
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["row", "doc_id", "item_id", "first_token", "n_tokens", "n_equal"])


def _row() -> Column:
    """What tells rows apart: their id and text."""
    return F.xxhash64("doc_id", "text")


def _found(docs: DataFrame, bench: DataFrame, small: int = SMALL) -> DataFrame:
    """row, doc_id, item_id, first_token, n_tokens, n_equal: verified overlaps of each row."""
    items = _items(bench)
    seeded, masks = _seeds(items), _masks(items)
    keyed = docs.select(_row().alias("row"), "doc_id", "text")
    return _broadcast_hits(keyed, items, seeded, masks) if seeded.count() <= small else _joined_hits(keyed, items, seeded, masks)


def overlaps(docs: DataFrame, bench: DataFrame, small: int = SMALL) -> DataFrame:
    """doc_id, item_id, first_token, n_tokens, n_equal: the longest verified overlap of each document with each item."""
    best = F.max_by(F.struct("first_token", "n_tokens", "n_equal"), F.struct("n_equal", "n_tokens", -F.col("first_token"))).alias("x")
    return _found(docs, bench, small).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.*")


def _broadcast_hits(docs: DataFrame, items: DataFrame, seeded: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    # at most SMALL seeds, counted above, and items that have one; an item has no more tokens than seeds and LEAST
    rows, whole = seeded.toPandas(), items.join(seeded.select("item_key").distinct(), "item_key", "left_semi").toPandas()
    rows["seed"] = rows["seed"].to_numpy(np.int64).view(np.uint64)
    rows = rows.sort_values("seed", kind="stable")
    number = whole.reset_index().set_index("item_key")["index"]
    table = docs.sparkSession.sparkContext.broadcast((rows["seed"].to_numpy(np.uint64), number.reindex(rows["item_key"]).to_numpy(np.int64), rows["place"].to_numpy(np.int64), whole["item_id"].to_numpy(np.int64), whole["item"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, item, places, item_ids, tokens_of = table.value
        # a quick test by 20 bits of the seed, before the search among all seeds
        quick = np.zeros(1 << 20, bool)
        quick[(known >> np.uint64(44)).astype(np.int64)] = True
        for batch in batches:
            toks, first = tokens(batch.column(2).to_pylist())
            doc_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
            hits = []
            for h, at in seeds(toks, first, masks):
                maybe = quick[(h >> np.uint64(44)).astype(np.int64)]
                h, at = h[maybe], at[maybe]
                low, high = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
                n = high - low
                at, low, n = at[n > 0], low[n > 0], n[n > 0]
                which = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                hits.append((np.repeat(at, n), which))
            place, which = (np.concatenate(x) for x in zip(*hits, strict=True))
            yield _compare(batch.column(0).to_pylist(), batch.column(1).to_pylist(), toks, first, doc_of[place], place, item[which], places[which], item_ids, tokens_of)

    return docs.mapInArrow(run, _OUT)


def _joined_hits(docs: DataFrame, items: DataFrame, seeded: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """The same by a shuffle of the documents' seeds: for benchmarks of any size."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toks, first = tokens(batch.column(1).to_pylist())
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            doc_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
            for h, at in seeds(toks, first, masks):
                d = doc_of[at]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(rows[d]), pa.array(at - first[d], pa.int64())], ["seed", "row", "at"])

    rows = docs.select("row", "text").mapInArrow(emit, "seed long, row long, at long")
    # each diagonal of a row and an item once, with the item's tokens
    hits = rows.join(seeded, "seed").select("row", "item_key", (F.col("at") - F.col("place")).alias("shift")).distinct().join(items, "item_key")
    whole = docs.withColumnRenamed("row", "_row").join(hits.select("row").distinct(), F.col("_row") == F.col("row"), "left_semi")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toks, first = tokens(batch.column("text").to_pylist())
            shift = batch.column("shift").to_numpy(zero_copy_only=False)
            start, at = np.maximum(shift, 0), np.maximum(-shift, 0)
            n = np.arange(batch.num_rows)
            yield _compare(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), toks, first, n, first[:-1] + start, n, at, batch.column("item_id").to_pylist(), batch.column("item").to_pylist())

    return hits.join(whole, F.col("row") == F.col("_row")).select("row", "doc_id", "item_id", "shift", "item", "text").mapInArrow(verify, _OUT)


def clean(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of docs that overlap with no item, with their own columns."""
    bad = _found(docs, bench).select(F.col("row").alias("_bad_row"), F.col("doc_id").alias("_bad_id")).distinct()
    return docs.join(bad, (_row() == F.col("_bad_row")) & docs["doc_id"].eqNullSafe(F.col("_bad_id")), "left_anti")
