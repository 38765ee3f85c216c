"""Removal of repeated byte strings with a run-length index.

A byte goes if a string of LENGTH bytes covers it that also starts in a document with a smaller id.  All of it is exact;
what is spread over the cluster is the index.

1. Anchors.  Every string of LENGTH bytes has a minimizer: its K-byte gram with the smallest hash.  Equal strings have
   equal minimizers, so each chunk of documents exchanges its distinct minimizers (see `chunks`) and learns which of them
   another document has too.  Strings whose minimizer is unshared cannot repeat and are out.
2. Stretches.  Neighbouring strings with the same minimizer make one stretch of text; it goes to a bucket by its
   minimizer, once for each chunk and spelling, with its smallest document.  So all equal strings meet in one bucket, no
   matter how many documents share them: a passage in a third of all documents is one stretch a chunk.  A minimizer that
   occurs more than HOT times may stand in as many different surroundings; its strings are dealt one by one, by a hash of
   all their bytes, so no bucket grows with it.
3. Index.  There are as many buckets as the counted bytes of the shared stretches need at BUCKET_BYTES each.  A bucket
   takes its stretches in parts of some INDEX_BYTES.  The distinct ones lie in a line, whose
   Burrows-Wheeler transform is kept as runs (symbol, first row, first mapped row) with the places of the suffixes at both
   ends of each run as samples; the suffix array is dropped.  For each string of LENGTH bytes of the line the index keeps
   the row at which its interval begins and the smallest document that has it.
4. Matching statistics.  Every stretch is streamed backwards through the runs.  Where the run's symbol is not the text's,
   the walk goes on from the nearer ends of the symbol's runs above and below, of which the sample that agrees longer with
   the text is taken.  So each place gets a row, a place in the line and the length to which both agree; where that is
   LENGTH or more, the row's interval tells whether a smaller document has the string.
5. Cutting.  The marks go back to their chunks, one bit a string, where they are merged and cut, some documents at a time.

A task's memory follows from these constants and from the longest text, not from the number of texts.  Hashes decide only where strings meet; strings are compared byte by byte.

Defined results: a null or empty text has no bytes and loses none; a null id is larger than every other; rows with equal
ids do not remove from each other; strings never cross documents; other columns are left alone; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.bytes_np import Rolling, mixed, ranges, sliding_min
from granary.llm.chunks import Chunk, Merged, answered, bucket_of, chunk_size, ids_of, n_buckets, opened, restored, sent, slices, squeezed
from granary.llm.chunks import pack as packed
from granary.llm.common import written

LENGTH = 50
K = 20
#: Occurrences of a minimizer beyond which its strings are dealt one by one.
HOT = 1 << 18
#: Bytes of a chunk at the most (one longer document stands alone): some 12 bytes of memory each.
MOST_CHUNK_BYTES = 16_000_000
#: Bytes of stretches in a bucket.
BUCKET_BYTES = 32_000_000
#: Bytes of a bucket's stretches that are indexed at once, some 60 bytes of memory each; larger indexes are also slower.
INDEX_BYTES = 250_000
#: Bytes of stretches with one minimizer beyond which a bucket takes their strings one by one.
MOST_INDEX_BYTES = 2_000_000
#: Bytes of a chunk that are hashed or cut at once.
BLOCK = 1 << 19
#: Stands for a null id: after every other.
LAST = np.iinfo(np.int64).max


# ------------------------------------------------------------------ the run-length index

def as_symbols(data: np.ndarray) -> np.ndarray:
    """Bytes as symbols: UTF-8 has no byte 255, so that 0 is free for the end of a text."""
    return data + np.uint8(1)


def words_at(line: np.ndarray) -> np.ndarray:
    """The eight symbols from each place on as one number, the first in its lowest byte; the line ends in eight blanks."""
    return np.ndarray((len(line) - 8,), "<u8", np.ascontiguousarray(line), strides=(1,))


def agreement(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """To how many symbols, `most` at the most, two lines (as words) agree from some places on."""
    out = most.copy()
    left = np.flatnonzero(most > 0)
    for step in range(0, int(most.max()) if len(most) else 0, 8):
        different = a[at_a[left] + step] ^ b[at_b[left] + step]
        stop = different != 0
        at = left[stop]
        low = different[stop]
        out[at] = np.minimum(most[at], step + (np.bitwise_count((low & -low) - np.uint64(1)) >> 3))
        left = left[~stop]
        left = left[most[left] > step + 8]
        if not len(left):
            break
    return out


class RunLengthIndex:
    """Of the texts that lie in a row in `data` (no byte 255), begin at `starts` (one more at the end), with `owners`."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, owners: np.ndarray, length: int = LENGTH) -> None:
        self.length = length
        sizes = np.diff(starts)
        n = len(data) + len(sizes)
        line = np.zeros(n + 8, np.uint8)  # every text followed by its end
        line[np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)] = as_symbols(data)
        self.line = words_at(line)
        suffixes, equal = _sorted_suffixes(line, length)
        # the transform as runs, with the suffixes at both ends of each
        last = line[suffixes - 1]
        last[suffixes == 0] = 0
        first = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]])[:n])
        self.run_start, self.run_symbol = first.astype(np.int32), last[first]
        self.run_end = np.append(first[1:], n).astype(np.int32) - 1
        self.start_sample, self.end_sample = suffixes[self.run_start], suffixes[self.run_end]
        # rows of a symbol's runs go, in their order, to the rows whose suffixes begin with it
        order = np.argsort(self.run_symbol, kind="stable")
        size = (self.run_end - self.run_start + 1)[order]
        self.run_shift = np.empty(len(order), np.int32)
        self.run_shift[order] = np.cumsum(size) - size - self.run_start[order]
        # runs by symbol, to find those above and below a row
        self.sorted_runs = order
        self.sorted_keys = self.run_symbol[order].astype(np.int64) * len(order) + order
        # strings of `length` symbols inside one text: where their rows begin and who has them
        ends = starts[1:] + np.arange(len(sizes))
        of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)[suffixes]
        whole = ends[of] - suffixes >= length
        heads = np.flatnonzero(~(equal & whole))
        smallest = np.minimum.reduceat(owners[of], heads) if n else np.empty(0, np.int64)
        self.interval_start, self.interval_owner = heads[whole[heads]].astype(np.int32), smallest[whole[heads]]

    def match(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of texts in a row: for each byte a row, a place in the line, and the length of the match.

        All texts are read at once, backwards from their ends; longer ones go on when shorter ones are through.
        """
        symbols = np.concatenate([as_symbols(data), np.zeros(8, np.uint8)])
        text = words_at(symbols)
        sizes = np.diff(starts)
        order = np.argsort(-sizes, kind="stable")
        sizes, ends = sizes[order], starts[1:][order]
        rows, places, lengths = (np.zeros(len(data), np.int32) for _ in range(3))
        row, length = (np.zeros(len(sizes), np.int32) for _ in range(2))
        place = np.full(len(sizes), self.start_sample[0] if len(self.run_start) else 0, np.int32)
        alive = len(sizes) - np.searchsorted(sizes[::-1], np.arange(int(sizes[0]) if len(sizes) else 0), "right")
        for step, n in enumerate(alive.tolist(), 1):
            at = ends[:n] - step
            symbol = symbols[at]
            run = np.searchsorted(self.run_start, row[:n], "right") - 1
            other = np.flatnonzero(self.run_symbol[run] != symbol)
            if len(other):
                run[other] = self._jump(text, at[other], symbol[other], run[other], row, place, length, other)
            row[:n] += self.run_shift[run]
            place[:n] -= 1
            length[:n] += 1
            if len(other):  # a symbol that the line has not
                lost = other[run[other] < 0]
                row[lost] = length[lost] = 0
                place[lost] = self.start_sample[0]
            rows[at], places[at], lengths[at] = row[:n], place[:n], length[:n]
        return rows, places, lengths

    def _jump(self, text, at, symbol, run, row, place, length, lanes) -> np.ndarray:
        """Moves lanes to the better of the nearest ends of their symbol's runs; gives those runs, -1 where there is none."""
        n = len(self.sorted_keys)
        key = symbol.astype(np.int64) * len(self.run_start)
        below = np.searchsorted(self.sorted_keys, key + run)
        above = below - 1
        has_above = (above >= 0) & (self.sorted_keys[above] >= key)
        has_below = (below < n) & (self.sorted_keys[np.minimum(below, n - 1)] < key + len(self.run_start))
        above, below = self.sorted_runs[above], self.sorted_runs[np.minimum(below, n - 1)]
        most = length[lanes]
        up = np.where(has_above, agreement(text, self.line, at + 1, self.end_sample[above], np.where(has_above, most, 0)), -1)
        down = np.where(has_below, agreement(text, self.line, at + 1, self.start_sample[below], np.where(has_below, most, 0)), -1)
        better = up >= down
        row[lanes] = np.where(better, self.run_end[above], self.run_start[below])
        place[lanes] = np.where(better, self.end_sample[above], self.start_sample[below])
        length[lanes] = np.maximum(up, down)
        return np.where(has_above | has_below, np.where(better, above, below), -1)

    def smallest_owners(self, rows: np.ndarray) -> np.ndarray:
        """The smallest owner of the `length` symbols that begin the suffixes at some rows."""
        return self.interval_owner[np.searchsorted(self.interval_start, rows, "right") - 1]


def _sorted_suffixes(line: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of a line (with eight blanks behind it) in order, and whether each begins like the one before it, to
    `length` symbols.  By doubling; only suffixes that are still tied are sorted again."""
    n = len(line) - 8
    key = words_at(line).byteswap()
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])[:n]
    del key
    rank = np.empty(n, np.int32)  # the first row of those that are equal so far
    rank[order] = np.flatnonzero(new).astype(np.int32)[np.cumsum(new, dtype=np.int32) - 1]
    width, short, half = 8, None, 8
    while True:
        if width <= length:
            short, half = rank.copy(), width
        tied = np.flatnonzero(~new | np.append(~new[1:], False)[:n])
        if not len(tied):
            break
        at = order[tied]
        ahead = np.where(at + width < n, rank[np.minimum(at + width, n - 1)], -1)
        pair = (rank[at].astype(np.int64) << 32) | (ahead + 1)
        sub = np.argsort(pair)
        at, pair = at[sub], pair[sub]
        order[tied] = at
        fresh = np.concatenate([[True], pair[1:] != pair[:-1]])
        new[tied] = fresh
        rank[at] = tied[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        width *= 2
    equal = np.zeros(n, bool)
    if n:
        a, b, rest = order[1:], order[:-1], length - half
        equal[1:] = (short[a] == short[b]) & (a + rest < n) & (b + rest < n) & (short[np.minimum(a + rest, n - 1)] == short[np.minimum(b + rest, n - 1)])
    return order, equal


# ------------------------------------------------------------------ anchors and stretches

class Anchored:
    """The stretches of a chunk: runs of strings of LENGTH bytes with one minimizer (at one place, in one document).

    start and count: the first string of a stretch and how many there are; key: the minimizer's hash; doc: the document.
    """

    def __init__(self, chunk: Chunk, length: int = LENGTH, k: int = K) -> None:
        parts = [_stretches(chunk, a, min(a + BLOCK, len(chunk.data) - length + 1), length, k) for a in range(0, len(chunk.data) - length + 1, BLOCK)]
        parts.append((np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.uint64)))
        self.start, self.count, self.key = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.doc = (np.searchsorted(chunk.starts, self.start, "right") - 1).astype(np.int32)

    def minimizers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct minimizers in order, in how many stretches each is, and whether two documents have it."""
        order = np.argsort(self.key, kind="stable")  # so documents ascend inside a key
        key, doc = self.key[order], self.doc[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        after = np.append(at[1:], len(key))
        return key[at], after - at, doc[at] != doc[after - 1] if len(at) else np.empty(0, bool)


def _stretches(chunk: Chunk, a: int, b: int, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, count and key of the stretches among the strings that start at places a .. b-1."""
    grams = Rolling(chunk.data[a : b + length - 1]).grams(k)
    # a gram's rank is the upper half of its hash; with its place below, minima are the first of the smallest
    packed = sliding_min((grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64), length - k + 1)
    place = packed.astype(np.uint32)
    # strings that cross a document's end are none; there are length - 1 of them or more between two documents
    ends = chunk.starts[1:-1]
    ends = ends[(ends > a) & (ends < b + length - 1)] - a
    crossing = np.zeros(b - a + 1, np.int32)
    np.add.at(crossing, np.maximum(ends - length + 1, 0), 1)
    np.add.at(crossing, np.minimum(ends, b - a), -1)
    inside = np.cumsum(crossing[:-1]) == 0
    head = inside.copy()
    head[1:] &= ~inside[:-1] | (place[1:] != place[:-1])
    at = np.flatnonzero(head)
    before = np.concatenate([[0], np.cumsum(inside)])
    # minimizers are small hashes: mixed once more, they are spread evenly over the buckets
    return (at + a).astype(np.int32), np.diff(np.append(before[at], before[-1])).astype(np.int32), mixed(grams[place[at]])


def span_hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of spans of data (starts ascend), a block of data at a time."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        a = int(start[i])
        j = int(np.searchsorted(start, a + BLOCK))
        out[i:j] = Rolling(data[a : int((start[i:j] + length[i:j]).max())]).spans(start[i:j] - a, start[i:j] - a + length[i:j])
        i = j
    return out


def _distinct(data: np.ndarray, start: np.ndarray, length: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first of each spelling, the number of each span's spelling, and the smallest owner of each."""
    _, first, number = np.unique(span_hashes(data, start, length), return_index=True, return_inverse=True)
    # equal hashes are compared byte by byte; a span that differs from its first is a spelling of its own
    twin = np.flatnonzero(first[number] != np.arange(len(start)))
    odd = [twin[:0]]
    for i in range(0, len(twin), 1 << 12):
        x = twin[i : i + (1 << 12)]
        y = first[number[x]]
        same = length[x] == length[y]
        size = np.where(same, length[x], 1)
        bad = data[ranges(start[x], size)] != data[ranges(start[y], size)]
        odd.append(x[~same | (np.add.reduceat(bad, np.cumsum(size) - size) > 0)])
    alone = np.concatenate(odd)
    number[alone] = len(first) + np.arange(len(alone))
    first = np.concatenate([first, alone])
    smallest = np.full(len(first), LAST, np.int64)
    np.minimum.at(smallest, number, owners)
    return first, number, smallest


def _owners(chunk: Chunk) -> np.ndarray:
    return np.where(chunk.no_id, LAST, chunk.doc_ids)


_SENT = "bucket int, chunk_id long, keys binary, times binary"
_SHARED = "chunk_id long, bucket int, answer binary, n_bytes long"
_STRETCHES = "bucket int, chunk_id long, part binary, counts binary, owners binary, data binary"
_FOUND = "chunk_id long, bucket int, answer binary"
_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans binary"


class Shared:
    """What a chunk sends: its stretches whose minimizer another document has, each spelling once, in the order of keys.

    Deterministic, so that the answers of the last step meet the same order.
    """

    def __init__(self, chunk: Chunk, got: pd.DataFrame) -> None:
        a = Anchored(chunk)
        keys, _, _ = a.minimizers()
        state = answered(got, np.uint8)[np.searchsorted(keys, a.key)] if len(keys) else np.empty(0, np.uint8)
        plain, hot = np.flatnonzero(state == 1), np.flatnonzero(state == 2)
        # the strings of hot stretches, one by one, keyed by all their bytes
        start = np.concatenate([a.start[plain], ranges(a.start[hot], a.count[hot])])
        count = np.concatenate([a.count[plain], np.ones(len(start) - len(plain), np.int32)])
        doc = np.concatenate([a.doc[plain], np.repeat(a.doc[hot], a.count[hot])])
        key = np.concatenate([a.key[plain], span_hashes(chunk.data, start[len(plain) :], count[len(plain) :] + LENGTH - 1)])
        del a, keys, state, plain, hot
        order = np.argsort(start, kind="stable")
        self.start, self.count, self.doc, key = start[order], count[order], doc[order], key[order]
        self.owner = _owners(chunk)[self.doc]
        first, number, smallest = _distinct(chunk.data, self.start, self.count + LENGTH - 1, self.owner)
        order = np.lexsort((first, key[first]))
        place_of = np.empty(len(order), np.int64)
        place_of[order] = np.arange(len(order))
        first = first[order]
        self.keys, self.sent_start, self.sent_count, self.sent_owner = key[first], self.start[first], self.count[first], smallest[order]
        #: Of each stretch, the place of its spelling among those sent.
        self.number = place_of[number]


def repeated(data: np.ndarray, counts: np.ndarray, owners: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For every string of `length` bytes of stretches in a row whether a smaller owner than the stretch's has it too."""
    sizes = counts + length - 1
    starts = np.cumsum(sizes) - sizes
    first, number, smallest = _distinct(data, starts, sizes, owners)
    line = data[ranges(starts[first], sizes[first])]
    begins = np.concatenate([[0], np.cumsum(sizes[first])])
    index = RunLengthIndex(line, begins, smallest, length)
    rows, _, agreed = index.match(line, begins)
    at = ranges(begins[:-1], counts[first])
    marks = agreed[at] >= length
    marks[marks] = index.smallest_owners(rows[at[marks]]) < np.repeat(smallest, counts[first])[marks]
    # a stretch that a smaller owner has too is marked as a whole
    mark_start = np.cumsum(counts[first]) - counts[first]
    return marks[ranges(mark_start[number], counts)] | np.repeat(owners > smallest[number], counts)


def repeated_in_parts(data: np.ndarray, counts: np.ndarray, owners: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The same as `repeated`, some INDEX_BYTES at a time.  part: a byte for each stretch, equal where strings are equal."""
    sizes = counts + LENGTH - 1
    starts, mark_start = np.cumsum(sizes) - sizes, np.cumsum(counts) - counts
    marks = np.zeros(int(counts.sum()), bool)
    parts = min(256, -(-len(data) // INDEX_BYTES))
    of = part.astype(np.int64) * parts >> 8
    for p in range(parts):
        own = np.flatnonzero(of == p)
        at = ranges(mark_start[own], counts[own])
        if int(sizes[own].sum()) > MOST_INDEX_BYTES:  # many surroundings of one minimizer: its strings one by one
            first, who = ranges(starts[own], counts[own]), np.repeat(owners[own], counts[own])
            n = -(-len(first) * LENGTH // INDEX_BYTES)
            dealt = bucket_of(span_hashes(data, first, np.full(len(first), LENGTH)), n).astype(np.int32)
            order = np.argsort(dealt, kind="stable")
            for x in np.split(order, np.searchsorted(dealt[order], np.arange(1, n))):
                one = np.ones(len(x), np.int64)
                marks[at[x]] = repeated(data[ranges(first[x], one * LENGTH)], one, who[x])
        elif len(own):
            marks[at] = repeated(data[ranges(starts[own], sizes[own])], counts[own], owners[own])
    return marks


def pack(docs: DataFrame) -> DataFrame:
    """The chunk table of docs, of chunks of a bounded size."""
    return packed(docs, chunk_bytes=min(MOST_CHUNK_BYTES, chunk_size(docs)))


def mark(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (pairs of 64-bit byte places) of every row of docs."""
    spark = docs.sparkSession
    chunks = pack(docs)
    buckets = n_buckets(spark, chunks)

    def anchors(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for chunk in opened(frame):
            keys, times, several = Anchored(chunk).minimizers()
            rows += sent(chunk.chunk_id, keys, buckets, times=(2 * times + several).astype(np.uint32))
        return pd.DataFrame(rows, columns=["bucket", "chunk_id", "keys", "times"])

    def share(frame: pd.DataFrame) -> pd.DataFrame:
        m = Merged(frame)
        told = m.column("times", np.uint32)
        times = np.bincount(m.places, weights=told >> 1, minlength=len(m.keys))
        many = np.bincount(m.places, minlength=len(m.keys)) > 1
        many[m.places[told & 1 > 0]] = True
        out = m.answers((many * np.where(times > hot, 2, 1)).astype(np.uint8)[m.places])
        # what will be sent, before each chunk leaves its copies out: stretches have some 16 strings
        strings = (LENGTH - K + 2) // 2
        out["n_bytes"] = 0
        out.loc[0, "n_bytes"] = int((times * many * np.where(times > hot, strings * LENGTH, strings + LENGTH)).sum())
        return out

    anchored = chunks.groupBy("chunk_id").applyInPandas(anchors, _SENT)
    shared = written(anchored.groupBy("bucket").applyInPandas(share, _SHARED), "rindex-shared")
    parts = max(1, -(-(shared.agg(F.sum("n_bytes")).first()[0] or 0) // BUCKET_BYTES))

    def stretches(frame: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for chunk in opened(frame):
            own = Shared(chunk, got)
            at = slices(own.keys, parts)
            for b in np.flatnonzero(np.diff(at)).tolist():
                x = slice(at[b], at[b + 1])
                data = chunk.data[ranges(own.sent_start[x], own.sent_count[x] + LENGTH - 1)]
                rows.append({"bucket": b, "chunk_id": chunk.chunk_id, "part": squeezed(own.keys[x].astype(np.uint8)), "counts": squeezed(own.sent_count[x].astype(np.uint8)), "owners": squeezed(own.sent_owner[x]), "data": squeezed(data)})
        return pd.DataFrame(rows, columns=["bucket", "chunk_id", "part", "counts", "owners", "data"])

    spread = chunks.groupBy("chunk_id").cogroup(shared.groupBy("chunk_id")).applyInPandas(stretches, _STRETCHES)

    def index(frame: pd.DataFrame) -> pd.DataFrame:
        counts = [restored(x, np.uint8).astype(np.int64) for x in frame["counts"]]
        cut = np.cumsum([n.sum() for n in counts])[:-1]
        counts = np.concatenate(counts)
        part, owners, data = (np.concatenate([restored(x, t) for x in frame[c]]) for c, t in (("part", np.uint8), ("owners", np.int64), ("data", np.uint8)))
        # equal strings have one key, so they are in one part of the bucket
        marks = repeated_in_parts(data, counts, owners, part)
        return pd.DataFrame({"chunk_id": frame["chunk_id"].to_numpy(), "bucket": frame["bucket"].to_numpy(), "answer": [squeezed(x) for x in np.split(marks, cut)]})

    found = written(spread.groupBy("bucket").applyInPandas(index, _FOUND), "rindex-found")
    # both answers of a chunk as one table: those of the first exchange have kind 0
    both = shared.drop("n_bytes").withColumn("kind", F.lit(0)).unionByName(found.withColumn("kind", F.lit(1)))

    def cut(frame: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame(columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])]
        for chunk in opened(frame):
            out.append(_cut(chunk, Shared(chunk, got[got["kind"] == 0]), answered(got[got["kind"] == 1], bool)))
        return pd.concat(out[1:] or out)

    return chunks.groupBy("chunk_id").cogroup(both.groupBy("chunk_id")).applyInPandas(cut, _OUT)


def _cut(chunk: Chunk, own: Shared, marks: np.ndarray) -> pd.DataFrame:
    begin = np.cumsum(own.sent_count) - own.sent_count
    rows, i, n = [], 0, len(chunk.lengths)
    while i < n:  # some documents at a time
        j = max(i + 1, int(np.searchsorted(chunk.starts, chunk.starts[i] + BLOCK, "right")) - 1)
        x = slice(*np.searchsorted(own.start, chunk.starts[[i, j]]))
        number, count = own.number[x], own.count[x]
        hit = marks[ranges(begin[number], count)] | np.repeat(own.owner[x] > own.sent_owner[number], count)
        rows += _cut_rows(chunk.bytes[chunk.starts[i] : chunk.starts[j]], chunk.starts[i : j + 1] - chunk.starts[i], ranges(own.start[x] - chunk.starts[i], count)[hit])
        i = j
    out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
    out.insert(0, "doc_id", ids_of(chunk))
    return out


def _cut_rows(raw: bytes, starts: np.ndarray, hits: np.ndarray) -> list[tuple]:
    """Of documents in a row, without the strings that begin at the places `hits`."""
    n = len(raw)
    repeats = np.zeros(n + 1, bool)
    repeats[hits] = True
    # a byte goes if one of the LENGTH strings that cover it is repeated
    before = np.cumsum(repeats[:-1], dtype=np.int32)
    gone = before > 0
    gone[LENGTH:] = before[LENGTH:] > before[:-LENGTH]
    edge = np.diff(np.pad(gone.astype(np.int8), 1))
    # a run of removed bytes is cut where a document ends: strings never cross, so only neighbours can touch there
    opens, closes = edge[:-1] == 1, edge[1:] == -1
    inner = starts[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    both = inner[gone[inner] & gone[inner - 1]]
    opens[both] = True
    closes[both - 1] = True
    first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    removed = np.concatenate([[0], np.cumsum(gone)])
    of = np.searchsorted(first, starts)
    rows = []
    for i in range(len(starts) - 1):
        a, b = int(starts[i]), int(starts[i + 1])
        x, y = int(of[i]), int(of[i + 1])
        spans = list(zip(first[x:y].tolist(), last[x:y].tolist(), strict=True))
        h, at = hashlib.sha256(), a
        for s, e in spans:
            h.update(raw[at:s])
            at = e
        h.update(raw[at:b])
        rows.append((b - a, int(removed[b] - removed[a]), y - x, h.hexdigest(), (np.array(spans, np.int64).reshape(-1, 2) - a).tobytes()))
    return rows


def removed_spans(docs: DataFrame) -> DataFrame:
    """doc_id, begin, end (byte places) of every removed run."""

    def run(batches):
        for frame in batches:
            ends = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in frame["spans"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"].repeat([len(x) for x in ends]), "begin": np.concatenate(ends)[:, 0] if ends else [], "end": np.concatenate(ends)[:, 1] if ends else []})

    return mark(docs).select("doc_id", "spans").mapInPandas(run, "doc_id long, begin long, end long")
