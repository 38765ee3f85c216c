"""Exact duplicates by counting quotient filters and byte verification.

Texts are equal if they are the same bytes without their blanks.  Texts are packed into chunks once (`chunks`); nothing
but fingerprints, and the bytes of texts whose fingerprint occurs again, leaves a chunk after that:

1. The task of a chunk builds counting quotient filters of its fingerprints, one for each bucket (a range of leading
   bits), so a text that is in the chunk many times is one entry with its count.
2. A bucket merges the filters of all chunks.  A filter gives its fingerprints back in sorted order and without loss, so
   merging is merging sorted remainders and adding counts.  Each chunk is told which of its entries count above one.
3. Rows of those go on with their bytes, one row for each text of a chunk, and are grouped by the bytes themselves: two
   texts with one fingerprint stay two.  All other rows are alone, and their texts are never shuffled.
4. Rows meet their group by the digest of the text.  A group with a thousandth of all rows or more, of which there are at
   most a thousand, is dealt with a salt.

Of equal texts the row with the most code points in the original text stays, then that with the smallest id; a null id
comes after all ids, and of equal rows one stays, the first by its place in the chunk table.

Defined results: a null text is an empty one, and equal to those that hold blanks only; repeated rows are in one group;
other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import chunks
from granary.llm.common import written

#: What is deleted before texts are compared.
BLANK_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Fingerprints that a bucket is meant for; there are as many buckets as that needs.
PER_BUCKET = 1_000_000
#: Bytes of texts in a chunk.  Rows sent to buckets are never more than fingerprints.
CHUNK_BYTES = 16_000_000
#: A group with a share of one in HOT of all rows is dealt with a salt: there are at most HOT of them.
HOT, SALTS = 1000, 32


@dataclass
class QuotientFilter:
    """A counting quotient filter of 64-bit fingerprints that share their leading `head` bits.

    A fingerprint is head, quotient (q bits) and remainder.  Slot by slot stand the remainders, those of one quotient in a
    sorted run, at the quotient's own slot or, where that is taken, after the run before.  `occupied` has a bit for each
    quotient with a run, `ends` one for each slot that ends a run; so remainders and the two bitmaps give every
    fingerprint back.  counts holds the count of each slot in use.
    """

    head: int
    q: int
    n_slots: int
    used: np.ndarray  # bit for each slot
    occupied: np.ndarray  # bit for each quotient
    ends: np.ndarray  # bit for each slot
    remainders: np.ndarray
    counts: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray, head: int) -> QuotientFilter:
        """Of sorted, distinct keys and their counts."""
        n = len(keys)
        q = max(1, int(np.ceil(np.log2(max(n, 1) / 0.75))))
        if q + head >= 64:
            raise ValueError("no bits are left for remainders")
        low = keys << np.uint64(head)
        quotients = (low >> np.uint64(64 - q)).astype(np.int64)
        remainders = (low << np.uint64(q)) >> np.uint64(head + q)
        slots = np.maximum.accumulate(quotients - np.arange(n)) + np.arange(n) if n else quotients
        n_slots = max(1 << q, int(slots[-1]) + 1 if n else 0)
        used, occupied, ends = np.zeros(n_slots, bool), np.zeros(1 << q, bool), np.zeros(n_slots, bool)
        used[slots], occupied[quotients] = True, True
        ends[slots[np.append(quotients[1:] != quotients[:-1], True)] if n else []] = True
        return cls(head, q, n_slots, np.packbits(used), np.packbits(occupied), np.packbits(ends), remainders, counts.astype(np.uint64))

    def keys(self, head_bits: int) -> np.ndarray:
        """The fingerprints, sorted: runs in the order of their quotients, sorted in themselves."""
        occupied = np.flatnonzero(np.unpackbits(self.occupied, count=1 << self.q)).astype(np.uint64)
        used = np.flatnonzero(np.unpackbits(self.used, count=self.n_slots))
        ends = np.unpackbits(self.ends, count=self.n_slots)[used].astype(np.int64)
        run = np.cumsum(ends) - ends
        low = (occupied[run] << np.uint64(64 - self.q)) | (self.remainders << np.uint64(self.head)) if len(used) else self.remainders
        return (low >> np.uint64(self.head)) | (np.uint64(head_bits) << np.uint64(64 - self.head)) if self.head else low

    def to_bytes(self) -> bytes:
        width = (64 - self.head - self.q + 7) // 8
        cut = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        many = self.counts > 254
        small = np.where(many, 255, self.counts).astype(np.uint8)
        head = np.array([self.head, self.q, self.n_slots, len(self.remainders), int(many.sum())], np.int64)
        return b"".join((head.tobytes(), self.used.tobytes(), self.occupied.tobytes(), self.ends.tobytes(), np.ascontiguousarray(cut).tobytes(), small.tobytes(), self.counts[many].tobytes()))

    @classmethod
    def from_bytes(cls, blob: bytes) -> QuotientFilter:
        head, q, n_slots, n, n_many = (int(x) for x in np.frombuffer(blob, np.int64, 5))
        at = 40

        def take(count: int, dtype=np.uint8) -> np.ndarray:
            nonlocal at
            part = np.frombuffer(blob, dtype, count, at)
            at += part.nbytes
            return part

        used, occupied, ends = take((n_slots + 7) // 8), take(((1 << q) + 7) // 8), take((n_slots + 7) // 8)
        width = (64 - head - q + 7) // 8
        remainders = np.zeros((n, 8), np.uint8)
        remainders[:, :width] = take(n * width).reshape(n, width)
        counts = take(n).astype(np.uint64)
        counts[counts == 255] = take(n_many, np.uint64)
        return cls(head, q, n_slots, used, occupied, ends, remainders.view("<u8").reshape(-1), counts)


def merge(filters: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of filters as sorted keys and counts."""
    keys, places = np.unique(np.concatenate([k for k, _ in filters]), return_inverse=True)
    counts = np.zeros(len(keys), np.uint64)
    np.add.at(counts, places, np.concatenate([c for _, c in filters]))
    return keys, counts


def _texts(chunk: chunks.Chunk) -> Iterator[tuple[bytes, int]]:
    """Every text without its blanks, and the code points that it has with them."""
    for start, end in zip(chunk.starts[:-1].tolist(), chunk.starts[1:].tolist(), strict=True):
        raw = chunk.bytes[start:end]
        following = int(np.count_nonzero((chunk.data[start:end] & 0xC0) == 0x80))
        yield raw.translate(None, BLANK_BYTES), end - start - following


def fingerprints(chunk: chunks.Chunk, print_bits: int) -> np.ndarray:
    """The leading print_bits of a 64-bit hash of every text; fewer bits make collisions, which the bytes settle."""
    return np.array([xxhash.xxh64_intdigest(t) for t, _ in _texts(chunk)], np.uint64) & np.uint64((1 << 64) - (1 << 64 - print_bits))


_FILTERS = "bucket long, chunk_id long, filter binary"
_ANSWERS = "chunk_id long, bucket long, shared binary"


def _filters(bits: int, print_bits: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for chunk in chunks.opened(frame):
                keys, counts = np.unique(fingerprints(chunk, print_bits), return_counts=True)
                heads = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)
                at = np.append(np.flatnonzero(np.diff(heads, prepend=np.uint64(1 << 63))), len(keys))
                parts = [(int(heads[a]), chunk.chunk_id, QuotientFilter.build(keys[a:b], counts[a:b], bits).to_bytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pd.DataFrame(parts, columns=["bucket", "chunk_id", "filter"])

    return run


def _merged(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """For the filter of each chunk, which of its entries count above one in the sum of all."""
    found = [QuotientFilter.from_bytes(x) for x in frame["filter"]]
    parts = [(f.keys(int(key[0])), f.counts) for f in found]
    keys, counts = merge(parts)
    shared = [np.packbits(counts[np.searchsorted(keys, k)] > 1).tobytes() for k, _ in parts]
    return pd.DataFrame({"chunk_id": frame["chunk_id"], "bucket": frame["bucket"], "shared": shared})


_ROUTED = "fp binary, text binary, n_points long, no_id int, doc_id long, chunk_id long, at int, n long"
_ROWS = "doc_id long, chunk_id long, at int, text_sha256 binary, shared boolean"


def _shared(chunk: chunks.Chunk, answers: pd.DataFrame, bits: int, print_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of every text of the chunk, and whether it counts above one."""
    prints = fingerprints(chunk, print_bits)
    keys = np.unique(prints)
    heads = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)
    told = [np.unpackbits(np.frombuffer(r.shared, np.uint8), count=int(np.count_nonzero(heads == np.uint64(r.bucket)))) for r in answers.sort_values("bucket").itertuples(index=False)]
    return prints, np.concatenate(told).astype(bool)[np.searchsorted(keys, prints)]


def _no_id(chunk: chunks.Chunk) -> list[int]:
    return chunk.no_id.astype(int).tolist()


def _routed(bits: int, print_bits: int):
    def run(key: tuple, frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        best: dict[bytes, tuple] = {}
        for chunk in chunks.opened(frame):
            prints, shared = _shared(chunk, answers, bits, print_bits)
            for at, ((text, n_points), doc_id, none, goes) in enumerate(zip(_texts(chunk), chunk.doc_ids.tolist(), _no_id(chunk), shared.tolist(), strict=True)):
                if goes:
                    rank = (-n_points, none, doc_id, at)
                    held = best.get(text)
                    best[text] = (min(held[0], rank), held[1] + 1, held[2]) if held else (rank, 1, prints[at].tobytes())
        rows = [(fp, text, -r[0], r[1], None if r[1] else r[2], key[0], r[3], n) for text, (r, n, fp) in best.items()]
        return pd.DataFrame(rows, columns=["fp", "text", "n_points", "no_id", "doc_id", "chunk_id", "at", "n"]).astype({"doc_id": "Int64"})

    return run


def _every(bits: int, print_bits: int):
    def run(key: tuple, frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for chunk in chunks.opened(frame):
            _, shared = _shared(chunk, answers, bits, print_bits)
            digests = [sha256(t).digest() for t, _ in _texts(chunk)]
            out.append(pd.DataFrame({"doc_id": chunks.ids_of(chunk), "chunk_id": key[0], "at": np.arange(len(digests)), "text_sha256": digests, "shared": shared}))
        return pd.concat(out)

    return run


def duplicates(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, per_bucket: int = PER_BUCKET, print_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs (doc_id, text)."""
    packed = chunks.pack(docs, chunk_bytes=chunk_bytes)
    n_rows = packed.agg(F.sum("n_docs")).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, n_rows) / per_bucket))))
    sent = packed.mapInPandas(_filters(bits, print_bits), _FILTERS)
    answers = written(sent.groupBy("bucket").applyInPandas(_merged, _ANSWERS), "dedup-answers")
    both = packed.groupBy("chunk_id").cogroup(answers.groupBy("chunk_id"))
    first = F.min(F.struct((-F.col("n_points")).alias("n"), "no_id", "doc_id", "chunk_id", "at")).alias("first")
    groups = both.applyInPandas(_routed(bits, print_bits), _ROUTED).groupBy("fp", "text").agg(first, F.sum("n").alias("size"))
    # the bytes have been compared; from here on a text is its digest
    groups = written(groups.select(F.unhex(F.sha2("text", 256)).alias("key"), "size", "first.doc_id", F.col("first.chunk_id").alias("_chunk"), F.col("first.at").alias("_at")), "dedup-groups")
    large = groups.where(F.col("size") * HOT >= n_rows).select(F.col("key").alias("_large"))  # at most HOT rows: sizes add up to n_rows at most
    is_large = F.col("_large").isNotNull()
    salts = F.explode(F.when(is_large, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("_salt")
    groups = groups.join(F.broadcast(large), F.col("key") == F.col("_large"), "left").select("key", "size", F.col("doc_id").alias("_keep"), "_chunk", "_at", salts)
    rows = both.applyInPandas(_every(bits, print_bits), _ROWS).join(F.broadcast(large), F.col("text_sha256") == F.col("_large"), "left")
    rows = rows.withColumn("salt", F.when(is_large, F.pmod(F.xxhash64("chunk_id", "at"), F.lit(SALTS))).otherwise(0).cast("int"))
    found = rows.join(groups, (F.col("text_sha256") == F.col("key")) & (F.col("salt") == F.col("_salt")), "left")
    alone = F.col("key").isNull()
    return found.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("_keep")).alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | ((F.col("chunk_id") == F.col("_chunk")) & (F.col("at") == F.col("_at")))).alias("kept"), F.lower(F.hex("text_sha256")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The distinct texts of docs: doc_id and group_size of the rows that stay."""
    return duplicates(docs).where("kept").select("doc_id", "group_size", "text_sha256")
