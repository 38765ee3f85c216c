"""Packed chunks of documents, and an exchange of keys between them.

Operators that must look up every n-gram of a large corpus cannot afford a row for each.  A chunk is some megabytes of
whole documents, packed into one row of a table in the shared folder.  Its task reduces the chunk to its distinct keys and
sends them, sorted, as one binary row to each of P buckets; a bucket merges what all chunks sent and answers each with
one row aligned to its keys.  So a key that is in every document costs one entry a chunk, buckets are even because keys
are hashes, and the shuffle carries bytes, not rows.  The table is bucketed by chunk, so answers meet their chunk without
moving texts again.

Chunk and bucket sizes follow from the input: there are as many buckets as chunks, and a chunk grows with the root of the
input, from CHUNK_BYTES to MOST_CHUNK_BYTES (one longer document stands alone), so that rows of the exchange stay large
and a bucket stays within a task's memory.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import scratch_path

CHUNK_BYTES = 4_000_000
MOST_CHUNK_BYTES = 64_000_000
#: Bit of a document's flags: its id is null.
NO_ID = 128

_SCHEMA = "chunk_id long, n_docs int, n_bytes long, doc_ids binary, flags binary, lengths binary, data binary"


def chunk_size(docs: DataFrame) -> int:
    """From the bytes that the texts have, which are counted."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    return int(min(MOST_CHUNK_BYTES, max(CHUNK_BYTES, 250 * size**0.5)))


def pack(docs: DataFrame, flag: Column | None = None, chunk_bytes: int | None = None) -> DataFrame:
    """The chunk table of docs (doc_id, text): ids, flags (bit 0: flag, NO_ID), byte lengths and all texts in a row."""
    chunk_bytes = chunk_bytes or chunk_size(docs)
    one = (F.lit(False) if flag is None else F.coalesce(flag, F.lit(False))).cast("int")
    flagged = docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), "text", (one + F.when(F.col("doc_id").isNull(), NO_ID).otherwise(0)).alias("flag"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, flags, texts, size = [], [], [], 0
        number = itertools.count()

        def emit() -> pa.RecordBatch:
            key = np.array(ids, np.int64).tobytes()
            lengths = np.array([len(t) for t in texts], np.int64)
            # named by its task and its number there: equal documents in two tasks are still two chunks
            chunk = (TaskContext.get().partitionId() << 32) + next(number)
            data = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
            return pa.RecordBatch.from_pylist([{"chunk_id": chunk, "n_docs": len(ids), "n_bytes": size, "doc_ids": key, "flags": np.array(flags, np.uint8).tobytes(), "lengths": lengths.tobytes(), "data": data}], schema=_arrow())

        for batch in batches:
            for i, t, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = (t or "").encode("utf-8", "surrogatepass")
                if ids and size + len(raw) > chunk_bytes:
                    yield emit()
                    ids, flags, texts, size = [], [], [], 0
                ids.append(i)
                flags.append(f)
                texts.append(raw)
                size += len(raw)
        if ids:
            yield emit()

    packed = flagged.mapInArrow(run, _SCHEMA)
    return bucketed(packed, "chunk_id", "chunks")


def _arrow() -> pa.Schema:
    return pa.schema([("chunk_id", pa.int64()), ("n_docs", pa.int32()), ("n_bytes", pa.int64()), ("doc_ids", pa.binary()), ("flags", pa.binary()), ("lengths", pa.binary()), ("data", pa.binary())])


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """df as a table in the shared folder, bucketed by key: joins and groups by the key need no shuffle of it."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    name = f"granary_{label}_{uuid.uuid4().hex}"
    df.write.option("path", scratch_path(spark, label)).option("compression", "none").bucketBy(n, key).saveAsTable(name)
    return spark.table(name)


class Chunk:
    """One row of the chunk table, opened."""

    def __init__(self, row) -> None:
        self.chunk_id = int(row.chunk_id)
        self.doc_ids = np.frombuffer(row.doc_ids, np.int64)
        flags = np.frombuffer(row.flags, np.uint8)
        self.flag, self.no_id = (flags & 1).astype(bool), (flags & NO_ID) > 0
        self.lengths = np.frombuffer(row.lengths, np.int64)
        self.starts = np.zeros(len(self.lengths) + 1, np.int64)
        np.cumsum(self.lengths, out=self.starts[1:])
        self.bytes = zstandard.ZstdDecompressor().decompress(row.data, max_output_size=max(1, int(row.n_bytes)))
        self.data = np.frombuffer(self.bytes, np.uint8)


def opened(frame: pd.DataFrame) -> Iterator[Chunk]:
    for row in frame.itertuples(index=False):
        yield Chunk(row)


def n_buckets(spark: SparkSession, chunks: DataFrame) -> int:
    """About as many buckets as chunks: each then gets about what one chunk sends."""
    return max(1, chunks.count())


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each 64-bit key by its upper half; monotonous, so sorted keys fall into slices."""
    return ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def slices(sorted_keys: np.ndarray, n: int) -> np.ndarray:
    """Where each bucket's slice of sorted keys begins; n + 1 places."""
    bounds = bucket_of(sorted_keys, n)
    return np.searchsorted(bounds, np.arange(n + 1, dtype=np.uint64))


def squeezed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def restored(blob: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype)


def ids_of(chunk: Chunk) -> pd.Series:
    return pd.Series(chunk.doc_ids).astype("Int64").mask(chunk.no_id)


def sent(chunk_id: int, keys: np.ndarray, buckets: int, **columns: np.ndarray) -> list[dict]:
    """One row for each bucket with a part of sorted keys; columns: further arrays aligned to the keys."""
    at = slices(keys, buckets)
    rows = []
    for b in np.flatnonzero(np.diff(at)).tolist():
        part = slice(at[b], at[b + 1])
        rows.append({"bucket": b, "chunk_id": chunk_id, "keys": keys[part].tobytes()} | {k: squeezed(v[part]) for k, v in columns.items()})
    return rows


class Merged:
    """What all chunks sent to one bucket: distinct keys, and for each sent key its place among them."""

    def __init__(self, frame: pd.DataFrame) -> None:
        self.rows = frame
        parts = [np.frombuffer(k, np.uint64) for k in frame["keys"]]
        self.lengths = np.array([len(p) for p in parts])
        self.ends = np.cumsum(self.lengths)
        self.keys, self.places = np.unique(np.concatenate(parts), return_inverse=True)

    def column(self, name: str, dtype) -> np.ndarray:
        return np.concatenate([restored(x, dtype) for x in self.rows[name]])

    def answers(self, values: np.ndarray) -> pd.DataFrame:
        """values (one for each sent key) as one row for each chunk."""
        blobs = [squeezed(values[e - n : e]) for e, n in zip(self.ends, self.lengths, strict=True)]
        return pd.DataFrame({"chunk_id": self.rows["chunk_id"].to_numpy(), "bucket": self.rows["bucket"].to_numpy(), "answer": blobs})


def answered(frame: pd.DataFrame, dtype) -> np.ndarray:
    """The answers to one chunk, in the order of its keys."""
    frame = frame.sort_values("bucket")
    return np.concatenate([restored(x, dtype) for x in frame["answer"]]) if len(frame) else np.empty(0, dtype)
