"""Token ids in a grammar-compressed container (Re-Pair).

Texts are encoded with a public tokenizer and each document ends with the id END.  Documents are dealt by ranges of their
ids; the tasks read their range in order and close a shard every SHARD_IDS ids.  In a shard the most frequent pairs of
neighbouring symbols are replaced by new symbols, again and again, until no pair occurs LEAST times: a round takes all
pairs that are frequent enough and do not overlap with a more frequent one, so a shard needs rounds, not one pass for each
rule.  Pairs of old symbols only become rarer, so a later round looks only at those that were frequent and at the
neighbours of new symbols.  A shard's row in the container has

* rules: pairs of symbols, little-endian unsigned 32-bit; rule k defines symbol FIRST + k from earlier symbols,
* lengths: for every rule, into how many ids it expands,
* sequence: the remaining symbols, little-endian unsigned 32-bit,
* doc_ids and ends: the documents in ascending order and where each ends, counted in ids.

`expand` decodes a whole shard; `decode_slice` uses the expansion lengths to decode only the symbols that cover one
document, and `fetch` does so for a document of the container.

Ranges follow from the counted bytes of the texts; ids that repeat are dealt by a hash of their texts too, so a hot id is
many tasks' work.  The starts of shards are sums over the shards of a range and over the table of ranges.

Defined results: a null or empty text has only its END; rows with equal ids stand in the order of their texts' hashes; a
null id comes first; a text with one of the tokenizer's added tokens is encoded whole, as the library does; other columns
are left alone; an empty table gives an empty container.
"""

from __future__ import annotations

import gc
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from granary.llm.bytes_np import ranges
from granary.llm.chunks import restored, squeezed
from granary.llm.common import scratch_path

END = 0
#: fixed value: size of the vocabulary; symbols from here on are rules
FIRST = 50_257
LEAST = 64
#: Ids after which a shard is closed: some 60 bytes of memory each.
SHARD_IDS = 1 << 21
#: Bytes of text in a range: at least, at most; in between a range grows with the root of the input.
RANGE_BYTES = (16_000_000, 256_000_000)
#: Words that a worker remembers.
REMEMBERED = 800_000
#: Marks that may end a word.
MARKS = ".,;:!?)]}*#$%&|\""

# the byte-level form of text: printable bytes stand for themselves, the others for the letters from U+0100 on
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_FORM = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}
#: Remembered for parts with white space at an edge; no encoding has one byte.
UNSAFE = b"?"

_WORKER: dict[str, object] = {}


class Encoder:
    """The tokenizer with a memory for words.

    Its pre-tokenizer never joins a letter with the blank before the next word's blank, so the parts of a text between
    single blanks can be encoded one by one, each with its blank before it.  That fails only where white space stands at
    a part's edge; such a text is encoded whole.  New parts are encoded as one line: each has exactly one blank, in its
    first token, so the tokens that begin with a blank show where the next part begins.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # the memory below takes its place
        self.memory: dict[str, bytes] = {}
        self.openings: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True  # the byte-level form of a blank

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def opening(self, text: str) -> bytes:
        """The first part of a text, which has no blank before it."""
        found = self.openings.get(text)
        if found is None:
            if len(self.openings) >= REMEMBERED // 4:
                self.openings.clear()
            found = self.openings[text] = self.whole(text)
        return found

    def learn(self, new: set[str]) -> None:
        if len(self.memory) + len(new) > REMEMBERED:
            self.memory.clear()
        plain, ended = set(), []
        for part in new:
            if not part or part[0].isspace() or part[-1].isspace():
                self.memory[part] = UNSAFE
                continue
            # marks after a letter or digit are a token run of their own, so the word is known without them too
            word = part.rstrip(MARKS)
            if len(word) < len(part) and word and word[-1].isalnum():
                ended.append((part, word, part[len(word) :]))
                if word not in self.memory:
                    plain.add(word)
            else:
                plain.add(part)
        letters = [x for x in plain if x.isalpha()]
        tokenize, memory = self.model.tokenize, self.memory
        for word in letters:  # letters alone are one pre-token: the model can take them as they are
            shown = "\u0120" + word if word.isascii() else (" " + word).encode().decode("latin-1").translate(BYTE_FORM)
            memory[word] = array("I", [t.id for t in tokenize(shown)]).tobytes()
        plain = [x for x in plain if not x.isalpha()]
        lines = [plain[i : i + 1000] for i in range(0, len(plain), 1000)]
        encoded = self.tokenizer.encode_batch_fast([" " + " ".join(line) for line in lines], add_special_tokens=False)
        for line, x in zip(lines, encoded, strict=True):
            ids = np.array(x.ids, "<u4")
            at = np.flatnonzero(self.begins[ids])
            if len(at) != len(line):
                raise ValueError("the tokenizer joins words")
            raw, ends = ids.tobytes(), (4 * np.append(at, len(ids))).tolist()
            self.memory.update(zip(line, (raw[a:b] for a, b in zip(ends, ends[1:], strict=False)), strict=True))
        for part, word, marks in ended:
            self.memory[part] = self.memory[word] + self.opening(marks)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        gc.disable()  # nothing here is part of a cycle
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        split = [(t or "").split(" ") for t in texts]
        firsts = [parts.pop(0) for parts in split]
        known = [list(map(self.memory.get, parts)) for parts in split]
        gaps = [[i for i, x in enumerate(own) if x is None] if None in own else [] for own in known]
        self.learn({parts[i] for parts, at in zip(split, gaps, strict=True) for i in at})
        out = []
        for text, first, parts, own, at in zip(texts, firsts, split, known, gaps, strict=True):
            for i in at:
                own[i] = self.memory[parts[i]]
            if not text:
                out.append(b"")
            elif UNSAFE in own or not first or first[0].isspace() or first[-1].isspace() or any(x in text for x in self.added):
                out.append(self.whole(text))
            else:
                out.append(self.opening(first) + b"".join(own))
        return out


def _encoder(path: str) -> Encoder:
    if _WORKER.get("path") != path:
        _WORKER.update(path=path, encoder=Encoder(path))
    return _WORKER["encoder"]


def repair(ids: np.ndarray, first: int = FIRST, least: int = LEAST, separator: int | None = END) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rules (n x 2), expansion lengths and the remaining sequence of one shard.  Pairs never hold the separator."""
    n = len(ids)
    seq = np.append(ids, 0).astype(np.uint32)  # a place behind the last, which begins no pair
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    gone = np.zeros(n + 1, bool)
    gone[n] = True
    rules, lengths = [np.empty((0, 2), np.uint32)], np.ones(first, np.int64)
    # places whose pair may be frequent: all of them at first
    places, left, right = np.arange(n - 1, dtype=np.int32), seq[: max(n - 1, 0)], seq[1 : max(n, 1)]
    while True:
        if separator is not None:
            inner = np.flatnonzero((left != separator) & (right != separator))
            places, left, right = places[inner], left[inner], right[inner]
        # in a run of equal symbols every second place begins a pair
        equal = np.flatnonzero(left == right)
        if len(equal):
            follows = np.concatenate([[False], after[places[equal[:-1]]] == places[equal[1:]]])
            nth = np.arange(len(equal))
            drop = equal[(nth - np.maximum.accumulate(np.where(follows, 0, nth))) & 1 == 1]
            places, left, right = np.delete(places, drop), np.delete(left, drop), np.delete(right, drop)
        key = (left.astype(np.uint64) << np.uint64(32)) | right
        here = _counts(key, least)
        often = np.flatnonzero(here >= least)
        places, key, here = places[often], key[often], here[often]
        if not len(places):
            break
        # an occurrence is replaced if its pair is more frequent than those it overlaps with (ties: the earlier place)
        near = after[places[:-1]] == places[1:]
        wins = np.ones(len(places), bool)
        wins[1:] &= ~near | (here[1:] > here[:-1])
        wins[:-1] &= ~near | (here[:-1] >= here[1:])
        chosen, which, times = np.unique(key[wins], return_inverse=True, return_counts=True)
        worth = times >= max(2, least // 4)
        if not worth.any():
            worth = times >= 2
        if not worth.any():
            break
        number = np.cumsum(worth) - 1
        kept = worth[which]
        at, which = places[wins][kept], number[which[kept]]
        chosen = chosen[worth]
        new = np.stack([chosen >> np.uint64(32), chosen & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
        seq[at] = len(lengths) + which
        lengths = np.concatenate([lengths, lengths[new[:, 0]] + lengths[new[:, 1]]])
        rules.append(new)
        second = after[at]
        gone[second] = True
        after[at] = after[second]
        before[after[second]] = at
        # frequent pairs that were not touched, and the pairs beside new symbols
        beside = before[at]
        places = np.sort(np.concatenate([places[~gone[places]], beside[beside >= 0], at]))
        places = places[np.concatenate([[True], places[1:] != places[:-1]]) & (after[places] < n)]
        left, right = seq[places], seq[after[places]]
    return np.concatenate(rules), lengths[first:], seq[~gone]


def _counts(key: np.ndarray, least: int) -> np.ndarray:
    """How often each key occurs; 0 for some that occur less than `least` times.

    Keys fall into bins.  Bins that are too small hold no frequent key, bins of one key are its count, others are sorted.
    """
    if len(key) < 1 << 16:
        _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
        return n[inverse]
    out = np.zeros(len(key), np.int64)
    bins = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int32)
    size = np.bincount(bins, minlength=1 << 21)
    rest = np.flatnonzero((size >= least)[bins])
    bins, key = bins[rest], key[rest]
    kept = np.zeros(1 << 21, np.uint64)
    kept[bins] = key
    mixed = np.zeros(1 << 21, bool)
    mixed[bins[kept[bins] != key]] = True
    several = mixed[bins]
    out[rest] = size[bins]
    _, inverse, n = np.unique(key[several], return_inverse=True, return_counts=True)
    out[rest[several]] = n[inverse]
    return out


def expand(seq: np.ndarray, rules: np.ndarray, first: int = FIRST) -> np.ndarray:
    """The ids of a sequence: every symbol's expansion stands once in a table, from which the sequence is gathered."""
    seq = np.asarray(seq, np.int64)
    parts: list[np.ndarray] = []
    one = np.arange(first, dtype=np.uint32)
    for a, b in rules.tolist():
        parts.append(np.concatenate([parts[x - first] if x >= first else one[x : x + 1] for x in (a, b)]))
    lengths = np.concatenate([np.ones(first, np.int64), np.fromiter(map(len, parts), np.int64, len(parts))])
    starts = np.cumsum(lengths) - lengths
    table = np.concatenate([one, *parts])
    return table[ranges(starts[seq], lengths[seq])]


def expansion_lengths(seq: np.ndarray, lengths: np.ndarray, first: int = FIRST) -> np.ndarray:
    out = np.ones(len(seq), np.int64)
    big = seq >= first
    out[big] = lengths[seq[big].astype(np.int64) - first]
    return out


def decode_slice(seq: np.ndarray, rules: np.ndarray, lengths: np.ndarray, start: int, stop: int, first: int = FIRST) -> np.ndarray:
    """Ids start..stop of a shard, expanding only the symbols that cover them."""
    ends = np.cumsum(expansion_lengths(seq, lengths, first))
    low, high = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
    before = int(ends[low - 1]) if low else 0
    return expand(seq[low:high], rules, first)[start - before : stop - before]


_SHARD = pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("n_ids", pa.int64()), ("rules", pa.binary()), ("lengths", pa.binary()), ("sequence", pa.binary()), ("doc_ids", pa.binary()), ("ends", pa.binary()), ("no_id", pa.binary()), ("first_id", pa.int64()), ("last_id", pa.int64())])
_SHARD_SQL = "shard long, part long, n_ids long, rules binary, lengths binary, sequence binary, doc_ids binary, ends binary, no_id binary, first_id long, last_id long"


def _shard(part: int, ids: list[int | None], parts: list[bytes]) -> pa.RecordBatch:
    line = np.frombuffer(b"".join(parts), "<u4")
    rules, lengths, seq = repair(line)
    known = [i for i in ids if i is not None]
    row = {
        "shard": TaskContext.get().partitionId(), "part": part, "n_ids": len(line),
        "rules": squeezed(rules.astype("<u4")), "lengths": squeezed(lengths), "sequence": squeezed(seq.astype("<u4")),
        "doc_ids": squeezed(np.array([i or 0 for i in ids], np.int64)), "ends": squeezed(np.cumsum([len(p) // 4 for p in parts], dtype=np.int64)),
        "no_id": squeezed(np.array([i is None for i in ids])), "first_id": known[0] if known else None, "last_id": known[-1] if known else None,
    }
    return pa.RecordBatch.from_pylist([row], schema=_SHARD)


def write(docs: DataFrame, path: str, tokenizer: str | None = None, shard_ids: int = SHARD_IDS, range_bytes: int | None = None) -> None:
    """Encodes docs (doc_id, text) and writes the container below path, one row a shard, in ascending doc_id order."""
    file = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long") + 1), F.lit(0))).first()[0]
    low, high = RANGE_BYTES
    n = max(1, -(-size // (range_bytes or int(min(high, max(low, 500 * size**0.5))))))
    order = [F.col("doc_id"), F.xxhash64("text")]
    dealt = docs.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(file)
        end = np.array([END], "<u4").tobytes()
        part, ids, parts, n_ids = 0, [], [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                for i, x in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                    ids.append(i)
                    parts.append(x + end)
                    n_ids += len(x) // 4 + 1
                    if n_ids >= shard_ids:
                        yield _shard(part, ids, parts)
                        part, ids, parts, n_ids = part + 1, [], [], 0
        if ids:
            yield _shard(part, ids, parts)

    dealt.mapInArrow(run, _SHARD_SQL).write.option("compression", "none").parquet(path)


def read(spark, path: str) -> DataFrame:
    """The container's shards with first_start, the ids of all shards before: sums in a range and over the table of ranges."""
    shards = spark.read.schema(_SHARD_SQL).parquet(path)
    sizes = shards.select("shard", "part", "n_ids")
    ranges_ = sizes.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    before = ranges_.select("shard", (F.sum("_n").over(W.orderBy("shard")) - F.col("_n")).alias("_before"))
    # ranges are RANGE_BYTES of text or more, so `before` is some megabytes for 100 TB; shards are more, and joined
    inner = F.sum("n_ids").over(W.partitionBy("shard").orderBy("part")) - F.col("n_ids")
    starts = sizes.withColumn("_inner", inner).join(F.broadcast(before), "shard")
    starts = starts.select(F.col("shard").alias("_shard"), F.col("part").alias("_part"), (F.col("_before") + F.col("_inner")).alias("first_start"))
    return shards.join(starts, (F.col("shard") == F.col("_shard")) & (F.col("part") == F.col("_part"))).drop("_shard", "_part")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of every shard its row, ids of documents (null where there is none), starts and ends, rules and sequence."""
    for batch in batches:
        for i in range(batch.num_rows):
            r = {k: batch.column(k)[i].as_py() for k in batch.schema.names}
            ends = restored(r["ends"], np.int64)
            doc = pa.array(restored(r["doc_ids"], np.int64), mask=restored(r["no_id"], bool))
            yield r, doc, np.concatenate([[0], ends[:-1]]), ends, restored(r["rules"], "<u4").reshape(-1, 2), restored(r["sequence"], "<u4")


def documents(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the decoded container."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, doc, starts, ends, rules, seq in _opened(batches):
            ids = expand(seq, rules).astype("<u4")
            if len(ids) != r["n_ids"]:
                raise ValueError(f"shard {r['shard']}.{r['part']} has {len(ids)} ids instead of {r['n_ids']}")
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([doc, pa.array(starts + r["first_start"]), pa.array(ends - starts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read(spark, path).drop("lengths", "first_id", "last_id").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(spark, path: str, doc_id: int) -> DataFrame:
    """doc_id and ids of the rows of one document: only the shards that may hold it are read, and only its symbols decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, doc, starts, ends, rules, seq in _opened(batches):
            lengths = restored(r["lengths"], np.int64)
            hits = [decode_slice(seq, rules, lengths, int(starts[i]), int(ends[i])).tolist() for i, d in enumerate(doc.to_pylist()) if d == doc_id]
            yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(hits), pa.int64()), pa.array(hits, pa.list_(pa.int64()))], ["doc_id", "ids"])

    shards = spark.read.schema(_SHARD_SQL).parquet(path)
    return shards.where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).mapInArrow(run, "doc_id long, ids array<long>")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes docs as a container in the shared folder and reads it back."""
    path = scratch_path(docs.sparkSession, "repair")
    write(docs, path, tokenizer)
    return documents(docs.sparkSession, path)
