"""Language identification by a bidirectional gated recurrent network over bytes.

Two recurrent layers read windows of a text's UTF-8 bytes, one forwards and one backwards; every byte gets a
probability for each language from the two states beside it, and a document's probabilities are the means over all its
letter bytes.  Gates and candidates use piecewise linear forms (clip), which cost a pass instead of an exponential.  The
network is trained in numpy by backpropagation through time on windows of a bounded sample of labelled rows, and is a few
kilobytes that go to the tasks with the function.

Texts are read whole: they are cut into windows of WINDOW bytes with MARGIN bytes of their neighbours on each side as
context, all windows of a batch run side by side, and only a window's own bytes count.

Bound of the sample: PER_LANGUAGE rows a language, those with the smallest hash of their id, and WINDOWS_PER_ROW windows
from each, at hashed places over its whole text.  Languages are all that the labelled rows have.

Defined results: a null text, or one without a letter, gets `und` with score 0; rows with a null label are predicted but
not learned from; without any labelled row every text gets `und`; repeated rows get equal results; other columns are
left alone; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HIDDEN = 8
WINDOW = 96
MARGIN = 16
PER_LANGUAGE = 400
WINDOWS_PER_ROW = 4
EPOCHS = 6
BATCH = 128
RATE = 0.01
#: Windows that run side by side.
WIDE = 4096
UNKNOWN = "und"


def hard_sigmoid(x: np.ndarray) -> np.ndarray:
    return np.clip(0.25 * x + 0.5, 0, 1)


def hard_tanh(x: np.ndarray) -> np.ndarray:
    return np.clip(x, -1, 1)


@dataclass
class Network:
    """inputs: what each byte adds to the gates (update, reset) and the candidate; one set for each direction."""

    languages: list[str]
    inputs: list[np.ndarray]  # 2 x (257, 3H); byte 256 stands for no byte
    gates: list[np.ndarray]  # 2 x (H, 2H)
    candidate: list[np.ndarray]  # 2 x (H, H)
    out: np.ndarray  # (2H, L)
    bias: np.ndarray  # (L,)

    @staticmethod
    def fresh(languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        draw = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        return Network(languages, [draw(257, 3 * hidden, scale=0.4) for _ in "fb"], [draw(hidden, 2 * hidden, scale=0.3) for _ in "fb"], [draw(hidden, hidden, scale=0.3) for _ in "fb"], draw(2 * hidden, len(languages), scale=0.3), np.zeros(len(languages), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [*self.inputs, *self.gates, *self.candidate, self.out, self.bias]


def run_layer(net: Network, side: int, data: np.ndarray, keep: bool = False):
    """States of one direction over data (T, B), in reading order; with keep also what backpropagation needs."""
    hidden = net.candidate[side].shape[0]
    steps, width = data.shape
    table, gates, candidate = net.inputs[side], net.gates[side], net.candidate[side]
    states = np.empty((steps, width, hidden), np.float32)
    h = np.zeros((width, hidden), np.float32)
    kept = []
    for t in range(steps):
        x = table[data[t]]
        zr_in = x[:, : 2 * hidden] + h @ gates
        zr = hard_sigmoid(zr_in)
        z, r = zr[:, :hidden], zr[:, hidden:]
        c_in = x[:, 2 * hidden :] + (r * h) @ candidate
        c = hard_tanh(c_in)
        new = h + z * (c - h)
        if keep:
            kept.append((h, zr_in, z, r, c_in, c))
        states[t] = h = new
    return states, kept


def back_layer(net: Network, side: int, data: np.ndarray, kept: list, d_states: np.ndarray):
    """Gradients of inputs, gates and candidate of one direction."""
    hidden = net.candidate[side].shape[0]
    gates, candidate = net.gates[side], net.candidate[side]
    g_in, g_gates, g_cand = np.zeros_like(net.inputs[side]), np.zeros_like(gates), np.zeros_like(candidate)
    dh = np.zeros_like(d_states[0])
    for t in range(len(data) - 1, -1, -1):
        h, zr_in, z, r, c_in, c = kept[t]
        dh = dh + d_states[t]
        dc = dh * z * (np.abs(c_in) < 1)
        dz = dh * (c - h)
        d_rh = dc @ candidate.T
        dzr = np.concatenate([dz, d_rh * h], axis=1) * 0.25 * (np.abs(zr_in) < 2)
        g_cand += (r * h).T @ dc
        g_gates += h.T @ dzr
        np.add.at(g_in, data[t], np.concatenate([dzr, dc], axis=1))
        dh = dh * (1 - z) + d_rh * r + dzr @ gates.T
    return g_in, g_gates, g_cand


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def scores(net: Network, data: np.ndarray) -> np.ndarray:
    """Probabilities (T, B, L) of every position of data (T, B)."""
    f, _ = run_layer(net, 0, data)
    b, _ = run_layer(net, 1, data[::-1])
    hidden = f.shape[2]
    return softmax(f @ net.out[:hidden] + b[::-1] @ net.out[hidden:] + net.bias)


def train(languages: list[str], data: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Adam on the mean cross-entropy of all positions; data (N, T) bytes, 256 for none; label (N,)."""
    net = Network.fresh(languages, seed=seed)
    r = np.random.default_rng(seed)
    params = net.parameters()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    hidden, step = HIDDEN, 0
    for _ in range(epochs):
        order = r.permutation(len(data))
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            x = np.ascontiguousarray(data[rows].T)
            f, kept_f = run_layer(net, 0, x, keep=True)
            b, kept_b = run_layer(net, 1, x[::-1], keep=True)
            back = b[::-1]
            p = softmax(f @ net.out[:hidden] + back @ net.out[hidden:] + net.bias)
            p[:, np.arange(len(rows)), label[rows]] -= 1
            p[x == 256] = 0
            p /= max(1, (x != 256).sum())
            flat = p.reshape(-1, p.shape[2])
            g_out = np.concatenate([f.reshape(-1, hidden).T @ flat, back.reshape(-1, hidden).T @ flat])
            gf = back_layer(net, 0, x, kept_f, p @ net.out[:hidden].T)
            gb = back_layer(net, 1, x[::-1], kept_b, (p @ net.out[hidden:].T)[::-1])
            grads = [gf[0], gb[0], gf[1], gb[1], gf[2], gb[2], g_out, flat.sum(0)]
            size = np.sqrt(sum(float((g * g).sum()) for g in grads))
            step += 1
            for p_, g, m, v in zip(params, grads, first, second, strict=True):
                g = g * min(1.0, 1.0 / (size + 1e-9))
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                p_ -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of some texts with their margins (N, WINDOW + 2 MARGIN), the text of each, and its first byte."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    n = -(-lengths // WINDOW)
    text_of = np.repeat(np.arange(len(texts)), n)
    first = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
    gap = WINDOW + MARGIN  # no byte beyond a text is another's
    places = np.concatenate([[0], np.cumsum(lengths + gap)[:-1]]) + gap if len(texts) else np.zeros(0, np.int64)
    line = np.full(int(lengths.sum() + gap * (len(texts) + 1)), 256, np.int16)
    for at, t in zip(places.tolist(), texts, strict=True):
        line[at : at + len(t)] = np.frombuffer(t, np.uint8)
    start = places[text_of] + first - MARGIN
    return line[start[:, None] + np.arange(WINDOW + 2 * MARGIN)], text_of, first


#: Bytes that count: letters of ASCII and everything beyond ASCII.
_COUNTS = np.zeros(257, bool)
_COUNTS[65:91] = _COUNTS[97:123] = _COUNTS[128:256] = True


def predict(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities (texts, L) over the counting bytes; zero where there is none."""
    total, count = np.zeros((len(texts), len(net.languages))), np.zeros(len(texts))
    data, text_of, _ = windows(texts)
    for i in range(0, len(data), WIDE):
        part = np.ascontiguousarray(data[i : i + WIDE].T)
        p = scores(net, part)[MARGIN : MARGIN + WINDOW]
        own = _COUNTS[part[MARGIN : MARGIN + WINDOW]]
        np.add.at(total, text_of[i : i + WIDE], (p * own[:, :, None]).sum(0))
        np.add.at(count, text_of[i : i + WIDE], own.sum(0))
    return total / np.maximum(count, 1)[:, None]


def picked(text: str, most: int = WINDOWS_PER_ROW) -> np.ndarray:
    """At most so many of the windows of a whole text: those whose number has the smallest hash with the text's."""
    raw = text.encode("utf-8", "surrogatepass")
    found, _, _ = windows([raw])
    own = xxhash.xxh64_intdigest(raw)
    order = sorted(range(len(found)), key=lambda k: xxhash.xxh64_intdigest(k.to_bytes(8, "little"), own))
    return found[sorted(order[:most])]


def sample(docs: DataFrame, learnable: Column, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, lang, windows (bytes): at most per_language labelled rows of each language, those with the smallest hash of their
    id; of rows that share an id, or have none, those with the smallest hash of their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [picked(t).astype(np.int16).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.binary())], ["doc_id", "lang", "windows"])

    labelled = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    # a row is its id and its text, so rows that share an id, or have none, are told apart; the cut is taken in hashed parts
    # of a language first, so that a language of most rows is not one task's
    own = [F.xxhash64("doc_id").alias("key"), F.xxhash64("text").alias("print")]
    order = ["key", F.col("doc_id").asc_nulls_last(), "print"]
    keyed = labelled.select("doc_id", "lang", *own)
    part = W.partitionBy("lang", F.pmod(F.xxhash64("key", "print"), F.lit(64))).orderBy(*order)
    few = keyed.withColumn("n", F.row_number().over(part)).where(F.col("n") <= per_language)
    few = few.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("n") <= per_language)
    # equal rows are one entry with its count, and each task hands on one of them
    few = few.groupBy(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), F.col("print").alias("_print")).agg(F.count(F.lit(1)).cast("int").alias("_times"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang")) & (F.xxhash64("text") == F.col("_print"))
    taken = labelled.join(F.broadcast(few), same).dropDuplicates(["doc_id", "lang", "_print"])  # per_language rows a language at most
    taken = taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return taken.select("doc_id", "lang", "text").mapInArrow(run, "doc_id long, lang string, windows binary")


def learn(docs: DataFrame, learnable: Column, per_language: int = PER_LANGUAGE, epochs: int = EPOCHS) -> Network | None:
    """Trains on the driver, from a sample of at most per_language rows a language."""
    rows = sorted((r.lang, -1 if r.doc_id is None else r.doc_id, bytes(r.windows)) for r in sample(docs, learnable, per_language).collect())
    languages = sorted({lang for lang, _, _ in rows})
    if not languages:
        return None
    data, label = [], []
    for lang, _, own in rows:
        data.append(np.frombuffer(own, np.int16).reshape(-1, WINDOW + 2 * MARGIN))
        label += [languages.index(lang)] * len(data[-1])
    return train(languages, np.concatenate(data), np.array(label), epochs)


def predictions(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                lettered = pc.fill_null(pc.match_substring_regex(batch.column(1), r"\p{L}"), False).to_numpy(zero_copy_only=False)
                names, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
                rows = np.flatnonzero(lettered)
                if net is not None and len(rows):
                    p = predict(net, [x.encode("utf-8", "surrogatepass") for x in batch.column(1).take(pa.array(rows)).to_pylist()])
                    best = p.argmax(1)
                    score[rows] = np.clip(p[np.arange(len(rows)), best], 0, 1)
                    for i, k in zip(rows.tolist(), best.tolist(), strict=True):
                        names[i] = net.languages[k]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, learnable: Column) -> DataFrame:
    """Learns from the rows of docs where learnable holds and predicts all of them."""
    return predictions(docs, learn(docs, learnable))
