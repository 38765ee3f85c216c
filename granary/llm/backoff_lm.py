"""Language-model scoring with a weighted backoff automaton.

The model is a smoothed bigram model over whole words.  Its root state reads a word w with probability
p(w) = (c(w) + 1) / (N + V + 1), where a word that was never seen stands for one more type; a state for each seen word u
has an arc for each word that was seen after it, with weight (c(u, w) + MU * p(w)) / (c(u) + MU), and a failure arc to the
root with weight MU / (c(u) + MU).  That sums to one in every state.  A text is read from left to right once: the state
is carried from word to word, failure arcs are taken where no arc reads the word, and log-probabilities add up.

Counts cover every document that is not held out, and the automaton has as many arcs as the corpus has distinct bigrams,
so no task holds it whole.  Each chunk of documents (see `chunks`) exchanges its distinct words and bigrams for their
counts over the whole corpus and builds the part of the automaton that its own texts can reach: the same states, arcs and
weights that the whole automaton would show them.  Documents of a chunk are read side by side, one word a step.

Words are known by 64-bit hashes: two of V words share one with a chance of about V^2 / 2^65.

Defined results: a null or empty text is one end token; a held_out of null counts as not held out; null ids stay null;
equal rows count as often as they occur; other columns are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.bytes_np import LOWER, Rolling, mixed, word_spans
from granary.llm.chunks import Chunk, Merged, answered, ids_of, n_buckets, opened, pack, sent, squeezed
from granary.llm.common import written

#: Weight of the unigram distribution in a state, in tokens.
MU = 100.0
#: Hashes of the end of a text and of the state before its first word; no word's hash is so small by design of chance.
END, START = np.uint64(1), np.uint64(2)


class BackoffAutomaton:
    """States 0 (root) .. S-1 over words 0 .. U-1; arcs in the order of state * U + word; the root reads every word.

    arc_next and root_next hold the state after a word; fail_next the state that a failure arc leads to.
    """

    def __init__(self, n_words: int, arc_keys: np.ndarray, arc_weight: np.ndarray, arc_next: np.ndarray, root_weight: np.ndarray, root_next: np.ndarray, fail_weight: np.ndarray, fail_next: np.ndarray) -> None:
        self.n_words = n_words
        self.arc_keys, self.arc_weight, self.arc_next = arc_keys, arc_weight, arc_next
        self.root_weight, self.root_next = root_weight, root_next
        self.fail_weight, self.fail_next = fail_weight, fail_next

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights of reading one word in each of many states, and the states after it."""
        weight = np.zeros(len(state))
        after = np.empty(len(state), np.int64)
        left = np.arange(len(state))
        s, w = state, word
        while len(left):
            root = s == 0
            at = left[root]
            weight[at] += self.root_weight[w[root]]
            after[at] = self.root_next[w[root]]
            left, s, w = left[~root], s[~root], w[~root]
            if not len(left):
                break
            key = s * self.n_words + w
            place = np.minimum(np.searchsorted(self.arc_keys, key), max(len(self.arc_keys) - 1, 0))
            hit = self.arc_keys[place] == key if len(self.arc_keys) else np.zeros(len(key), bool)
            at = left[hit]
            weight[at] += self.arc_weight[place[hit]]
            after[at] = self.arc_next[place[hit]]
            left, s, w = left[~hit], s[~hit], w[~hit]
            weight[left] += self.fail_weight[s]
            s = self.fail_next[s]
        return weight, after

    def read(self, words: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
        """Log-probability of each text words[first[d]:first[d + 1]], all from the state start."""
        lengths = np.diff(first)
        order = np.argsort(-lengths, kind="stable")
        sizes, begins = lengths[order], first[:-1][order]
        total = np.zeros(len(lengths))
        state = np.full(len(lengths), start, np.int64)
        # texts that still have a word at step t are the first so many of the order
        alive = len(sizes) - np.searchsorted(sizes[::-1], np.arange(int(sizes[0]) if len(sizes) else 0), "right")
        for t, n in enumerate(alive.tolist()):
            weight, state[:n] = self.step(state[:n], words[begins[:n] + t])
            total[:n] += weight
        out = np.empty(len(lengths))
        out[order] = total
        return out


class Counted:
    """The distinct words and bigrams of a chunk, in a fixed order, with how often its learned documents have them."""

    def __init__(self, chunk: Chunk) -> None:
        low = LOWER[chunk.data]
        begin, end, first = word_spans(low, chunk.starts)
        n_docs = len(chunk.lengths)
        per_doc = np.diff(first) + 1
        self.first = np.concatenate([[0], np.cumsum(per_doc)])
        toks = np.full(int(self.first[-1]), END, np.uint64)
        inner = np.ones(len(toks), bool)
        inner[self.first[1:] - 1] = False
        toks[inner] = Rolling(low).spans(begin, end)
        self.learned = np.repeat(~chunk.flag, per_doc)
        self.words, self.ids = np.unique(toks, return_inverse=True)
        n = len(self.words)
        before = np.full(len(toks), n, np.int64)  # n: the start
        before[1:] = self.ids[:-1]
        before[self.first[:-1]] = n
        pair = before * np.int64(n) + self.ids
        self.pairs, self.pair_of = np.unique(pair, return_inverse=True)
        known = np.append(self.words, START)
        pair_keys = mixed(mixed(known[self.pairs // n]) + self.words[self.pairs % n] * np.uint64(3))
        keys = np.concatenate([mixed(self.words ^ np.uint64(5)), pair_keys])
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.n_docs = n_docs

    def counts(self) -> np.ndarray:
        """Of the sorted keys, in the chunk's learned documents."""
        words = np.bincount(self.ids, weights=self.learned, minlength=len(self.words))
        pairs = np.bincount(self.pair_of, weights=self.learned, minlength=len(self.pairs))
        return np.concatenate([words, pairs]).astype(np.int64)[self.order]


_SENT = "bucket int, chunk_id long, keys binary, counts binary, single binary"
_ANSWER = "chunk_id long, bucket int, answer binary, n_tokens long, n_types long"
_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, held_out: Column, mu: float = MU) -> DataFrame:
    """Scores every row of docs (doc_id, text) with a model learned from those where held_out is not true."""
    spark = docs.sparkSession
    chunks = pack(docs, held_out)
    buckets = n_buckets(spark, chunks)

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for chunk in opened(frame):
            c = Counted(chunk)
            rows += sent(chunk.chunk_id, c.keys, buckets, counts=c.counts(), single=(c.order < len(c.words)))
        return pd.DataFrame(rows, columns=["bucket", "chunk_id", "keys", "counts", "single"])

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        m = Merged(frame)
        total = np.bincount(m.places, weights=m.column("counts", np.int64), minlength=len(m.keys)).astype(np.int64)
        single = np.zeros(len(m.keys), bool)
        single[m.places] = m.column("single", bool)
        out = m.answers(total[m.places])
        out["n_tokens"] = out["n_types"] = 0
        out.loc[0, ["n_tokens", "n_types"]] = [int(total[single].sum()), int((total[single] > 0).sum())]
        return out

    counted = chunks.groupBy("chunk_id").applyInPandas(count, _SENT)
    answers = written(counted.groupBy("bucket").applyInPandas(merge, _ANSWER), "lm-counts")
    n_all, v_all = answers.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_types"), F.lit(0))).first()
    n_train = chunks.select("chunk_id", "n_docs", "flags")

    def learned_docs(batches):
        for frame in batches:
            yield pd.DataFrame({"n": [int((np.frombuffer(f, np.uint8) & 1 == 0).sum()) for f in frame["flags"]]})

    starts = n_train.select("flags").mapInPandas(learned_docs, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def read(frame: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame(columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])]
        for chunk in opened(frame):
            c = Counted(chunk)
            value = np.empty(len(c.keys), np.int64)
            value[c.order] = answered(got, np.int64)
            n = len(c.words)
            single, double = value[:n], value[n:]
            automaton, start = _automaton(c, single, double, int(n_all), int(v_all), int(starts), mu)
            of = np.repeat(np.arange(c.n_docs), np.diff(c.first))
            base = np.bincount(of, weights=automaton.root_weight[c.ids], minlength=c.n_docs)
            out.append(pd.DataFrame({
                "doc_id": ids_of(chunk), "held_out": chunk.flag, "n_tokens": np.diff(c.first),
                "n_known": np.bincount(of, weights=single[c.ids] > 0, minlength=c.n_docs).astype(np.int64),
                "train_tokens": int(n_all), "base_score": base, "score": automaton.read(c.ids, c.first, start),
            }))
        return pd.concat(out[1:] or out)

    return chunks.groupBy("chunk_id").cogroup(answers.groupBy("chunk_id")).applyInPandas(read, _OUT)


def _automaton(c: Counted, single: np.ndarray, double: np.ndarray, n_all: int, v_all: int, starts: int, mu: float) -> tuple[BackoffAutomaton, int]:
    """The states and arcs that the chunk's texts can reach, and the start state."""
    n = len(c.words)
    root = (single + 1) / (n_all + v_all + 1)
    seen = np.append(single, starts)  # of each context; the last is the start
    state_of = np.where(seen > 0, np.cumsum(seen > 0), 0)  # a context that was never seen has no state of its own
    total = np.concatenate([[1.0], seen[seen > 0]])
    fail = np.log10(mu / (total + mu))
    context, word = c.pairs // n, c.pairs % n
    arcs = double > 0
    weight = np.log10((double[arcs] + mu * root[word[arcs]]) / (seen[context[arcs]] + mu))
    keys = state_of[context[arcs]] * n + word[arcs]  # contexts ascend, so do their states and the keys
    after = state_of[:n]
    return BackoffAutomaton(n, keys, weight, after[word[arcs]], np.log10(root), after, fail, np.zeros(len(fail), np.int64)), int(state_of[n])
