"""Parts that need no Spark: index, grammar, automaton, network, hashes."""

import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import gru_langid
from granary.llm.backoff_lm import BackoffAutomaton
from granary.llm.bytes_np import Rolling, ranges, sliding_min
from granary.llm.decontaminate import AGREE, LEAST, MASKS, overlap, short_masks
from granary.llm.license_scan import TEMPLATES, Scanner, bigrams, dice
from granary.llm.repair_tokens import decode_slice, expand, repair
from granary.llm.rindex_dedup import RunLengthIndex, repeated


@given(st.binary(max_size=300), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_rolling(data, k):
    a = np.frombuffer(data, np.uint8)
    r = Rolling(a)
    seen = {}
    for i, h in enumerate(r.grams(k).tolist()):
        assert seen.setdefault(h, data[i : i + k]) == data[i : i + k]
    n = len(data)
    if n >= k:
        one = r.spans(np.array([0]), np.array([k]))[0]
        same = [i for i in range(n - k + 1) if data[i : i + k] == data[:k]]
        assert all(r.spans(np.array([i]), np.array([i + k]))[0] == one for i in same)


def test_rolling_over_blocks():
    data = np.random.default_rng(1).integers(0, 256, 200_000).astype(np.uint8)
    data[150_000:150_100] = data[10:110]
    r = Rolling(data)
    assert r.spans(np.array([10]), np.array([110]))[0] == r.spans(np.array([150_000]), np.array([150_100]))[0]
    g = r.grams(20)
    assert (g[10:90] == g[150_000:150_080]).all()


def test_sliding_min_and_ranges():
    h = np.array([5, 3, 4, 1, 9, 8, 7, 2])
    assert sliding_min(h, 3).tolist() == [min(h[i : i + 3]) for i in range(6)]
    assert ranges(np.array([4, 10]), np.array([2, 3])).tolist() == [4, 5, 10, 11, 12]


@given(st.lists(st.integers(0, 5), max_size=400), st.integers(2, 6))
@settings(max_examples=60, deadline=None)
def test_repair_round_trip(ids, least):
    ids = np.array(ids, np.uint32)
    rules, lengths, seq = repair(ids, first=6, least=least)
    assert (expand(seq, rules, 6) == ids).all()
    for k, (n, pair) in enumerate(zip(lengths, rules, strict=True)):
        assert n == len(expand(np.array([6 + k]), rules, 6)) and pair.max() < 6 + k
    if len(ids) > 3:
        assert (decode_slice(seq, rules, lengths, 1, len(ids) - 1, 6) == ids[1:-1]).all()


def test_repair_goes_to_the_end():
    for ids in ([1, 2, 3, 4] * 200, [5] * 700, [1, 2, 3, 4, 0, 5, 5, 5] * 90):
        rules, lengths, seq = repair(np.array(ids, np.uint32), first=10, least=8)
        assert (expand(seq, rules, 10) == ids).all()
        pairs = [(a, b) for a, b in zip(seq.tolist(), seq[1:].tolist(), strict=False) if a and b]
        # what no two places share is counted without overlaps: every second place of a run
        assert all(sum(1 for x in pairs if x == p) < (16 if p[0] == p[1] else 8) for p in set(pairs))
        assert 0 in ids or len(seq) < 16


def test_repair_of_many_kinds():
    r = np.random.default_rng(4)
    words = [r.integers(1, 60, int(r.integers(2, 9))) for _ in range(50)]
    ids = np.concatenate([words[int(k)] for k in r.integers(0, 50, 4000)] + [[0]]).astype(np.uint32)
    rules, lengths, seq = repair(ids, first=60, least=16)
    assert (expand(seq, rules, 60) == ids).all() and len(seq) + 2 * len(rules) < 0.4 * len(ids)


def laid(texts):
    """Texts in a row and where each begins."""
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def some_texts(r):
    alphabet = r.choice([b"ab", b"abc", bytes(range(255)), b"a"])
    base = [bytes(r.choice(alphabet) for _ in range(r.randint(1, 90))) for _ in range(6)]
    texts = [(r.choice(base) + r.choice(base))[r.randint(0, 3) :][: r.randint(1, 140)] or b"x" for _ in range(r.randint(1, 25))]
    return alphabet, texts


@pytest.mark.parametrize("seed", range(40))
def test_matching_statistics(seed):
    """Of texts that the index has and has not: lengths, places and smallest owners against plain search."""
    r = random.Random(seed)
    alphabet, texts = some_texts(r)
    owners = np.array([r.randint(-9, 30) for _ in texts])
    length = r.choice([8, 9, 13, 50])
    index = RunLengthIndex(*laid(texts), owners, length)
    asked = [bytes(r.choice(alphabet) for _ in range(r.randint(0, 60))) + r.choice(texts)[r.randint(0, 9) :] for _ in range(10)] + [b"\xfe\xfe", b""]
    data, starts = laid(asked)
    rows, places, lengths = index.match(data, starts)
    line = b"\xff".join(texts) + b"\xff"
    for j, t in enumerate(asked):
        for p in range(len(t)):
            n = 0
            while p + n < len(t) and any(t[p : p + n + 1] in x for x in texts):
                n += 1
            at = int(starts[j]) + p
            assert lengths[at] == n and (not n or line[places[at] : places[at] + n] == t[p : p + n])
            if n >= length:
                assert index.smallest_owners(rows[[at]])[0] == min(o for o, x in zip(owners, texts, strict=True) if t[p : p + length] in x)


@pytest.mark.parametrize("seed", range(25))
def test_repeated(seed):
    r = random.Random(seed)
    _, texts = some_texts(r)
    texts = [t + b"z" * (50 - len(t)) for t in texts]
    owners = [r.choice([-5, -1, 0, 7, 2**63 - 1]) for _ in texts]
    want = [any(o < own and t[p : p + 50] in x for o, x in zip(owners, texts, strict=True)) for t, own in zip(texts, owners, strict=True) for p in range(len(t) - 49)]
    got = repeated(laid(texts)[0], np.array([len(t) - 49 for t in texts]), np.array(owners))
    assert got.tolist() == want


def test_index_needs_its_runs_and_samples():
    text = b"abcabcabcabcabc" * 10
    index = RunLengthIndex(*laid([text]), np.array([3]))
    assert len(index.run_start) < 12 and len(index.end_sample) == len(index.start_sample) == len(index.run_start)
    r = random.Random(1)
    base = bytes(r.choice(b"abcd") for _ in range(300))
    texts = [base[:200] + base[100:] for _ in range(3)] + [base[50:]]
    data, starts = laid(texts)
    owners = np.array([5, 2, 9, 1])
    asked = [bytes(c if r.random() < 0.95 else r.choice(b"abcd") for c in base) for _ in range(20)]
    for samples in ("end_sample", "start_sample"):
        index = RunLengthIndex(data, starts, owners)
        sound = index.match(*laid(asked))
        assert len(index.run_start) < len(data) // 2 and (sound[2] >= 50).any()
        setattr(index, samples, np.zeros_like(getattr(index, samples)))
        assert (index.match(*laid(asked))[2] != sound[2]).any()


def test_automaton_sums_to_one():
    # two words; state 1 stands after word 0 and reads word 0 itself, word 1 by its failure arc
    root = np.log10(np.array([0.7, 0.3]))
    a = BackoffAutomaton(2, np.array([1 * 2 + 0]), np.log10(np.array([0.4 + 0.6 * 0.7])), np.array([1]), root, np.array([1, 0]), np.array([0.0, np.log10(0.6)]), np.array([0, 0]))
    w, after = a.step(np.array([1, 1, 0]), np.array([0, 1, 1]))
    assert after.tolist() == [1, 0, 0] and np.isclose(10 ** w[0] + 10 ** w[1], 1) and np.isclose(10 ** w[2], 0.3)
    got = a.read(np.array([0, 0, 1, 1]), np.array([0, 3, 3, 4]), 0)
    assert np.allclose(10**got, [0.7 * (0.4 + 0.42) * 0.18, 1, 0.3])


def test_gradients():
    r = np.random.default_rng(3)
    net = gru_langid.Network.fresh(["a", "b"], hidden=4)
    x = r.integers(0, 256, (6, 3)).astype(np.int16)
    for side in (0, 1):
        weight = r.standard_normal((6, 3, 4)).astype(np.float64)
        for group in (net.inputs, net.gates, net.candidate):
            group[side] = group[side].astype(np.float64)
        loss = lambda: float((gru_langid.run_layer(net, side, x)[0] * weight).sum())  # noqa: E731, B023
        _, kept = gru_langid.run_layer(net, side, x, keep=True)
        grads = gru_langid.back_layer(net, side, x, kept, weight)
        for p, g in zip((net.inputs[side], net.gates[side], net.candidate[side]), grads, strict=True):
            for _ in range(5):
                at = tuple(r.integers(0, n) for n in p.shape) if p is not net.inputs[side] else (int(x[r.integers(0, 6), 0]), int(r.integers(0, 12)))
                old, step = p[at], 1e-3
                p[at] = old + step
                up = loss()
                p[at] = old - step
                down = loss()
                p[at] = old
                assert abs((up - down) / (2 * step) - g[at]) < 2e-2 * max(1, abs(g[at]))


def test_windows_cover_whole_texts():
    texts = [b"x" * 5, b"", bytes(range(200)) + b"y" * 300]
    data, of, first = gru_langid.windows(texts)
    m, w = gru_langid.MARGIN, gru_langid.WINDOW
    for i, t in enumerate(texts):
        own = np.concatenate([d[m : m + w] for d, k in zip(data, of, strict=True) if k == i] or [np.empty(0)])
        assert bytes(own[own < 256].astype(np.uint8)) == t


def test_overlap():
    a = np.arange(20, dtype=np.uint64)
    b = np.concatenate([np.full(7, 99, np.uint64), a, np.full(5, 99, np.uint64)])
    b[12] = 1000
    assert overlap(a, b, 10, 17) == (7, 20, 19)
    assert overlap(a, np.full(30, 99, np.uint64), 0, 0) is None
    short = np.arange(8, dtype=np.uint64)
    assert overlap(short, np.concatenate([short[:7], short[:1]]), 0, 0) is None


def test_license_bounds_lose_nothing():
    s = Scanner()
    for name, text in TEMPLATES:
        assert s.scan("Some words before.\n" + text + "\nand after")[1] == 1.0, name
    words = "permission is hereby granted free of charge to any person".split()
    own = bigrams(words)
    every = [dice(own, t) for _, t in s.templates]
    assert all(v < s.least or i in s.fitting(own.total()) for i, v in enumerate(every))
    assert s.scan(None) == (None, None, 0, 0)


@pytest.mark.parametrize("n", range(1, 27))
def test_masks_cover_every_pattern(n):
    """Some mask at some place avoids the differing tokens, for every way in which a fifth of n tokens can differ."""
    short = n < LEAST
    places = range(1, n - 1) if short else range(n)  # the ends of a whole item agree
    patterns = np.array([sum(1 << i for i in c) for c in combinations(places, n * (100 - AGREE) // 100)], np.int64)
    for mask in short_masks(n) if short else MASKS:
        shape = int(mask[::-1], 2)
        for at in range(n - len(mask) + 1):
            patterns = patterns[patterns & (shape << at) != 0]
    assert not len(patterns)


def test_licences_inside_texts():
    from granary.llm.license_scan import FULL

    scanner = Scanner()
    r = random.Random(6)
    prose = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))
    mit = next(t for name, t in TEMPLATES if name == "MIT" and len(t) > 500)
    mit = mit.replace(" The above copyright", "\n\nThe above copyright").replace(" THE SOFTWARE IS PROVIDED", "\n\nTHE SOFTWARE IS PROVIDED")
    cases = [("MIT", mit), *FULL, *((name, text.replace(". ", ".\n\n")) for name, text in FULL[:4])]
    for name, text in cases:
        got = scanner.scan(f"{prose(150)}\n\n{text}\n\n{prose(200)}")
        assert got[0] == name and got[1] > 0.95, (name, got)
    assert scanner.scan("Great stuff here. Released under the MIT License. Enjoy it a lot")[0] == "MIT"
    assert scanner.scan("Here. Licensed under the MIT License. And " * 3000)[0] == "MIT"
    assert scanner.scan(prose(2000))[0] is None
