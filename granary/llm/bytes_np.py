"""Array helpers for Arrow batches of texts: rolling hashes, word spans and sliding minima without a loop over rows."""

from __future__ import annotations

import numpy as np

#: Odd, so that it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: fixed values: the finalizer of SplitMix64
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

#: Prefix sums are made block by block, so that temporaries stay small.
BLOCK = 1 << 16

_POWERS: dict[int, np.ndarray] = {}


def _block_powers(base: int) -> np.ndarray:
    if base not in _POWERS:
        table = np.full(BLOCK, base, np.uint64)
        table[0] = 1
        _POWERS[base] = np.cumprod(table, dtype=np.uint64)
    return _POWERS[base]


def powers_at(base: int, at: np.ndarray) -> np.ndarray:
    """base^at modulo 2^64, from a table for the places inside a block and one for the blocks."""
    if not len(at):
        return np.empty(0, np.uint64)
    step = pow(base, BLOCK, 1 << 64)
    blocks = np.full(int(at.max()) // BLOCK + 1, step, np.uint64)
    blocks[0] = 1
    np.cumprod(blocks, out=blocks)
    return blocks[at >> 16] * _block_powers(base)[at & (BLOCK - 1)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX[0])
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX[1])
    return h ^ (h >> np.uint64(31))


class Rolling:
    """Hashes of any spans of an array of small numbers, from one prefix sum modulo 2^64."""

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        self.sums = np.zeros(n + 1, np.uint64)
        table, scale, step = _block_powers(BASE), np.uint64(1), np.uint64(pow(BASE, BLOCK, 1 << 64))
        with np.errstate(over="ignore"):
            for i in range(0, n, BLOCK):
                part = symbols[i : i + BLOCK].astype(np.uint64) + np.uint64(1)
                np.cumsum(part * table[: len(part)], out=part)
                self.sums[i + 1 : i + 1 + len(part)] = part * scale + self.sums[i]
                scale = scale * step

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * powers_at(INVERSE, start) + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """Of every k symbols in a row."""
        n = len(self.sums) - k
        if n <= 0:
            return np.empty(0, np.uint64)
        out = np.empty(n, np.uint64)
        table, scale, step = _block_powers(INVERSE), np.uint64(1), np.uint64(pow(INVERSE, BLOCK, 1 << 64))
        with np.errstate(over="ignore"):
            for i in range(0, n, BLOCK):
                j = min(n, i + BLOCK)
                out[i:j] = mixed((self.sums[i + k : j + k] - self.sums[i:j]) * table[: j - i] * scale)
                scale = scale * step
        return out


def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all parts in a row, and where each begins; the last number is the whole length."""
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=starts[1:])
    return np.frombuffer(b"".join(parts), np.uint8), starts


#: For each byte, whether it separates words.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Lower case of A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_TABLE = LOWER.tobytes()


def word_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of texts that lie in a row, and the first word of each text (one more at the end)."""
    word = np.zeros(len(data) + 1, bool)
    word[:-1] = ~BLANK[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    # a text that begins inside a run of word bytes begins a word
    inner = starts[:-1]
    first[inner[inner < len(data)]] |= word[inner[inner < len(data)]]
    begin = np.flatnonzero(first[:-1])
    last = word[:-1] & (~word[1:] | first[1:])
    end = np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(begin, starts)


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, by doubling."""
    out, have = h, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0]+lengths[0]-1, starts[1] .., in a row."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(starts - (ends - lengths), lengths)
