"""Texts as arrays: words, word hashes, k-grams and winnowing, in NumPy.

Texts are UTF-8 bytes. A translation table maps every separator to a space
(and lower-cases A-Z where asked for), so one pass over the bytes finds all
words of many texts. Hashes have 64 bits and depend on nothing but the words.
"""

from __future__ import annotations

import numpy as np

SLICE_BYTES = 1 << 19
SEED = 0x51EE5

_rng = np.random.Generator(np.random.PCG64(SEED))
_CHARS = _rng.integers(0, 1 << 64, size=64 * 256, dtype=np.uint64)
#: Odd factors of a word's place in a run: two rows, for two values that have nothing to do with each other.
_STEPS = _rng.integers(0, 1 << 63, size=(2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LONG = np.uint64(0x9E3779B97F4A7C15)


def _table(lower: bool, keep) -> bytes:
    out = bytearray(range(256))
    for c in range(256):
        if lower and 65 <= c <= 90:
            out[c] = c + 32
        elif not keep(c):
            out[c] = 32
    return bytes(out)


#: Words of [^\x20\x09-\x0D]+, as they are and with A-Z lower-cased.
PLAIN = _table(False, lambda c: c != 32 and not 9 <= c <= 13)
LOWER = _table(True, lambda c: c != 32 and not 9 <= c <= 13)
#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower-cased.
ALNUM = _table(True, lambda c: 48 <= c <= 57 or 97 <= c <= 122 or c >= 128)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def long_word_powers(longest: int) -> np.ndarray:
    """By how much the values of a word's 64-byte parts are multiplied: 1 for the first, whatever else is in the slice."""
    return np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(longest // 64, _LONG, np.uint64))))


def _hash_slice(texts: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    blob = (b" " + b" ".join(texts) + b" ").translate(table)
    b = np.frombuffer(blob, np.uint8)
    inside = b != 32
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    at = np.fromiter(map(len, texts), np.int64, len(texts))
    at = 1 + np.concatenate(([0], np.cumsum(at + 1)))
    off = np.searchsorted(starts, at)
    if not len(starts):
        return np.empty(0, np.uint64), off
    lens = ends - starts
    first = np.cumsum(lens) - lens
    pos = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(first, lens)
    values = _CHARS.take(((pos & 63) << 8) | b[inside])
    longest = int(lens.max())
    if longest > 64:
        values *= long_word_powers(longest)[pos >> 6]
    return mix(np.add.reduceat(values, first)), off


def hash_words(texts: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, offsets): the words of text i stand at offsets[i]:offsets[i + 1]."""
    hashes, offsets, done, i = [], [np.zeros(1, np.int64)], 0, 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= SLICE_BYTES):
            size += len(texts[j])
            j += 1
        h, off = _hash_slice(texts[i:j], table)
        hashes.append(h)
        offsets.append(off[1:] + done)
        done += len(h)
        i = j
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), np.concatenate(offsets)


def grams(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hashes of all runs of k words, over the ends of texts too: one for each start but the last k - 1. salt 0 and 1 give the two halves of a 128-bit value."""
    n = len(h) - k + 1
    return grams_at(h, np.arange(0), k) if n <= 0 else _summed(lambda j: h[j : j + n], n, k, salt)


def grams_at(h: np.ndarray, starts: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """The hashes that grams() gives the runs of k words that begin at starts."""
    return _summed(lambda j: h[starts + j], len(starts), k, salt)


def _summed(word, n: int, k: int, salt: int) -> np.ndarray:
    out = np.full(n, np.uint64(k), np.uint64)
    for j in range(k if n else 0):
        # Beyond the factors a word is mixed with its place.
        out += word(j) * _STEPS[salt, j] if j < _STEPS.shape[1] else mix(word(j) * _STEPS[salt, j % _STEPS.shape[1]] + np.uint64(j))
    return mix(out)


def within(off: np.ndarray, k: int, n: int) -> np.ndarray:
    """Of the starts 0..n-1: where k words from there on belong to one text."""
    room = np.repeat(off[1:], np.diff(off))[:n]
    return room - np.arange(n) >= k


def text_of(off: np.ndarray) -> np.ndarray:
    """The number of the text that each word belongs to."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def winnow(g: np.ndarray, width: int) -> np.ndarray:
    """For each run of width hashes the place of its least one, the last of equals.

    Equal runs choose the same hash at the same distance, whatever stands
    around them: so a shared run always shares its chosen hash.
    """
    n = len(g) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, at = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, width):
        x = g[j : j + n]
        less = x <= best
        best[less] = x[less]
        at[less] = j
    return at + np.arange(n)


def spans(covered: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of true places, as (start, end)."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).astype(np.int8)))
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True))


def runs(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places the windows of that width cover that begin at starts."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + width, n), -1)
    return np.cumsum(step[:n]) > 0
