"""Vectorised words, word hashes and shingles of many texts at once (numpy)."""

from __future__ import annotations

import numpy as np

#: A-Z to a-z, other ASCII but 0-9 and a-z to a blank, other bytes as they are.
FOLD = bytes(
    32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b
    for b in range(256)
)

_rng = np.random.Generator(np.random.PCG64(20240601))
#: Random odd 64-bit values for each byte, and powers of an odd multiplier.
BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def powers(n: int, base: np.uint64 = MULTIPLIER) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of UTF-8 texts, in order, and the number of words
    of each text. A word is a run of 0-9, a-z and non-ASCII bytes after folding."""
    hashes, counts, _, _, _ = word_spans(texts)
    return hashes, counts


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What word_hashes gives, then the folded bytes of all texts and where in them each
    word begins, and its length."""
    none = np.zeros(0, np.int64)
    if not texts:
        return np.zeros(0, np.uint64), none, np.zeros(0, np.uint8), none, none
    whole = np.frombuffer((b" ".join(texts) + b" ").translate(FOLD), np.uint8)
    inside = whole != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate(([0], edges))
    starts, ends = edges[0::2], edges[1::2]  # the last byte is a blank, so they pair up
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, text_ends), prepend=0)
    if not len(starts):
        return np.zeros(0, np.uint64), counts.astype(np.int64), whole, none, none
    lengths = ends - starts
    kept = whole[inside]
    firsts = np.cumsum(lengths) - lengths
    place = np.arange(len(kept), dtype=np.int64) - np.repeat(firsts, lengths)
    value = BYTE[kept]
    value *= powers(int(lengths.max()))[place]
    return mixed(np.add.reduceat(value, firsts) + lengths.astype(np.uint64)), counts.astype(np.int64), whole, starts, lengths


def gathered(whole: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of the given words, one after another."""
    ends = np.cumsum(lengths)
    return whole[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)]


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each `size` consecutive words (len - size + 1 of them, order matters)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p = powers(size, np.uint64(0xD1342543DE82EF95))
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += hashes[k : k + n] * p[k]
    return mixed(out)
