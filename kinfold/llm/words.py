"""Hashes of words, worked out over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE = _rng.integers(0, 1 << 64, 256, np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = np.ones(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 64, 2 * len(_powers)), BASE, np.uint64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers


def word_hashes(raw: list[bytes], apart: bool = False) -> tuple[np.ndarray, list[int]]:
    """Hashes of the words between ASCII white space in all UTF-8 texts, one after the other, and how many
    there are up to the end of each text. ``apart`` makes a word of every character from U+3000 to
    U+9FFF, whose scripts put no spaces between words."""
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    space = SPACE[data]
    begins = np.ones(len(data), bool)
    begins[1:] = space[:-1]
    if apart:
        lead = (data >= 0xE3) & (data <= 0xE9)
        begins |= lead
        begins[3:] |= lead[:-3]
    begins &= ~space
    body = data[~space]
    first = np.flatnonzero(begins[~space])
    lengths = np.diff(np.append(first, len(body)))
    where = np.arange(len(body)) - np.repeat(first, lengths)
    values = BYTE[body] * powers(int(lengths.max(initial=0)) + 1)[where]
    words = np.add.reduceat(values, first) if len(first) else np.zeros(0, np.uint64)
    limits = np.searchsorted(np.flatnonzero(begins), np.cumsum([len(r) + 1 for r in raw]))
    return mix(words + lengths.astype(np.uint64) * BASE), limits.tolist()
