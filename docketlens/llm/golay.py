"""Fuzzy keys of 23-bit words by the perfect binary Golay code.

The code [23, 12, 7] covers every 23-bit word by exactly one codeword within
three bits.  A word within two bits of its codeword gets that codeword's index
only; a word three bits away also gets the five codewords four bits away.  Two
words that differ in at most two bits then always share a key, and words that
differ in three or four bits often do.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

BITS, DATA, CHECK = 23, 12, 11
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
MASK = (1 << BITS) - 1
KEYS = 6


def _remainder(word: int) -> int:
    for shift in range(BITS - 1, CHECK - 1, -1):
        if word >> shift & 1:
            word ^= GENERATOR << (shift - CHECK)
    return word


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(syndrome of each bit, error patterns to try for each of the 2^11 syndromes, -1 padded)."""
    unit = np.array([_remainder(1 << b) for b in range(BITS)], dtype=np.int64)
    by_weight: dict[int, dict[int, list[int]]] = {w: {} for w in range(5)}
    for weight in range(5):
        for bits in combinations(range(BITS), weight):
            pattern = sum(1 << b for b in bits)
            syndrome = 0
            for b in bits:
                syndrome ^= int(unit[b])
            by_weight[weight].setdefault(syndrome, []).append(pattern)
    patterns = np.full((1 << CHECK, KEYS), -1, dtype=np.int64)
    for syndrome in range(1 << CHECK):
        for weight in range(4):
            if syndrome in by_weight[weight]:
                found = list(by_weight[weight][syndrome])
                if weight == 3:
                    found += by_weight[4].get(syndrome, [])
                break
        patterns[syndrome, : min(KEYS, len(found))] = found[:KEYS]
    return unit, patterns


def syndromes(word: np.ndarray) -> np.ndarray:
    unit, _ = tables()
    out = np.zeros(len(word), dtype=np.int64)
    for b in range(BITS):
        out ^= ((word >> b) & 1) * unit[b]
    return out


def fuzzy_keys(word: np.ndarray) -> np.ndarray:
    """Codeword indices (12 bits) near each 23-bit word: shape (n, 6), -1 where fewer."""
    word = np.asarray(word, dtype=np.int64) & MASK
    _, patterns = tables()
    error = patterns[syndromes(word)]
    return np.where(error < 0, -1, (word[:, None] ^ error) >> CHECK)
