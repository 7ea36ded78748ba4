"""Batch text primitives shared by the training-data operators.

Everything here works on whole Arrow/numpy batches: one Python-level tokenizer
call per text and numpy for the rest.  A *word* is a maximal run of letters and
digits in lower case; texts of any length are processed whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
U64 = np.uint64
_MEMO_LIMIT = 2_000_000


class WordIds(dict):
    """word -> stable 64-bit hash; a bounded memo in front of xxh3."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _MEMO_LIMIT:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        self[word] = value
        return value


def words(text: str | None) -> list[str]:
    """Words of one text; NULL and blank texts have none."""
    return WORD.findall(text.lower()) if text else []


def word_ids(texts: Iterable[str | None], memo: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """Flat uint64 word hashes of all texts and the word count of each text."""
    find, get, flat, lengths = WORD.findall, memo.__getitem__, [], []
    for text in texts:
        found = find(text.lower()) if text else ()
        lengths.append(len(found))
        if found:
            flat.append(np.fromiter(map(get, found), dtype=U64, count=len(found)))
    return (np.concatenate(flat) if flat else np.empty(0, U64)), np.asarray(lengths, dtype=np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijective scramble of 64-bit values."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def shingles(flat: np.ndarray, lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, none crossing two texts.

    Returns (hashes, start position of each run in ``flat``, runs per text).
    """
    runs = np.maximum(lengths - k + 1, 0)
    total = int(runs.sum())
    if not total:
        return np.empty(0, U64), np.empty(0, np.int64), runs
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    offsets = np.concatenate(([0], np.cumsum(runs)[:-1]))
    position = np.arange(total, dtype=np.int64) + np.repeat(starts - offsets, runs)
    value = flat[position]
    for i in range(1, k):
        value = value * U64(0x9E3779B97F4A7C15) + flat[position + i]
        value ^= value >> U64(29)
    return mix64(value), position, runs


def segments_reduce(ufunc: np.ufunc, values: np.ndarray, runs: np.ndarray, empty: int) -> np.ndarray:
    """ufunc.reduce over consecutive groups of ``values``; ``empty`` for groups without values."""
    out = np.full(len(runs), empty, dtype=values.dtype)
    filled = runs > 0
    if filled.any():
        offsets = np.concatenate(([0], np.cumsum(runs)[:-1]))
        out[filled] = ufunc.reduceat(values, offsets[filled])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 bits as the int64 Spark stores."""
    return x.view(np.int64)


def unique_sorted(values: Sequence[int] | np.ndarray) -> np.ndarray:
    return np.unique(np.asarray(values))
