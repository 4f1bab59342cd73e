"""Word shingle sets of whole texts as sorted 64-bit hashes, for a batch of texts at a time."""

from __future__ import annotations

import numpy as np

from strandweave.llm.common import byte_buffer

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z lower-cased, split at space and 09-0D) of the texts data[off[i]:off[i + 1]], and each text's first word."""
    word = ~SPACE[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    edge = off[:-1][np.diff(off) > 0]
    begin[edge] = word[edge]
    at = np.flatnonzero(begin)
    first = np.searchsorted(at, off)
    if not len(at):
        return np.zeros(0, np.uint64), first
    b = LOWER[data[word]].astype(np.uint64)
    place = np.flatnonzero(word)
    start = np.searchsorted(place, at)
    n = np.diff(np.append(start, len(place)))
    within = np.arange(len(place)) - np.repeat(start, n)
    h = np.add.reduceat(mix(b + (within.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), start)
    return mix(h), first


def shingle_sets(column, words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the `words`-word shingles of each text; a text with fewer words has its whole sequence as one, one without words none."""
    data, off = byte_buffer(column)
    h, first = word_hashes(data, off)
    s = np.zeros(max(len(h) - words + 1, 0), np.uint64)
    for j in range(words):
        s = mix(s + h[j : j + len(s)] * np.uint64(2 * j + 3) + np.uint64(words))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            x = np.sort(s[a : b - words + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for i in range(a, b):
                one = mix(one + h[i : i + 1] * np.uint64(11))
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, exactly, on full sets; an empty set is like nothing."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
