"""Hashes of words and of runs of words, for a few texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts are joined up to this many bytes before they are hashed together.
CHUNK = 1 << 20

_RANDOM = np.random.default_rng(40_009)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RANDOM.integers(1, 2**62)) * 2 + 1
_PLACES = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_POWERS = [np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * _MIX
    return x ^ (x >> np.uint64(29))


def _powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        steps = np.full(max(n, 256), _BASE & (2**64 - 1), np.uint64)
        steps[0] = 1
        _POWERS[0] = np.multiply.accumulate(steps)
    return _POWERS[0]


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the hashes of its words, in order; words are what is between blanks."""
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
    blank = _BLANK[joined]
    edges = np.flatnonzero(np.diff(blank, prepend=True))
    first, stop = edges[::2], edges[1::2]
    if not len(first):
        return [np.zeros(0, np.uint64) for _ in texts]
    length = stop - first
    letters = joined[~blank]
    at = np.cumsum(length) - length
    place = np.arange(len(letters)) - np.repeat(at, length)
    hashes = mixed(np.add.reduceat(_BYTE[letters] * _powers(int(length.max()))[place], at))
    return np.split(hashes, np.searchsorted(first, ends_of_texts[:-1]))


def hashed(texts: list[bytes]) -> Iterator[np.ndarray]:
    """``word_hashes`` of any number of texts, in chunks of bounded size."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= CHUNK:
            yield from word_hashes(group)
            group, size = [], 0
    if group:
        yield from word_hashes(group)


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words; of the whole if there are fewer, but some."""
    n = min(n, len(words))
    if not n:
        return words
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out += words[i : len(words) - n + 1 + i] * _PLACES[i % 64]
    return mixed(out + np.uint64(n))


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """The distinct runs of ``n`` words, sorted."""
    return np.unique(runs(words, n))
