"""Word tables: each worker numbers the words it meets and keeps what it computed for them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash

from .common import ENTRY_BYTES, MEMO_BYTES


class _Numbers(dict):
    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word):
        self[word] = n = len(self)
        self.new.append(word)
        return n


class WordTable:
    """Numbers for words and arrays of their features; features(words) gives one array per feature."""

    def __init__(self, features: Callable[[list[bytes]], list[np.ndarray]]):
        self.features = features
        self.reset()

    def reset(self):
        self.numbers = _Numbers()
        self.columns: list[np.ndarray] = []
        self.held = 0

    def start(self):
        """To be called between steps: numbers given so far may lose their meaning."""
        if self.held > MEMO_BYTES:
            self.reset()

    def of(self, words: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
        ids = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        if self.numbers.new:
            new = self.features(self.numbers.new)
            self.held += sum(map(len, self.numbers.new)) + ENTRY_BYTES * len(self.numbers.new)
            self.numbers.new.clear()
            self.columns = [np.concatenate(x) for x in zip(self.columns, new, strict=True)] if self.columns else new
        return ids, self.columns


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def split_step(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """All words of the texts one after another, and where each text's words start, with the end."""
    parts = [t.split() for t in texts]
    bounds = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=bounds[1:])
    return [w for p in parts for w in p], bounds


def window_hashes(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of width words within a text, and the row of each; positions are those that lie in one text."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
        out ^= out >> np.uint64(29)
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    whole = rows[:n] == rows[width - 1 :]
    return np.where(whole, out, 0), np.where(whole, rows[:n], -1)
