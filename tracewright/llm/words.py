"""Words of UTF-8 texts as numbers: hashes, windows of several words, bounded tables of known words."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import BLANKS

_ODD = np.uint64(0x9E3779B97F4A7C15)
CONTINUATION = bytes(range(0x80, 0xC0))


def split(data: bytes) -> list[bytes]:
    """Maximal runs of bytes outside \\x20 and \\x09-\\x0D: what bytes.split() gives, whatever the locale."""
    return data.split()


def code_points(data: bytes) -> int:
    """Code points outside ASCII white space."""
    return len(data.translate(None, CONTINUATION + BLANKS))


class _Index(dict):
    """Numbers words as they are asked for; the new ones are listed."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class WordTable:
    """Numbers for words, kept over texts. Starts anew with a text once it holds more than `most` bytes, counting ENTRY for
    each word besides its own.

    describe(first, new words) is called with the words not known before, numbered from first.
    """

    ENTRY = 200

    def __init__(self, most: int = 64 << 20):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.index = _Index()
        self.held = 0

    def describe(self, first: int, words: list[bytes]) -> None:
        raise NotImplementedError

    def slots(self, words: list[bytes]) -> np.ndarray:
        if self.held > self.most:
            self.clear()
        index = self.index
        out = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        if index.new:
            new, index.new = index.new, []
            self.held += sum(map(len, new)) + self.ENTRY * len(new)
            self.describe(len(index) - len(new), new)
        return out


class HashTable(WordTable):
    """64-bit hashes of words."""

    def clear(self) -> None:
        super().clear()
        self.hashes = np.zeros(1 << 12, np.uint64)

    def describe(self, first: int, words: list[bytes]) -> None:
        n = first
        while n + len(words) > len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[n : n + len(words)] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))

    def of(self, words: list[bytes]) -> np.ndarray:
        slots = self.slots(words)
        return self.hashes[slots]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash for each run of `width` words; empty if there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * _ODD + hashes[k : k + n]
    return mix(out)


def repeated_words(hashes: np.ndarray, width: int) -> int:
    """Words that lie in a window of `width` words which occurs twice or more, first occurrences included."""
    w = windows(hashes, width)
    if len(w) < 2:
        return 0
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(len(w), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    step = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(step, at, 1)
    np.add.at(step, at + width, -1)
    return int((np.cumsum(step[:-1]) > 0).sum())
