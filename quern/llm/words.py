"""Vectorised word windows: shingles, anchors, bitmap signatures.

All functions work on one Arrow batch of texts at a time. Hashes have 64 bits:
of 10^9 different values two coincide with a chance of about 3 %.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

from quern.llm.forms import consistent
from quern.operators.batches import among, bitmap, by_runs, per_batch, sliced  # noqa: F401

WORD = re.compile(r"[^\W_]+")
#: Bits of a signature. Pairs of long texts with little in common still differ in too few of 256 bits to be told apart.
BITS = 384
_P, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


class _Codes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_codes = _Codes()


def words(text: str | None) -> list[str]:
    """Longest runs of letters and digits of the consistent, lower-cased text."""
    return WORD.findall(consistent(text).lower()) if text else []


class Batch:
    """Word codes of many texts, one after another, ``gap`` unused places after each."""

    def __init__(self, texts: list[list[str]], gap: int = 64):
        self.n = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.cumsum(self.n + gap) - (self.n + gap)
        flat = np.fromiter((_codes[w] for t in texts for w in t), np.uint64, int(self.n.sum()))
        self.doc = np.repeat(np.arange(len(texts)), self.n)
        self.at = np.arange(len(flat)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        self.code = np.zeros(int((self.n + gap).sum()), np.uint64)
        self.code[self.start[self.doc] + self.at] = flat

    def nodes(self) -> np.ndarray:
        """One hash per word sequence."""
        return np.array([xxhash.xxh64_intdigest(self.code[a : a + n].tobytes()) for a, n in zip(self.start, self.n, strict=True)], np.uint64).view(np.int64)

    def windows(self, k: int, seed: int = 0) -> np.ndarray:
        """Hash of the k words from each place on; only places with k words left in their text mean anything."""
        size = len(self.code) - k + 1
        h = np.full(max(size, 0), seed + k, np.uint64)
        for j in range(k):
            h *= _P
            h += self.code[j : j + size]
        h ^= h >> np.uint64(33)
        h *= _A
        h ^= h >> np.uint64(29)
        h *= _B
        h ^= h >> np.uint64(32)
        return h

    def shingles(self, k: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """(document, hash), distinct and sorted, of the runs of k words."""
        ok = self.at + k <= self.n[self.doc]
        doc, h = self.doc[ok], self.windows(k)[self.start[self.doc[ok]] + self.at[ok]]
        return distinct(doc, h)


def distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """doc ascending."""
    h, cut = h.copy(), np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True]) if len(doc) else ()
    for a, z in zip(cut[:-1], cut[1:], strict=True):
        h[a:z].sort()
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def parities(doc: np.ndarray, h: np.ndarray, n: int, size: int) -> np.ndarray:
    """Per document the parities of its 32-bit hashes by bit number, in 64-bit words."""
    bits = np.bincount(doc * size + (h * np.uint64(size) >> np.uint64(32)).astype(np.int64), minlength=n * size) & 1
    return np.packbits(bits.astype(np.uint8).reshape(n, size), axis=1).view(np.int64).reshape(n, size // 64)


def signatures(doc: np.ndarray, h: np.ndarray, n: int) -> list[np.ndarray]:
    """Per document the parities of its hashes by bit number, in 64-bit words. The bits in which two differ are at most the values only one of them has."""
    packed = parities(doc, h >> np.uint64(32), n, BITS)
    return [np.ascontiguousarray(packed[:, i]) for i in range(BITS // 64)]
