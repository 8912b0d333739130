"""Byte-pair encoding with a public tokenizer's ranks, by a pair occurrence index.

Each different piece of text (what the tokenizer's pattern splits off) is
encoded once per worker. The new pieces of a batch lie one after another in one
array; an index maps each pair of neighbouring tokens to all its positions;
ranks are applied in ascending order, a whole list of positions at a time, and
each merge updates the lists of the pairs it touches. A pair that a merge makes
always has a later rank than the merge, so each rank is visited once.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How byte-level BPE splits a text before merging: contractions, letters, digits, other signs with a blank before them, blanks.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PairIndexEncoder:
    """Keeps the ids of seen pieces, at most ``most`` of them."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN, most: int = 400_000):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.find = regex.compile(pattern).findall
        self.most = most
        self.pairs: dict[tuple[int, int], int | None] = {}
        self._reset()

    def _reset(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.bounds = np.zeros(1 << 14, np.int64)

    def _rank(self, pair: tuple[int, int]) -> int | None:
        try:
            return self.pairs[pair]
        except KeyError:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            self.pairs[pair] = r = self.ranks.get(self.tokens[pair[0]] + self.tokens[pair[1]])
            return r

    def merge(self, pieces: list[str]) -> tuple[list[int], list[int]]:
        """Ids of all pieces one after another, and where each ends."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        data = b"".join(raw)
        token: list[int] = self.single[np.frombuffer(data, np.uint8)].tolist()
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        end, cut = 0, []
        for r in raw:
            end += len(r)
            cut.append(end)
            if end:
                after[end - 1] = n
            if end < n:
                before[end] = -1
        where: dict[int, dict[tuple[int, int], list[int]]] = {}
        active: list[int] = []

        def note(i: int, j: int) -> None:
            pair = (token[i], token[j])
            r = self._rank(pair)
            if r is not None:
                if (held := where.get(r, {}).get(pair)) is not None:
                    held.append(i)
                else:
                    if r not in where:
                        where[r] = {}
                        heapq.heappush(active, r)
                    where[r][pair] = [i]

        for i in range(n):
            if after[i] < n:
                note(i, after[i])
        while active:
            r = heapq.heappop(active)
            found = sorted((i, pair) for pair, at in where.pop(r).items() for i in at)
            for i, (a, b) in found:
                j = after[i]
                if token[i] != a or j >= n or token[j] != b:
                    continue
                k = after[j]
                token[i], token[j], after[i] = r, -1, k
                if k < n:
                    before[k] = i
                    note(i, k)
                if (h := before[i]) >= 0:
                    note(h, i)
        ids, ends, at = [], [], 0
        for c in cut:
            ids += [t for t in token[at:c] if t >= 0]
            ends.append(len(ids))
            at = c
        return ids, ends

    def _learn(self, new: list[str]) -> None:
        if len(self.number) + len(new) > self.most:
            self._reset()
        ids, ends = self.merge(new)
        have, base = len(self.number), int(self.bounds[len(self.number)])
        while len(self.ids) < base + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.bounds) < have + len(new) + 1:
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        self.ids[base : base + len(ids)] = ids
        self.bounds[have + 1 : have + 1 + len(new)] = np.array(ends, np.int64) + base
        self.number.update(zip(new, range(have, have + len(new)), strict=True))

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the pieces of all texts, pieces per text)."""
        split = [self.find(t) if t else [] for t in texts]
        new = {p for s in split for p in s if p not in self.number}
        if new:
            if len(self.number) + len(new) > self.most:  # start again with what this batch needs
                self._reset()
                new = {p for s in split for p in s}
            self._learn(sorted(new))
        count = np.fromiter(map(len, split), np.int64, len(split))
        get = self.number.__getitem__
        return np.fromiter((get(p) for s in split for p in s), np.int64, int(count.sum())), count

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        piece, count = self.numbers(texts)
        size = (self.bounds[1:] - self.bounds[:-1])[piece] if len(piece) else np.zeros(0, np.int64)
        total = np.zeros(len(piece) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        end = np.cumsum(count)
        return total[end] - total[end - count]

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        piece, count = self.numbers(texts)
        start, size = self.bounds[piece], self.bounds[piece + 1] - self.bounds[piece]
        total = np.zeros(len(piece) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        flat = self.ids[np.repeat(start - total[:-1], size) + np.arange(total[-1])]
        offsets = np.zeros(len(count) + 1, np.int32)
        offsets[1:] = total[np.cumsum(count)]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "surrogatepass")


_held: dict[tuple, PairIndexEncoder] = {}


def encoder(path: str, pattern: str) -> PairIndexEncoder:
    """One per worker process: what it has seen serves all of the worker's tasks."""
    if (path, pattern) not in _held:
        _held[path, pattern] = PairIndexEncoder(path, pattern)
    return _held[path, pattern]


def _portions(b: pa.RecordBatch, column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of at most about ``most`` bytes of text."""
    size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy().astype(np.int64)
    group = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), b.num_rows]
    for a, z in zip(cuts, cuts[1:], strict=False):
        if z > a:
            yield b.slice(a, z - a)


def encode(rows: DataFrame, id: Column, text: Column, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(id, ids): no special tokens; null and empty texts have an empty list. Rows come out as they come in; no shuffle."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in batches:
            for part in _portions(b, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), e.encode(part.column(1).to_pylist())], ["id", "ids"])

    src = rows.select(id.alias("id"), text.cast("string").alias("text"))
    return src.mapInArrow(f, f"id {src.schema['id'].dataType.simpleString()}, ids array<int>")


def token_counts(rows: DataFrame, keep: dict[str, Column], text: Column, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """The kept columns and ``tokens``, the number of ids of the text; 0 for null and empty texts."""
    src = rows.select(*(c.alias(n) for n, c in keep.items()), text.cast("string").alias("__text"))
    schema = ", ".join(f"`{n}` {src.schema[n].dataType.simpleString()}" for n in keep)
    names = list(keep)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in batches:
            for part in _portions(b, len(names)):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(e.lengths(part.column(len(names)).to_pylist()))], [*names, "tokens"])

    return src.mapInArrow(f, f"{schema}, tokens long")
