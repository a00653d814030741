"""Byte n-grams as numbers: counted in batches, and scored through a table of values already looked up."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A symbol is a byte, or EDGE before a text's start and after its end; it takes BITS bits of a gram.
EDGE, BITS = 256, 9
#: Symbols that are turned into grams at once.
BLOCK = 1 << 21


def grams(text: bytes, order: int) -> Iterator[np.ndarray]:
    """The gram of `order` symbols that ends at each byte of text and at its end, in blocks. The last symbol is lowest."""
    for at in range(0, len(text) + 1, BLOCK):
        low, high = max(0, at - order + 1), min(len(text), at + BLOCK)
        part = np.frombuffer(text, np.uint8, high - low, low).astype(np.uint64)
        part = np.concatenate([np.full(order - 1 - (at - low), EDGE, np.uint64), part, np.full(int(at + BLOCK > len(text)), EDGE, np.uint64)])
        n = len(part) - order + 1
        out = np.zeros(n, np.uint64)
        for k in range(order):
            out = out << np.uint64(BITS) | part[k : k + n]
        yield out


def pieces(texts: list[bytes], order: int) -> Iterator[tuple[np.ndarray, list[int], list[int]]]:
    """The grams of all texts in runs of about BLOCK: the grams, whose they are, and how many in a row are.

    Short texts share a run and long ones have several, so memory is bounded.
    """
    held, owners, total = [], [], 0
    for k, text in enumerate(texts):
        for x in grams(text, order):
            held.append(x)
            owners.append(k)
            total += len(x)
            if total >= BLOCK:
                yield np.concatenate(held), owners, [len(y) for y in held]
                held, owners, total = [], [], 0
    if held:
        yield np.concatenate(held), owners, [len(y) for y in held]


def slices(batch: pa.RecordBatch, column: str, size: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows whose texts (binary) hold about `size` bytes."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    at, total = 0, 0
    for k, n in enumerate(lengths):
        total += n
        if total >= size or k == len(lengths) - 1:
            part = batch.slice(at, k + 1 - at)
            yield part, part.column(column).to_pylist()
            at, total = k + 1, 0


class Counter:
    """Counts of grams, merged whenever enough have come together."""

    def __init__(self, limit: int = 1 << 22) -> None:
        self.limit, self.held, self.pending = limit, [(np.empty(0, np.uint64), np.empty(0, np.int64))], 0

    def add(self, found: np.ndarray) -> None:
        keys, n = np.unique(found, return_counts=True)
        self.held.append((keys, n.astype(np.int64)))
        self.pending += len(keys)
        if self.pending > self.limit:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys, inverse = np.unique(np.concatenate([k for k, _ in self.held]), return_inverse=True)
        n = np.bincount(inverse, np.concatenate([c for _, c in self.held]), len(keys)).astype(np.int64)
        self.held, self.pending = [(keys, n)], 0
        return keys, n


class Memo:
    """Values of grams by a function of sorted distinct grams, kept in a table of fixed size and found again there.

    A gram's place is a hash of it, and what stood there goes; results don't depend on the table.
    """

    def __init__(self, value: Callable[[np.ndarray], np.ndarray], bits: int = 21) -> None:
        self.value, self.shift = value, np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64), np.zeros(1 << bits)

    def __call__(self, found: np.ndarray) -> np.ndarray:
        at = found * np.uint64(0x9E3779B97F4A7C15) >> self.shift
        out, new = self.values[at], self.keys[at] != found
        if new.any():
            keys, inverse = np.unique(found[new], return_inverse=True)
            values = self.value(keys)
            out[new] = values[inverse]
            to = keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift
            self.keys[to], self.values[to] = keys, values
        return out


def sums(texts: list[bytes], order: int, memo: Memo) -> np.ndarray:
    """For each text, the sum of its grams' values."""
    out = np.zeros(len(texts))
    for found, owners, lengths in pieces(texts, order):
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        np.add.at(out, owners, np.add.reduceat(memo(found), starts))
    return out


def parts(texts: list[bytes], order: int, memo: Memo) -> tuple[np.ndarray, pa.ListArray]:
    """For each text, the sum of its grams' values, and those without one (nan) as (word, gram, n); word is empty."""
    out, keys, counts = np.zeros(len(texts)), [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for found, owners, lengths in pieces(texts, order):
        values = memo(found)
        rare = np.isnan(values)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        np.add.at(out, owners, np.add.reduceat(np.where(rare, 0, values), starts))
        whose = np.repeat(np.array(owners, np.uint64), lengths)[rare]
        key, n = np.unique(whose << np.uint64(BITS * order) | found[rare], return_counts=True)
        keys.append(key)
        counts.append(n)
    key, n = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    ends = np.searchsorted(key >> np.uint64(BITS * order), np.arange(len(texts) + 1, dtype=np.uint64)).astype(np.int32)
    gram = (key & np.uint64((1 << BITS * order) - 1)).view(np.int64)
    rows = pa.StructArray.from_arrays([pa.array([b""] * len(key), pa.binary()), pa.array(gram), pa.array(n)], ["word", "gram", "n"])
    return out, pa.ListArray.from_arrays(pa.array(ends), rows)
