"""Benchmark decontamination by spaced-seed hashing.

A spaced seed is a fixed mask over a few consecutive tokens: the chosen ones are hashed, the others ignored, so a
hit survives substitutions at ignored places. Hashes of all places of the test texts are looked up by those of all
places of the documents; around each hit, document and test text are laid along each other and the longest stretch
is taken in which enough tokens agree.

The test texts are sent to all tasks in blocks of a bounded number of tokens, with one pass over the documents for
each block, so a large benchmark needs more passes and no more memory. (A token takes 100 bytes or so there; the usual
public test sets are a few million tokens.)

What the masks find: of 13 tokens and more, any two substitutions; three in a stretch of 15 but for 6 of 455 choices
of places. Test texts of OVERLAP tokens and less are sought by their first tokens, and all found.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import held, keep_rows, read, whole

#: Each chooses 6 of 9 to 12 places. Of 13 tokens with two substitutions, some mask has a hit.
MASKS = ("110110011", "1101001011", "10110100101", "111000100101")
#: A stretch counts from so many tokens on, or all of a shorter test text, if this share of its tokens agree.
OVERLAP = 13
AGREE = 0.8
#: Tokens of the test texts that are sent to the tasks at once.
BLOCK_TOKENS = 1_000_000
#: Pairs of tokens that are looked at at once.
CELLS = 1 << 20
REMEMBERED = 300_000
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


class Tokens(dict):
    """Hashes of tokens: white-space-separated, lower case, without punctuation at the ends; 0 if nothing is left."""

    def __missing__(self, token: str) -> int:
        low, high = 0, len(token)
        while low < high and unicodedata.category(token[low])[0] in "PS":
            low += 1
        while low < high and unicodedata.category(token[high - 1])[0] in "PS":
            high -= 1
        self[token] = found = xxhash.xxh64_intdigest(token[low:high]) | 1 if low < high else 0
        return found

    def of(self, text: str) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        found = text.lower().split()
        hashes = np.fromiter(map(self.__getitem__, found), np.uint64, len(found))
        return hashes[hashes != 0]


def tokens() -> Tokens:
    return held("tokens", Tokens)


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the chosen tokens at each place where the mask fits."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for factor, k in zip(_FACTORS, [k for k, bit in enumerate(mask) if bit == "1"], strict=True):
        total += hashes[k : k + n] * factor
    return total ^ (total >> np.uint64(29)) ^ np.uint64(len(mask))


class Index:
    """The test texts of one block: their token hashes, and where each seed hash stands in them."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids = [i for i, _ in items]
        self.texts = [tokens().of(t) for _, t in items]
        found, where = [np.empty(0, np.uint64)], [np.empty((0, 2), np.int64)]
        singles, single_where = [np.empty(0, np.uint64)], [np.empty((0, 2), np.int64)]
        for k, hashes in enumerate(self.texts):
            n = len(hashes)
            if 0 < n <= OVERLAP:  # one of the first tokens must agree
                some = n - needed(n) + 1
                singles.append(hashes[:some])
                single_where.append(np.stack([np.full(some, k), np.arange(some)], 1))
            for mask in MASKS:
                found.append(seeds(hashes, mask))
                where.append(np.stack([np.full(len(found[-1]), k), np.arange(len(found[-1]))], 1))
        self.keys, self.where = _sorted(np.concatenate(found), np.concatenate(where))
        self.singles, self.single_where = _sorted(np.concatenate(singles), np.concatenate(single_where))
        self.maybe = np.zeros(1 << 22, bool)  # which leading bits any key has
        self.maybe[self.keys >> np.uint64(42)] = True

    def hits(self, hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Distinct (number of the test text, owner of the hit's place, place in hashes less place in the test text), sorted."""
        out = [np.empty((0, 3), np.int64)]
        for mask in MASKS if len(self.keys) else ():
            found = seeds(hashes, mask)
            near = np.flatnonzero(self.maybe[found >> np.uint64(42)])
            out += _meet(self.keys, self.where, found[near], near, owner)
        if len(self.singles):
            out += _meet(self.singles, self.single_where, hashes, np.arange(len(hashes)), owner)
        return _distinct(np.concatenate(out))

    def overlaps(self, docs: list[np.ndarray]) -> list[tuple[int, int, int, int, int, int]]:
        """(number of the document, item_id, first token, tokens, tokens that agree, tokens of the item).

        The longest of each document and item; of equal ones, that of which more agrees, and then the first.
        """
        if not docs:
            return []
        sizes = [len(x) for x in docs]
        every, ends = np.concatenate(docs), np.cumsum(sizes)
        lines, out = self.hits(every, np.repeat(np.arange(len(docs)), sizes)), []
        bounds = np.flatnonzero(np.concatenate([[True], lines[1:, 0] != lines[:-1, 0], [True]])) if len(lines) else [0]
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            k = int(lines[low, 0])
            item, best = self.texts[k], {}
            step = max(1, CELLS // len(item))
            for at in range(low, high, step):
                for d, *row in _along(item, every, ends - sizes, ends, lines[at : min(high, at + step)]):
                    if d not in best or (row[1], row[2], -row[0]) > (best[d][1], best[d][2], -best[d][0]):
                        best[d] = row
            out += [(d, self.ids[k], *x, len(item)) for d, x in best.items()]
        return sorted(out)


def needed(n: int) -> int:
    """How many of n tokens must agree."""
    return -int(-AGREE * n * (1 - 1e-12) // 1)


def _sorted(keys: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    return keys[order], where[order]


def _distinct(rows: np.ndarray) -> np.ndarray:
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)])] if len(rows) else rows


def _meet(keys: np.ndarray, where: np.ndarray, found: np.ndarray, places: np.ndarray, owner: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct (text, owner, diagonal) of all found that are among the sorted keys, in runs of CELLS pairs: a hot seed may stand for many."""
    low, high = np.searchsorted(keys, found), np.searchsorted(keys, found, side="right")
    hit = high > low
    low, n, places = low[hit], (high - low)[hit], places[hit]
    upto, at = np.cumsum(n), 0
    while at < len(n):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CELLS, side="right")))
        of = n[at:end]
        k = np.arange(of.sum()) - np.repeat(np.cumsum(of) - of, of) + np.repeat(low[at:end], of)
        place = np.repeat(places[at:end], of)
        yield _distinct(np.stack([where[k, 0], owner[place], place - where[k, 1]], 1))
        at = end


def _along(item: np.ndarray, every: np.ndarray, starts: np.ndarray, ends: np.ndarray, lines: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(document, first token, tokens, agreeing) of an item laid along documents; lines hold item, document, diagonal."""
    n, d = len(item), lines[:, 1]
    at = lines[:, 2, None] + np.arange(n)
    inside = (at >= starts[d][:, None]) & (at < ends[d][:, None])
    same = inside & (every[np.clip(at, 0, len(every) - 1)] == item)
    may = np.flatnonzero(same.sum(1) >= needed(min(OVERLAP, n)))
    # Texts that repeat themselves have few kinds of rows.
    kinds, kind = np.unique(np.packbits(np.concatenate([same, inside], 1)[may], axis=1), axis=0, return_inverse=True)
    first = np.full(len(kinds), -1)
    first[kind.ravel()[::-1]] = may[::-1]
    spans = []
    for row in first.tolist():
        low, high = int(np.argmax(inside[row])), int(n - np.argmax(inside[row][::-1]))
        span = None
        if n > OVERLAP:
            span = stretch(same[row, low:high], OVERLAP)
        elif high - low == n and same[row].sum() >= needed(n):  # a short item counts as a whole
            span = 0, n, int(same[row].sum())
        spans.append(None if span is None else (low + span[0], span[1] - span[0], span[2]))
    return [(int(d[r]), int(lines[r, 2] - starts[d[r]]) + spans[x][0], *spans[x][1:]) for r, x in zip(may.tolist(), kind.ravel().tolist(), strict=True) if spans[x]]


def stretch(same: np.ndarray, least: int) -> tuple[int, int, int] | None:
    """(start, end, agreeing) of the longest stretch of `least` or more tokens of which the share AGREE agree."""
    value = np.concatenate([[0.0], np.cumsum(np.where(same, 1 - AGREE, -AGREE))]) + 1e-9 * np.arange(len(same) + 1)
    lowest = np.minimum.accumulate(value)  # the first place at or below a value starts the longest stretch
    starts = np.searchsorted(-lowest, -value, side="left")
    lengths = np.arange(len(value)) - starts
    if not len(lengths) or lengths.max() < least:
        return None
    end = int(np.argmax(lengths))
    start = int(starts[end])
    while not same[start]:  # both ends agree
        start += 1
    while not same[end - 1]:
        end -= 1
    return (start, end, int(same[start:end].sum())) if end - start >= least else None


def _scan(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, memory = sent.value, tokens()
        for batch in batches:
            rows = []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column("doc_id").to_pylist()
                rows += [(ids[d], *x) for d, *x in index.overlaps([memory.of(t.as_py()) for t in part.column("text")])]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "first_token", "n_tokens", "n_agree", "item_tokens"])

    return run


def _indexes(docs: DataFrame, benchmark: DataFrame, block_tokens: int) -> Iterator:
    """A broadcast index for each block of the test texts."""
    items = benchmark.select(F.col("item_id").cast("long"), whole("text").alias("text"), F.size(F.split("text", r"\s+")).alias("n")).where("text <> ''")
    blocks = -(-(items.agg(F.sum("n")).first()[0] or 0) // block_tokens)
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield docs.sparkSession.sparkContext.broadcast(Index([(r.item_id, r.text) for r in part.collect()]))


def overlaps(docs: DataFrame, benchmark: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, item_id, first_token, n_tokens, n_agree, item_tokens: the longest overlap of each document and test text.

    Test texts of more than OVERLAP tokens: the longest stretch of OVERLAP or more whose ends agree and of which the
    share AGREE agrees. Shorter ones must occur as a whole, of which that share agrees. Of equal stretches, that of
    which more agrees counts, and then the first. Null and empty texts overlap nothing; a null id is reported as null.
    Repeated rows are reported each. A document is read whole, and held by its task. An empty table on either side
    gives no rows. Other columns are not read.
    """
    schema = "doc_id long, item_id long, first_token long, n_tokens long, n_agree long, item_tokens long"
    texts = docs.select(F.col("doc_id").cast("long"), whole("text").alias("text"))
    found = [texts.mapInArrow(_scan(sent), schema) for sent in _indexes(docs, benchmark, block_tokens)]
    return reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], schema)


def _keep(sent):
    def start():
        index, memory = sent.value, tokens()

        def keep(texts: list[str]) -> list[bool]:
            found = {d for d, *_ in index.overlaps([memory.of(t) for t in texts])}
            return [d not in found for d in range(len(texts))]

        return keep

    return start


def clean(docs: DataFrame, benchmark: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The rows of docs that overlap no test text, as `overlaps` has it.

    Each row is decided where it is read, so rows without an id and repeated rows go too, and nothing is shuffled.
    Rows with null or empty texts stay. All columns are kept, whatever their names.
    """
    for sent in _indexes(docs, benchmark, block_tokens):
        docs = keep_rows(docs, _keep(sent))
    return docs


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`overlaps` of all documents with all test texts of benchmark."""
    return overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
