"""Phrases of a corpus whose words go together, by fingerprints first and texts only at the end.

Texts are lower-cased (A-Z) and read in runs, with one space between words. Prefix sums of a polynomial in the run's bytes give the
Rabin-Karp fingerprint of every run of words as one difference, so all n-grams of a run are hashed by a few passes
of numpy. Tasks count fingerprints, and the shuffle adds the counts up, with a pointer to the first row that has one and the sum
of a second, independent hash of its words over all occurrences. Only frequent fingerprints go on: what
holds one rare part is rare itself, so words come first, then pairs of frequent words, triples of frequent pairs, and longer phrases of
frequent triples. Which fingerprints are frequent is told to all tasks as a bitmap of a fixed size; it may say yes to too
many, never to too few.

Phrases are then read from the rows that the pointers name, one text for each frequent fingerprint. Where the sum is not
that text's second hash times the count, several texts share a fingerprint: all occurrences of those are compared word for word and counted by text,
so collisions never count together (64 and 32 bits; that both agree for different texts is left out of account).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import freed, read, written

WORDS, LEAST, TOP = 5, 100, 2000
#: Bytes of text that are hashed together, fingerprints and languages that a task holds before it passes them on.
RUN, HELD, HELD_LANGS = 1 << 19, 1 << 19, 300_000
#: Rows that go to Spark at once.
SENT_ROWS = 1 << 16
#: The bitmap has 2 ** BITS bits (32 MB) at any size of the corpus, in rows of CELL bits.
BITS, CELL = 28, 1 << 15
#: Languages whose totals are sent to all tasks; more are joined by a shuffle.
SENT_LANGS = 100_000
NO_ID = np.iinfo(np.int64).max

BASE, CHECK = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STOP = re.compile(rb"[.,;:!?\x0A-\x0D]")
_SPACED = bytes(32 if k else c for c, k in enumerate(_KIND.tolist()))
_POWERS: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** k and its inverse for k < n, modulo 2 ** 64."""
    if len(_POWERS.get((base, 1), ())) < n:
        for sign in (1, -1):
            row = np.full(n, pow(base, sign, 1 << 64), np.uint64)
            row[:1] = 1
            _POWERS[base, sign] = np.multiply.accumulate(row)
    return _POWERS[base, 1], _POWERS[base, -1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Run:
    """The words of some texts, and the fingerprints of their n-grams.

    begins, ends: of each word in `text`, where words have one space between them; piece, lang, doc and word: which piece, language and
    document a word stands in, and its number there.
    """

    def __init__(self, texts: list[bytes], langs: list[str], ids: list[int], first: list[int], width: int = 64) -> None:
        joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        kind = _KIND[joined]
        char = kind == 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], char, [False]]).view(np.int8)))
        at, stop = edge[0::2], edge[1::2]
        self.piece = np.cumsum(kind == 2)[at]
        keep = char.copy()
        keep[stop] = True
        self.text = np.where(char, _LOWER[joined], 32).astype(np.uint8)[keep]
        size = stop - at + 1
        self.ends = np.cumsum(size) - 1
        self.begins = self.ends - size + 1
        lengths = np.array([len(t) + 1 for t in texts])
        of = np.searchsorted(np.cumsum(lengths), at, side="right")
        self.langs, number = np.unique(np.array(langs, object), return_inverse=True)
        self.lang, self.doc = number[of], np.array(ids, np.int64)[of]
        start = np.searchsorted(of, np.arange(len(texts)))
        self.word = np.arange(len(at)) - start[of] + np.array(first, np.int64)[of]
        seeds = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") for x in self.langs], np.uint64)
        self.seed = seeds[self.lang]
        self.sums, self.down = self._prefixes(BASE)
        sums, down = self._prefixes(CHECK)
        self.marks = _mixed((sums[self.ends] - sums[self.begins]) * down[self.begins])
        self.width = np.uint64(64 - width)

    def _prefixes(self, base: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = _powers(base, len(self.text) + 1)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.text.astype(np.uint64) + np.uint64(1)) * up[: len(self.text)])]), down

    def prints(self, n: int) -> np.ndarray:
        """The fingerprint of the n words from each word on; of use where `inside`."""
        m = max(0, len(self.begins) - n + 1)
        begins, ends = self.begins[:m], self.ends[n - 1 : n - 1 + m]
        raw = (self.sums[ends] - self.sums[begins]) * self.down[begins]
        return _mixed(_mixed(raw) ^ self.seed[:m] + np.uint64(n)) >> self.width << self.width

    def checks(self, n: int, at: np.ndarray) -> np.ndarray:
        """A second hash of the n words from the given ones on, of 32 bits, from hashes of the words by another polynomial."""
        out = np.full(len(at), n, np.uint64)
        for k in range(n):
            out = (out ^ self.marks[at + k]) * np.uint64(CHECK)
            out ^= out >> np.uint64(29)
        return (out >> np.uint64(32)).astype(np.int64)

    def inside(self, n: int) -> np.ndarray:
        """Whether the n words from each word on stand in one piece."""
        m = max(0, len(self.begins) - n + 1)
        return self.piece[:m] == self.piece[n - 1 : n - 1 + m]

    def word_ids(self) -> np.ndarray:
        """A number for each word, equal for equal texts only: found by fingerprints and compared byte for byte."""
        m = len(self.begins)
        _, first, number = np.unique(self.prints(1), return_index=True, return_inverse=True)
        like, size = first[number], self.ends - self.begins
        same = size == size[like]
        for k in range(int(size.max(initial=0))):
            at = np.flatnonzero(same & (size > k))
            if not len(at):
                break
            same[at] = self.text[self.begins[at] + k] == self.text[self.begins[like[at]] + k]
        if not same.all():
            seen: dict[bytes, int] = {}
            data = self.text.tobytes()
            number = np.array([seen.setdefault(data[b:e], len(seen)) for b, e in zip(self.begins.tolist(), self.ends.tolist(), strict=True)], np.int64)
        return number.reshape(m)


def _segments(text: bytes, size: int) -> Iterator[bytes]:
    """The text in parts of about `size` bytes, cut where a piece ends; a longer piece stays whole."""
    at = 0
    while len(text) - at > size and (stop := _STOP.search(text, at + size)):
        yield text[at : stop.start()]
        at = stop.start()
    yield text[at:]


def runs(batches: Iterator[pa.RecordBatch], width: int = 64, size: int = RUN) -> Iterator[Run]:
    """Runs of about `size` bytes over columns text (binary), lang and doc_id."""
    held: tuple[list, ...] = ([], [], [], [])
    total = 0
    for batch in batches:
        for text, lang, doc in zip(batch.column("text"), batch.column("lang").to_pylist(), batch.column("doc_id").to_pylist(), strict=True):
            before = 0
            whole = text.as_py() or b""
            for part in _segments(whole, size):
                for column, value in zip(held, (part, lang, NO_ID if doc is None else doc, before), strict=True):
                    column.append(value)
                total += len(part)
                if len(part) < len(whole):
                    before += len(part.translate(_SPACED).split())
                if total >= size:
                    yield Run(*held, width)
                    held, total = ([], [], [], []), 0
    if held[0]:
        yield Run(*held, width)


def _has(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    at = prints >> np.uint64(64 - BITS)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _likely(run: Run, n: int, bits: np.ndarray | None, known: int, prints: dict[int, np.ndarray]) -> np.ndarray:
    """Where n words stand in one piece and all their parts of `known` words may be frequent."""
    ok = run.inside(n)
    if bits is not None and n > known:
        if known not in prints:
            prints[known] = _has(bits, run.prints(known))
        for k in range(n - known + 1):
            ok = ok & prints[known][k : k + len(ok)]
    return np.flatnonzero(ok)


COUNTED = "lang string, fp long, n long, rid long, mark long"


def _grouped(fp: np.ndarray, n: np.ndarray, rid: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, ...]:
    """One row for each fingerprint: its count, first row, and sum of second hashes."""
    order = np.argsort(fp, kind="stable")
    fp = fp[order]
    first = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]])) if len(fp) else np.zeros(0, np.int64)
    if not len(first):
        return fp, n, rid, mark
    return fp[first], np.add.reduceat(n[order], first), np.minimum.reduceat(rid[order], first), np.add.reduceat(mark[order], first)


def _counted(sizes: list[int], sent, known: int, width: int):
    """COUNTED: fingerprints with their counts, and words by language (fp is null) when words are counted."""
    names = [c.split(" ")[0] for c in COUNTED.split(", ")]

    def out(fp: np.ndarray, *more: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(fp), SENT_ROWS):
            part = [x[k : k + SENT_ROWS] for x in (fp.view(np.int64), *more)]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(part[0]), pa.string()), *map(pa.array, part)], names)

    def words(totals: dict[str, int]) -> pa.RecordBatch:
        n = len(totals)
        return pa.RecordBatch.from_arrays([pa.array(list(totals)), pa.nulls(n, pa.int64()), pa.array(list(totals.values()), pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value if sent else None
        held: list[tuple[np.ndarray, ...]] = []
        pending, totals = 0, {}
        for run in runs(batches, width):
            cache: dict[int, np.ndarray] = {}
            for n in sizes:
                at = _likely(run, n, bits, known, cache)
                held.append(_grouped(run.prints(n)[at], np.ones(len(at), np.int64), run.doc[at], run.checks(n, at)))
                pending += len(held[-1][0])
            if 1 in sizes:
                for k, c in enumerate(np.bincount(run.lang, minlength=len(run.langs)).tolist()):
                    totals[run.langs[k]] = totals.get(run.langs[k], 0) + c
                if len(totals) > HELD_LANGS:
                    yield words(totals)
                    totals = {}
            if pending > 2 * HELD:
                held = [_grouped(*map(np.concatenate, zip(*held, strict=True)))]
                pending = len(held[0][0])
                if pending > HELD:
                    yield from out(*held[0])
                    held, pending = [], 0
        if held:
            yield from out(*_grouped(*map(np.concatenate, zip(*held, strict=True))))
        if totals:
            yield words(totals)

    return task


def occurrences(run: Run, n: int, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(fingerprints, pointers, counts) of the n-grams at the given words: groups of one fingerprint whose words all equal those that the
    pointer, the occurrence of least (document, word), begins. What differs makes groups of its own."""
    ids, prints = run.word_ids(), run.prints(n)
    while len(at):
        at = at[np.lexsort((run.doc[at], prints[at]))]
        keys = prints[at]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        pointer = np.repeat(at[starts], np.diff(np.concatenate([starts, [len(at)]])))
        same = run.lang[at] == run.lang[pointer]
        for k in range(n):
            same &= ids[at + k] == ids[pointer + k]
        counts = np.add.reduceat(same.astype(np.int64), starts)
        yield keys[starts], at[starts], counts
        at = np.sort(at[~same])


TEXTS = "fp long, lang string, phrase binary, words int, f long, rid long, word long, mark long"


def _rows(found: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.binary(), pa.int32(), *[pa.int64()] * 4]
    columns = list(zip(*found, strict=True)) or [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split(" ")[0] for c in TEXTS.split(", ")])


def _phrases_at(run: Run, n: int, at: np.ndarray) -> Iterator[tuple]:
    """TEXTS rows of the n-grams at the given words: one for each text, with its count, its first place and its second hash."""
    data = run.text.tobytes()
    for prints, pointers, counts in occurrences(run, n, at):
        begins, ends = run.begins[pointers].tolist(), run.ends[pointers + n - 1].tolist()
        rows = zip(prints.view(np.int64).tolist(), begins, ends, run.lang[pointers].tolist(), counts.tolist(), run.doc[pointers].tolist(), run.word[pointers].tolist(), run.checks(n, pointers).tolist(), strict=True)
        for fp, b, e, k, *more in rows:
            yield fp, run.langs[k], data[b:e], n, *more


def _pointed(words: int, width: int):
    """TEXTS rows of the fingerprints that each row (text, lang, doc_id, fps) is asked for, as the row's first occurrence has them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                asked, found = np.array(row.column("fps").to_pylist()[0], np.int64).view(np.uint64), []
                for run in runs(iter([row]), width):
                    for n in range(1, words + 1):
                        at = np.flatnonzero(run.inside(n))
                        at = at[np.isin(run.prints(n)[at], asked)]
                        found += list(_phrases_at(run, n, at))
                yield _rows(found)

    return task


def _compared(words: int, sent, width: int):
    """TEXTS rows of all occurrences of the bitmap's fingerprints, by text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for run in runs(batches, width):
            for n in range(1, words + 1):
                at = np.flatnonzero(run.inside(n))
                yield _rows(list(_phrases_at(run, n, at[_has(bits, run.prints(n)[at])])))

    return task


def _bitmap(frequent: DataFrame) -> np.ndarray:
    """The leading BITS bits of the fingerprints in `fp`, as a bitmap: 2 ** BITS / 8 bytes come to the driver at most."""
    place = F.shiftrightunsigned("fp", 64 - BITS)
    cells = frequent.groupBy((place / CELL).cast("long").alias("cell")).agg(F.bitmap_construct_agg(place % CELL).alias("bits"))
    out = np.zeros((1 << BITS) // 8, np.uint8)
    for row in cells.collect():
        out[row.cell * (CELL // 8) : (row.cell + 1) * (CELL // 8)] = np.frombuffer(bytes(row.bits), np.uint8)
    return out


def phrases(docs: DataFrame, words: int = WORDS, least: int = LEAST, width: int = 64) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f, first_doc_id, first_word) of all phrases that occur `least` times in their language, and (lang, n) of its words.

    docs: doc_id, lang, text. width is how many bits of a fingerprint count; phrases and counts don't depend on it.
    """
    with freed(docs.sparkSession):
        return _phrases(docs, words, least, width)


def _phrases(docs: DataFrame, words: int, least: int, width: int) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    # Written, as pointers name its rows.
    table = docs.select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    table = written(table.withColumn("rid", F.monotonically_increasing_id()), compression="zstd")
    rows = table.select(F.col("rid").alias("doc_id"), "lang", "text")
    found, bits, known, sent = [], None, 0, None
    sums = [F.sum("n").alias("n"), F.min("rid").alias("rid"), F.try_sum("mark").alias("mark")]
    for sizes in [s for s in ([1], [2], [3], list(range(4, words + 1))) if s and s[0] <= words]:
        counts = rows.mapInArrow(_counted(sizes, sent, known, width), COUNTED)
        found.append(written(counts.groupBy("lang", "fp").agg(*sums).where(F.col("lang").isNotNull() | (F.col("n") >= least))))
        if sizes[-1] < words:
            now = _bitmap(found[-1].where("lang is null"))
            bits, known = (now if bits is None else bits | now), sizes[-1]
            sent = spark.sparkContext.broadcast(bits)
    frequent = found[0].where("lang is null")
    for more in found[1:]:
        frequent = frequent.unionByName(more)
    asked = frequent.groupBy("rid").agg(F.collect_list("fp").alias("fps"))
    texts = rows.join(asked.hint("merge"), F.col("doc_id") == F.col("rid")).select("text", "lang", "doc_id", "fps").mapInArrow(_pointed(words, width), TEXTS)
    # A long text is read in several runs, and each finds the phrase.
    first = texts.groupBy("fp").agg(F.min(F.struct("rid", "word", "lang", "phrase", "words", "mark")).alias("t"))
    # A sum that passes 64 bits is null, and its fingerprint is compared word for word as well.
    read_once = written(frequent.join(first.hint("merge"), "fp").select("fp", "t.lang", "t.phrase", "t.words", F.col("n").alias("f"), "t.rid", "t.word", F.coalesce(F.try_multiply("n", "t.mark") == F.col("mark"), F.lit(False)).alias("alone")))
    known = read_once.where("alone").drop("fp", "alone")
    several = read_once.where("not alone").select("fp")
    if several.count():
        compared = rows.mapInArrow(_compared(words, spark.sparkContext.broadcast(_bitmap(several)), width), TEXTS).join(several.hint("merge"), "fp", "left_semi")
        compared = compared.groupBy("fp", "lang", "phrase", "words").agg(F.sum("f").alias("f"), F.min(F.struct("rid", "word")).alias("t"))
        known = known.unionByName(compared.where(F.col("f") >= least).select("lang", "phrase", "words", "f", "t.rid", "t.word"))
    known = known.join(table.select("rid", F.col("doc_id").alias("first_doc_id")).hint("merge"), "rid")
    return written(known.select("lang", F.col("phrase").cast("string").alias("phrase"), "words", "f", "first_doc_id", F.col("word").alias("first_word"))), found[0].where("lang is not null").select("lang", "n")


def collocations(docs: DataFrame, words: int = WORDS, least: int = LEAST, top: int = TOP, width: int = 64) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, first_doc_id, first_word: each language's `top` phrases of 2 to `words` words.

    a, l, r are the counts of the phrase and of its parts at the cut of least score = floor(1000 a n / (l r)), the first of several; n
    the language's words. Phrases inside a longer one that occurs as often are left out. Ranks are by score, a (both
    falling) and phrase (bytes). first_doc_id and first_word (from 0) point to the phrase's first place in the table.
    """
    table, totals = phrases(docs, words, least, width)
    totals = F.broadcast(totals) if totals.count() <= SENT_LANGS else totals.hint("merge")
    split = F.split("phrase", " ", -1)
    many = table.where("words > 1")
    part = lambda begin, n: F.array_join(F.slice(split, begin, n), " ")
    cuts = many.select("lang", "phrase", "words", "f", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "f", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    side = lambda name, count: table.select("lang", F.col("phrase").alias(name), F.col("f").alias(count)).hint("merge")
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    scored = cuts.withColumns({"up": (F.lit(1000).cast("decimal(5,0)") * wide("f") * wide("n")).cast("decimal(38,0)"), "down": (wide("l") * wide("r")).cast("decimal(38,0)")}).withColumn("score", F.expr("up div down"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "n")).alias("cut"))

    inner = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), b -> array_join(slice(w, b, m), ' '))))")
    longer = table.where("words > 2").withColumn("w", split).select("lang", "f", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    kept = many.join(longer.hint("merge"), ["lang", "phrase"], "left").where("around is null or around < f")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"), "phrase")
    ranked = kept.join(best.hint("merge"), ["lang", "phrase"]).select("lang", "phrase", "f", "first_doc_id", "first_word", "cut.*").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", F.col("f").alias("a"), "l", "r", "n", "score", "first_doc_id", "first_word")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language of documents.

    Null texts are empty, a null lang is `und`. Repeated rows count as often as they stand there. A long text is read in parts, cut
    where pieces end; one piece is held whole. Ties in score go to the more frequent phrase, then to the first by bytes. An
    empty table, or one without a phrase that occurs 100 times, gives no rows. Other columns are not read.
    """
    return collocations(read(spark, sf_dir, "documents")).drop("first_doc_id", "first_word")
