"""Quality rules: counts of words, lines and repeats, then n-gram perplexity within a band for the language.

A modified Kneser-Ney model over byte n-grams is counted by Spark on the documents that pass the plain rules, and all
n-grams stay in it. An n-gram is held as one number (its symbols' codes side by side, so without collisions). What its
value depends on ends in the same two symbols before the last one, but for contexts of one byte or none; so counts are
dealt out by these two, and each task builds its share of the model, with the short contexts (SYMBOLS squared at most)
beside it, and gives the values of its n-grams. Those of frequent n-grams (COMMON of all symbols, so 1 / COMMON at
most) are looked up in a broadcast, and the others joined.

A document's perplexity is that of its bytes and end. Quartiles of its logarithm over each language's documents give
the language's band, and documents beyond it on either side are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import cut, read, whole
from folio.llm.grams import BITS, Counter, Memo, parts, pieces, slices

ORDER = 4
COMMON = 2e-7
SYMBOLS = 257
#: A band reaches this many interquartile ranges beyond the quartiles of a language's log10 perplexities.
REACH = 3.0
#: Steps of log10 perplexity in which quartiles are counted, and the narrowest range that counts.
STEP, NARROWEST = 0.001, 0.02
#: Bands of so many languages are broadcast (64 bytes each); of more, a language's rows meet its band in runs of so many.
SENT_LANGUAGES, SALTED_ROWS = 50_000, 10_000_000
MARKS = b"#*$%&|<>"
OUTSIDE = b"\x20\x09\x0a\x0b\x0c\x0d" + bytes(range(0x80, 0xC0))


def repeated_words(words: list[bytes]) -> int:
    """How many words stand in a 3-word window that occurs twice or more."""
    if len(words) < 4:
        return 0
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) >= 1 << 21:  # three numbers no longer fit one
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(number) + ids[2:]
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


def base(data: bytes) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of UTF-8 text."""
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeats = repeated_words(words)
    return (len(words), len(data.translate(None, OUTSIDE)), len(data) - len(data.translate(None, MARKS)), len(lines) - len(set(lines)), repeats, len(words) < 50 or 100 * repeats > 50 * len(words))


@dataclass
class Model:
    """For each context length: sorted cells with (count - discount) / context's count, and contexts with the rest."""

    cells: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def build(cls, order: np.ndarray, gram: np.ndarray, count: np.ndarray, n: np.ndarray, discounts: dict[int, np.ndarray]) -> Model:
        cells, contexts = [], []
        for m in range(ORDER + 1):
            of = np.flatnonzero(order == m)
            of = of[np.argsort(gram[of], kind="stable")]
            share = (count[of] - discounts.get(m, np.zeros(4))[np.minimum(count[of], 3)]) / n[of]
            key, first = np.unique(gram[of] >> np.uint64(BITS), return_index=True)
            cells.append((gram[of], share))
            contexts.append((key, 1 - (np.add.reduceat(share, first) if len(of) else np.empty(0))))
        return cls(cells, contexts)

    def value(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last symbol after the others."""
        p = np.full(len(grams), 1 / SYMBOLS)
        for m, ((cell, share), (key, rest)) in enumerate(zip(self.cells, self.contexts, strict=True)):
            if not len(key):
                break
            low = grams & np.uint64((1 << BITS * (m + 1)) - 1)
            c = np.minimum(np.searchsorted(key, low >> np.uint64(BITS)), len(key) - 1)
            k = np.minimum(np.searchsorted(cell, low), len(cell) - 1)
            p = np.where(key[c] == low >> np.uint64(BITS), rest[c] * p + np.where(cell[k] == low, share[k], 0), p)
        return np.log10(p)


def discounts(ones: int, twos: int, threes: int, fours: int) -> np.ndarray:
    """D for counts 0, 1, 2, 3 and more, from how many n-grams have the counts 1 to 4 (Chen and Goodman, 1998); 0.1 at least."""
    n = [max(1, x) for x in (ones, twos, threes, fours)]
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([0.0, *(min(k, max(0.1, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3))])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = Counter()
    for batch in batches:
        for _, texts in slices(batch, "text"):
            for found, _, _ in pieces([t for t in texts if not base(t)[-1]], ORDER + 1):
                counter.add(found)
    keys, n = counter.merge()
    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["gram", "n"])


def _uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = Counter()
    for batch in batches:
        for _, texts in slices(batch, "text"):
            for found, _, _ in pieces(texts, ORDER + 1):
                counter.add(found)
    keys, n = counter.merge()
    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["gram", "uses"])


@dataclass
class Counts:
    """What the model is made of: gram, n of the longest n-grams, rows of the two shortest levels, discounts by level."""

    full: DataFrame
    short: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # gram, n, count
    discounts: dict[int, np.ndarray]
    least: float


def fit(docs: DataFrame, share: float = 0.0) -> Counts:
    """The model of the documents that pass the plain rules.

    A share above 0 leaves n-grams that make up less of all symbols, and single ones, to the interpolation.
    """
    texts = docs.select(whole("text").cast("binary").alias("text"))
    # For the longest n-grams `count` is how often they occur, for others how many symbols they follow.
    level = texts.mapInArrow(_count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).withColumn("count", F.col("n"))
    longest = full = level = cut(level.withColumn("m", F.lit(ORDER)))
    for m in range(ORDER - 1, -1, -1):
        level = cut(level.groupBy(F.col("gram").bitwiseAND((1 << BITS * (m + 1)) - 1).alias("gram")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("count")).withColumn("m", F.lit(m)))
        full = full.unionByName(level)
    found = {r.m: discounts(*r[1:]) for r in full.groupBy("m").agg(*(F.sum((F.col("count") == k).cast("long")) for k in (1, 2, 3, 4))).collect()}
    rows = full.where("m < 2").toPandas()
    short = [tuple(rows[rows.m == m][c].to_numpy(np.int64) for c in ("gram", "n", "count")) for m in (0, 1)]
    return Counts(longest.select("gram", "n"), [(g.view(np.uint64), n, c) for g, n, c in short], found, max(2, share * short[0][1].sum()) if share else 1)


def _values(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (short, by_level, least), held = sent.value, list(batches)
        if not held:
            return
        gram, n, uses = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in range(3))
        gram, inverse = np.unique(gram.view(np.uint64), return_inverse=True)
        n, uses = (np.bincount(inverse, x, len(gram)).astype(np.int64) for x in (n, uses))
        level = (gram[n > 0], n[n > 0], n[n > 0])
        levels = {ORDER: level, 0: short[0], 1: short[1]}
        for m in range(ORDER - 1, 1, -1):
            key, inverse, count = np.unique(level[0] & np.uint64((1 << BITS * (m + 1)) - 1), return_inverse=True, return_counts=True)
            levels[m] = level = key, np.bincount(inverse, level[1], len(key)).astype(np.int64), count
        rows = []
        for m, (cell, often, count) in levels.items():
            _, context = np.unique(cell >> np.uint64(BITS), return_inverse=True)
            kept = often >= least
            rows.append(tuple(x[kept] for x in (np.full(len(cell), m), cell, count, np.bincount(context, count)[context] if len(cell) else count)))
        model = Model.build(*(np.concatenate(x) for x in zip(*rows, strict=True)), by_level)
        used = uses > 0
        yield pa.RecordBatch.from_arrays([pa.array(gram[used].view(np.int64)), pa.array(uses[used]), pa.array(model.value(gram[used]))], ["gram", "uses", "value"])

    return run


def gram_values(texts: DataFrame, model: Counts) -> DataFrame:
    """gram, uses, value (log10) of each n-gram of texts (binary)."""
    uses = texts.select("text").mapInArrow(_uses, "gram long, uses long").groupBy("gram").agg(F.sum("uses").alias("uses"))
    both = model.full.select("gram", "n", F.lit(0).cast("long").alias("uses")).union(uses.select("gram", F.lit(0).cast("long"), "uses"))
    sent = texts.sparkSession.sparkContext.broadcast((model.short, model.discounts, model.least))
    before = F.shiftright("gram", BITS).bitwiseAND((1 << 2 * BITS) - 1)
    return cut(both.repartition(before).mapInArrow(_values(sent), "gram long, uses long, value double"))


def _score(sent):
    names = ["doc_id", "language", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "sure", "size", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_values = sent.value

        def value(found: np.ndarray) -> np.ndarray:
            if not len(known):
                return np.full(len(found), np.nan)
            at = np.minimum(np.searchsorted(known, found), len(known) - 1)
            return np.where(known[at] == found, known_values[at], np.nan)

        memo = Memo(value)
        for batch in batches:
            for part, texts in slices(batch, "text"):
                columns = list(zip(*map(base, texts), strict=True))
                sure, rare = parts(texts, ORDER + 1, memo)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("language"), *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.bool_()), pa.array(sure), pa.array([len(t) + 1 for t in texts], pa.int64()), rare], names)

    return run


def bands(scored: DataFrame, reach: float = REACH) -> DataFrame:
    """language, low, high from the documents that pass the plain rules; a row for each language."""
    bins = scored.where("not base_failed").groupBy("language", F.floor(F.col("log_perplexity") / STEP).alias("bin")).count()
    upto = Window.partitionBy("language").orderBy("bin")
    of = Window.partitionBy("language")
    ranked = bins.withColumns({"upto": F.sum("count").over(upto), "all": F.sum("count").over(of)})
    quartile = [F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("bin"))) * STEP for q in (0.25, 0.75)]
    ends = ranked.groupBy("language").agg(quartile[0].alias("q1"), quartile[1].alias("q3"))
    wide = F.greatest(F.col("q3") - F.col("q1"), F.lit(NARROWEST)) * reach
    return ends.select("language", (F.col("q1") - wide).alias("low"), (F.col("q3") + wide).alias("high"))


def judge(docs: DataFrame, model: Counts | None = None, reach: float = REACH) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, perplexity of docs' rows.

    docs has doc_id, text and lang; a null lang is a language of its own. The model is fitted on docs if none is
    given. Null text counts as empty and fails the plain rules, as all texts of less than 50 words do. Repeated rows
    count and are judged each. An empty table gives no rows. Other columns are not read.
    """
    model = model or fit(docs)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("language"), whole("text").cast("binary").alias("text"))
    values = gram_values(texts, model)
    often = COMMON * (values.agg(F.sum("uses")).first()[0] or 0)
    found = values.where(F.col("uses") >= often).select("gram", "value").orderBy("gram").toPandas()
    sent = docs.sparkSession.sparkContext.broadcast((found.gram.to_numpy(np.int64).view(np.uint64), found.value.to_numpy(float)))
    schema = "doc_id long, language string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, sure double, size long, rare array<struct<word: binary, gram: long, n: long>>"
    read_ = texts.mapInArrow(_score(sent), schema).withColumn("row", F.monotonically_increasing_id())
    # A document's own row travels with its rare n-grams, under a number that no n-gram has.
    own = F.struct(F.expr("X''").alias("word"), (-1 - F.col("row")).alias("gram"), F.lit(0).cast("long").alias("n"))
    columns = [c for c in read_.columns if c not in ("rare", "row")]
    dealt = read_.select("row", F.posexplode(F.concat(F.array(own), "rare")).alias("at", "x"), *columns)
    dealt = dealt.select("row", "x.gram", "x.n", *(F.when(F.col("at") == 0, F.col(c)).alias(c) for c in columns))
    joined = dealt.join(values.where(F.col("uses") < often).select("gram", "value").hint("merge"), "gram", "left")
    rows = joined.groupBy("row").agg(*(F.max(c).alias(c) for c in columns), F.sum(F.col("n") * F.coalesce("value", F.lit(0.0))).alias("more"))
    scored = cut(rows.select(*columns[:-2], (-(F.col("sure") + F.col("more")) / F.col("size")).alias("log_perplexity")))
    limits = cut(bands(scored, reach))
    if limits.count() <= SENT_LANGUAGES:
        placed = scored.join(F.broadcast(limits), "language", "left")
    else:  # one language may have most rows, so each is dealt out by a hash of the row
        salt = max(16, scored.count() // SALTED_ROWS)
        limits = limits.withColumn("salt", F.explode(F.expr(f"sequence(0L, {salt - 1}L)")))
        placed = scored.withColumn("salt", F.pmod(F.xxhash64("doc_id", "log_perplexity"), F.lit(salt))).join(limits.hint("merge"), ["language", "salt"], "left")
    within = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(False))
    return placed.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & within).alias("kept"), F.pow(F.lit(10.0), "log_perplexity").alias("perplexity"), "low", "high",
    )


def op10_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`judge` on all documents, with the model of those that pass the plain rules."""
    return judge(read(spark, sf_dir, "documents"))
