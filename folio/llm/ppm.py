"""Scores of texts by prediction by partial matching (PPM, method C, with exclusion) over bytes.

Spark counts all byte n-grams of the training documents, and all stay in the model. It holds, for contexts of up to
ORDER bytes, the next bytes and their counts. A byte is coded in the longest context that the model has; where that
lacks the byte, an escape is coded and the next shorter context follows, without the bytes already ruled out. As the
model is fixed once trained, all of this depends on the last ORDER + 1 symbols alone, and a document's score is the
sum of its n-grams' logarithms. A text's end is coded as one more symbol.

What an n-gram's value depends on ends in the same two symbols before the last one, but for contexts of one byte or
none. So counts are dealt out by these two; each task builds the trie of its share, with the short contexts (SYMBOLS
squared at most) beside it, and gives the values of its n-grams. Values of frequent n-grams (COMMON of all symbols,
so 1 / COMMON at most) are looked up in a broadcast, and the others joined.

Beside it stands a word unigram model as a base. Frequent words (at least WORD_SHARE of all tokens, so 1 / WORD_SHARE
at most) are looked up in a broadcast, and the others joined, so no word heats a join.
"""

from __future__ import annotations

from collections import Counter as Counts
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import cut, id_bucket, read, whole
from folio.llm.grams import BITS, Counter, Memo, parts, pieces, slices
from folio.llm.simhash import word_blocks

ORDER = 4
COMMON = 1e-6
WORD_SHARE = 5e-6
SYMBOLS = 257
#: Words that a task counts before it passes them on.
HELD_WORDS = 200_000
ADD = 0.1


def _low(x: np.ndarray, symbols: int) -> np.ndarray:
    return x & np.uint64((1 << BITS * symbols) - 1)


@dataclass
class Trie:
    """For contexts of each length: sorted cells (grams) and contexts with what coding needs, as log10."""

    cells: list[tuple[np.ndarray, np.ndarray]]  # gram, count
    contexts: list[dict[str, np.ndarray]]  # key, n, q; from the longer context: what is left in the shorter
    left: float  # log10 of a symbol's share where no context has it

    @classmethod
    def build(cls, order: np.ndarray, gram: np.ndarray, count: np.ndarray, n: np.ndarray, q: np.ndarray) -> Trie:
        """Rows: context length, gram (context and symbol), its count, its context's count and distinct symbols."""
        cells, contexts = [], []
        for m in range(ORDER + 1):
            of = np.flatnonzero(order == m)
            of = of[np.argsort(gram[of], kind="stable")]
            cells.append((gram[of], count[of].astype(float)))
            key, first, kept = np.unique(gram[of] >> np.uint64(BITS), return_index=True, return_counts=True)
            sure = np.add.reduceat(count[of], first) if len(of) else np.empty(0)
            at = {"key": key, "n": n[of][first].astype(float), "q": q[of][first].astype(float), "sure": sure.astype(float), "kept": kept.astype(float)}
            if m and len(of):  # exclusion: the shorter context's counts of the symbols that this one has
                shorter = np.searchsorted(cells[m - 1][0], _low(gram[of], m))
                gone = np.add.reduceat(cells[m - 1][1][shorter], first)
                up = np.searchsorted(contexts[m - 1]["key"], _low(key, m - 1))
                low = contexts[m - 1]
                at["escape_left"] = low["q"][up] - at["kept"] + low["n"][up] - low["sure"][up]
                at["all_left"] = at["escape_left"] + low["sure"][up] - gone
            contexts.append(at)
        return cls(cells, contexts, -np.log10(max(1, SYMBOLS - len(cells[0][0]))))

    def value(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last symbol after the others."""
        out, open_ = np.zeros(len(grams)), np.ones(len(grams), bool)
        total, escape = np.zeros(len(grams)), np.zeros(len(grams))  # of the next context, where a longer one went before
        entered = np.zeros(len(grams), bool)
        for m in range(ORDER, -1, -1):
            at = self.contexts[m]
            if not len(at["key"]):
                continue
            key = _low(grams >> np.uint64(BITS), m)
            c = np.minimum(np.searchsorted(at["key"], key), len(at["key"]) - 1)
            here = open_ & (at["key"][c] == key)
            fresh = here & ~entered
            total[fresh], escape[fresh] = (at["n"] + at["q"])[c[fresh]], (at["q"] + at["n"] - at["sure"])[c[fresh]]
            entered |= here
            here &= total > 0  # nothing is left in this context but what is ruled out
            cell, count = self.cells[m]
            g = _low(grams, m + 1)
            k = np.minimum(np.searchsorted(cell, g), len(cell) - 1)
            hit = here & (cell[k] == g)
            out[hit] += np.log10(count[k[hit]] / total[hit])
            miss = here & ~hit
            out[miss] += np.log10(escape[miss] / total[miss])
            open_ &= ~hit
            if m:
                go = open_ & entered
                total[go], escape[go] = at["all_left"][c[go]], at["escape_left"][c[go]]
        out[open_] += self.left
        return out


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counters = Counter(), Counter()
    for batch in batches:
        for part, texts in slices(batch, "text"):
            held = part.column("held_out").to_pylist()
            for k, counter in enumerate(counters):
                for found, _, _ in pieces([t for t, h in zip(texts, held, strict=True) if h is (k == 1)], ORDER + 1):
                    counter.add(found)
    for k, counter in enumerate(counters):
        keys, n = counter.merge()
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n * (k == 0)), pa.array(n)], ["gram", "n", "uses"])


def _summed(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(grams, return_inverse=True)
    return keys, np.bincount(inverse, n, len(keys)).astype(np.int64)


def _values(sent, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, held = sent.value, list(batches)
        if not held:
            return
        gram, n, uses = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in range(3))
        gram, rows = gram.view(np.uint64), []
        for m in range(ORDER + 1):
            of, count = pairs if m < 2 else (gram[n > 0], n[n > 0])
            cell, count = _summed(_low(of, m + 1), count)
            _, context, q = np.unique(cell >> np.uint64(BITS), return_inverse=True, return_counts=True)
            kept = count >= least
            rows.append(tuple(x[kept] for x in (np.full(len(cell), m), cell, count, np.bincount(context, count, len(q))[context].astype(np.int64), q[context])))
        trie = Trie.build(*(np.concatenate(x) for x in zip(*rows, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(uses), pa.array(trie.value(gram))], ["gram", "uses", "value"])

    return run


def gram_values(texts: DataFrame, share: float = 0.0) -> DataFrame:
    """gram, uses, value (log10) of each n-gram of texts (text as binary, held_out), which is trained on those not held out.

    A share above 0 leaves n-grams that make up less of all symbols, and single ones, to the escapes.
    """
    counted = cut(texts.select("text", F.coalesce("held_out", F.lit(True)).alias("held_out")).mapInArrow(_count_grams, "gram long, n long, uses long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("uses").alias("uses")))
    last = F.col("gram").bitwiseAND((1 << 2 * BITS) - 1).alias("gram")
    pairs = counted.where("n > 0").groupBy(last).agg(F.sum("n").alias("n")).toPandas()
    pairs = pairs.gram.to_numpy(np.int64).view(np.uint64), pairs.n.to_numpy(np.int64)
    least = max(2, share * pairs[1].sum()) if share else 1
    sent = texts.sparkSession.sparkContext.broadcast(pairs)
    before = F.shiftright("gram", BITS).bitwiseAND((1 << 2 * BITS) - 1)
    return cut(counted.repartition(before).select("gram", "n", "uses").mapInArrow(_values(sent, least), "gram long, uses long, value double"))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counts = Counts()

    def passed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch.column("text"):
            for words in word_blocks(text.as_py().lower()):
                held.update(words)
                if len(held) > HELD_WORDS:
                    yield passed()
                    held.clear()
    yield passed()


def _score(sent):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "sure", "score", "rare", "rare_grams"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known_grams, known_values), common = sent.value

        def value(found: np.ndarray) -> np.ndarray:
            if not len(known_grams):
                return np.full(len(found), np.nan)
            at = np.minimum(np.searchsorted(known_grams, found), len(known_grams) - 1)
            return np.where(known_grams[at] == found, known_values[at], np.nan)

        memo = Memo(value)
        for batch in batches:
            for part, texts in slices(batch, "text"):
                rows = []
                for text in texts:
                    tokens = known = 0
                    sure, rare = 0.0, Counts()
                    for words in word_blocks(text.lower()):
                        tokens += len(words)
                        values = list(map(common.get, words))
                        if None in values:
                            rare.update(w for w, v in zip(words, values, strict=True) if v is None)
                            values = [v for v in values if v is not None]
                        known += len(values)
                        sure += sum(values)
                    rows.append((tokens, known, sure, list(rare.items())))
                columns = list(zip(*rows, strict=True))
                rare = pa.array([[{"word": w, "gram": -1, "n": n} for w, n in x] for x in columns[3]], pa.list_(pa.struct([("word", pa.binary()), ("gram", pa.int64()), ("n", pa.int64())])))
                score, rare_grams = parts(texts, ORDER + 1, memo)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()), pa.array(score), rare, rare_grams], names)

    return run


def score(docs: DataFrame, held_out: str = "held_out", share: float = 0.0, word_share: float = WORD_SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs.

    docs has doc_id, text and the boolean column held_out; the other rows train both models. Null text counts as
    empty: one end token and one end symbol. Repeated rows count and score each. An empty table gives no rows; with
    no training rows all words are unknown and all symbols alike. Other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.col(held_out).alias("held_out"), whole("text").cast("binary").alias("text"))
    training = texts.where("not held_out")
    values = gram_values(texts, share)
    often = COMMON * (values.agg(F.sum("uses")).first()[0] or 0)
    found = values.where(F.col("uses") >= often).select("gram", "value").orderBy("gram").toPandas()
    frequent = found.gram.to_numpy(np.int64).view(np.uint64), found.value.to_numpy(float)

    words = cut(training.select("text").mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")))
    ends = training.count()
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    total, distinct = total + ends, distinct + (ends > 0)
    least = max(1, word_share * total)
    common = {bytes(r.word): float(np.log10(r.c + ADD)) for r in words.where(F.col("c") >= least).collect()}

    sent = spark.sparkContext.broadcast((frequent, common))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, sure double, score double, rare array<struct<word: binary, gram: long, n: long>>, rare_grams array<struct<word: binary, gram: long, n: long>>"
    scored = texts.mapInArrow(_score(sent), schema).withColumn("row", F.monotonically_increasing_id())
    # A document's own row travels with its rare words and grams, under a key that is no word and falls together with none.
    own = F.struct(F.concat(F.lit("\n"), F.col("row").cast("string")).cast("binary").alias("word"), F.lit(-1).cast("long").alias("gram"), F.lit(0).cast("long").alias("n"))
    pieces_ = scored.select("row", F.posexplode(F.concat(F.array(own), "rare", "rare_grams")).alias("at", "x"), "doc_id", "held_out", "n_tokens", "n_known", "sure", "score")
    first = [F.when(F.col("at") == 0, F.col(c)).alias(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "sure", "score")]
    pieces_ = pieces_.select("row", "x.word", "x.gram", "x.n", *first)
    known = words.where(F.col("c") < least).select("word", F.lit(-1).cast("long").alias("gram"), "c", F.lit(None).cast("double").alias("value"))
    known = known.union(values.where(F.col("uses") < often).select(F.expr("X''"), "gram", F.lit(None).cast("long"), "value"))
    joined_ = pieces_.join(known.hint("merge"), ["word", "gram"], "left")
    c = F.coalesce("c", F.lit(0))
    rows = joined_.groupBy("row").agg(
        *(F.max(x).alias(x) for x in ("doc_id", "held_out", "n_tokens", "n_known", "sure", "score")),
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.when(F.col("gram") < 0, F.col("n") * F.log10(c + F.lit(ADD))).otherwise(0)).alias("more"),
        F.sum(F.col("n") * F.coalesce("value", F.lit(0.0))).alias("more_score"),
    )
    end, norm = float(np.log10(ends + ADD)), float(np.log10(total + ADD * (distinct + 1)))
    tokens = F.col("n_tokens") + 1
    return rows.select("doc_id", "held_out", tokens.alias("n_tokens"), (F.col("n_known") + F.col("more_known") + int(ends > 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("sure") + F.col("more") + F.lit(end) - tokens * F.lit(norm)).alias("base_score"), (F.col("score") + F.col("more_score")).alias("score"))


def op4_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs.select("doc_id", "text", (id_bucket("doc_id", 10) == 0).alias("held_out")))
