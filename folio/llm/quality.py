"""A quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each document. Spark counts how often each pattern of votes occurs
in all documents; expectation-maximisation over those counts estimates how often each labeller is right in either
class, and so the probability that a document with a given pattern is good. These posteriors are the training labels
of a linear scorer over hashed byte 4-grams and hashed ranges of the text's statistics, which decides about each
document. No given quality labels are used.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import held, keep_rows, read, whole
from folio.llm.simhash import word_blocks

GOOD, BAD, NONE = "g", "b", "-"
#: Common words of English, German, French and Spanish.
STOP = frozenset("the of and to in a is that it for on was as with be by are this at der die und das ist ein den von zu mit auf nicht le la les des et un une est en que de du dans pour el los se y no con del".encode().split())
SYMBOLS = b"#*$%&|<>"
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
#: Hash buckets of the scorer; the last ones are for statistics.
BUCKETS = 1 << 15
#: So many documents at most, those of the least hashes of id and text, train the scorer. The counts for the labellers cover all.
TRAINING_ROWS = 3000
#: Documents below this probability of good quality are rejected.
KEEP = 0.3


def statistics(data: bytes) -> dict[str, float]:
    n = repeats = stops = long = 0
    last, seen = None, Counter()
    for words in word_blocks(data.lower()):
        n += len(words)
        repeats += sum(map(eq, words, words[1:])) + (words[:1] == [last])
        stops += sum(map(STOP.__contains__, words))
        long += sum(len(w) for w in words)
        last = words[-1] if words else last
        seen.update(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    solid = max(1, long)
    return {
        "words": n,
        "symbols": (len(data) - len(data.translate(None, SYMBOLS))) / max(1, n),
        "repeats": repeats / max(1, n),
        "stops": stops / max(1, n),
        "length": long / max(1, n),
        "letters": (len(data) - len(data.translate(None, LETTERS))) / solid,
        "stated": (data.count(b". ") + data.count(b".\n") + data.endswith(b".")) / max(1, n),
        "same_lines": 1 - len(set(lines)) / max(1, len(lines)),
        "distinct": len(seen) / max(1, n),
        "top": max(seen.values(), default=0) / max(1, n),
    }


def votes(s: dict[str, float]) -> str:
    """One letter for each labeller.

    The share of distinct words falls with length in any text, so its labeller calls bad only what is below 3,000 words.
    """

    def vote(good: bool, bad: bool) -> str:
        return GOOD if good else BAD if bad else NONE

    enough = s["words"] >= 10
    return "".join((
        vote(s["symbols"] < 0.02, s["symbols"] > 0.2),
        vote(s["repeats"] < 0.05 and enough, s["repeats"] > 0.2 and enough),
        vote(s["stops"] > 0.12 and enough, s["stops"] < 0.02 and enough),
        vote(3 <= s["length"] <= 9, s["length"] < 2 or s["length"] > 14),
        vote(s["letters"] > 0.9, s["letters"] < 0.75),
        vote(0.01 < s["stated"] < 0.3, s["stated"] < 0.003 and enough),
        vote(s["same_lines"] < 0.1 and enough, s["same_lines"] > 0.4),
        vote(s["distinct"] > 0.3 and enough, s["distinct"] < 0.15 and 10 <= s["words"] < 3000),
        vote(s["top"] < 0.15 and enough, s["top"] > 0.3 and enough),
    ))


def _ranges(s: dict[str, float]) -> list[int]:
    """A bucket for the range that each statistic falls in."""
    return [BUCKETS - 1 - 32 * k - min(31, int((np.log2(x + 1) if name in ("words", "length") else min(1, x) ** 0.5 * 10) * (1 if name == "words" else 3))) for k, (name, x) in enumerate(s.items())]


def features(data: bytes, s: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their values: 4-grams by frequency, ranges by 0.1."""
    ranges, gram = np.array(_ranges(s)), np.frombuffer(data, np.uint8)
    if len(gram) < 4:
        return ranges, np.full(len(ranges), 0.1, np.float32)
    counts = np.zeros(BUCKETS, np.int64)
    for i in range(0, len(gram) - 3, 1 << 20):
        counts += np.bincount(_grams(gram[i : i + (1 << 20) + 3]), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return np.concatenate([at, ranges]), np.concatenate([counts[at] / (len(gram) - 3), np.full(len(ranges), 0.1)]).astype(np.float32)


def _grams(text: np.ndarray) -> np.ndarray:
    x = text.astype(np.uint32)
    x = x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16) | x[3:] << np.uint32(24)
    return (x * np.uint32(2654435761) >> np.uint32(8)) % np.uint32(BUCKETS - 32 * 10)


def posteriors(counts: dict[str, int], rounds: int = 100) -> dict[str, float]:
    """The probability of the good class for each pattern of votes, by expectation-maximisation.

    It starts from calling bad what two labellers call so. Of a labeller, what counts is how often its votes are
    right in either class; that it does not vote tells nothing.
    """
    patterns = sorted(counts)
    if not patterns:
        return {}
    n = np.array([counts[p] for p in patterns], float)
    vote = np.array([["gb-".index(c) for c in p] for p in patterns])
    good = np.array([(0.95, 0.6, 0.05)[min(2, p.count(BAD))] for p in patterns])
    for _ in range(rounds):
        share = (n @ good + 1) / (n.sum() + 2)
        score = np.full(len(patterns), np.log(share / (1 - share)))
        for k in range(vote.shape[1]):
            one, zero = (np.array([(n * of)[vote[:, k] == v].sum() for v in range(2)]) + 1 for of in (good, 1 - good))
            score += np.append(np.log(one / one.sum()) - np.log(zero / zero.sum()), 0)[vote[:, k]]
        new = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return dict(zip(patterns, good.tolist(), strict=True))


@dataclass(frozen=True)
class Model:
    posterior: dict[str, float]
    weights: np.ndarray
    bias: float

    def score(self, data: bytes, s: dict[str, float]) -> float:
        gram = np.frombuffer(data, np.uint8)
        z = self.bias + 0.1 * float(self.weights[_ranges(s)].sum())
        if len(gram) >= 4:
            z += sum(float(self.weights[_grams(gram[i : i + (1 << 20) + 3])].sum(dtype=np.float64)) for i in range(0, len(gram) - 3, 1 << 20)) / (len(gram) - 3)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = 30, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels, by AdaGrad in a fixed order of rows."""
    w, bias, seen, seen_bias = np.zeros(BUCKETS, np.float32), 0.0, np.full(BUCKETS, 1e-6, np.float32), 1e-6
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            at, x, y = rows[k]
            off = 1 / (1 + np.exp(-np.clip(bias + float(w[at] @ x), -30, 30))) - y
            g = off * x
            seen[at] += g * g
            w[at] -= rate * g / np.sqrt(seen[at])
            seen_bias += off * off
            bias -= rate * off / np.sqrt(seen_bias)
    return w, float(bias)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held("quality")
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([votes(statistics(t.as_py())) for t in batch.column("text")], pa.string())], ["votes"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for t in batch.column("text"):
            s = statistics(data := t.as_py())
            at, x = features(data, s)
            rows.append((votes(s), at.astype("<u2").tobytes(), x.astype("<f4").tobytes()))
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([batch.column("chosen"), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], ["chosen", "votes", "at", "x"])


def fit(docs: DataFrame, training_rows: int = TRAINING_ROWS) -> Model:
    """The model for docs.

    At most 3**9 patterns and training_rows rows of hashed features (6 bytes for each of BUCKETS at most, 200 KB) come
    to the driver. Where most rows are repeated, fewer rows may train.
    """
    texts = docs.select(whole("text").cast("binary").alias("text"), F.xxhash64("doc_id", whole("text")).alias("chosen"))
    counts = {r.votes: r["count"] for r in texts.select("text").mapInArrow(_votes, "votes string").groupBy("votes").count().collect()}
    posterior = posteriors(counts)
    # The sample is the rows of the training_rows least hashes; of rows with one hash (repeated rows) one counts.
    share = 2 * training_rows / max(1, sum(counts.values()))
    texts = texts.withColumn("chosen", F.pmod("chosen", F.lit(1 << 62)))
    near = texts.where(F.col("chosen") < int(min(1.0, share) * (1 << 62))).select("chosen").distinct()
    chosen = [r.chosen for r in near.orderBy("chosen").limit(training_rows).collect()]
    sample = texts.where(F.col("chosen") <= (chosen[-1] if chosen else -1)).mapInArrow(_features, "chosen long, votes string, at binary, x binary")
    rows = sample.groupBy("chosen").agg(F.first(F.struct("votes", "at", "x")).alias("f")).select("f.*").collect()
    rows = sorted((r.votes, bytes(r.at), bytes(r.x)) for r in rows)
    w, bias = train([(np.frombuffer(at, "<u2").astype(np.int64), np.frombuffer(x, "<f4"), posterior[v]) for v, at, x in rows])
    return Model(posterior, w, bias)


def _score(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            rows = []
            for t in batch.column("_text"):
                s = statistics(data := t.as_py())
                rows.append((v := votes(s), model.posterior.get(v, 0.5), model.score(data, s)))
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            kept = [x >= KEEP for x in columns[2]]
            added = [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.float64()), pa.array(kept, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns - 1)), *added], [*batch.schema.names[:-1], "votes", "posterior", "score", "kept"])

    return run


def score(docs: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The given columns of docs with votes, posterior, score (the probability of good quality) and kept.

    Null and empty texts get the votes of a text without words. Repeated rows score alike. An empty table gives no
    rows. None of the given columns may be called votes, posterior, score, kept or _text; others are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*columns)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "votes string, posterior double, score double, kept boolean"])
    return docs.select(*columns, whole("text").cast("binary").alias("_text")).mapInArrow(_score(sent), schema)


def keep_good(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of docs that the model, fitted on docs if none is given, does not reject.

    Null and empty texts are judged as texts without words, equal texts alike, with or without an id. All columns are
    kept, whatever their names. A text is held whole by its task, with all its distinct words and lines.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    def start():
        held("quality")
        model = sent.value
        return lambda texts: [model.score(data, statistics(data)) >= KEEP for data in map(str.encode, texts)]

    return keep_rows(docs, start)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`score` of all documents by the model fitted on them."""
    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs))
