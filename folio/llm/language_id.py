"""Language identification by a convolutional network over bytes, trained in numpy.

A window of WINDOW bytes is embedded byte by byte; filters of several widths run over it, each keeps its largest
value in the window, and a softmax over these gives the languages. To apply it, what a filter gives for each pair of
bytes is worked out once, so a window takes a few table look-ups a byte. A text is cut into windows from its first to
its last byte (the last is filled up with spaces); their scores, weighed by their bytes, are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import id_bucket, read, whole

WINDOW = 256
WIDTHS, FILTERS, EMBEDDED = (2, 3, 4), 16, 8
#: For each language, so many windows train the network: those of least hash, up to WINDOWS_OF_ONE from a document.
WINDOWS_PER_LANGUAGE, WINDOWS_OF_ONE = 800, 2
UNKNOWN = "und"
OVER = 4
#: Windows that run through the network at once.
TOGETHER = 64


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # 256, EMBEDDED
    filters: list[np.ndarray]  # for each width: width, EMBEDDED, FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> None:
        """What each filter gives for bytes, and pairs of bytes, at its places."""
        self.pairs, self.singles = [], []
        for f in self.filters:
            at = np.einsum("be,kef->kbf", self.embedding, f).astype(np.float32)
            self.pairs.append([(at[k][:, None] + at[k + 1][None]).reshape(65536, FILTERS) for k in range(0, len(f) - 1, 2)])
            self.singles.append(at[-1] if len(f) % 2 else None)

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """The largest value of each filter in each window (rows of WINDOW bytes)."""
        pair = windows[:, :-1].astype(np.int32) << 8 | windows[:, 1:]
        out = []
        for width, pairs, single in zip(WIDTHS, self.pairs, self.singles, strict=True):
            n = WINDOW - width + 1
            value = pairs[0][pair[:, :n]]
            for k, table in enumerate(pairs[1:], 1):
                value += table[pair[:, 2 * k : 2 * k + n]]
            if single is not None:
                value += single[windows[:, width - 1 : width - 1 + n]]
            out.append(value.max(1))
        return np.maximum(np.concatenate(out, 1) + self.bias, 0)

    def scores(self, windows: np.ndarray) -> np.ndarray:
        return np.concatenate([self.pooled(windows[k : k + TOGETHER]) @ self.out + self.out_bias for k in range(0, len(windows), TOGETHER)])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 6, rate: float = 0.01, batch: int = 64, seed: int = 1) -> Network:
    """The network by Adam; rows in a fixed random order, so equal rows give an equal network."""
    rng = np.random.default_rng(seed)
    shapes = [(256, EMBEDDED), *((w, EMBEDDED, FILTERS) for w in WIDTHS)]
    p = [rng.normal(0, 0.5 / np.sqrt(np.prod(s[:-1]) if len(s) > 2 else 1), s).astype(np.float32) for s in shapes]
    hidden = FILTERS * len(WIDTHS)
    p += [np.zeros(hidden, np.float32), rng.normal(0, 0.3, (hidden, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)]
    mean, square, step = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for k in range(0, len(order), batch):
            rows = windows[order[k : k + batch]]
            embedded, pools, places, patches = p[0][rows], [], [], []
            for width, f in zip(WIDTHS, p[1 : 1 + len(WIDTHS)], strict=True):
                n = WINDOW - width + 1
                value = sum(embedded[:, j : j + n] @ f[j] for j in range(width))
                at = value.argmax(1)  # rows, FILTERS
                pools.append(np.take_along_axis(value, at[:, None], 1)[:, 0])
                places.append(at)
            raw = np.concatenate(pools, 1) + p[-3]
            active = np.maximum(raw, 0)
            off = _softmax(active @ p[-2] + p[-1])
            off[np.arange(len(rows)), labels[order[k : k + batch]]] -= 1
            off /= len(rows)
            back = (off @ p[-2].T) * (raw > 0)
            grads = [np.zeros_like(p[0])]
            for w, (width, f, at) in enumerate(zip(WIDTHS, p[1 : 1 + len(WIDTHS)], places, strict=True)):
                g = back[:, w * FILTERS : (w + 1) * FILTERS]
                grad = np.empty_like(f)
                for j in range(width):
                    seen = rows[np.arange(len(rows))[:, None], at + j]  # the byte under each filter's best place
                    grad[j] = np.einsum("bfe,bf->ef", p[0][seen], g)
                    np.add.at(grads[0], seen.ravel(), (g[..., None] * f[j].T[None]).reshape(-1, EMBEDDED))
                grads.append(grad)
            grads += [back.sum(0), active.T @ off, off.sum(0)]
            step += 1
            for x, g, m, s in zip(p, grads, mean, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Network(languages, p[0], p[1 : 1 + len(WIDTHS)], *p[-3:])


def windows_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The windows of a text, and how many of its bytes each holds."""
    n = max(1, -(-len(data) // WINDOW))
    held = np.full(n, WINDOW)
    held[-1] = len(data) - WINDOW * (n - 1)
    return np.frombuffer(data.lower().ljust(n * WINDOW), np.uint8).reshape(n, WINDOW), held


def fit(docs: DataFrame, per_language: int = WINDOWS_PER_LANGUAGE) -> Network | None:
    """The network of the rows of docs (text, lang, doc_id) that have a lang; None if none has one and a text.

    The driver gets per_language windows for each language.
    """
    data = F.col("text").cast("binary")
    some = docs.where("lang is not null and text is not null and text <> ''").withColumn("nth", F.explode(F.expr(f"sequence(0, {WINDOWS_OF_ONE - 1})")))
    chosen = F.pmod(F.xxhash64("doc_id", "text", "nth"), F.lit(1 << 62))
    start = F.pmod(F.xxhash64("nth", "text"), F.greatest(F.lit(1), F.octet_length("text") - WINDOW + 1)).cast("int") + 1
    cuts = some.select("lang", chosen.alias("chosen"), F.substring(data, start, WINDOW).alias("piece"))
    # Least hashes are found among those below a bound that leaves about OVER times as many as are wanted.
    found = {r.lang: r["count"] for r in cuts.groupBy("lang").count().collect()}
    if not found:
        return None
    bounds = F.create_map(*(F.lit(x) for lang, n in sorted(found.items()) for x in (lang, min(1.0, OVER * per_language / n))))
    cuts = cuts.where(F.col("chosen") <= bounds[F.col("lang")] * float(1 << 62))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("chosen", "piece"))
    rows = sorted((r.lang, bytes(r.piece)) for r in cuts.withColumn("n", first).where(F.col("n") <= per_language).select("lang", "piece").collect())
    languages = sorted({x for x, _ in rows})
    return train(np.stack([windows_of(x)[0][0] for _, x in rows]), np.array([languages.index(x) for x, _ in rows]), languages)


def _predict(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = sent.value
        if network:
            network.tables()
        for whole_batch in batches:
            for begin in range(0, whole_batch.num_rows, 256):
                batch = whole_batch.slice(begin, 256)
                names, sure = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
                known = [k for k, (text, letters) in enumerate(zip(batch.column("text"), batch.column("letters").to_pylist(), strict=True)) if letters and network]
                cut = [windows_of(batch.column("text")[k].as_py()) for k in known]
                scores = network.scores(np.concatenate([w for w, _ in cut])) if cut else None
                ends = np.cumsum([len(w) for w, _ in cut]).tolist()
                for k, (_, held), end in zip(known, cut, ends, strict=True):
                    p = _softmax(held @ scores[end - len(held) : end] / max(1, held.sum()))
                    names[k], sure[k] = network.languages[int(p.argmax())], float(p.max())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names), pa.array(sure)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs (doc_id, held_out, text).

    lang_pred is `und`, with score 0, if the text is null or has no letter, or if nothing could be learned. Repeated
    rows get the same answer. An empty table gives no rows. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(network)
    texts = docs.select(F.col("doc_id").cast("long"), "held_out", whole("text").cast("binary").alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return texts.mapInArrow(_predict(sent), "doc_id long, held_out boolean, lang_pred string, score double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", (id_bucket("doc_id", 4) == 2).alias("held_out"))
    return predict(docs, fit(docs.where("not held_out")))
