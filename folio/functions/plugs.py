"""Where a model is plugged in: an encoder of texts and a scorer of pairs, both over batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.text import terms

DIMENSIONS = 64
#: Rows whose words are counted at once.
PART = 256


def _slots(words: list[str], dimensions: int) -> np.ndarray:
    return np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dimensions for w in words], np.int64)


def hashed_vectors(rows: DataFrame, text: str, dimensions: int = DIMENSIONS, name: str = "vector") -> DataFrame:
    """rows with a vector: ln(1 + count) of each term, added up at the term's hash; the encoder where no model is given.

    It is made within the row, from the words of PART rows at a time. A text without terms has the zero vector.
    """

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for at in range(0, len(batch), PART):
                lists = [() if x is None else x for x in batch.iloc[at : at + PART]]
                row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                code, words = pd.factorize(np.concatenate([np.asarray(x, object) for x in lists]))
                cell, n = np.unique(row * np.int64(max(1, len(words))) + code, return_counts=True)
                row, code = np.divmod(cell, max(1, len(words)))
                place = row * dimensions + _slots(list(words), dimensions)[code]
                out += list(np.bincount(place, np.log1p(n), len(lists) * dimensions).reshape(-1, dimensions))
            yield pd.Series(out, index=batch.index, dtype=object)

    # Declared so, it is not repeated in the filters on the vector.
    return rows.withColumn(name, encode.asNondeterministic()(terms(text)))


def vectorize(rows: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "text", name: str = "vector") -> DataFrame:
    """rows with the vectors of an encoder; load() runs once in each worker and gives a function of a batch of texts."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series(list(np.asarray(model(batch.fillna("").tolist()), np.float32)), index=batch.index)

    return rows.withColumn(name, encode(text))


def count_tokens(rows: DataFrame, load: Callable[[], Callable[[list[str]], list[int]]], text: str = "text", name: str = "tokens") -> DataFrame:
    """rows with the token counts of a tokenizer, in place of text.token_count; load() runs once in each worker. A null text has none."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series(model(batch.fillna("").tolist()), index=batch.index, dtype="int32")

    return rows.withColumn(name, count(text))


def score_pairs(rows: DataFrame, load: Callable[[], Callable[[list[str], list[str]], np.ndarray]], left: str = "question", right: str = "content", name: str = "score") -> DataFrame:
    """rows with the scores of a pair scorer; load() runs once in each worker."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for a, b in batches:
            yield pd.Series(np.asarray(model(a.fillna("").tolist(), b.fillna("").tolist()), float), index=a.index)

    return rows.withColumn(name, score(left, right))
