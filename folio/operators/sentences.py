"""Sentences and their terms, row by row: each text's sentences stay lists in its row, so nothing is shuffled.

Spark splits the texts; numbers of the sentences come from the term counts of a row, for some hundred rows at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions.text import terms

#: Rows whose terms are counted at once.
PART = 128


def split_sentences(text: Column | str) -> Column:
    """A text's sentences: cut at white space after ., ! or ?."""
    return F.split(text, r"(?<=[.!?])\s+")


def _spans(lists: pa.ListArray) -> np.ndarray:
    """The number of the list that each value of lists.flatten() is in."""
    return np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))


def number_sentences(rows: DataFrame, name: str, numbers: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """rows (with sentences, a list of texts) with `name`, a list of one number for each sentence.

    numbers(row, sentence, term): row is that of each sentence, the others are the sentence and the number of each term
    occurrence, in order; it gives a number for each sentence.
    """
    names = [*rows.columns, name]
    kinds = T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    lists = rows.withColumn("_terms", F.transform("sentences", lambda x: terms(x)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                held = part.column("_terms")
                row, each = _spans(held), held.flatten()
                words = each.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                found = numbers(row, _spans(each), words)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))]).astype(np.int32)
                made = pa.ListArray.from_arrays(pa.array(ends), pa.array(found, pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], made], names)

    return lists.mapInArrow(run, kinds)


def counted(sentence: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(key, sentence, count) of each distinct term of a sentence, by ascending key = sentence * size + term; and size."""
    size = int(term.max(initial=0)) + 1
    key, n = np.unique(sentence * size + term, return_counts=True)
    return key, key // size, n.astype(float), size


def next_cosines(row: np.ndarray, sentence: np.ndarray, term: np.ndarray) -> np.ndarray:
    """The cosine of the term counts of each sentence and the next one of its row; 0 where either has no terms, and for a row's last."""
    key, of, n, size = counted(sentence, term)
    norm = np.sqrt(np.bincount(of, n * n, len(row)))
    to = np.minimum(np.searchsorted(key, key + size), max(len(key) - 1, 0))
    hit = (key[to] == key + size) if len(key) else np.zeros(0, bool)
    dot = np.bincount(of[hit], n[hit] * n[to[hit]], len(row))
    both = norm * np.append(norm[1:], 0.0)
    same = np.append(row[1:] == row[:-1], False) if len(row) else np.zeros(0, bool)
    return np.where(same & (both > 0), dot / np.where(both > 0, both, 1.0), 0.0)


def mean_weights(row: np.ndarray, sentence: np.ndarray, term: np.ndarray) -> np.ndarray:
    """The mean over each sentence's terms of ln(1 + count in the row); 0 without terms."""
    size = int(term.max(initial=0)) + 1
    _, at, n = np.unique(row[sentence] * size + term, return_inverse=True, return_counts=True)
    weight = np.bincount(sentence, np.log1p(n.astype(float))[at], len(row))
    many = np.bincount(sentence, minlength=len(row))
    return weight / np.maximum(many, 1)
