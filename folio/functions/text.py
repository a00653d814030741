"""Column functions for tokens and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_count(text: Column | str) -> Column:
    """The portable estimate of a text's tokens: a third of its characters, 1 at least."""
    return F.greatest(F.lit(1), F.floor((F.length(text) + 2) / 3).cast("int"))


def terms(text: Column | str) -> Column:
    """The letter-and-digit runs of a text, lower case."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def l2_normalize(vector: Column | str) -> Column:
    """The vector at length 1; a zero vector stays."""
    v = F.col(vector) if isinstance(vector, str) else vector
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))
