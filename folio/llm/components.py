"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), as joins and minima.

Before the first step and after each, every task contracts the edges that it reads, LOCAL at a time, to stars, so few
rounds are left to do across tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import cut, written

#: Edges that a task contracts at once (some 100 MB).
LOCAL = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hi, lo): edges from each node of the edges (a, b) to the least node that these connect it with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
    below = root != np.arange(len(nodes))
    return nodes[below], nodes[root[below]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> pa.RecordBatch:
        found = stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["hi", "lo"])

    for batch in batches:
        held.append(tuple(batch.column(c).to_numpy() for c in ("hi", "lo")))
        if sum(len(x) for x, _ in held) >= LOCAL:
            yield out()
    if held:
        yield out()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars around least nodes: each hi once, and no node both hi and lo."""
    ends = edges.select(F.col("hi").alias("node"), F.lit(1).alias("up")).union(edges.select("lo", F.lit(0)).distinct())
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (hi, lo) with hi > lo.

    Minima are partial aggregates, and cut, so that both sides of the joins are plain and AQE can split a hub's edges.
    """
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    large = cut(both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi > lo").distinct())
    low = cut(large.groupBy("hi").agg(F.min("lo").alias("m")))
    moved = large.join(low.hint("merge"), "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.union(low.select("hi", F.col("m").alias("lo"))).where("hi > lo").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node that has a link (a, b); root is the least node of its component. Nodes are longs.

    Each round is written, so a lost executor costs at most that round.
    """
    kind = "hi long, lo long"
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    edges = written(edges.mapInArrow(_contracted, kind).distinct())
    for _ in range(rounds):
        if _settled(edges):
            break
        edges = written(written(_stars(edges)).mapInArrow(_contracted, kind).distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(edges.select("lo", "lo").distinct())
