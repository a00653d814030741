"""Sparse retrieval: the best dot products over shared terms, without scoring what cannot win.

Questions are a stated set and go to the data in blocks of a bounded number. Each task passes over its chunks once and
keeps the n best of every question. A question's n-th best score so far is a bound: its terms are put in the order of the most that
each can add in the batch at hand, and those at the low end that cannot reach the bound together (stop words, mostly) bring no chunk
up. Chunks come up by the other terms alone, and only for those are the low terms looked up. So the pairs of questions and chunks that
are made fall as the bound rises, and results are those of scoring every pair (MaxScore; Turtle and Flood, 1995).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import terms

#: Questions that are sent to the tasks at once, pairs that are made at once, and how far below its bound a sum must stay.
BLOCK, PAIRS, SLACK = 4096, 1 << 20, 1e-5
#: Words of the chunks that a task has at once.
WORDS = 1 << 20


def hashed_terms(text: Column | str) -> Column:
    """The 64-bit hash of each term of a text, in order."""
    return F.transform(terms(text), lambda t: F.xxhash64(t))


def weights(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes, ln(1 + count))."""
    found, n = np.unique(hashes, return_counts=True)
    return found, np.log1p(n.astype(float))


class Asked:
    """Questions by tenant: entries (question, term, weight) over a sorted vocabulary of hashes."""

    def __init__(self, rows: list) -> None:
        self.qids = np.array([r.qid for r in rows], np.int64)
        self.roles = [r.role_id for r in rows]
        parts = [weights(np.array(r.words or [], np.int64)) for r in rows]
        self.vocabulary = np.unique(np.concatenate([h for h, _ in parts])) if parts else np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(rows)), [len(h) for h, _ in parts])
        term = np.searchsorted(self.vocabulary, np.concatenate([h for h, _ in parts]))
        weight = np.concatenate([w for _, w in parts])
        tenants = np.array([r.tenant_id for r in rows], object)
        self.by_tenant = {}
        for t in {r.tenant_id for r in rows}:
            mine = np.array([x == t for x in tenants])[of] if len(of) else np.zeros(0, bool)
            self.by_tenant[t] = (of[mine], term[mine], weight[mine])


def _spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, place): for each k, the places from starts[k] on, counts[k] of them."""
    which = np.repeat(np.arange(len(starts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


def _scores(of: np.ndarray, term: np.ndarray, weight: np.ndarray, bound: np.ndarray, postings: tuple, rows: int, made: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(question, row, score) of every pair that may reach its question's bound, in runs of about PAIRS pairs.

    postings: row, term, weight, sorted by term. made counts the pairs that came up, and those that share a term.
    """
    p_row, p_term, p_weight = postings
    starts = np.searchsorted(p_term, np.arange(int(term.max(initial=0)) + 2))
    most = np.zeros(len(starts) - 1)
    within = p_term < len(most)
    np.maximum.at(most, p_term[within], p_weight[within])
    gain = weight * most[term]
    size = starts[term + 1] - starts[term]
    # Of terms that add as much, the one in most chunks is left low first.
    order = np.lexsort((-size, gain, of))
    order = order[gain[order] > 0]
    of, term, weight, gain, size = of[order], term[order], weight[order], gain[order], size[order]
    if not len(of):
        return
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    sums = np.cumsum(gain)
    reach = sums - np.repeat(np.concatenate([[0.0], sums[first[1:] - 1]]), np.diff(np.concatenate([first, [len(of)]])))
    brings = reach + SLACK >= bound[of]
    made[1] += int(size.sum())
    ends = np.concatenate([first[1:], [len(of)]])
    lookup = np.sort(p_row * np.int64(len(most)) + p_term) if not brings.all() else None
    by_place = np.argsort(p_row * np.int64(len(most)) + p_term, kind="stable") if lookup is not None else None
    pairs = np.add.reduceat(np.where(brings, size, 0), first)
    at = 0
    while at < len(first):
        stop = at + max(1, int(np.searchsorted(np.cumsum(pairs[at:]), PAIRS, side="right")))
        e = np.arange(first[at], ends[stop - 1])
        top, low = e[brings[e]], e[~brings[e]]
        which, place = _spread(starts[term[top]], size[top])
        made[0] += len(which)
        key, inverse = np.unique(of[top][which] * np.int64(rows) + p_row[place], return_inverse=True)
        score = np.bincount(inverse, weight[top][which] * p_weight[place], len(key))
        q, row = key // rows, key % rows
        if len(low) and len(key):
            n_low = np.bincount(of[low], minlength=int(of[e].max()) + 1)
            low_at = np.searchsorted(of[low], q)
            pair, j = _spread(low_at, n_low[q])
            want = row[pair] * np.int64(len(most)) + term[low][j]
            to = np.minimum(np.searchsorted(lookup, want), len(lookup) - 1)
            hit = lookup[to] == want
            score += np.bincount(pair[hit], weight[low][j[hit]] * p_weight[by_place[to[hit]]], len(key))
        yield q, row, score
        at = stop


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of some WORDS words, one row at least, so that what is made of their postings stays bounded."""
    for batch in batches:
        ends = np.cumsum(batch.column("words").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, WORDS + (ends[at - 1] if at else 0), side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def _task(sent, n: int, places: int, made=None):
    """A task's best rows of each question: qid, point_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Asked = sent.value
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        bound = np.full(len(asked.qids), -np.inf)
        count = [0, 0]
        for batch in _parts(batches):
            if not batch.num_rows or not len(asked.vocabulary):
                continue
            ids = batch.column("point_id").to_numpy(zero_copy_only=False)
            tenants = batch.column("tenant_id").to_pylist()
            may = [set(x or ()) for x in batch.column("accessed_role").to_pylist()]
            words = batch.column("words")
            flat = words.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), np.array(words.value_lengths().fill_null(0)))
            to = np.minimum(np.searchsorted(asked.vocabulary, flat), len(asked.vocabulary) - 1)
            hit = asked.vocabulary[to] == flat
            size = np.int64(len(asked.vocabulary))
            key, n_words = np.unique(row[hit] * size + to[hit], return_counts=True)
            row, term, weight = key // size, key % size, np.log1p(n_words.astype(float))
            code = {t: k for k, t in enumerate(dict.fromkeys(tenants))}
            of_tenant = np.array([code[t] for t in tenants])
            open_to = {role: np.array([role in x for x in may], bool) for role in set(asked.roles)}
            for tenant, k in code.items():
                if tenant is None or tenant not in asked.by_tenant:
                    continue
                mine = np.flatnonzero(of_tenant[row] == k)
                mine = mine[np.argsort(term[mine], kind="stable")]
                for q, r, score in _scores(*asked.by_tenant[tenant], bound, (row[mine], term[mine], weight[mine]), batch.num_rows, count):
                    score = np.round(score, places)
                    keep = score >= bound[q]
                    q, r, score = q[keep], r[keep], score[keep]
                    free = np.zeros(len(q), bool)
                    for x in np.unique(q).tolist():
                        part = slice(np.searchsorted(q, x), np.searchsorted(q, x, side="right"))
                        free[part] = open_to[asked.roles[x]][r[part]]
                    q, r, score = q[free], r[free], score[free]
                    order = np.lexsort((ids[r], -score, q))
                    q, r, score = q[order], r[order], score[order]
                    for x in np.unique(q).tolist():
                        part = slice(np.searchsorted(q, x), min(np.searchsorted(q, x, side="right"), np.searchsorted(q, x) + n))
                        new = ids[r[part]], score[part]
                        if x in held:
                            new = tuple(np.concatenate(c) for c in zip(held[x], new, strict=True))
                            best = np.lexsort((new[0], -new[1]))[:n]
                            new = new[0][best], new[1][best]
                        held[x] = new
                        if len(new[1]) == n:
                            bound[x] = new[1][-1]
        if made is not None:
            made[0].add(count[0])
            made[1].add(count[1])
        found = [(np.full(len(i), asked.qids[x]), i, s) for x, (i, s) in held.items()]
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["qid", "point_id", "score"])

    return run


def best_by_terms(blocks: list[DataFrame], chunks: DataFrame, n: int, places: int, made=None) -> list[DataFrame]:
    """For each block of questions (qid, tenant_id, role_id, question) each task's n best chunks: qid, point_id, score.

    chunks: point_id, tenant_id, accessed_role, content. made: two accumulators, of pairs that came up and of pairs that share a term.
    """
    spark, out = chunks.sparkSession, []
    data = chunks.select(F.col("point_id").cast("long"), "tenant_id", "accessed_role", hashed_terms("content").alias("words"))
    for block in blocks:
        rows = block.select("qid", "tenant_id", "role_id", hashed_terms("question").alias("words")).collect()
        if rows:
            sent = spark.sparkContext.broadcast(Asked(rows))
            out.append(data.mapInArrow(_task(sent, n, places, made), "qid long, point_id long, score double"))
    return out
