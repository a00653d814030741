"""Retrieval for a table of questions: dense and sparse candidates, their fusion, and reranking.

Questions are a stated set and go to the data: they are sent to all tasks in blocks of a bounded number, each task
keeps its own best rows for each question, and only those meet in a shuffle. Scores are rounded to PLACES before
they are ranked, so that ties (equal texts) are ties however sums were added up, and fall to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.plugs import hashed_vectors
from folio.functions.text import terms
from folio.operators.lists import REACH, Lists, build_lists, search_lists
from folio.operators.sparse import best_by_terms

PLACES = 6
#: Questions that are sent to the tasks at once.
BLOCK = 4096
#: The constant of reciprocal-rank fusion (Cormack et al., 2009).
RRF = 60


def acl_join(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pairs of a question and a chunk of its tenant that its role may see: the rows of each question."""
    return chunks.join(questions.hint("merge"), "tenant_id").where(F.array_contains("accessed_role", F.col("role_id")))


def allowed(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """qid, n_allowed: how many chunks each question may see. Chunks are counted by tenant and role first."""
    seen = chunks.select("tenant_id", F.explode(F.array_distinct("accessed_role")).alias("role_id")).groupBy("tenant_id", "role_id").count()
    return questions.join(seen.hint("merge"), ["tenant_id", "role_id"], "left").select("qid", F.coalesce("count", F.lit(0)).alias("n_allowed"))


def _ranked(scored: DataFrame, n: int, by: str = "qid", key: str = "point_id") -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _blocks(questions: DataFrame, size: int) -> list[DataFrame]:
    n = -(-questions.count() // size)
    return [questions.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == k) for k in range(n)]


def _best(ids: np.ndarray, scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n of largest score, ties to the smaller id."""
    if len(ids) > n:
        near = scores >= -np.partition(-scores, n - 1)[n - 1]
        ids, scores = ids[near], scores[near]
    order = np.lexsort((ids, -scores))[:n]
    return ids[order], scores[order]


def _dense(sent, n: int):
    """A task keeps the best rows of each question over all its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, tenants, roles, matrix = sent.value
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            ids, of = batch.column("point_id").to_numpy(zero_copy_only=False), np.array(batch.column("tenant_id").to_pylist(), object)
            may = [set(x or ()) for x in batch.column("accessed_role").to_pylist()]
            open_to = {role: np.array([role in x for x in may], bool) for role in set(roles)}
            for tenant in set(of) - {None}:
                at, ask = np.flatnonzero(of == tenant), np.flatnonzero(tenants == tenant)
                for k in range(0, len(ask), 256):
                    scores = np.round(matrix[ask[k : k + 256]] @ rows[at].T, PLACES)
                    for q, line in zip(ask[k : k + 256].tolist(), scores, strict=True):
                        free = open_to[roles[q]][at]
                        found = _best(ids[at[free]], line[free], n)
                        held[q] = _best(*(np.concatenate(x) for x in zip(held[q], found, strict=True)), n) if q in held else found
        of = np.repeat([qids[q] for q in held], [len(x) for x, _ in held.values()]) if held else []
        columns = [np.concatenate([x[k] for x in held.values()]) if held else [] for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.float64())], ["qid", "point_id", "score"])

    return run


def dense_topk(questions: DataFrame, chunks: DataFrame, n: int = 40) -> DataFrame:
    """qid, point_id, score, rank: the n chunks of largest cosine that each question may see.

    questions: qid, tenant_id, role_id, vector; chunks: point_id, tenant_id, accessed_role, vector. A zero vector
    has cosine 0 with all, and a null one, asked or held, is left out.
    """
    spark, found = chunks.sparkSession, []
    unit = lambda v: F.expr(f"transform({v}, x -> cast(x as double) / greatest(sqrt(aggregate({v}, 0D, (s, y) -> s + cast(y as double) * cast(y as double))), 1e-300D))")
    for block in _blocks(questions, BLOCK):
        rows = block.where("vector is not null").select("qid", "tenant_id", "role_id", unit("vector").alias("vector")).collect()
        if not rows:
            continue
        sent = spark.sparkContext.broadcast(([r.qid for r in rows], np.array([r.tenant_id for r in rows], object), [r.role_id for r in rows], np.array([r.vector for r in rows], float)))
        data = chunks.where("vector is not null").select(F.col("point_id").cast("long"), "tenant_id", "accessed_role", unit("vector").alias("vector"))
        found.append(data.mapInArrow(_dense(sent, n), "qid long, point_id long, score double"))
    return _ranked(_union(found, spark), n)


def sparse_encode(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, weight = ln(1 + count): posting rows."""
    return rows.select(key, F.explode(terms(text)).alias("term")).groupBy(key, "term").agg(F.log1p(F.count(F.lit(1)).cast("double")).alias("weight"))


def _union(parts: list[DataFrame], spark, schema: str = "qid long, point_id long, score double") -> DataFrame:
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for more in parts[1:]:
        out = out.union(more)
    return out


def sparse_topk(questions: DataFrame, chunks: DataFrame, n: int = 40, made=None) -> DataFrame:
    """qid, point_id, score, rank: the n chunks of largest dot product over shared terms that each question may see.

    questions: qid, tenant_id, role_id, question; chunks: point_id, tenant_id, accessed_role, content. See sparse.py: one pass over the
    chunks for BLOCK questions, and no pair is made that the question's best so far rules out. Terms are told apart by 64-bit hashes.
    """
    return _ranked(_union(best_by_terms(_blocks(questions, BLOCK), chunks, n, PLACES, made), chunks.sparkSession), n)


def rrf(lists: list[DataFrame], k: int = 20, c: int = RRF) -> DataFrame:
    """qid, point_id, score, rank of the k best by summed 1 / (c + rank) over ranked lists (qid, point_id, rank)."""
    both = lists[0].select("qid", "point_id", "rank")
    for more in lists[1:]:
        both = both.unionByName(more.select("qid", "point_id", "rank"))
    return _ranked(both.groupBy("qid", "point_id").agg(F.round(F.sum(1 / (F.lit(float(c)) + F.col("rank"))), 9).alias("score")), k)


def overlap(question: Column | str, content: Column | str) -> Column:
    """The share of the question's distinct terms that the content has."""
    asked = F.array_distinct(terms(question))
    return F.coalesce(F.size(F.array_intersect(asked, terms(content))) / F.nullif(F.size(asked), F.lit(0)), F.lit(0.0))


def rerank(hits: DataFrame, score: Column | None = None, top: int = 5) -> DataFrame:
    """hits (qid, point_id, rank, question, content) with content, scored anew; ties keep the order of rank."""
    scored = hits.where("content is not null and content <> ''").withColumn("score", F.round(overlap("question", "content") if score is None else score, PLACES))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "rank")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("qid", "point_id", "score", F.col("place").alias("rank"))


def hybrid_search(questions: DataFrame, chunks: DataFrame, k: int = 20, top: int = 5) -> DataFrame:
    """The `top` chunks of each question after dense and sparse candidates (2k each), fusion to k and reranking.

    Both tables' column vector is used if they have one, and hashed term vectors otherwise.
    """
    asked, held = questions, chunks
    if "vector" not in questions.columns or "vector" not in chunks.columns:
        asked = hashed_vectors(questions.drop("vector"), "question").where("exists(vector, x -> x > 0)")
        held = hashed_vectors(chunks.drop("vector"), "content")
    fused = rrf([dense_topk(asked, held, 2 * k), sparse_topk(questions, chunks, 2 * k)], k).drop("score")
    # At most k rows of each question are wanted: few questions meet the texts in place, many by a shuffle of what is wanted.
    few = questions.count() <= BLOCK
    texts = chunks.select("point_id", "content").join(F.broadcast(fused) if few else fused.hint("merge"), "point_id")
    return rerank(texts.join(questions.select("qid", "question").hint("merge"), "qid"), top=top)


def approx_topk(questions: DataFrame, chunks: DataFrame | Lists, n: int, reach: float = REACH) -> DataFrame:
    """qid, point_id, score, rank: n near chunks by inverted lists (lists.py), of exact cosines; n rows whenever the question may see n.

    chunks: a table with vectors, or lists built before. With reach = 1 the rows are those of dense_topk; with less, fewer lists are
    read and neighbours may be missed (tests hold the recall to 0.9 for every tenant). Null vectors are left out; zero vectors have cosine 0.
    """
    index = chunks if isinstance(chunks, Lists) else build_lists(chunks)
    return _ranked(_union(search_lists(_blocks(questions, BLOCK), index, n, reach), questions.sparkSession), n)
