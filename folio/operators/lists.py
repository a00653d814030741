"""Approximate neighbours by inverted lists, with a bound that makes them exact on demand.

Every vector, at length 1, goes to the nearest of some centres, fitted on a bounded sample. For each tenant and role, a list is known by
how many vectors it has and by its radius, the largest distance of one of them to the centre. A question first takes its nearest lists until
they hold n rows that it may see, so it gets n rows whenever there are n. Its n-th best score then tells which other lists can
hold better ones: by the triangle inequality, none of a list is nearer than the centre less the radius. `reach` is the share of the
radius that is believed: with 1 no neighbour is missed, with less, lists whose far edge alone could hold one are left out.

Questions go to the data in blocks; a task keeps the n best of each question over the lists that it asks, so hot lists are never joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.text import l2_normalize
from folio.sources.shared import new_folder

#: Rows that fit the centres for each list, and lists at most. Every vector is in a list.
SAMPLED, LISTS = 20, 4096
#: The list of zero vectors, which are as far from all.
ZERO = -1
#: Scores are rounded before they are ranked; a list is left out only if it stays below by more than this.
SLACK = 2e-6
REACH = 0.6


@dataclass
class Lists:
    """centres; rows (point_id, tenant_id, accessed_role, unit, list); cells (tenant_id, role_id, list, n, radius)."""

    centres: np.ndarray
    rows: DataFrame
    cells: DataFrame


def _kept(rows: DataFrame, name: str, *sorted_by: str) -> DataFrame:
    folder = new_folder(rows.sparkSession, name)
    (rows.repartitionByRange(*sorted_by).sortWithinPartitions(*sorted_by) if sorted_by else rows).write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def _placed(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column("unit").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            at, far = np.zeros(len(rows), np.int32), np.zeros(len(rows))
            for k in range(0, len(rows), 1024):
                part = rows[k : k + 1024]
                d = (part**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * part @ centres.T
                at[k : k + 1024] = d.argmin(1)
            far = np.sqrt(((rows - centres[at]) ** 2).sum(1))
            at[~rows.any(1)] = ZERO
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(far)], [*batch.schema.names, "list", "far"])

    return run


def build_lists(chunks: DataFrame, lists: int | None = None) -> Lists:
    """Lists over chunks (point_id, tenant_id, accessed_role, vector); null vectors are left out.

    There are about the square root of the rows many, LISTS at most; their centres come from k-means over SAMPLED rows for each (those of
    least hash). More rows make longer lists, never missing ones.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    unit = chunks.where("vector is not null").select(F.col("point_id").cast("long"), "tenant_id", "accessed_role", l2_normalize("vector").alias("unit"))
    n = unit.count()
    lists = lists or max(1, min(LISTS, int(n**0.5)))
    share = min(1.0, SAMPLED * lists / max(n, 1))
    sample = unit.where((F.pmod(F.xxhash64("point_id"), F.lit(1 << 30)) < int(share * (1 << 30))) & F.exists("unit", lambda x: x != 0)).select(array_to_vector("unit").alias("features"))
    some = sample.limit(1).count()
    if some and lists > 1:
        centres = np.array([[float(x) for x in c] for c in KMeans(k=lists, seed=1, maxIter=10).fit(sample).clusterCenters()])
    else:
        width = len((unit.select("unit").first() or [[0.0]])[0])
        centres = np.zeros((1, width))
    schema = "point_id long, tenant_id string, accessed_role array<int>, unit array<double>, list int, far double"
    rows = _kept(unit.mapInArrow(_placed(unit.sparkSession.sparkContext.broadcast(centres)), schema), "lists", "list")
    cells = rows.select("tenant_id", F.explode(F.array_distinct("accessed_role")).alias("role_id"), "list", "far").groupBy("tenant_id", "role_id", "list").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))
    return Lists(centres, rows.drop("far"), _kept(cells, "cells"))


def _chosen(sent, n: int, reach: float):
    """qid, lists: for each question of a (tenant, role), the lists to search. Bounds: none at first, then each question's n-th best score.

    A group is the lists of one tenant and role, so LISTS + 1 rows at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions, centres, bounds = sent.value
        table = pa.Table.from_batches(list(batches))
        key = table.column("tenant_id")[0].as_py(), table.column("role_id")[0].as_py()
        at, size, radius = (np.array(table.column(c).to_pylist()) for c in ("list", "n", "radius"))
        ids, found = [], []
        for qid, vector in questions[key]:
            zero = at == ZERO
            far = np.sqrt(((centres[np.where(zero, 0, at)] - vector) ** 2).sum(1))
            order = np.lexsort((at, far, ~zero))
            held = np.cumsum(size[order]) - size[order]
            first = np.zeros(len(at), bool)
            first[order] = held < n
            first |= zero
            if bounds is None:
                chosen = first
            else:
                near = np.maximum(far - reach * radius, 0.0)
                best = np.where(zero, 0.0, 1 - near**2 / 2) if vector.any() else np.zeros(len(at))
                chosen = (best + SLACK >= bounds.get(qid, -2.0)) & ~first
            ids.append(qid)
            found.append(at[chosen].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.int32()))], ["qid", "lists"])

    return run


def _searched(sent, n: int):
    """A task's n best of each question over the rows of the lists that the question asks."""
    from folio.operators.retrieval import PLACES, _best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, roles, matrix, asks = sent.value
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column("unit").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            ids = batch.column("point_id").to_numpy(zero_copy_only=False)
            may = [set(x or ()) for x in batch.column("accessed_role").to_pylist()]
            cells: dict[tuple, list[int]] = {}
            for k, cell in enumerate(zip(batch.column("tenant_id").to_pylist(), batch.column("list").to_pylist(), strict=True)):
                if cell in asks:
                    cells.setdefault(cell, []).append(k)
            for cell, members in cells.items():
                at, ask = np.array(members), asks[cell]
                open_to = {role: np.array([role in may[k] for k in members], bool) for role in {roles[q] for q in ask}}
                for k in range(0, len(ask), 256):
                    scores = np.round(matrix[ask[k : k + 256]] @ rows[at].T, PLACES)
                    for q, line in zip(ask[k : k + 256].tolist(), scores, strict=True):
                        free = open_to[roles[q]]
                        found = _best(ids[at[free]], line[free], n)
                        held[q] = _best(*(np.concatenate(x) for x in zip(held[q], found, strict=True)), n) if q in held else found
        found = [(np.full(len(i), qids[q]), i, s) for q, (i, s) in held.items()]
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["qid", "point_id", "score"])

    return run


def search_lists(blocks: list[DataFrame], index: Lists, n: int, reach: float = REACH) -> list[DataFrame]:
    """For each block of questions (qid, tenant_id, role_id, vector) qid, point_id, score: a superset of each one's n best."""
    spark, out = index.rows.sparkSession, []
    for block in blocks:
        asked = block.where("vector is not null").select("qid", "tenant_id", "role_id", l2_normalize("vector").alias("unit")).collect()
        if not asked:
            continue
        questions: dict[tuple, list] = {}
        for r in asked:
            questions.setdefault((r.tenant_id, r.role_id), []).append((r.qid, np.array(r.unit)))
        place = {r.qid: k for k, r in enumerate(asked)}
        groups = F.broadcast(spark.createDataFrame(list(questions), "tenant_id string, role_id int"))
        cells = index.cells.join(groups, ["tenant_id", "role_id"], "left_semi")
        bounds, parts = None, []
        for _ in range(2):
            sent = spark.sparkContext.broadcast((questions, index.centres, bounds))
            asks: dict[tuple, list[int]] = {}
            for r in cells.groupBy("tenant_id", "role_id").applyInArrow(_by_group(_chosen(sent, n, reach)), "qid long, lists array<int>").collect():
                for at in r.lists:
                    asks.setdefault((asked[place[r.qid]].tenant_id, at), []).append(place[r.qid])
            if not asks:
                break
            told = spark.sparkContext.broadcast(([r.qid for r in asked], [r.role_id for r in asked], np.array([r.unit for r in asked]), {k: np.array(v) for k, v in asks.items()}))
            wanted = index.rows.where(F.col("list").isin(sorted({at for _, at in asks})))
            found = wanted.mapInArrow(_searched(told, n), "qid long, point_id long, score double")
            if bounds is None:
                found = _kept(found, "found")
                last = found.groupBy("qid").agg(F.array_sort(F.collect_list("score")).alias("s")).select("qid", F.when(F.size("s") >= n, F.element_at("s", -n)).alias("bound"))
                bounds = {r.qid: r.bound for r in last.collect() if r.bound is not None}
            parts.append(found)
        out += parts
    return out


def _by_group(run):
    """The function of a group's table from one of its batches."""

    def group(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(run(iter(table.to_batches()))))

    return group
