"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``[^\x20\x09-\x0D]+``: what the contracts call a word.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data: the context's checkpoint folder, or the one that spark.checkpoint.dir names.

    Where the session names none, a local master gets a folder of this machine, as in tests, and any other an error.
    """
    context = spark.sparkContext
    if (held := context._jsc.sc().getCheckpointDir()).isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
        held = context._jsc.sc().getCheckpointDir()
    return held.get()


_HELD: dict[object, object] = {}


def held(key: object, make: Callable[[], object] = object) -> object:
    """What a Python process keeps from task to task, made at first use.

    A process serves the tasks of one operator after another; it keeps things for one at a time and first lets go of
    those of any other.
    """
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, **options: str) -> DataFrame:
    """df, written to a table in the shared folder (with the writer's options) and read back.

    Unlike a checkpoint, it does not carry the size estimates of the plan behind it. In a loop with joins these multiply,
    each round by those of the one before, and soon are numbers of millions of digits.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the query that made them has ended, so that steps which write tables don't add up on disk."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Ids that are sent to all tasks at once (16 MB or so); more are joined by a shuffle.
SENT_IDS = 500_000


def without(docs: DataFrame, go: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose key is not in go (key as a long, distinct). Rows without a key stay.

    go is counted first: up to SENT_IDS keys are broadcast, so that no text crosses the network.
    """
    go = cut(go.select(F.col(key).alias("_go")))
    few = go.count() <= SENT_IDS
    return docs.join(F.broadcast(go) if few else go.hint("merge"), F.col(key).cast("long") == F.col("_go"), "left_anti")


def id_bucket(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus: the fixed folds of the contracts. A null id counts as ''."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % modulus


def whole(text: Column | str) -> Column:
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column, F.lit(""))


def keep_rows(docs: DataFrame, start: Callable[[], Callable[[list[str]], list[bool]]], size: int = 256) -> DataFrame:
    """The rows of docs whose texts a function says to keep; start() gives it, once in each task.

    It takes the texts of `size` rows at a time, null ones as ''. Each row is decided where it is read, so nothing is
    shuffled, and all columns are kept, whatever their names.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = start()
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                yield part.filter(pa.array(keep([x or "" for x in part.column("doc").field("text").to_pylist()]), pa.bool_()))

    return rows.mapInArrow(run, rows.schema).select("doc.*")
