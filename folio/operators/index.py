"""Upkeep of the chunk index: documents replaced, points kept by id, and a layout that lets filters skip files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import token_count


def chunk_id(tenant: str, src: str, idx: str):
    """The md5 of tenant_file_index, written as a uuid."""
    joined = F.concat_ws("_", F.col(tenant), F.col(src), F.col(idx).cast("string"))
    return F.regexp_replace(F.md5(joined), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def upsert(current: DataFrame, new: DataFrame, key: str = "chunk_id", version: str = "version") -> DataFrame:
    """current with new's rows in place of those with their ids; of several new rows with one id, the last version's."""
    last = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))).where("_n = 1").drop("_n")
    return current.join(last.select(key), key, "left_anti").unionByName(last)


def delete_documents(current: DataFrame, documents: DataFrame) -> DataFrame:
    """current without the points of the given (tenant_id, src_file)."""
    return current.join(documents.select("tenant_id", "src_file").distinct(), ["tenant_id", "src_file"], "left_anti")


#: Rows of a file of the index.
FILE_ROWS = 1_000_000


def write_index(chunks: DataFrame, path: str, file_rows: int = FILE_ROWS, **options: str) -> None:
    """Folders by tenant; within them files by ranges of src_file and sorted by it, so a file filter skips files' row groups.

    Rows are counted first and dealt by ranges of (tenant, file) of about file_rows, so a tenant has as many tasks and files as its
    rows need: a large one is no single task, and small ones share one.
    """
    parts = max(1, -(-chunks.count() // file_rows))
    dealt = chunks.repartitionByRange(parts, "tenant_id", "src_file").sortWithinPartitions("tenant_id", "src_file")
    dealt.write.mode("overwrite").partitionBy("tenant_id").options(**options).parquet(path)


def as_chunks(docs: DataFrame) -> DataFrame:
    """Documents (tenant_id, src_file, content, roles_csv) as one chunk each."""
    return docs.withColumn("chunk_idx", F.lit(0)).withColumn("chunk_id", chunk_id("tenant_id", "src_file", "chunk_idx")).withColumn("token_count", token_count("content"))
