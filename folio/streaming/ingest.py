"""Continuous ingestion: uploads come in, whole documents are replaced or deleted, and readers see whole batches only.

The index is a folder of batches. A batch writes its accepted uploads, then their chunks, then one row under `commits`; what has
no such row is not there for readers, and a batch that is run again either finds its row and stops or writes its folders again.
Nothing written before is touched, so the cost of a batch is that of its own documents.

The winner of several uploads of one (tenant, file) is the one of largest seq, however they fall into batches, so
the index does not depend on the order of arrival. Chunks belong to the batch of their upload: when another upload wins, or a deletion, all of the
old one's chunks are gone at once, however many the new one has. compact() writes what is there into a fresh folder.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folio.operators.chunking import chunk_documents
from folio.sources.gates import parse_roles, upload_gate

UPLOADED = "tenant_id string, src_file string, seq long, deleted boolean, md string, accessed_role array<int>"
INDEXED = "tenant_id string, src_file string, chunk_idx int, chunk_id string, content string, method string, token_count int, h1 string, h2 string, h3 string, accessed_role array<int>"
DOCUMENT = ("tenant_id", "src_file")
#: Uploads of one document and one seq: the larger of these wins.
ORDER = "struct(seq, deleted, coalesce(xxhash64(md, accessed_role), 0L) as tie)"


def gate_uploads(uploads: DataFrame) -> DataFrame:
    """UPLOADED with reject_reason, null where accepted, of uploads (tenant_id, src_file, roles_csv, md, seq, deleted).

    First failing rule: no tenant or name, the Markdown gate's (suffix, empty, size, UTF-8), roles that are no list of numbers. A deletion
    needs a tenant and a name only; a null `deleted` is none, a null seq comes before all others.
    """
    gone = F.coalesce("deleted", F.lit(False))
    rows = uploads.select("tenant_id", "src_file", F.coalesce("seq", F.lit(-(1 << 63))).alias("seq"), gone.alias("deleted"), F.when(~gone, F.col("md")).alias("md"), F.when(~gone, parse_roles("roles_csv")).alias("accessed_role"))
    sized = rows.withColumns({"filename": F.col("src_file"), "size_bytes": F.octet_length(F.coalesce("md", F.lit(""))), "content": F.col("md")})
    gated = upload_gate(sized, "markdown").drop("filename", "size_bytes", "content")
    named = (F.coalesce("tenant_id", F.lit("")) != "") & (F.coalesce("src_file", F.lit("")) != "")
    reason = F.when(~named, "no_name").when(~F.col("deleted"), F.coalesce("reject_reason", F.when(F.col("accessed_role").isNull(), "roles")))
    return gated.withColumn("reject_reason", reason)


def newest(uploads: DataFrame) -> DataFrame:
    """Of each document's uploads (UPLOADED) the winner. Aggregated before the shuffle, so one document may have any number."""
    row = F.struct(*(c.split(" ")[0] for c in UPLOADED.split(", ") if not c.startswith(DOCUMENT)))
    return uploads.groupBy(*DOCUMENT).agg(F.max_by(row, F.expr(ORDER)).alias("row")).select(*DOCUMENT, "row.*")


def chunk_uploads(uploads: DataFrame) -> DataFrame:
    """INDEXED rows of UPLOADED rows, one upload for each document; deletions have none. Read several times: give a written table."""
    live = uploads.where("not deleted")
    docs = live.select(F.concat_ws("\x00", *DOCUMENT).alias("doc_id"), *DOCUMENT, "md")
    return chunk_documents(docs).join(live.select(*DOCUMENT, "accessed_role").hint("merge"), list(DOCUMENT)).select(*(c.split(" ")[0] for c in INDEXED.split(", ")))


def committed(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the batches that readers see, one for each since the folder was begun or compacted."""
    try:
        return sorted(r.number for r in spark.read.schema("number long").parquet(f"{path}/commits").select("number").collect())
    except AnalysisException:
        return []


def write_batch(uploads: DataFrame, number: int, path: str) -> None:
    """One batch of uploads, as gate_uploads takes them, into the folder. A batch that is there already stays as it is."""
    spark = uploads.sparkSession
    if number in committed(spark, path):
        return
    gated = gate_uploads(uploads)
    at = lambda name: f"{path}/{name}/batch={number}"
    gated.where("reject_reason is not null").select(*DOCUMENT, "seq", "reject_reason").write.mode("overwrite").parquet(at("rejected"))
    newest(gated.where("reject_reason is null").drop("reject_reason")).write.mode("overwrite").parquet(at("uploads"))
    chunk_uploads(spark.read.schema(UPLOADED).parquet(at("uploads"))).write.mode("overwrite").parquet(at("chunks"))
    spark.range(1).select(F.lit(number).cast("long").alias("number")).write.mode("overwrite").parquet(at("commits"))


def ingest_stream(uploads: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A stream of uploads into the index under path. It takes what is there, in micro-batches of the source's size, and stops."""
    return uploads.writeStream.foreachBatch(lambda batch, number: write_batch(batch, number, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _live(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(winning uploads, without deletions, with batch; their chunks with batch) of the committed batches."""
    numbers = committed(spark, path)
    if not numbers:
        return tuple(spark.createDataFrame([], f"{schema}, batch long") for schema in (UPLOADED, INDEXED))
    read = lambda name, schema: spark.read.schema(f"{schema}, batch long").parquet(f"{path}/{name}").where(F.col("batch").isin(numbers))
    uploads = read("uploads", UPLOADED)
    best = uploads.groupBy(*DOCUMENT).agg(F.max(F.struct(F.expr(ORDER).alias("order"), "batch")).alias("best"))
    live = uploads.join(best.where("not best.order.deleted").select(*DOCUMENT, F.col("best.batch").alias("batch")), [*DOCUMENT, "batch"], "left_semi")
    return live, read("chunks", INDEXED).join(live.select(*DOCUMENT, "batch"), [*DOCUMENT, "batch"], "left_semi")


def ingested(spark: SparkSession, path: str) -> DataFrame:
    """The index as of the last whole batch: INDEXED."""
    return _live(spark, path)[1].drop("batch")


def compact(spark: SparkSession, path: str, to: str) -> None:
    """What readers of path see, as one batch of a fresh folder that later batches of the same stream can go to.

    Deletions go too, so uploads of a deleted document with a smaller seq, should they still come, would count again.
    """
    numbers = committed(spark, path)
    if numbers:
        for name, rows in zip(("uploads", "chunks"), _live(spark, path), strict=True):
            rows.drop("batch").write.parquet(f"{to}/{name}/batch={numbers[-1]}")
        spark.range(1).select(F.lit(numbers[-1]).cast("long").alias("number")).write.parquet(f"{to}/commits/batch={numbers[-1]}")


def index_of(uploads: DataFrame) -> DataFrame:
    """INDEXED of all uploads at once: what the stream comes to."""
    from folio.sources.shared import new_folder

    spark, to = uploads.sparkSession, new_folder(uploads.sparkSession, "uploads")
    newest(gate_uploads(uploads).where("reject_reason is null").drop("reject_reason")).write.parquet(to)
    return chunk_uploads(spark.read.schema(UPLOADED).parquet(to))
