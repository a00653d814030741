"""What a task has at once stays bounded: words of sparse search, files of the Markdown sink, files of the ingestion query."""

import numpy as np
import pyarrow as pa

from folio.operators import sparse
from folio.plans import stream_queries
from folio.sources import gates


def test_batches_are_cut_by_words(monkeypatch):
    monkeypatch.setattr(sparse, "WORDS", 10)
    words = [[1] * 4, None, [2] * 6, [3] * 25, [], [4] * 3]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(words, pa.list_(pa.int64()))], ["point_id", "words"])
    parts = list(sparse._parts(iter([batch])))
    assert np.concatenate([p.column("point_id").to_numpy() for p in parts]).tolist() == list(range(6))
    assert [len(p.column("words").flatten()) for p in parts] == [10, 25, 3]


def test_files_are_read_by_row(spark, tmp_path):
    docs = spark.createDataFrame([("t", "a.md", "1", "é"), ("t", "b.md", None, None)], "tenant_id string, src_file string, document_id string, content string")
    written = gates.write_markdown(docs, str(tmp_path))
    got = {r.path: bytes(r.content) for r in gates.read_markdown(written, str(tmp_path)).collect()}
    assert got == {"ocr/t/1.md": "é".encode(), "ocr/t/b.md": b""}


def test_uploads_come_in_more_files_than_batches(spark, tmp_path, monkeypatch):
    spark.range(400).selectExpr("id as doc_id", "'some text' as text", "'en' as lang", "'src0' as source", "9L as n_chars").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(1).write.parquet(str(tmp_path / "part.parquet"))  # a name within the fixture's SQL
    monkeypatch.setattr(stream_queries, "_folder", lambda s: str(tmp_path / "work"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        stream_queries._ingest(spark, str(tmp_path)).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(list((tmp_path / "work" / "in").glob("*.parquet"))) > 4
    assert len(list((tmp_path / "work" / "log" / "commits").glob("[0-9]*"))) <= 4
