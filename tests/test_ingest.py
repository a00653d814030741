"""Uploads as a stream against all uploads at once: replaced, shortened, deleted, refused, late and replayed."""

import pytest
from pyspark.sql import functions as F

from folio.streaming import ingest as I

UPLOADS = "tenant_id string, src_file string, roles_csv string, md string, seq long, deleted boolean, batch string, doc_id long, content string"
LONG = "# One\n\n" + "\n\n".join(f"## Part {k}\n\n" + f"Sentence {k} of some words. " * 40 for k in range(6))
ROWS = [
    ("t", "a.md", "1,2", LONG, 1, False),
    ("t", "b.md", "1", "# B\n\ntext", 2, False),
    ("u", "a.md", "2", "# other tenant", 3, None),
    ("t", "a.md", "3", "# short now", 4, False),
    ("t", "b.md", None, None, 5, True),
    ("t", "c.exe", "1", "refused", 6, False),
    ("t", "d.md", "1,x", "refused", 7, False),
    ("t", "e.md", "1", "", 8, False),
    ("t", "a.md", "1,x", "a refused upload replaces nothing", 9, False),
    ("t", "f.md", "1", "x", 10, False),
    ("t", "f.md", "1", "y", 10, False),
    (None, "g.md", "1", "no tenant", 11, False),
    ("t", "never.md", None, None, 12, True),
    ("t", "n.md", "1", "no number", None, False),
    ("t", "b2.md", "1", LONG, 13, False),
    ("t", "f.md", "1", "y", 10, False),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, "y") for r in rows], UPLOADS)





def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


@pytest.mark.parametrize("order", ["as they came", "backwards", "all at once"])
def test_stream_comes_to_the_batch_index(spark, tmp_path, order):
    parts = [ROWS] if order == "all at once" else [ROWS[k : k + 6] for k in range(0, len(ROWS), 6)]
    want = rows(I.index_of(frame(spark, ROWS)))
    source = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    for part in parts[::-1] if order == "backwards" else parts:
        frame(spark, part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(UPLOADS).parquet(source)
        I.ingest_stream(stream, str(tmp_path / "index"), str(tmp_path / "log")).awaitTermination()
    got = I.ingested(spark, str(tmp_path / "index"))
    assert rows(got) == want and len(I.committed(spark, str(tmp_path / "index"))) == len(parts)
    by_file = {(r.tenant_id, r.src_file): r.n for r in got.groupBy("tenant_id", "src_file").agg(F.count("*").alias("n")).collect()}
    assert by_file[("t", "a.md")] == 1 and by_file[("t", "b2.md")] > 1 and ("t", "b.md") not in by_file and ("t", "never.md") not in by_file
    assert {f for _, f in by_file} == {"a.md", "f.md", "n.md", "b2.md"}
    assert got.where("src_file = 'a.md' and tenant_id = 't'").first().accessed_role == [3]


def test_reasons(spark):
    got = {r.seq: r.reject_reason for r in I.gate_uploads(frame(spark, ROWS)).collect()}
    assert got[6] == "suffix" and got[7] == "roles" and got[8] == "empty" and got[11] == "no_name" and got[5] is None and got[12] is None


def test_half_a_batch_is_not_there_and_a_replayed_one_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "index")
    assert I.ingested(spark, path).count() == 0
    I.write_batch(frame(spark, ROWS[:3]), 0, path)
    before = rows(I.ingested(spark, path))
    # A batch that stopped before its last step: uploads and chunks stand there, its row does not.
    I.write_batch(frame(spark, ROWS[3:]), 1, str(tmp_path / "other"))
    for name in ("uploads", "chunks"):
        spark.read.parquet(str(tmp_path / "other" / name / "batch=1")).write.parquet(f"{path}/{name}/batch=1")
    assert rows(I.ingested(spark, path)) == before
    I.write_batch(frame(spark, ROWS[3:]), 1, path)
    after = rows(I.ingested(spark, path))
    assert after == rows(I.index_of(frame(spark, ROWS))) != before
    I.write_batch(frame(spark, [("t", "z.md", "1", "not taken", 99, False)]), 1, path)
    assert rows(I.ingested(spark, path)) == after


def test_batch_of_deletions_alone_and_compaction(spark, tmp_path):
    path, to = str(tmp_path / "index"), str(tmp_path / "fresh")
    I.write_batch(frame(spark, ROWS), 0, path)
    I.write_batch(frame(spark, [("t", "b2.md", None, None, 50, True), ("u", "a.md", None, None, 51, True)]), 1, path)
    got = rows(I.ingested(spark, path))
    assert got == rows(I.index_of(frame(spark, [*ROWS, ("t", "b2.md", None, None, 50, True), ("u", "a.md", None, None, 51, True)])))
    I.compact(spark, path, to)
    assert rows(I.ingested(spark, to)) == got and I.committed(spark, to) == [1]
    I.write_batch(frame(spark, [("t", "f.md", "2", "# newer", 60, False)]), 2, to)
    assert {r.content for r in I.ingested(spark, to).where("src_file = 'f.md'").collect()} == {"# newer"}
