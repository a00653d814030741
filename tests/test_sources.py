"""Files and tables as sources: what is opened, what reaches the source, what happens when it fails."""

import random

import pytest
from pyspark.sql import functions as F

from folio.functions import plugs
from folio.operators import chunking as K
from folio.operators import index as I
from folio.sources import gates as A


def test_scan_of_markdown_files(spark, tmp_path):
    big = A.MARKDOWN_BYTES + 1
    files = {"a.md": b"# x", "b.TXT": "é".encode(), "c.markdown": b"\xc3\x28", "d.pdf": b"%PDF", "e.md": b"", "none": b"x", "sub/f.md": b"ok", "big.md": b"a" * big}
    (tmp_path / "sub").mkdir()
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.filename: (r.size_bytes, r.reject_reason, None if r.content is None else bytes(r.content)) for r in A.scan_uploads(spark, str(tmp_path), "markdown").collect()}
    assert got == {
        "a.md": (3, None, b"# x"), "b.TXT": (2, None, "é".encode()), "c.markdown": (2, "not_utf8", None), "d.pdf": (4, "suffix", None),
        "none": (1, "suffix", None), "f.md": (2, None, b"ok"), "big.md": (big, "too_large", None),
    }
    pdf = {r.filename: r.reject_reason for r in A.scan_uploads(spark, str(tmp_path), "pdf").collect()}
    assert pdf["d.pdf"] is None and set(pdf.values()) == {None, "suffix"} and len(pdf) == len(files) - 1
    plan = A.scan_uploads(spark, str(tmp_path), "markdown")._jdf.queryExecution().executedPlan().toString()
    assert f"LessThanOrEqual(length,{A.MARKDOWN_BYTES})" in plan


@pytest.fixture(scope="module")
def derby(spark):
    """A table in memory whose key is skewed: half of the rows have one of ten values, some none."""
    options = {"url": "jdbc:derby:memory:folio;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver", "dbtable": "people"}
    rng = random.Random(1)
    rows = [(k, rng.randrange(10) if k % 2 else rng.randrange(10, 100_000), f"n{k}") for k in range(4000)] + [(4000 + k, None, "none") for k in range(5)]
    spark.createDataFrame(rows, "id int, dept int, name string").write.format("jdbc").options(**options).mode("overwrite").save()
    return options, rows


def test_scan_of_a_table(spark, derby):
    options, rows = derby
    got = A.scan_table(spark, options, "id int, dept int, name string", key="dept", partitions=6)
    assert sorted((r.ID if "ID" in r else r.id, r[1], r[2]) for r in got.collect()) == sorted(rows, key=lambda r: r[0])
    some = A.scan_table(spark, options, "id int", key="id", partitions=4, where="id < 100 and dept is not null", columns=["id"])
    assert sorted(r[0] for r in some.collect()) == [r[0] for r in rows if r[0] < 100 and r[1] is not None]
    assert A.scan_table(spark, options, "id int, dept int, name string").count() == len(rows)


def test_ranges_are_even_on_a_skewed_key_and_filters_reach_the_source(spark, derby):
    options, rows = derby
    cuts = [float(x) for x in sorted(set(spark.read.format("jdbc").options(**options).load().select(F.col("dept").cast("double").alias("k")).stat.approxQuantile("k", [k / 6 for k in range(1, 6)], 0.0)))]
    ranges = A._ranges("dept", cuts)
    counts = [sum(eval(c.replace("dept IS NULL", "d is None").replace("dept", "d").replace("OR", "or").replace("AND", "and"), {"d": r[1]}) if r[1] is not None else "IS NULL" in c for r in rows) for c in ranges]
    assert sum(counts) == len(rows) and max(counts) < 2.5 * len(rows) / len(counts)
    frame = A.read_table(spark, options, "id int").where("id < 100").select("name")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(ID,100)" in plan or "LessThan(id,100)" in plan
    assert "DEPT" not in plan.split("ReadSchema")[-1].upper()


def test_a_table_that_fails_is_empty_also_when_rows_are_read(spark, derby):
    options, _ = derby
    none = A.scan_table(spark, options | {"dbtable": "no_such"}, "id int, x string")
    assert none.columns == ["id", "x"] and none.count() == 0
    late = A.scan_table(spark, options | {"dbtable": '(select "id", 1 / ("dept" - "dept") as x from people) t'}, "id int, x int")
    assert late.count() == 0 and late.columns == ["id", "x"]
    assert A.read_table(spark, options | {"dbtable": '(select "id", 1 as x from people) t'}, "id int").count() == len(derby[1])
    assert A.scan_table(spark, options, "id int", key="no_such").count() == 0
    assert A.scan_table(spark, options | {"url": "jdbc:derby:memory:nowhere"}, "id int").count() == 0


def test_layout_by_size_and_skipping(spark, tmp_path):
    rows = spark.range(40_000).selectExpr("if(id % 10 < 9, 'large', concat('t', cast(id % 7 as string))) as tenant_id", "concat('f', lpad(cast(id div 20 as string), 5, '0')) as src_file", "cast(id as string) as content").repartition(5)
    path = str(tmp_path / "index")
    I.write_index(rows, path, 2000, **{"parquet.block.size": "4096", "parquet.block.row.count.limit": "200"})
    back = spark.read.parquet(path)
    assert back.count() == 40_000 and back.exceptAll(rows.select(*back.columns)).count() == 0
    files = {r.tenant_id: r.n for r in back.withColumn("f", F.input_file_name()).groupBy("tenant_id").agg(F.count_distinct("f").alias("n")).collect()}
    assert files["large"] >= 16 and all(n <= 4 for t, n in files.items() if t != "large")
    one = back.where("tenant_id = 'large' and src_file = 'f00700'")
    assert one.count() == 18
    held = one.select("src_file").withColumn("f", F.input_file_name()).select("f").distinct().count()
    assert held == 1
    frame = one.select("content")
    frame.collect()
    scan = frame._jdf.queryExecution().executedPlan().collectLeaves().head()
    metrics = scan.metrics()
    assert metrics.apply("numPartitions").value() == 1
    assert metrics.apply("numOutputRows").value() < 0.05 * 40_000


def test_semantic_cuts_with_an_encoder_like_term_counts(spark):
    rng = random.Random(6)
    words = ["red", "blue", "green", "one", "two", "three"]
    text = lambda: ". ".join(" ".join(rng.choice(words[:3] if k < 5 else words[3:]) for _ in range(6)) for k in range(10)) + "."
    sections = spark.createDataFrame([(k, text()) for k in range(12)], "doc_id long, content string")

    def load():
        import re

        import numpy as np

        return lambda texts: np.array([[re.findall(r"\w+", t.lower()).count(w) for w in words] for t in texts], float)

    want = sorted(map(tuple, K.split_semantic(sections, ("doc_id",), 10).collect()))
    assert sorted(map(tuple, K.split_semantic(sections, ("doc_id",), 10, load).collect())) == want and len(want) > 12


def test_tokens_of_a_tokenizer(spark):
    got = plugs.count_tokens(spark.createDataFrame([("a b c",), (None,), ("",)], "text string"), lambda: lambda texts: [len(t.split()) for t in texts])
    assert [r.tokens for r in got.collect()] == [3, 0, 0]
