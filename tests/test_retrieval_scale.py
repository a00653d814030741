"""Approximate search against the exact one, packing of long keys, and the Markdown sink."""

import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from folio.functions.plugs import hashed_vectors
from folio.operators import lists as L
from folio.operators import retrieval as R
from folio.operators.packing import pack
from folio.plans import retrieval_queries as Q
from folio.sources import gates as A


def pairs(df):
    return {(r.qid, r.point_id) for r in df.collect()}


def test_recall_of_approximate_search_for_every_tenant(spark):
    for sf in ("0.001", "0.01"):
        d = f"/root/testdata/sf{sf}"
        asked, vectors = Q._asked(spark, d), Q._vectors(spark, d)
        tenant = {r.qid: r.tenant_id for r in asked.collect()}
        exact, found = pairs(R.dense_topk(asked, vectors, 10)), pairs(R.approx_topk(asked, vectors, 10))
        assert len(found) == len(exact)
        for t in set(tenant.values()):
            mine = {x for x in exact if tenant[x[0]] == t}
            assert len(mine & found) >= 0.9 * len(mine) > 0, (t, len(mine & found), len(mine))


def vectors(spark):
    """3,000 vectors of one tenant, 12 of another far from most of them, zero and null vectors, a row that few roles see."""
    rng = random.Random(4)
    near = lambda c: [x + rng.gauss(0, 0.4) for x in c]
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(k, "large", [1, 2], near(centres[k % 5])) for k in range(3000)]
    rows += [(5000 + k, "small", [1] if k % 2 else [1, 2], near(centres[5] if k % 3 else centres[0])) for k in range(12)]
    rows += [(6000, "large", [1], [0.0] * 8), (6001, "small", [2], [0.0] * 8), (6002, "small", [1], None), (6003, "small", None, centres[0]), (6004, None, [1], centres[0])]
    rows += [(7000 + k, "large", [3], near(centres[5])) for k in range(3)]
    asked = [(k, t, role, v) for k, (t, role, v) in enumerate((t, role, v) for t in ("large", "small", "none", None) for role in (1, 2, 3, None) for v in (centres[0], near(centres[5]), [0.0] * 8, None, near(centres[2])))]
    return spark.createDataFrame(asked, "qid long, tenant_id string, role_id int, vector array<double>"), spark.createDataFrame(rows, "point_id long, tenant_id string, accessed_role array<int>, vector array<double>").repartition(3)


def test_a_small_tenant_gets_all_its_rows_and_the_exact_setting_is_exact(spark):
    asked, held = vectors(spark)
    index = L.build_lists(held)
    for n in (1, 10, 50):
        want = R.dense_topk(asked, held, n)
        assert sorted(map(tuple, R.approx_topk(asked, index, n, reach=1.0).collect())) == sorted(map(tuple, want.collect()))
        count = lambda df: {r.qid: r["count"] for r in df.groupBy("qid").count().collect()}
        for reach in (0.0, 0.6):
            found = R.approx_topk(asked, index, n, reach=reach)
            assert count(found) == count(want)
    assert R.approx_topk(asked.where("qid < 0"), index, 5).count() == 0
    assert R.approx_topk(asked, held.where("point_id < 0"), 5).count() == 0
    one = held.where("point_id = 1")
    assert sorted(map(tuple, R.approx_topk(asked, one, 5, reach=1.0).collect())) == sorted(map(tuple, R.dense_topk(asked, one, 5).collect()))


def test_few_lists_are_searched(spark):
    asked, held = vectors(spark)
    index = L.build_lists(held, 40)
    asks = lambda reach: L.search_lists([asked.where("qid = 1")], index, 10, reach)
    rows = {reach: sum(f.count() for f in asks(reach)) for reach in (0.0, 0.6, 1.0)}
    assert rows[0.0] <= rows[0.6] <= rows[1.0]


def plain_sparse(questions, chunks, n):
    words = lambda t: Counter(w for w in re.split(r"[^\w]+", (t or "").lower()) if w)
    bags = [(p, t, r, words(c)) for p, t, r, c in chunks]
    out = []
    for q, tenant, role, text in questions:
        asked = words(text)
        scored = []
        for p, t, roles, bag in bags:
            if t == tenant and t is not None and role in (roles or ()) and asked.keys() & bag.keys():
                scored.append((-round(sum(math.log1p(bag[w]) * math.log1p(c) for w, c in asked.items() if w in bag), 6), p))
        out += [(q, p, -s, k) for k, (s, p) in enumerate(sorted(scored)[:n], 1)]
    return sorted(out)


def sparse_rows(rng, n, q):
    common, rare = ["the", "of", "and"], [f"w{k}" for k in range(60)]
    text = lambda size: " ".join(rng.choice(common) if rng.random() < 0.6 else rng.choice(rare) for _ in range(size))
    chunks = [(k, rng.choice(["a", "b"]), rng.choice([[1], [1, 2], [2], None]), text(rng.randrange(1, 30))) for k in range(n)]
    chunks += [(n, "a", [1], None), (n + 1, "a", [1], ""), (n + 2, None, [1], "the w1"), (n + 3, "c", [1], "the the the")]
    asked = [(k, rng.choice(["a", "b", "c", "none"]), rng.choice([1, 2]), text(rng.randrange(0, 9))) for k in range(q)]
    return asked + [(q, "a", 1, None), (q + 1, None, 1, "the")], chunks


def frames(spark, asked, chunks, parts):
    questions = spark.createDataFrame(asked, "qid long, tenant_id string, role_id int, question string")
    return questions, spark.createDataFrame(chunks, "point_id long, tenant_id string, accessed_role array<int>, content string").repartition(parts)


def test_sparse_like_every_pair_scored(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    asked, chunks = sparse_rows(random.Random(2), 400, 60)
    questions, held = frames(spark, asked, chunks, 3)
    try:
        for size, n in (("10000", 5), ("20", 5), ("20", 1000)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert sorted(map(tuple, R.sparse_topk(questions, held, n).collect())) == plain_sparse(asked, chunks, n)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert R.sparse_topk(questions.where("qid < 0"), held, 5).count() == 0
    assert R.sparse_topk(questions, held.where("point_id < 0"), 5).count() == 0


def test_pairs_fall_with_stop_words_and_hundred_times_the_questions(spark):
    rng = random.Random(9)
    chunks = [(k, "a", [1], " ".join(["the", "of", *(f"w{rng.randrange(300)}" for _ in range(6))])) for k in range(6000)]
    few = [(k, "a", 1, f"the of w{k % 300} w{(k * 7 + 1) % 300}") for k in range(8)]
    many = [(100 * k + q, t, r, x) for k in range(100) for q, t, r, x in few]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        for asked in (few, many):
            made = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
            questions, held = frames(spark, asked, chunks, 1)
            rows = R.sparse_topk(questions, held, 10, made).collect()
            assert len(rows) == 10 * len(asked)
            assert made[0].value < 0.25 * made[1].value, (made[0].value, made[1].value)
        assert sorted(tuple(r) for r in rows if r.qid < 8) == plain_sparse(few, chunks, 10)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_dense_keeps_the_best_over_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = spark.range(500).selectExpr("id as point_id", "'t' as tenant_id", "array(1 + cast(id % 2 as int)) as accessed_role", "array(1D, cast(id % 50 as double)) as vector").repartition(2)
    q = spark.createDataFrame([(1, "t", 1, [0.0, 1.0]), (2, "t", 2, [1.0, 0.0]), (3, "u", 1, [1.0, 0.0])], "qid long, tenant_id string, role_id int, vector array<double>")
    want = sorted(map(tuple, R.dense_topk(q, rows, 30).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, R.dense_topk(q, rows, 30).collect())) == want and len(want) == 60
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_a_key_of_a_million_rows_packs_in_one_pass(spark):
    rows = spark.range(1_000_000).selectExpr("if(id % 100 = 0, null, 'k') as k", "id as at", "cast(id % 7 as int) as size")
    got = {r.k: r for r in pack(rows, ["k"], "at", "size", 20).groupBy("k").agg(F.max("pack").alias("last"), F.count("*").alias("n"), F.sum("size").alias("size")).collect()}
    assert got["k"].n == 990_000 and got[None].n == 10_000
    total, packs = 0, 0
    for i in range(1_000_000):
        if i % 100:
            total, packs = (total + i % 7, packs) if total + i % 7 <= 20 else (i % 7, packs + 1)
    assert got["k"].last == packs


def test_markdown_files(spark, tmp_path):
    docs = spark.createDataFrame([("t", "a.md", None, "é\n"), ("t", "b.txt", "7", None), ("u", "c", "", "x")], "tenant_id string, src_file string, document_id string, content string")
    got = {(r.path, r.size) for r in A.write_markdown(docs, str(tmp_path)).collect()}
    assert got == {("ocr/t/a.md", 3), ("ocr/t/7.md", 0), ("ocr/u/c.md", 1)}
    assert {p: (tmp_path / p).read_bytes().decode() for p, _ in got} == {"ocr/t/a.md": "é\n", "ocr/t/7.md": "", "ocr/u/c.md": "x"}


def test_hashed_vectors_are_made_in_the_row(spark):
    texts = ["Red red BLUE, green", "", None, "!?", "cá đỏ cá-1"] + [f"w{k % 7} w{k % 11} w{k}" for k in range(600)]
    rows = hashed_vectors(spark.createDataFrame(list(enumerate(texts)), "point_id long, content string"), "content")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    for r in rows.collect():
        want = [0.0] * 64
        for term, n in Counter("".join(c if c.isalnum() else " " for c in (r.content or "").lower()).split()).items():
            want[int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % 64] += math.log1p(n)
        assert all(abs(x - y) < 1e-12 for x, y in zip(r.vector, want, strict=True))
