"""Semantic cuts where many slopes are equal: the query and its SQL must take the same side."""

import random

import duckdb
import pytest

from folio.plans.registry import ORACLES, QUERIES

WORDS = ["alphabetical", "bibliography", "conversation", "distribution", "encyclopedia", "frequentness"]


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """Documents of short sentences from few words, so that cosines repeat and half billionths come up."""
    rng, to = random.Random(1), str(tmp_path_factory.mktemp("tied"))
    texts = [" ".join(" ".join(rng.choices(WORDS, k=rng.randint(1, 4))) + "." for _ in range(rng.randint(140, 200))) for _ in range(600)]
    duckdb.execute("create or replace table d as select unnest(?) as text", [texts])
    duckdb.execute(f"copy (select row_number() over () - 1 as doc_id, text, 'en' as lang, 'src0' as source, length(text) as n_chars from d) to '{to}/documents.parquet' (format parquet)")
    return to


def test_equal_slopes_like_sql(spark, tied):
    got = sorted((r.doc_id, r.part, r.content) for r in QUERIES["b6_split_semantic"](spark, tied).collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tied}/documents.parquet'")
    assert got == sorted(con.execute(f"select doc_id, part, content from ({ORACLES['b6_split_semantic']})").fetchall())
    assert len(got) > 1200


def test_a_document_of_one_sentence_is_one_part(spark):
    from folio.operators.chunking import split_semantic

    rows = spark.createDataFrame([(1, "a" * 4000), (2, "b" * 2000 + ". " + "c" * 2000), (3, None), (4, "short")], "doc_id long, content string")
    assert sorted((r.doc_id, r.part, len(r.content)) for r in split_semantic(rows, ("doc_id",)).collect()) == [(1, 0, 4000), (2, 0, 4002)]


def test_cuts_are_exact(spark):
    """Slopes that differ by half a billionth are told apart; 21 slopes have the second largest as their percentile."""
    from pyspark.sql import functions as F

    from folio.operators.chunking import _cuts

    rng = random.Random(2)
    lists = [[rng.choice([0, 1, 2, 3, 500_000_000]) for _ in range(rng.choice([1, 2, 11, 21, 21, 41]))] for _ in range(300)]
    rows = spark.createDataFrame([(k, [1 - x / 1e9 for x in d] + [0.0]) for k, d in enumerate(lists)], "k int, cosines array<double>")
    got = {r.k: r.cuts for r in rows.select("k", _cuts(F.col("cosines")).alias("cuts")).collect()}
    for k, d in enumerate(lists):
        ends = [d[0], *d, d[-1]] if len(d) > 1 else [0, 0, 0]
        slopes = [(b - a) * (2 if len(d) > 1 and i in (0, len(d) - 1) else 1) for i, (a, b) in enumerate(zip(ends, ends[2:], strict=False))]
        place, order = 95 * (len(d) - 1), sorted(slopes)
        bar = order[place // 100] * (100 - place % 100) + (order[place // 100 + 1] * (place % 100) if place % 100 else 0)
        assert got[k] == [i for i, x in enumerate(slopes) if 100 * x > bar]
