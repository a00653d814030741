import random

import numpy as np
from pyspark.sql import functions as F

from folio.llm import language_id as L
from tests.llm.rows import HARD, docs

WORDS = {
    "de": "der die und ist nicht schön über haben werden sein mit auf eine für groß Straße".split(),
    "en": "the and of with have which would this that from their there about house".split(),
    "fr": "le la les et était être avec dans pour cette où français très déjà".split(),
}


def texts(rng, n):
    return [(lang, " ".join(rng.choice(words) for _ in range(rng.randint(5, 200)))) for _ in range(n) for lang, words in WORDS.items()]


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    rows = [(i, t, lang, i % 4 == 2) for i, (lang, t) in enumerate(texts(rng, 60))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out boolean")
    got = {r.doc_id: r for r in L.predict(frame, L.fit(frame.where("not held_out"))).collect()}
    held = [r for r in rows if r[3]]
    assert len(got) == len(rows) and sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_tables_give_the_same_as_the_filters():
    rng = np.random.default_rng(1)
    windows = rng.integers(0, 256, (3, L.WINDOW)).astype(np.uint8)
    net = L.train(windows, np.array([0, 1, 0]), ["a", "b"], epochs=1)
    net.tables()
    plain = []
    for width, f in zip(L.WIDTHS, net.filters):
        value = np.stack([sum(net.embedding[windows[:, i + j]] @ f[j] for j in range(width)) for i in range(L.WINDOW - width + 1)], 1)
        plain.append(value.max(1))
    assert np.allclose(net.pooled(windows), np.maximum(np.concatenate(plain, 1) + net.bias, 0), atol=1e-4)


def test_hard_rows(spark):
    frame = docs(spark, [*HARD, "12345 !?", "the and of " * 4000]).withColumn("held_out", F.lit(False))
    got = {r.doc_id: r for r in L.predict(frame, L.fit(frame)).collect()}
    assert len(got) == len(HARD) + 2
    assert [i for i, r in sorted(got.items()) if r.lang_pred == "und"] == [1, 2, 3, 4, len(HARD) + 1]
    assert {r.lang_pred for r in L.predict(frame, None).collect()} == {"und"}
    none = frame.withColumn("lang", F.lit(None).cast("string"))
    assert L.fit(none) is None and L.predict(docs(spark, []).withColumn("held_out", F.lit(True)), None).count() == 0
    assert L.windows_of(b"x" * 700)[1].tolist() == [256, 256, 188]


def test_query_like_a_plain_pass(spark, tmp_path):
    """Every row of the query: windows one by one through embedding, filters, maxima and softmax, averaged by their letters."""
    rng = random.Random(5)
    rows = [(i, t, lang) for i, (lang, t) in enumerate(texts(rng, 25))] + [(900, None, "en"), (901, "123 !", "en"), (902, "the and of " * 100, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    docs_ = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text", "lang", (L.id_bucket("doc_id", 4) == 2).alias("held_out"))
    net = L.fit(docs_.where("not held_out"))
    net.tables()
    got = {r.doc_id: r for r in L.op7_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and got[900].lang_pred == got[901].lang_pred == "und"
    for i, t, _ in rows:
        if got[i].lang_pred == "und":
            continue
        windows, held = L.windows_of(t.encode())
        total = 0
        for w, h in zip(windows, held):
            pooled = np.concatenate([np.max([sum(net.embedding[w[p + j]] @ f[j] for j in range(width)) for p in range(L.WINDOW - width + 1)], 0) for width, f in zip(L.WIDTHS, net.filters)])
            total = total + h * net.scores(w[None])[0] if i % 5 else total + h * (np.maximum(pooled + net.bias, 0) @ net.out + net.out_bias)
        p = L._softmax(total / max(1, held.sum()))
        assert got[i].lang_pred == net.languages[int(p.argmax())] and abs(got[i].score - p.max()) < 1e-3
