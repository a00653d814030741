"""The corpus pipeline against plain versions of its stages."""

import random
import zlib

import numpy as np
import sentencepiece

import corpus_pipeline
from folio.llm import quality, sentencepiece_scan
from tests.llm.rows import HARD
from tests.llm.test_near_copies import plain_kept
from tests.llm.test_quality import corpus

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_run_like_plain_stages(spark, tmp_path):
    rng = random.Random(7)
    texts = [t for t, _ in corpus(rng)]
    passage = "the quick judge of seven northern harbours wrote that every lantern must be dark before the tide returns to them"
    texts += [texts[5], texts[5] + " of", " ".join(texts[9].split()[::-1]) + " " + passage + ".", " ".join(texts[11].split()[::-1]) + " Mail to ann.b7@example.org or 10.1.2.3.", *HARD]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts, 1)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    stages = [f for _, f in corpus_pipeline.STAGES]
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    good = stages[0](spark, rows, str(tmp_path))
    model = quality.fit(rows)
    kept = {i: t for i, t, *_ in docs if model.score((t or "").encode(), quality.statistics((t or "").encode())) >= quality.KEEP}
    assert {r.doc_id: r.text for r in good.collect()} == kept and good.columns == rows.columns

    one = {i: t for i, t in kept.items() if i in plain_kept(kept)[0]}
    clean = {i: t for i, t in one.items() if passage not in (t or "")}
    assert len(clean) < len(one) < len(kept) < len(docs)

    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(clean)
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_scan.default_model())
    changed = 0
    for i, t in clean.items():
        back = library.decode(list(got[i].ids))
        assert got[i].ids_crc32 == zlib.crc32(np.array(got[i].ids, "<i4").tobytes()) and list(got[i].ids) == library.encode(back)
        if "@example" in (t or ""):
            changed += 1
            assert "ann.b7@" not in back and "10.1.2.3" not in back and len(back) >= len(t) - 6 and back.split(" Mail")[0] == t.split(" Mail")[0]
        elif "▁" not in (t or ""):
            assert back == (t or "")
    assert changed == 1


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
