"""The corpus pipeline against plain versions of its stages, with near copies by five-word shingles at 0.8 or more."""

import random

import sentencepiece

import corpus_pipeline
from folio.llm import quality, sentencepiece_scan
from tests.llm.rows import HARD
from tests.llm.test_near_copies import plain_kept
from tests.llm.test_pipeline import SCHEMA
from tests.llm.test_quality import corpus


def test_run_like_plain_stages(spark, tmp_path):
    rng = random.Random(17)
    texts = [t for t, _ in corpus(rng)]
    passage = "the quick judge of seven northern harbours wrote that every lantern must be dark before the tide returns to them"
    half = texts[8].split()
    texts += [texts[5], texts[5] + " of", " ".join(half[: len(half) // 2]), texts[9] + " " + passage + ".", texts[14] + " " + passage.upper(), *HARD, texts[5]]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts, 1)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    model = quality.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    good = {i: t for i, t, *_ in docs if model.score((t or "").encode(), quality.statistics((t or "").encode())) >= quality.KEEP}
    one = {i: t for i, t in good.items() if i in plain_kept(good)[0]}
    clean = {i: t for i, t in one.items() if passage not in (t or "").lower()}
    assert len(clean) < len(one) < len(good) < len(docs)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(clean)
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_scan.default_model())
    assert all(list(got[i].ids) == library.encode(t or "") for i, t in clean.items())
