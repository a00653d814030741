import random
import zlib

import numpy as np
import sentencepiece

from folio.llm import sentencepiece_scan as S
from tests.llm.rows import HARD, docs


def test_like_the_library_on_whole_and_chunked_texts(spark):
    rng = random.Random(1)
    texts = [*HARD, "".join(rng.choice("abcdeAB01=+/") for _ in range(700)), " ".join("".join(rng.choice("thenosri") for _ in range(rng.randint(1, 14))) for _ in range(300))]
    library = sentencepiece.SentencePieceProcessor(model_file=S.default_model())
    frame = docs(spark, texts)
    for chunk in (64, 1 << 15):
        got = {r.doc_id: r for r in S.decode(S.encode(frame, chunk=chunk)).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts, 1):
            want = library.encode(t or "")
            assert got[i].ids == want
            assert got[i].ids_crc32 == zlib.crc32(np.array(want, "<i4").tobytes())
            assert got[i].text == library.decode(want)


def test_round_trip_and_empty_table(spark):
    got = {r.doc_id: r for r in S.round_trip(docs(spark, HARD)).collect()}
    assert [r.round_trip for _, r in sorted(got.items())] == ["▁" not in (t or "") for t in HARD]
    assert sorted(S.round_trip(docs(spark, HARD), chunk=64).collect()) == sorted(got.values())
    assert S.round_trip(docs(spark, [])).count() == 0
    twice = docs(spark, ["a b"]).union(docs(spark, ["a b"]))
    assert S.round_trip(twice).count() == 2


def test_blocks_of_chunks_combine(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 3)
    text = "".join(random.Random(2).choice("abst") for _ in range(900))
    got = S.encode(docs(spark, [text]), chunk=40).first()
    assert got.ids == sentencepiece.SentencePieceProcessor(model_file=S.default_model()).encode(text)


def test_searched_together_like_one_by_one():
    """All words of many kinds, with characters that are no piece, long runs and cuts, against the library."""
    rng, library = random.Random(4), sentencepiece.SentencePieceProcessor(model_file=S.default_model())
    kinds = ["etaoinshr", "abcdefghijklmnopqrstuvwxyzABCDEF", "éüñßøçàè", "漢字かな语言", "😀🎈\x00\x07", "0123456789.,-/", "абвгдежз", "▁"]
    words = ["".join(rng.choice(rng.choice(kinds)) if rng.random() < 0.2 else rng.choice(kind) for _ in range(rng.choice([1, 3, 7, 15, 40, 200]))) for kind in kinds for _ in range(120)]
    pieces = S.Pieces(S.default_model())
    texts = ["".join(rng.choice(words) + " " * rng.choice([0, 1, 1, 1, 2]) for _ in range(30)) for _ in range(40)]
    assert [np.frombuffer(x, "<i4").tolist() for x in pieces.all_words([S.marked(t) for t in texts])] == [library.encode(t) for t in texts]
    pairs = rng.sample(sorted(pieces.texts), 400)
    found = pieces.steps.agree(np.array([a << 32 | b for a, b in zip(pairs, pairs[1:])], np.int64))
    assert found.tolist() == [pieces.agree(pieces.texts[a], pieces.texts[b]) for a, b in zip(pairs, pairs[1:])]


def test_at_chunk_edges_and_beyond_two_megabytes(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=S.default_model())
    base = "".join(random.Random(5).choice(["the ", "lantern", " of", "x", "é", "漢", "\n", "  "]) for _ in range(40))
    texts = [base[:n] for n in range(60, 70)] + [(base * 20000)[:2_300_000]]
    got = {r.doc_id: r.ids for r in S.encode(docs(spark, texts[:-1]), chunk=32).union(S.encode(docs(spark, texts[-1:], 11))).collect()}
    for i, t in enumerate(texts, 1):
        assert got[i] == library.encode(t)
