import random

import numpy as np

import corpus_pipeline
from folio.llm import near_copies
from tests.llm.rows import HARD, docs


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain_kept(texts):
    """The ids that stay, by looking at all pairs."""
    sets = {i: plain_set(t) for i, t in texts.items()}
    label, changed = {i: i for i in texts}, True
    near = [(i, j) for i in texts for j in texts if j < i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in near:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    return {i for i in texts if label[i] == i}, len(near)


def corpus(rng):
    word = lambda: rng.choice(["al", "be", "ga", "de", "ep"]) + str(rng.randint(0, 99))
    out = []
    for _ in range(25):
        words = [word() for _ in range(rng.randint(8, 200))]
        out.append(" ".join(words))
        for _ in range(rng.randint(1, 4)):  # chains of changed copies on both sides of 0.8
            for _ in range(rng.choice([1, 1, 2, 4, 8])):
                words[rng.randrange(len(words))] = word()
            out.append(" ".join(words))
    words = [word() for _ in range(60)]
    out += [" ".join([*words, word()]).upper() for _ in range(60)]  # one crowded group
    rng.shuffle(out)
    return out


def test_stage_like_all_pairs(spark):
    texts = dict(enumerate(HARD + corpus(random.Random(5)), 1))
    want, near = plain_kept(texts)
    assert near > 1000 and 30 < len(want) < len(texts) - 60
    frame = docs(spark, list(texts.values()))
    for got in (corpus_pipeline.near_dedup(spark, frame, ""), near_copies.keep_one(frame, 3), near_copies.keep_one(frame, 2, 300)):
        assert {r.doc_id for r in got.collect()} == want and got.columns == frame.columns


def test_pairs_at_the_bound_share_a_band():
    rng, missed = np.random.default_rng(6), 0
    for _ in range(500):
        x = rng.integers(0, 1 << 63, 220).astype(np.uint64)  # 176 of 220 shared
        missed += not (near_copies.band_keys(x[:198]) == near_copies.band_keys(np.sort(np.concatenate([x[:176], x[198:]])))).any()
    assert missed == 0


def test_blocks_of_words_and_null_ids(spark):
    data = b"ab cd ef gh ij kl " * 300
    assert len(near_copies.shingles(data)) == 6 and len(near_copies.shingles(b" ")) == 0 and len(near_copies.shingles(b"a b")) == 1
    frame = docs(spark, ["a", "a", "a"]).selectExpr("if(doc_id = 1, null, doc_id) doc_id", "text")
    assert [r.doc_id for r in near_copies.keep_one(frame).collect()] == [2]
    assert near_copies.keep_one(docs(spark, [])).count() == 0


def test_rows_that_share_an_id_or_have_none(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = [(None, a), (None, a), (None, a + " more"), (7, b), (7, b), (7, c), (8, b), (9, c), (None, c), (5, d), (6, d), (None, None), (None, ""), (6, "other words")]
    frame = docs(spark, [t for _, t in rows])
    ids = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(rows, 1)], "k long, id long")
    frame = frame.join(ids, frame.doc_id == ids.k).drop("doc_id", "k").withColumnRenamed("id", "doc_id").select(*frame.columns)
    got = near_copies.keep_one(frame)
    assert got.columns == frame.columns
    kept = sorted((r.doc_id or 0, (r.text or "")[:2]) for r in got.collect())
    assert kept == [(0, ""), (0, "a0"), (5, "d0"), (6, "ot"), (7, "b0"), (7, "c0")]


def test_simhash_brings_candidates_together(spark):
    rng = random.Random(9)
    words = [f"w{rng.randint(0, 999)}" for _ in range(900)]
    texts = {1: " ".join(words), 2: " ".join([*words, "end"]), 3: " ".join(rng.sample(words, 900)), 4: " ".join(words[:60])}
    sets = {i: near_copies.shingles(t.encode()) for i, t in texts.items()}
    fps = {i: near_copies.simhash(x) for i, x in sets.items()}
    for i, x in sets.items():
        assert fps[i] & (1 << 64) - 1 == sum(1 << k for k in range(64) if 2 * sum(int(h) >> k & 1 for h in x) > len(x))
    assert ((fps[1] ^ fps[2]) & (1 << 64) - 1).bit_count() <= 2 < ((fps[1] ^ fps[3]) & (1 << 64) - 1).bit_count()
    rows = [(i, int(near_copies._node(x)), len(x), fps[i], []) for i, x in sets.items()]
    prints = spark.createDataFrame(rows, "doc_id long, node long, size long, fp long, keys array<long>")  # without bands
    frame = spark.createDataFrame([(i, t.encode()) for i, t in texts.items()], "doc_id long, text binary")
    assert [{r.a, r.b} for r in near_copies.near_links(prints, frame).collect()] == [{rows[0][1], rows[1][1]}]
