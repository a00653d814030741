import random

import numpy as np

from folio.llm import quality as Q
from tests.llm.rows import HARD, docs


def corpus(rng):
    """Texts and whether they are good."""
    def word():
        return "".join(rng.choice(["th", "er", "on", "an", "re", "he"]) for _ in range(rng.randint(1, 4)))

    out = []
    for k in range(120):
        words = [rng.choice(["the", "of", "and", "to"]) if rng.random() < 0.4 else word() for _ in range(rng.randint(30, 200))]
        if k % 6 == 0:
            out.append((" ".join([word()] * 150), False))
        elif k % 6 == 1:
            out.append((" ".join(w + rng.choice(["$$$", "###", "&&&"]) for w in words), False))
        else:
            out.append((". ".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9)) + ".", True))
    return out


def test_separates_good_from_bad_without_labels(spark):
    texts = corpus(random.Random(1))
    frame = docs(spark, [t for t, _ in texts])
    got = {r.doc_id: r.kept for r in Q.score(frame, Q.fit(frame)).collect()}
    right = sum(got[i] == good for i, (_, good) in enumerate(texts, 1))
    assert right >= 0.97 * len(texts)
    kept = Q.keep_good(frame)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}


def test_posteriors_like_a_plain_em():
    rng = np.random.default_rng(1)
    counts = {}
    for _ in range(4000):
        good = rng.random() < 0.8
        p = "".join(Q.NONE if rng.random() < 0.2 else (Q.GOOD if (rng.random() < acc) == good else Q.BAD) for acc in (0.95, 0.9, 0.85, 0.8))
        counts[p] = counts.get(p, 0) + 1
    found = Q.posteriors(counts)
    assert found["gggg"] > 0.99 and found["bbbb"] < 0.01 and 0 < found["gb--"] < 1
    assert found["g--b"] > found["b--g"]


def test_hard_rows_and_empty_table(spark):
    frame = docs(spark, HARD)
    got = Q.score(frame, Q.fit(frame)).collect()
    assert len(got) == len(HARD) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (5, 6)}) == 1
    empty = docs(spark, [])
    assert Q.score(empty, Q.fit(empty)).count() == 0 and Q.keep_good(empty).columns == empty.columns


def plain_em(counts, rounds=100):
    """Expectation-maximisation, document by document class, with plain loops."""
    good = {p: (0.95, 0.6, 0.05)[min(2, p.count("b"))] for p in counts}
    for _ in range(rounds):
        total = sum(counts.values())
        share = (sum(n * good[p] for p, n in counts.items()) + 1) / (total + 2)
        new = {}
        right = []
        for k in range(len(next(iter(counts)))):
            cell = {}
            for vote in "gb":
                cell[vote, 1] = sum(n * good[p] for p, n in counts.items() if p[k] == vote) + 1
                cell[vote, 0] = sum(n * (1 - good[p]) for p, n in counts.items() if p[k] == vote) + 1
            right.append({(v, c): cell[v, c] / (cell["g", c] + cell["b", c]) for v in "gb" for c in (0, 1)})
        for p in counts:
            one, zero = share, 1 - share
            for k, v in enumerate(p):
                if v != "-":
                    one, zero = one * right[k][v, 1], zero * right[k][v, 0]
            new[p] = one / (one + zero)
        moved = max(abs(new[p] - good[p]) for p in counts)
        good = new
        if moved < 1e-9:
            break
    return good


def test_posteriors_equal_the_plain_em():
    rng = np.random.default_rng(3)
    for _ in range(5):
        counts = {}
        for _ in range(500):
            truth = rng.random() < 0.7
            p = "".join(Q.NONE if rng.random() < 0.2 else (Q.GOOD if (rng.random() < acc) == truth else Q.BAD) for acc in (0.95, 0.9, 0.8))
            counts[p] = counts.get(p, 0) + 1
        want, found = plain_em(counts), Q.posteriors(counts)
        assert all(abs(found[p] - want[p]) < 1e-6 for p in counts)


def test_query_like_a_plain_scorer(spark, tmp_path):
    """Every row of the query: votes and posterior by the plain EM, score by adding up the weights gram by gram."""
    texts = [t for t, _ in corpus(random.Random(6))][:60] + HARD[:9]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model, counts = Q.fit(frame), {}
    for t in texts:
        v = Q.votes(Q.statistics((t or "").encode()))
        counts[v] = counts.get(v, 0) + 1
    want = plain_em(counts)
    for r in Q.op8_quality(spark, str(tmp_path)).collect():
        data = (texts[r.doc_id - 1] or "").encode()
        s = Q.statistics(data)
        grams = [(int.from_bytes(data[i : i + 4], "little") * 2654435761 % (1 << 32) >> 8) % (Q.BUCKETS - 320) for i in range(len(data) - 3)]
        z = model.bias + sum(0.1 * float(model.weights[b]) for b in Q._ranges(s)) + (sum(float(model.weights[g]) for g in grams) / len(grams) if grams else 0)
        assert r.votes == Q.votes(s) and abs(r.posterior - want[r.votes]) < 1e-6
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-5 and r.kept == (r.score >= Q.KEEP)


def test_repeated_rows_do_not_fill_the_sample(spark):
    texts = [t for t, _ in corpus(random.Random(7))]
    frame = docs(spark, texts).selectExpr("doc_id", "text").union(spark.range(4000).selectExpr("cast(null as long) doc_id", "'one text for all of these rows' text"))
    seen = []
    train, Q.train = Q.train, lambda rows: seen.append(len(rows)) or train(rows)
    try:
        Q.fit(frame, training_rows=50)
    finally:
        Q.train = train
    assert 0 < seen[0] <= 50
