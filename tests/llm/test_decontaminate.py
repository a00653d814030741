import random
import time
from itertools import combinations

import numpy as np

from folio.llm import decontaminate as D
from tests.llm.rows import HARD, docs


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(n)]


def plain_stretch(same, least):
    best = None
    for i in range(len(same)):
        for j in range(i + least, len(same) + 1):
            if same[i] and same[j - 1] and sum(same[i:j]) >= D.AGREE * (j - i) and (best is None or j - i > best):
                best = j - i
    return best


def test_stretch_like_all_stretches():
    rng = np.random.default_rng(1)
    for _ in range(400):
        same = rng.random(rng.integers(0, 40)) < 0.75
        got, want = D.stretch(same, 6), plain_stretch(same.tolist(), 6)
        # The longest stretch may lose a disagreeing end; it still exists whenever any does, unless cut below the least.
        assert (got is None) <= (want is None or want < 6 + 4)
        if got:
            assert got[2] >= D.AGREE * (got[1] - got[0]) and got[1] - got[0] >= 6


def test_planted_passages(spark):
    rng = random.Random(2)
    items = [words(rng, n) for n in (5, 14, 30, 60)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(9, None), (10, "")], "item_id long, text string")

    def within(passage):
        return " ".join([*words(rng, 40), *passage, *words(rng, 40)])

    swapped = list(items[3])
    for k in (7, 19, 33, 50):
        swapped[k] = "other"
    texts = [within(items[0]), within(items[1]), within([f"{w.upper()}," for w in items[2]]), within(swapped), within(items[3][20:40]), within(items[2][:9]), within(words(rng, 60)), *HARD]
    got = {(r.doc_id, r.item_id): r for r in D.overlaps(docs(spark, texts), bench).collect()}
    assert set(got) == {(1, 0), (2, 1), (3, 2), (4, 3), (5, 3)}
    assert (got[4, 3].first_token, got[4, 3].n_tokens, got[4, 3].n_agree) == (40, 60, 56)
    in_blocks = {(r.doc_id, r.item_id) for r in D.overlaps(docs(spark, texts), bench, block_tokens=20).collect()}
    assert in_blocks == set(got)
    kept = {r.doc_id for r in D.clean(docs(spark, texts), bench).collect()}
    assert kept == set(range(6, len(texts) + 1))
    assert D.overlaps(docs(spark, []), bench).count() == 0
    assert D.clean(docs(spark, texts), bench.where("item_id > 8")).count() == len(texts)


def test_every_single_substitution_is_hit():
    item = np.arange(1, 14, dtype=np.uint64) * np.uint64(977)
    for k in range(13):
        doc = item.copy()
        doc[k] = 5
        index = D.Index([])
        index.ids, index.texts = [1], [item]
        found = [np.isin(D.seeds(doc, m), D.seeds(item, m)).any() for m in D.MASKS]
        assert any(found), k


def plain_overlap(item, doc):
    """The longest stretch over all diagonals: (tokens, agreeing, first), by trying everything."""
    best, n = None, len(item)
    for shift in range(-n, len(doc)):
        low, high = max(0, -shift), min(n, len(doc) - shift)
        same = [item[i] == doc[i + shift] for i in range(low, high)]
        if n <= D.OVERLAP:
            if high - low == n and 5 * sum(same) >= 4 * n:
                found = (n, sum(same), -(low + shift))
            else:
                continue
        else:
            spans = [(j - i, sum(same[i:j]), -(low + i + shift)) for i in range(len(same)) if same[i] for j in range(i + D.OVERLAP, len(same) + 1) if same[j - 1] and 5 * sum(same[i:j]) >= 4 * (j - i)]
            if not spans:
                continue
            found = max(spans)
        best = max(best, found) if best else found
    return best


def test_query_like_all_diagonals(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = words(rng, 30)
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in (4, 9, 10, 12, 13, 18, 25, 40)] + [["same"] * 20]
    texts = [None, ""]
    for k in range(63):
        passage = list(items[k % len(items)])
        for k in range(len(passage)):
            if rng.random() < rng.choice([0, 0.1, 0.15]):
                passage[k] = "new" + str(rng.randint(0, 99))
        cut = rng.choice([0, 0, 0, 3])
        texts.append(" ".join([*rng.choices(vocabulary, k=rng.randint(0, 9)), *passage[cut:], *rng.choices(vocabulary, k=rng.randint(0, 9))]))
    texts += ["same " * 70, " ".join(items[1][1:]), " ".join(["x", *items[1][1:]]), " ".join([*items[1][:-1], "x"])]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): (r.n_tokens, r.n_agree, r.first_token) for r in D.op6_decontaminate(spark, str(tmp_path)).collect()}
    want = {}
    for d, t in enumerate(texts, 1):
        for i, item in enumerate(items):
            if found := plain_overlap(item, (t or "").split()):
                want[d, i] = found[0], found[1], -found[2]
    assert len(want) > 40 and len({i for _, i in want}) == len(items)
    # Where all is found, the longest stretch is the plain one's, but for ends that disagree and are cut after choosing it.
    assert set(got) <= set(want)
    seeded = {p for p in want if any(np.isin(D.seeds(h, m), D.seeds(g, m)).any() for m in D.MASKS for h, g in [(D.tokens().of(texts[p[0] - 1]), D.tokens().of(" ".join(items[p[1]])))]) or len(items[p[1]]) <= D.OVERLAP}
    assert {p for p in seeded if want[p][1] < want[p][0]} - set(got) <= {p for p in want if want[p][0] < D.OVERLAP + 4 and len(items[p[1]]) > D.OVERLAP}
    for p in want:
        if len(items[p[1]]) <= D.OVERLAP or want[p][0] == want[p][1]:
            assert got[p] == want[p], p


def test_masks_by_enumeration():
    """How many choices of substituted places some mask survives."""

    def survived(n, changed):
        spots = list(combinations(range(n), changed))
        return sum(any(all(at + k not in out for k, bit in enumerate(m) if bit == "1") for m in D.MASKS for at in range(n - len(m) + 1)) for out in map(set, spots)), len(spots)

    assert survived(13, 1) == (13, 13) and survived(13, 2) == (78, 78) and survived(15, 3) == (449, 455)


def test_repetitive_text_is_bounded():
    text = "la " * 350_000  # 1 MB
    index = D.Index([(k, " ".join(["la"] * n)) for k, n in enumerate((9, 40, 60))])
    began = time.perf_counter()
    found = index.overlaps([D.tokens().of(text)])
    assert [x[1:] for x in found] == [(0, 0, 9, 9, 9), (1, 0, 40, 40, 40), (2, 0, 60, 60, 60)]
    assert time.perf_counter() - began < 60


def test_rows_decide_themselves(spark):
    passage = " ".join(words(random.Random(3), 20))
    frame = spark.createDataFrame([(None, passage, 1), (None, "fine", 2), (7, passage, 3), (7, passage, 3), (8, None, None)], "doc_id long, text string, `a.b` int")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert [tuple(r) for r in D.clean(frame, bench).collect()] == [(None, "fine", 2), (8, None, None)]
    assert D.clean(frame, bench).columns == frame.columns
