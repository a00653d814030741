import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import grams, ppm
from tests.llm.rows import HARD, docs

EDGE = 256


class Plain:
    """PPM with dictionaries, one symbol at a time."""

    def __init__(self, texts, share):
        self.counts, total = Counter(), 0
        for t in texts:
            seq = [EDGE] * ppm.ORDER + list(t) + [EDGE]
            for i in range(ppm.ORDER, len(seq)):
                total += 1
                for m in range(ppm.ORDER + 1):
                    self.counts[tuple(seq[i - m : i + 1])] += 1
        least = max(2, share * total)
        self.kept, self.n, self.q = {}, Counter(), Counter()
        for g, c in self.counts.items():
            self.n[g[:-1]] += c
            self.q[g[:-1]] += 1
            if c >= least:
                self.kept.setdefault(g[:-1], {})[g[-1]] = c

    def p(self, context, s):
        out, ruled = 1.0, set()
        for m in range(ppm.ORDER, -1, -1):
            x = tuple(context[len(context) - m :])
            cells = self.kept.get(x)
            if not cells:
                continue
            left = {t: c for t, c in cells.items() if t not in ruled}
            escape = self.q[x] - len(ruled) + self.n[x] - sum(cells.values())
            total = sum(left.values()) + escape
            if total:
                if s in left:
                    return out * left[s] / total
                out *= escape / total
            ruled = set(cells)
        return out / (257 - len(ruled))

    def score(self, t):
        seq = [EDGE] * ppm.ORDER + list(t) + [EDGE]
        return sum(math.log10(self.p(seq[i - ppm.ORDER : i], seq[i])) for i in range(ppm.ORDER, len(seq)))


def test_like_a_plain_model(spark):
    rng = random.Random(1)
    texts = HARD[:7] + [" ".join(rng.choice(["the", "cat", "sat", "mat", "é" * rng.randint(1, 3), "Rare%d" % k]) for _ in range(rng.randint(1, 40))) for k in range(60)]
    frame = docs(spark, texts).withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 10 == 0)
    data = {i: (t or "").encode() for i, t in enumerate(texts, 1)}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in data}
    for share, word_share in ((1e-6, 5e-6), (0.002, 0.03)):
        model = Plain([t for i, t in data.items() if not held[i]], share)
        words = Counter(w for i, t in data.items() if not held[i] for w in [*t.lower().split(), b"\n"])
        total, distinct = sum(words.values()), len(words)
        got = {r.doc_id: r for r in ppm.score(frame, share=share, word_share=word_share).collect()}
        assert len(got) == len(data)
        for i, t in data.items():
            tokens, r = [*t.lower().split(), b"\n"], got[i]
            base = sum(math.log10((words[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens)
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(tokens), sum(words[w] > 0 for w in tokens), total)
            assert r.base_score == pytest.approx(base, abs=1e-8) and r.score == pytest.approx(model.score(t), abs=1e-8)
        assert sum(model.p([116, 104, 101, 32], s) for s in range(257)) == pytest.approx(1)
        assert sum(model.p([256, 256, 256, 256], s) for s in range(257)) == pytest.approx(1)


def test_empty_table(spark):
    assert ppm.score(docs(spark, []).withColumn("held_out", F.lit(True))).count() == 0
    one = ppm.score(docs(spark, ["ab"]).withColumn("held_out", F.lit(True))).first()
    assert one.n_known == 0 and one.score == pytest.approx(-3 * math.log10(257))


def test_grams_in_blocks(monkeypatch):
    texts = [b"abcdefghij" * 3, b"", b"xy"]
    whole_sums = grams.sums(texts, 3, grams.Memo(lambda g: np.sqrt(g.astype(float)), 4))
    whole = np.concatenate(list(grams.grams(b"abcdefghij", 3)))
    monkeypatch.setattr(grams, "BLOCK", 4)
    assert np.array_equal(np.concatenate(list(grams.grams(b"abcdefghij", 3))), whole)
    assert np.allclose(grams.sums(texts, 3, grams.Memo(lambda g: np.sqrt(g.astype(float)), 4)), whole_sums)
    assert len(whole) == 11 and whole[-1] == (105 << 18 | 106 << 9 | 256)
    assert len(np.concatenate(list(grams.grams(b"abcd", 3)))) == 5 and len(np.concatenate(list(grams.grams(b"", 3)))) == 1


class Whole(Plain):
    """The plain model of all n-grams, single ones as well."""

    def __init__(self, texts):
        super().__init__(texts, 0)
        self.kept = {}
        for g, c in self.counts.items():
            self.kept.setdefault(g[:-1], {})[g[-1]] = c


def test_all_grams_count(spark, monkeypatch):
    rng = random.Random(2)
    texts = ["only once: zq\u00fcx", *[" ".join(rng.choice(["the", "cat", "sat", "r%d" % rng.randint(0, 99)]) for _ in range(30)) for _ in range(40)], "only twice zq\u00fcy"]
    frame = docs(spark, texts).withColumn("held_out", F.col("doc_id") % 4 == 2)
    model = Whole([t.encode() for i, t in enumerate(texts, 1) if i % 4 != 2])
    for common in (ppm.COMMON, 0.002, 1.0):  # all in the broadcast, some, none
        monkeypatch.setattr(ppm, "COMMON", common)
        got = {r.doc_id: r.score for r in ppm.score(frame).collect()}
        assert all(got[i] == pytest.approx(model.score(t.encode()), abs=1e-8) for i, t in enumerate(texts, 1))
