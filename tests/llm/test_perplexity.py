import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folio.llm import perplexity as P
from tests.llm.rows import HARD, docs

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


class Plain:
    """Modified Kneser-Ney with dictionaries."""

    def __init__(self, texts, share):
        levels = [Counter() for _ in range(P.ORDER + 1)]
        raw = [Counter() for _ in range(P.ORDER + 1)]
        for t in texts:
            seq = [256] * P.ORDER + list(t) + [256]
            for i in range(P.ORDER, len(seq)):
                for m in range(P.ORDER + 1):
                    raw[m][tuple(seq[i - m : i + 1])] += 1
        levels[P.ORDER] = raw[P.ORDER]
        for m in range(P.ORDER):
            levels[m] = Counter(g[1:] for g in raw[m + 1])
        least = max(2, share * sum(raw[0].values()))
        self.share, self.rest = {}, {}
        for m, level in enumerate(levels):
            of = Counter(level.values())
            n = [max(1, of[k]) for k in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1])
            d = [0] + [min(k, max(0.1, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3)]
            all_, sure = Counter(), defaultdict(float)
            for g, c in level.items():
                all_[g[:-1]] += c
            for g, c in level.items():
                if raw[m][g] >= least:
                    self.share[g] = (c - d[min(c, 3)]) / all_[g[:-1]]
                    sure[g[:-1]] += self.share[g]
            self.rest |= {x: 1 - s for x, s in sure.items()}

    def p(self, context, s):
        p = 1 / 257
        for m in range(P.ORDER + 1):
            x = tuple(context[len(context) - m :])
            if x in self.rest:
                p = self.share.get((*x, s), 0) + self.rest[x] * p
        return p

    def mean(self, t):
        seq = [256] * P.ORDER + list(t) + [256]
        return -sum(math.log10(self.p(seq[i - P.ORDER : i], seq[i])) for i in range(P.ORDER, len(seq))) / (len(t) + 1)


def corpus(rng):
    texts = [" ".join(rng.choice(["the", "cat", "sat", "on", "é%d" % rng.randint(0, 9), "mat."]) + str(k % 7) for _ in range(rng.randint(40, 120))) for k in range(40)]
    return [*texts, "\n".join(["same line of text here"] * 30), " ".join("zq%dxv#" % rng.randint(0, 10**9) for _ in range(80)), *HARD]


def test_like_a_plain_model(spark):
    texts = corpus(random.Random(1))
    frame = docs(spark, texts)
    for share in (1e-6, 0.002):
        model = Plain([(t or "").encode() for t in texts if not plain_base(t)[-1]], share)
        got = {r.doc_id: r for r in P.judge(frame, P.fit(frame, share)).collect()}
        assert len(got) == len(texts)
        logs = sorted(math.floor(model.mean((t or "").encode()) / P.STEP) for t in texts if not plain_base(t)[-1])
        q1, q3 = (next(b for k, b in enumerate(logs, 1) if k >= q * len(logs)) * P.STEP for q in (0.25, 0.75))
        wide = max(q3 - q1, P.NARROWEST) * P.REACH
        for i, t in enumerate(texts, 1):
            r, mean = got[i], model.mean((t or "").encode())
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_base(t)
            assert math.log10(r.perplexity) == pytest.approx(mean, abs=1e-9)
            assert r.kept == (not plain_base(t)[-1] and q1 - wide <= mean <= q3 + wide)
        assert sum(model.p([116, 104, 101, 32], s) for s in range(257)) == pytest.approx(1)
        assert not got[42].kept and all(got[i].kept or got[i].base_failed for i in range(1, 41))


def test_null_language_and_empty_table(spark):
    assert P.judge(docs(spark, [])).count() == 0
    frame = docs(spark, ["the cat sat on the mat %d " % k * 1 + " ".join(str(j * k) for j in range(60)) for k in range(5)])
    rows = P.judge(frame.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(rows) == 5 and all(r.kept for r in rows if not r.base_failed)


def test_many_distinct_words():
    words = [b"%d" % (k % 50) for k in range(400)]
    assert P.repeated_words(words) == 400 and P.repeated_words(words[:51]) == 0 and P.repeated_words(words[:53]) == 6


class Whole(Plain):
    """The plain model of all n-grams: none occurs less than once, so the bar of two goes."""

    def __init__(self, texts, monkeypatch):
        monkeypatch.setitem(globals(), "max", lambda *x: 0 if x[0] == 2 else __builtins__["max"](*x))
        super().__init__(texts, 0)
        monkeypatch.delitem(globals(), "max")


def test_all_grams_count(spark, monkeypatch):
    texts = corpus(random.Random(2))
    model = Whole([(t or "").encode() for t in texts if not plain_base(t)[-1]], monkeypatch)
    for common in (P.COMMON, 0.002, 1.0):  # all in the broadcast, some, none
        monkeypatch.setattr(P, "COMMON", common)
        for r in P.judge(docs(spark, texts)).collect():
            assert math.log10(r.perplexity) == pytest.approx(model.mean((texts[r.doc_id - 1] or "").encode()), abs=1e-9)
