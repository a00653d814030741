import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from folio.llm import collocations
from tests.llm.rows import HARD


def plain(rows, words=5, least=100, top=2000):
    """rows: (doc_id, lang, text). Every n-gram as text, and scores in Python's whole numbers."""
    f, n = Counter(), Counter()
    for doc, lang, text in rows:
        lang = lang if lang is not None else "und"
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, words + 1):
                for i in range(len(ws) - k + 1):
                    f[lang, " ".join(ws[i : i + k])] += 1
    out = {}
    many = {key: c for key, c in f.items() if c >= least and " " in key[1]}
    for (lang, phrase), a in many.items():
        ws = phrase.split(" ")
        cuts = [(1000 * a * n[lang] // (f[lang, " ".join(ws[:k])] * f[lang, " ".join(ws[k:])]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        inside = any(g == lang and c >= a and f" {phrase} " in f" {other} " and other != phrase for (g, other), c in many.items())
        if not inside:
            row = (lang, phrase, a, f[lang, " ".join(ws[:k])], f[lang, " ".join(ws[k:])], n[lang], score)
            out.setdefault(lang, []).append(row)
    rows = []
    for found in out.values():
        found.sort(key=lambda r: (-r[6], -r[2], r[1].encode()))
        rows += [(r[0], rank, *r[1:]) for rank, r in enumerate(found[:top], 1)]
    return sorted(rows)


def frame(spark, rows):
    more = [(*r, "x", "y", 7) for r in rows]
    return spark.createDataFrame(more, "doc_id long, lang string, text string, phrase string, fp string, f int").repartition(3)


def made(seed, n):
    rng = random.Random(seed)
    vocabulary = ["New", "york", "city", "the", "The", "of", "a", "é漢", "x\x00y", "state", "<b>"]
    rows = []
    for k in range(n):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " \r\n"]) for _ in range(rng.randrange(40)))
        if rng.random() < 0.4:
            text += " the united states of America the united"
        rows.append((None if k % 17 == 0 else k // 2, rng.choice(["en", "en", None, "und", "fr"]), text))
    return rows


def got(df):
    return sorted(tuple(r)[:8] for r in df.collect())


@pytest.mark.parametrize("width", [64, 7])
def test_like_plain_counts(spark, width):
    """With 7 bits nearly all fingerprints collide, and no count may change."""
    rows = made(1, 150)
    want = plain(rows, least=8)
    assert len({r[0] for r in want}) == 3 and any(len(r[2].split(" ")) == 5 for r in want)
    found = collocations.collocations(frame(spark, rows), least=8, width=width)
    assert got(found) == want
    for r in found.collect():
        texts = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for d, lang, t in rows if d == r.first_doc_id and (lang or "und") == r.lang]
        assert any(re.findall(r"[^\x20\x09-\x0D.,;:!?]+", t)[r.first_word :][: len(r.phrase.split(" "))] == r.phrase.split(" ") for t in texts)


def test_top_shorter_phrases_and_hard_texts(spark):
    rows = made(2, 60) + [(k, "en", t) for k, t in enumerate(HARD * 2)]
    assert got(collocations.collocations(frame(spark, rows), least=5, top=4)) == plain(rows, least=5, top=4)
    assert got(collocations.collocations(frame(spark, rows), words=2, least=5)) == plain(rows, words=2, least=5)
    assert got(collocations.collocations(frame(spark, []))) == []
    assert got(collocations.collocations(frame(spark, [(1, None, None), (None, "en", "")]))) == []


def test_query_takes_the_whole_table(spark, tmp_path):
    rows = [(k, "en", "a b c. d e") for k in range(100)] + [(500, "en", "d e")] * 3 + [(k, "fr", "a b") for k in range(99)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = collocations.op12_collocations(spark, str(tmp_path))
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert got(out) == plain(rows)
    assert [r[2] for r in got(out)] == ["a b c", "d e"]


def test_runs_of_any_size_give_the_same_words():
    texts = ["One two. three  four", "five" * 30, "a b c d e f, g h i j k! l m n"] * 3
    batch = pa.RecordBatch.from_pydict({"text": [t.encode() for t in texts], "lang": ["en"] * 9, "doc_id": list(range(9))})

    def seen(size):
        out = Counter()
        for run in collocations.runs([batch], size=size):
            data = run.text.tobytes()
            for n in (1, 2, 3):
                for at in np.flatnonzero(run.inside(n)).tolist():
                    out[n, int(run.doc[at]), int(run.word[at]), data[run.begins[at] : run.ends[at + n - 1]]] += 1
        return out

    assert seen(1 << 20) == seen(7) == seen(1)


def test_fingerprints_are_of_text_language_and_length_alone():
    one = collocations.Run([b"x a  b", b"A\tb"], ["en", "en"], [1, 2], [0, 0])
    other = collocations.Run([b"a b"], ["fr"], [1], [0])
    assert one.prints(2)[1] == one.prints(2)[3] != other.prints(2)[0]
    assert list(one.inside(2)) == [True, True, False, True]


def test_bitmap_is_the_set_of_leading_bits(spark):
    prints = [0, -1, 1 << 40, -(1 << 40), 123456789 << 32]
    bits = collocations._bitmap(spark.createDataFrame([(p,) for p in prints], "fp long"))
    assert len(bits) == (1 << collocations.BITS) // 8
    assert collocations._has(bits, np.array(prints, np.int64).view(np.uint64)).all()
    assert int(np.unpackbits(bits).sum()) == len({(p % (1 << 64)) >> (64 - collocations.BITS) for p in prints})
