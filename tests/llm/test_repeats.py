import hashlib
import random

import numpy as np
import pytest

from folio.llm import repeats
from tests.llm.rows import HARD


def plain(rows, least):
    """(doc_id, n_bytes, n_removed, n_spans, sha256, kept) by looking every string up."""
    rows = [(None if d is None else d, (t if isinstance(t, bytes) else (t or "").encode())) for d, t in rows]
    order = lambda d: repeats.NO_ID if d is None else d
    first = {}
    for d, t in rows:
        for i in range(len(t) - least + 1):
            s = t[i : i + least]
            first[s] = min(first.get(s, order(d)), order(d))
    out = []
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if first[t[i : i + least]] < order(d):
                gone[i : i + least] = b"\1" * least
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def frame(spark, rows):
    more = [(d, t, "x", 7, b"y", 1) for d, t in rows]
    return spark.createDataFrame(more, "doc_id long, text string, key string, rid int, part binary, lo int").repartition(3)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in df.collect()), key=str)


def made(seed, n, alphabet="ab", shared=6):
    """Short texts of few letters, with passages that many of them share, in and out of context."""
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    passages = [word(rng.randrange(5, 60)) for _ in range(shared)]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(passages) if rng.random() < 0.5 else word(rng.randrange(12)) for _ in range(rng.randrange(6)))
        rows.append((rng.choice([None, *range(n)]), text))
    return rows + [(n + 1, rows[0][1]), (n + 2, rows[0][1]), rows[1], rows[1]]


@pytest.mark.parametrize("hot, group", [(1 << 15, 1 << 14), (8, 4)])
def test_like_every_string_looked_up(spark, hot, group):
    """With small bounds, anchors go through their distinct surroundings and these by halves; the result stays."""
    for seed, alphabet, least, gram in ((1, "ab", 12, 4), (2, "abcdé\n", 10, 5), (3, "a", 9, 3)):
        rows = made(seed, 40, alphabet)
        assert got(repeats.remove_repeats(frame(spark, rows), least, gram, hot, group)) == plain(rows, least)


def test_hard_texts_with_the_bounds_of_the_query(spark):
    passage = "A passage of more than fifty bytes which stands in several texts, é漢 and all. "
    rows = [(k, t) for k, t in enumerate(HARD * 2)]
    rows += [(100, passage), (101, "Before " + passage + "after"), (99, "x" + passage[:52] + "y"), (None, passage), (None, passage), (102, passage * 3), (103, passage[:49])]
    assert got(repeats.remove_repeats(frame(spark, rows))) == plain(rows, 50)
    assert got(repeats.remove_repeats(frame(spark, []))) == []


def test_query_takes_the_whole_table(spark, tmp_path):
    rows = [(k, ("A line that all texts have in common, of more than fifty bytes. " if k % 3 else "") + f"And one of its own: {k * 7919}") for k in range(60)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = repeats.op13_repeats(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, out.collect())) == sorted(r[:5] for r in plain(rows, 50))


def test_anchors_are_the_same_in_every_occurrence():
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(80))).encode() for _ in range(60)]
    found, of, at = repeats.anchors(texts, 12, 5)
    where = {}
    for h, k, p in zip(found.tolist(), of.tolist(), at.tolist(), strict=True):
        where.setdefault(k, {})[p] = h
    seen = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - 11):
            marks = tuple((p - i, h) for p, h in sorted(where.get(k, {}).items()) if i <= p <= i + 7)
            assert marks, "each string has an anchor"
            low = min(h for _, h in marks)
            seen.setdefault(t[i : i + 12], set()).add(tuple(m for m in marks if m[1] == low))
    assert all(len(x) == 1 for x in seen.values())


def test_suffix_array_and_maximal_repeats_like_plain_search():
    rng = random.Random(3)
    for _ in range(60):
        parts = list({bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(4, 14))) for _ in range(rng.randrange(1, 9))})
        data = b"".join(parts)
        ends = np.repeat(np.cumsum([len(p) for p in parts]), [len(p) for p in parts])
        begins = np.arange(len(data))
        order, common = repeats.suffix_array(np.frombuffer(data, np.uint8), begins, ends - begins)
        suffixes = [data[b : ends[b]] for b in begins]
        assert [suffixes[k] for k in order] == sorted(suffixes)
        for a, b, c in zip(order, order[1:], common[1:], strict=False):
            x, y = suffixes[a], suffixes[b]
            assert c == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
        group, place, length = repeats.repeat_groups(parts, 3)
        mine = {}
        for g, p, n in zip(group.tolist(), place.tolist(), length.tolist(), strict=True):
            mine.setdefault(g, (n, set()))[1].add(p)
        want = {}
        for b in begins.tolist():
            for n in range(3, ends[b] - b + 1):
                want.setdefault(data[b : b + n], set()).add(b)
        expected = set()
        starts = set(np.cumsum([0] + [len(p) for p in parts]).tolist())
        for s, places in want.items():
            after = {data[p + len(s)] if p + len(s) < ends[p] else (-1, p) for p in places}
            before = {data[p - 1] for p in places}
            if len(places) > 1 and len(after) > 1 and (len(before) > 1 or places & starts):
                expected.add((len(s), frozenset(places)))
        assert {(n, frozenset(p)) for n, p in mine.values()} == expected
