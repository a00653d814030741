import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F

from folio.llm import merkle
from folio.llm.common import id_bucket
from tests.llm.rows import HARD


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain(rows):
    """Every row's result by lists and hashlib: rows are (doc_id, source, lang, n_chars, text)."""

    def leaf(row, text):
        values = [row[0], row[1], row[2], row[3], text]
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def lower(t):
        return t if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    def climb(nodes):
        """The last node, and for each of nodes its siblings and a function that folds a replacement."""
        paths = [[] for _ in nodes]
        at = [[k] for k in range(len(nodes))]
        while len(nodes) > 1:
            runs = [list(range(k, min(k + 8, len(nodes)))) for k in range(0, len(nodes), 8)]
            for run in runs:
                for k in run:
                    for leaf_no in at[k]:
                        paths[leaf_no].append(([nodes[j] for j in run if j < k], [nodes[j] for j in run if j > k]))
            at = [[x for k in run for x in at[k]] for run in runs]
            nodes = [h(*(nodes[k] for k in run)) for run in runs]
        return nodes[0], paths

    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    keys = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs, inner = [], {}
    for g in keys:
        members = sorted(((r, leaf(r, r[4])) for r in groups[g]), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        sub, paths = climb([x for _, x in members])
        inner[g] = (members, paths)
        subs.append(sub)
    root, tops = climb(subs)
    out = []
    for g, sub, top in zip(keys, subs, tops, strict=True):
        for (row, own), path in zip(*inner[g], strict=True):
            tampered = zlib.crc32(("" if row[0] is None else str(row[0])).encode()) % 3 == 0
            now = leaf(row, lower(row[4])) if tampered else own
            siblings = ""
            for left, right in path + top:
                siblings += "".join(left + right)
                now = h(*left, now, *right)
            out.append((row[0], own, sub, root, h(siblings), now, now == root))
    return out


def frame(spark, rows):
    more = [(*r, "x", 7) for r in rows]
    return spark.createDataFrame(more, "doc_id long, source string, lang string, n_chars long, text string, digest string, grp int")


def run(spark, rows):
    made, subroots, root = merkle.manifest(merkle.document_leaves(frame(spark, rows), id_bucket("doc_id", 3) == 0))
    return [tuple(r) for r in made.collect()], subroots, root


def key(row):
    return tuple(str(x) for x in row)


def test_compression_is_sha256():
    texts = [hashlib.sha256(bytes([k])).hexdigest() for k in range(20)]
    for n in (1, 2, 7, 8):
        made, states = merkle.parents([texts[k : k + n] for k in range(0, 20 - n)])
        assert made == [h(*texts[k : k + n]) for k in range(0, 20 - n)]
        assert all(len(s) == n and s[0] == merkle.START.astype(">u4").tobytes() for s in states)
    assert np.array_equal(merkle.START[:2], np.array([0x6A09E667, 0xBB67AE85], np.uint32))


def test_fold_takes_only_the_state_and_what_is_right_of_it():
    kids = [h(str(k)) for k in range(8)]
    (made,), (states,) = merkle.parents([kids])
    other = h("other")
    for slot in range(8):
        assert merkle.fold([kids[slot]], [[(states[slot], "".join(kids[slot + 1 :]), 8)]]) == [made]
        assert merkle.fold([other], [[(states[slot], "".join(kids[slot + 1 :]), 8)]]) == [h(*kids[:slot], other, *kids[slot + 1 :])]
    assert merkle.fold([kids[3]], [[]]) == [kids[3]]


def test_like_plain_lists(spark):
    rows = [(k * 3 % 101, "src", ["en", "fr", None, "", "Ü"][k % 5 if k < 60 else 0], k, f"Text {k} A") for k in range(150)]
    rows += [(None, None, "en", None, None), (None, "s", None, 1, "B"), (5, "s", "lone", 1, "Only ONE"), (5, "s", "en", 1, "Only ONE"), (5, "s", "en", 1, "Only ONE")]
    rows += [(1000 + k, "s", "hard", len(t or ""), t) for k, t in enumerate(HARD)]
    got, subroots, root = run(spark, rows)
    assert sorted(got, key=key) == sorted(plain(rows), key=key)
    assert {r[3] for r in got} == {root} and subroots.count() == 7
    assert 0 < sum(not r[6] for r in got) < len(got)


def test_many_groups_and_one_row_and_none(spark):
    rows = [(k, "s", f"l{k % 90}", k, "Abc") for k in range(200)]
    assert sorted(run(spark, rows)[0], key=key) == sorted(plain(rows), key=key)
    one = [(3, "s", "en", 3, "A")]
    assert run(spark, one)[0] == plain(one)
    got, subroots, root = run(spark, [])
    assert got == [] and root is None and subroots.count() == 0


def test_order_of_rows_and_partitions_do_not_matter(spark):
    rows = [(k, "s", "en", k, f"Word {k}") for k in range(70)]
    made = merkle.manifest(merkle.document_leaves(frame(spark, rows[::-1]).repartition(7, F.rand(3)), id_bucket("doc_id", 3) == 0))[0]
    assert sorted(map(tuple, made.collect()), key=key) == sorted(plain(rows), key=key)


def test_query_like_plain_lists(spark, tmp_path):
    rows = [(k, "src", ["en", "de", None][k % 3], k, f"Text {k} A") for k in range(120)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op11_merkle(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(rows), key=key)
