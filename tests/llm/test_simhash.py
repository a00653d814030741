import random

import numpy as np
import xxhash

from folio.llm import simhash
from tests.llm.rows import HARD, docs


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    """The smallest reachable id for each id, by looking at all pairs."""
    ids, label = sorted(prints), {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if label[j] < label[i] and (prints[i] ^ prints[j]).bit_count() <= 2:
                    label[i], changed = label[j], True
    return label


def test_fingerprints_and_groups_like_all_pairs(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randint(0, 9)) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    near = [t + " tail" for t in base[:15]] + [t.replace("1", "2", 1) for t in base] + base[:5]
    texts = HARD + base + near
    prints = {i: plain_fingerprint(t) for i, t in enumerate(texts, 1)}
    want = plain_groups(prints)
    got = {r.doc_id: r for r in simhash.simhash_groups(docs(spark, texts)).collect()}
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
    kept = {r.doc_id for r in simhash.keep_one(docs(spark, texts)).collect()}
    assert kept == {i for i in want if want[i] == i}


def test_forest_finds_every_component():
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([seeds, *[s ^ (np.uint64(1) << rng.integers(0, 64, 12).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 12).astype(np.uint64)) for s in seeds]]))
    want = plain_groups(dict(enumerate(map(int, fps))))
    for fan in (2, 16):
        got = simhash.forest(fps, fan=fan, chunk=64)
        first = {}
        for i, r in enumerate(got):
            first.setdefault(r, i)
        assert {i: first[r] for i, r in enumerate(got)} == want


def test_large_groups_are_dealt_again(spark):
    rng = random.Random(5)
    fps = {0x1234567800000000 | rng.getrandbits(16) << rng.choice([0, 8, 16]) for _ in range(300)}
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = simhash.near_links(nodes, group=8)
    from folio.llm.components import components

    want = plain_groups({f: f for f in fps})
    got = {r.node: r.root for r in components(links).collect()}
    assert {f: got.get(f, f) for f in fps} == want


def test_words_over_blocks():
    data = ("ab cd  efg\n" * 50).encode()
    assert [w for ws in simhash.word_blocks(data, 7) for w in ws] == data.split()
    assert simhash.fingerprint(data) == plain_fingerprint(data.decode())


def test_empty_table_and_null_ids(spark):
    assert simhash.simhash_groups(docs(spark, [])).count() == 0
    frame = docs(spark, ["a", "a"]).selectExpr("if(doc_id = 1, null, doc_id) doc_id", "text")
    assert {(r.doc_id, r.component_id) for r in simhash.simhash_groups(frame).collect()} == {(None, 2), (2, 2)}
    assert simhash.keep_one(frame).count() == 2


def test_the_tree_prunes():
    rng = np.random.default_rng(9)
    fps = np.unique(np.concatenate([x := rng.integers(0, 2**50, 3000, dtype=np.uint64), x[:300] ^ np.uint64(3 << 20), x[0] ^ (np.uint64(1) << rng.integers(0, 50, 900).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 50, 900).astype(np.uint64))]))
    seen = []
    got = simhash.forest(fps, seen=seen)
    near = np.bitwise_count(fps[:, None] ^ fps) <= 2
    label = np.arange(len(fps))
    while (new := np.where(near, label, len(fps)).min(1)).tolist() != label.tolist():
        label = new
    first = {}
    for i, r in enumerate(got.tolist()):
        first.setdefault(r, i)
    assert [first[r] for r in got.tolist()] == label.tolist()
    looked = {level: sum(n for at, n, _ in seen if at == level) for level in (0, 1, 2)}
    left = {level: sum(n for at, _, n in seen if at == level) for level in (1, 2)}
    assert left[1] < looked[1] / 2 and looked[0] < len(fps) ** 2 / 6, (looked, left)


def test_groups_of_thousands(spark):
    """Groups of thousands through the whole search, with a crowd that shares a block, against all pairs."""
    rng = np.random.default_rng(11)
    x = rng.integers(0, 2**63, 6000, dtype=np.uint64)
    crowd = np.uint64(0x7FFFF << 43) | rng.integers(0, 2**20, 500, dtype=np.uint64)
    fps = np.unique(np.concatenate([x, x[:900] ^ (np.uint64(1) << rng.integers(0, 63, 900).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 900).astype(np.uint64)), crowd]))
    near = np.bitwise_count(fps[:, None] ^ fps) <= 2
    label = np.arange(len(fps))
    while (new := np.where(near, label, len(fps)).min(1)).tolist() != label.tolist():
        label = new
    from folio.llm.components import components

    frame = spark.createDataFrame([(v,) for v in fps.view(np.int64).tolist()], "fp long")
    for group in (4096, 64):
        found = {r.node: r.root for r in components(simhash.near_links(frame, group)).collect()}
        first, want = {}, label.tolist()
        for k, v in enumerate(fps.view(np.int64).tolist()):
            first.setdefault(found.get(v, v), k)
        assert [first[found.get(v, v)] for v in fps.view(np.int64).tolist()] == want
