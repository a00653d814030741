"""Near copies: texts whose distinct five-word shingles have a Jaccard similarity of 0.8 or more.

Distinct shingle sets are nodes. Candidates are the pairs that SimHash brings together: each node has a fingerprint of its shingles, and
the Gray-order index of simhash.py links those at 2 or fewer differing bits. Pairs at 0.8 differ in more bits than that, so MinHash bands
bring together the rest: a pair at 0.8 shares none of the BANDS keys
with a probability of about (1 - 0.8 ** ROWS) ** BANDS, 1.2e-7. Every candidate pair is then verified on its exact sets. In
a bucket of more than PAIRED nodes, each is first compared with one of up to HUBS of them, and these with each other. Where that leaves several
components in a bucket, the nodes of such buckets that hang together form a group, each set once, and what is outside
its largest component is compared with all through inverted indexes, block by block. No rows are made for pairs there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import cut, held, whole, without
from folio.llm.components import components
from folio.llm.simhash import SEED, near_links as near_prints, word_blocks

SHINGLE = 5
#: The similarity, as a fraction of whole numbers.
SIMILAR, OF = 4, 5
BANDS, ROWS = 40, 5
PAIRED, HUBS = 32, 8
#: Hashes of either side that a task searches at once (32 MB).
TOGETHER = 1 << 22
#: Rows whose sets a task holds at once.
PART = 512
#: Shingles whose MinHash values are computed at once.
BLOCK = 2048
_RANDOM = np.random.default_rng(SEED)
_XOR = _RANDOM.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)
_TIMES = _RANDOM.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)


def shingles(data: bytes) -> np.ndarray:
    """Sorted hashes of the distinct shingles; of a text with fewer words, one of all its words, or none."""
    found, held = [], []
    for words in word_blocks(data.lower()):
        words = held + words
        if len(words) >= SHINGLE:
            runs = zip(*(words[k:] for k in range(SHINGLE)), strict=False)
            found.append(np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in runs), np.uint64, len(words) - SHINGLE + 1)))
            held = words[1 - SHINGLE :]
        else:
            held = words
    if found:
        return np.unique(np.concatenate(found))
    return np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)] if held else [], np.uint64)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of hashes, each of ROWS minima and the band's number."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    short = (hashes ^ hashes >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(short), BLOCK):
        least = np.minimum(least, ((short[k : k + BLOCK] ^ _XOR) * _TIMES).min(1))
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = (key ^ row) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def simhash(hashes: np.ndarray) -> int:
    """The 64-bit SimHash of a set of hashes: a bit is 1 if set in over half of them."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[k : k + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def _node(hashes: np.ndarray) -> int:
    """The number of a set."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of PART rows, so that what is made of the rows stays small beside them."""
    for batch in batches:
        for at in range(0, batch.num_rows, PART):
            yield batch.slice(at, PART)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held("near copies")
    for batch in _parts(batches):
        nodes, sizes, fps, keys = [], [], [], [np.empty(0, np.uint64)]
        for x in batch.column("text"):
            found = shingles(x.as_buffer().to_pybytes())
            nodes.append(_node(found))
            sizes.append(len(found))
            fps.append(simhash(found))
            keys.append(band_keys(found))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate(keys).view(np.int64)))
        columns = [batch.column("doc_id"), batch.column("nameless"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), lists]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "nameless", "node", "size", "fp", "keys"])


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held("near copies")
    for batch in _parts(batches):
        nodes = pa.array([_node(shingles(x.as_buffer().to_pybytes())) for x in batch.column("text")], pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "nameless", "doc")), nodes], ["doc_id", "nameless", "doc", "node"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held("near copies")
    for batch in _parts(batches):
        found = [shingles(x.as_buffer().to_pybytes()) for x in batch.column("text")]
        right = [_node(x) == n for x, n in zip(found, batch.column("node").to_pylist(), strict=True)]
        out = pa.RecordBatch.from_arrays([batch.column("node"), pa.array([x.tobytes() for x in found], pa.binary())], ["node", "hashes"])
        yield out.filter(pa.array(right, pa.bool_()))


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held("near copies")
    for batch in _parts(batches):
        near = []
        for x, y in zip(batch.column("hashes_a"), batch.column("hashes_b"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            near.append(OF * both >= SIMILAR * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))


def _crossing(table: pa.Table) -> pa.Table:
    """Links from the nodes that ask to the others of other components (root), one to each component."""
    asks = table.column("asks").to_numpy()
    asking, others = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
    a, b = [], []
    if asking.num_rows and others.num_rows:
        nodes, roots = others.column("node").to_numpy(), others.column("root").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in others.column("hashes")]
        sizes = np.array([len(x) for x in sets])
        owner, every = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        posted, terms = owner[order], every[order]
        for node, root, held_set in zip(*(asking.column(c) for c in ("node", "root", "hashes")), strict=True):
            x = np.frombuffer(held_set.as_buffer(), np.uint64)
            low, high = np.searchsorted(terms, x), np.searchsorted(terms, x, side="right")
            both = np.zeros(len(sets), np.int64)
            for i, j in zip(low.tolist(), high.tolist(), strict=True):
                both[posted[i:j]] += 1  # a set has a hash once
            near = np.flatnonzero((OF * both >= SIMILAR * (sizes + len(x) - both)) & (roots != root.as_py()))
            for j in near[np.unique(roots[near], return_index=True)[1]]:
                a.append(node.as_py())
                b.append(int(nodes[j]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _in_blocks(inside: DataFrame, sets: DataFrame, together: int) -> DataFrame:
    """Links between the components (root) of each group. inside: node, root, size, group; sets: node, hashes.

    What is outside a group's largest component asks all of the group. Both sides are dealt into blocks of some
    `together` hashes, and a task has one block of each, so no task holds a whole group.
    """
    roots = inside.groupBy("group", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    groups = roots.groupBy("group").agg(F.max(F.struct("n", "root", "size")).alias("most"), F.sum("size").alias("size"))
    blocks = lambda size: F.ceil(size / F.lit(together)).cast("int")
    groups = cut(groups.select("group", F.col("most.root").alias("most"), blocks(F.col("size") - F.col("most.size")).alias("rows"), blocks(F.col("size")).alias("columns")))
    dealt = inside.join(groups.hint("merge"), "group").join(sets.hint("merge"), "node")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ("group", "node", "root", "hashes")
    others = dealt.select(*columns, F.lit(False).alias("asks"), place("columns").alias("column"), every("rows").alias("row"))
    asking = dealt.where("root <> most").select(*columns, F.lit(True).alias("asks"), place("rows").alias("row"), every("columns").alias("column"))
    return others.unionByName(asking).groupBy("group", "row", "column").applyInArrow(_crossing, "a long, b long")


def _sets_of(wanted: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """node, hashes of the distinct nodes wanted."""
    needed = wanted.join(nodes.hint("merge"), "node").select("node", F.col("rep").alias("doc_id"))
    return texts.join(needed.hint("merge"), "doc_id").select("node", "text").mapInArrow(_sets, "node long, hashes binary").dropDuplicates(["node"])


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of nodes that are similar."""
    sets = cut(_sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, texts))
    one, other = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"hashes_{c}")) for c in "ab")
    return cut(pairs.join(one.hint("merge"), "a").join(other.hint("merge"), "b").select("a", "b", "hashes_a", "hashes_b").mapInArrow(_similar, "a long, b long"))


#: For two nodes x and y: only sets of about one size can be similar.
ALIKE = f"{OF} * least(x.size, y.size) >= {SIMILAR} * greatest(x.size, y.size)"


def _by_simhash(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (node, size, fp): each with the least of its fingerprint, and these as the index links their fingerprints."""
    leads = cut(nodes.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("lead"), F.count(F.lit(1)).alias("n")).select("fp", "lead.node", "lead.size", "n"))
    ordered = (F.expr("least(x.node, y.node)").alias("a"), F.expr("greatest(x.node, y.node)").alias("b"))
    same = nodes.alias("x").join(leads.where("n > 1").alias("y").hint("merge"), F.expr(f"x.fp = y.fp and x.node <> y.node and {ALIKE}")).select(*ordered)
    links = near_prints(leads.select("fp")).distinct()
    one = links.join(leads.hint("merge"), links.a == leads.fp).select("node", "size", "b")
    return same.union(one.alias("x").join(leads.alias("y").hint("merge"), F.expr(f"x.b = y.fp and {ALIKE}")).select(*ordered))


def near_links(prints: DataFrame, texts: DataFrame, paired: int = PAIRED, together: int = TOGETHER) -> DataFrame:
    """Links (a, b) between nodes that connect all similar ones. prints: doc_id, node, size, fp, keys; texts: doc_id, text."""
    nodes = prints.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    nodes = cut(nodes)
    printed = _by_simhash(nodes.where("size > 0").select("node", "size", "fp"))
    dealt = nodes.where("size > 0").select("node", "size", F.explode("keys").alias("key"))
    counts = cut(dealt.groupBy("key").count().where("count > 1"))
    shared = cut(dealt.join(counts.hint("merge"), "key"))
    nodes = nodes.select("node", "rep")

    def between(x: DataFrame, y: DataFrame, where: str) -> DataFrame:
        x, y = x.alias("x"), y.alias("y").hint("merge")
        return x.join(y, F.expr(f"x.key = y.key and {where} and {ALIKE}")).select(F.expr("least(x.node, y.node)").alias("a"), F.expr("greatest(x.node, y.node)").alias("b")).distinct()

    few, many = shared.where(F.col("count") <= paired), shared.where(F.col("count") > paired)
    pairs = printed.union(between(few, few, "x.node < y.node"))
    crowded = not many.isEmpty()
    if crowded:
        # A node meets one hub of each of its buckets, and the hubs of a bucket meet each other: rows by node, not by node and hub.
        slot = lambda *by: F.pmod(F.xxhash64(*by), F.lit(HUBS))
        hubs = cut(many.groupBy("key", slot("node").alias("slot")).agg(F.min(F.struct("node", "size")).alias("hub")).select("key", "slot", "hub.node", "hub.size"))
        met = many.withColumn("slot", slot("key", "node"))
        pairs = pairs.union(between(met, hubs, "x.slot = y.slot and x.node <> y.node")).union(between(hubs, hubs, "x.node < y.node"))
    pairs = cut(pairs.distinct())
    links = _verified(pairs, nodes, texts)
    if crowded:
        roots = components(links)
        rooted = cut(many.join(roots.hint("merge"), "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root")))
        mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
        left = cut(rooted.join(mixed.hint("merge"), "key").select("key", "node", "root", "size"))
        if not left.isEmpty():
            tied = left.join(left.groupBy("key").agg(F.min("node").alias("to")).hint("merge"), "key").select(F.col("node").alias("a"), F.col("to").alias("b"))
            group = components(tied).select("node", F.col("root").alias("group"))
            inside = cut(left.select("node", "root", "size").distinct().join(group.hint("merge"), "node"))
            links = links.union(cut(_in_blocks(inside, _sets_of(inside.select("node"), nodes, texts), together)))
    return links


def keep_one(docs: DataFrame, paired: int = PAIRED, together: int = TOGETHER) -> DataFrame:
    """The rows of docs but for those that near copies connect with a row of a smaller doc_id: one row of each group stays.

    Texts without words are copies of each other, and null text counts as empty. Rows without an id come after all others, and
    rows that share an id are told apart by their texts; where copies of a group's least id are rows too, any one of them stays.
    """
    text, own = whole("text").cast("binary"), F.col("doc_id").cast("long")
    # Rows without an id take a hash of their text as one; what has the same by chance is told apart by its node.
    named = (F.coalesce(own, F.xxhash64(text)).alias("doc_id"), own.isNull().alias("nameless"))
    texts = docs.select(*named, text.alias("text"))
    prints = cut(texts.mapInArrow(_sketches, "doc_id long, nameless boolean, node long, size long, fp long, keys array<long>"))
    found = components(near_links(prints, texts.select("doc_id", "text"), paired, together))
    rooted = cut(prints.select("doc_id", "nameless", "node").join(found.hint("merge"), "node", "left").select("doc_id", "nameless", F.coalesce("root", "node").alias("root")))
    stay = cut(rooted.groupBy("root").agg(F.min(F.struct("nameless", "doc_id")).alias("least")))
    shared = cut(rooted.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("nameless").alias("nameless")).where("n > 1 or nameless").select("doc_id"))
    go = rooted.join(stay.hint("merge"), "root").where("struct(nameless, doc_id) <> least").select("doc_id")
    kept = without(docs.where(own.isNotNull()), go.union(shared).distinct())
    if shared.isEmpty():
        return kept
    # Ids do not tell these rows apart, so they are decided one by one.
    rows = docs.select(*named, text.alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")).join(shared.hint("merge"), "doc_id", "left_semi")
    kind = T.StructType([rows.schema["doc_id"], rows.schema["nameless"], rows.schema["doc"], T.StructField("node", T.LongType())])
    nodes = rows.mapInArrow(_nodes, kind).join(found.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = nodes.join(stay.hint("merge"), "root").where("struct(nameless, doc_id) = least").groupBy("root").agg(F.first("doc").alias("doc"))
    return kept.union(first.select("doc.*"))
