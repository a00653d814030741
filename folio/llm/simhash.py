"""SimHash near-duplicates found with a Gray-order hierarchical index.

Two fingerprints of 64 bits at 2 or fewer differences agree on at least one of three blocks, so each distinct
fingerprint goes to the three groups named by the leading bits of its blocks; the number of these bits follows the
number of fingerprints, so that a group holds some thousands. Within a group, fingerprints are sorted by Gray
rank and stand in a tree whose nodes hold the bits that all fingerprints below share; pairs of nodes are walked
from the top, differences accumulate over the newly shared bits, and pairs beyond the bound are left with all that
is below them, as are pairs whose fingerprints already hang together. A group gives a spanning forest of its links,
never all pairs, and the forests' union gives the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import cut, read, whole, without
from folio.llm.components import components

SEED = 42
SHINGLE = 3
DISTANCE = 2
#: Children of a node of the index.
FAN = 4
#: Blocks (lowest bit, bits): two fingerprints at DISTANCE agree on one of them at least.
BLOCKS = ((43, 21), (22, 21), (0, 22))
#: Fingerprints that a group holds on average, and how many times as many make it crowded.
GROUP, CROWDED = 4096, 4
#: Bytes of a text that are split into words at once.
BLOCK = 1 << 20
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def word_blocks(data: bytes, block: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of data, in lists of a bounded size."""
    at = 0
    while at < len(data):
        end = at + block
        while end < len(data) and data[end] not in SPACE:
            end += 1
        yield data[at:end].split()
        at = end


def fingerprint(data: bytes) -> int:
    """The 64-bit SimHash of UTF-8 text; 0 if it has no words."""
    ones, n, held = np.zeros(64, np.int64), 0, []
    for words in word_blocks(data.lower()):  # bytes.lower() changes A-Z alone, bytes.split() cuts at SPACE
        words = held + words
        if len(words) >= SHINGLE:
            hashes = np.fromiter((xxhash.xxh64_intdigest(b"%b %b %b" % x, SEED) for x in zip(words, words[1:], words[2:], strict=False)), np.uint64, len(words) - SHINGLE + 1)
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            n += len(hashes)
            held = words[1 - SHINGLE :]
        else:
            held = words
    if not n and held:
        return xxhash.xxh64_intdigest(b" ".join(held), SEED)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(x.as_buffer().to_pybytes()) for x in batch.column("text")), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the bits as a long). Null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long"), whole("text").cast("binary").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def forest(fps: np.ndarray, distance: int = DISTANCE, fan: int = FAN, chunk: int = 1 << 16, seen: list | None = None) -> np.ndarray:
    """For each of the distinct fps, the index of one member of its component under links of distance or less.

    seen takes (level, pairs of nodes looked at, pairs left within the distance) for each step of the walk.
    """
    order = np.argsort(gray_rank(fps), kind="stable")
    every = np.ascontiguousarray(fps[order])
    tree = [(every, every)]  # for each level, from the leaves: what all below have as 1, what any has
    while len(tree[-1][0]) > 1:
        starts = np.arange(0, len(tree[-1][0]), fan)
        tree.append((np.bitwise_and.reduceat(tree[-1][0], starts), np.bitwise_or.reduceat(tree[-1][1], starts)))
    root = np.arange(len(every))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def flat_roots() -> np.ndarray:
        nonlocal root
        while (root[root] != root).any():
            root = root[root]
        return root

    zero = np.zeros(1, np.int64)
    stack = [(len(tree) - 1, zero, zero, np.zeros(1, np.uint8), np.zeros(1, np.uint64))]
    while stack:
        level, a, b, differ, counted = stack.pop()
        if len(a) > chunk:
            stack += [(level, a[i : i + chunk], b[i : i + chunk], differ[i : i + chunk], counted[i : i + chunk]) for i in range(0, len(a), chunk)]
            continue
        ones, some = tree[level]
        shared = ~(ones[a] ^ some[a]) & ~(ones[b] ^ some[b])
        differ = differ + np.bitwise_count((ones[a] ^ ones[b]) & shared & ~counted)
        near = differ <= distance
        if seen is not None:
            seen.append((level, len(a), int(near.sum())))
        a, b, differ, shared = a[near], b[near], differ[near], shared[near]
        if level == 1 and len(a):  # nodes whose leaves all hang together need no second look
            tops = flat_roots()
            starts = np.arange(0, len(every), fan)
            low, high = np.minimum.reduceat(tops, starts), np.maximum.reduceat(tops, starts)
            apart = (low[a] != high[b]) | (low[b] != high[a])
            a, b, differ, shared = a[apart], b[apart], differ[apart], shared[apart]
        if level == 0:
            for x, y in zip(a.tolist(), b.tolist(), strict=True) if len(a) else ():
                x, y = top(x), top(y)
                if x != y:
                    root[max(x, y)] = min(x, y)
            continue
        below = len(tree[level - 1][0])
        i, j = np.divmod(np.arange(fan * fan), fan)
        x, y = (a[:, None] * fan + i).ravel(), (b[:, None] * fan + j).ravel()
        keep = (x <= y) & (x < below) & (y < below) if level > 1 else (x < y) & (x < below) & (y < below)
        if level == 1:  # nor do such leaves
            flat = flat_roots()
            keep &= flat[np.minimum(x, below - 1)] != flat[np.minimum(y, below - 1)]
        stack.append((level - 1, x[keep], y[keep], np.repeat(differ, fan * fan)[keep], np.repeat(shared, fan * fan)[keep]))
    out = np.empty(len(every), np.int64)
    out[order] = order[[top(k) for k in range(len(every))]]
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for group in batch.column("fps"):
            fps = group.values.to_numpy()
            to = fps[forest(fps.view(np.uint64))]
            a.append(fps[to != fps])
            b.append(to[to != fps])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def _dealt(fp: str, low: int, width: int, bits: str) -> str:
    """The `bits` leading bits of the `width` bits of fp from bit `low` on."""
    return f"shiftrightunsigned({fp} & {_signed(((1 << width) - 1) << low)}L, {low} + {width} - {bits})"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(nodes: DataFrame, group: int = GROUP) -> DataFrame:
    """Links (a, b) between distinct fingerprints fp that connect all at 2 or fewer differing bits.

    The fingerprints are counted, and dealt by so many bits that a group holds about `group` of them. Crowded groups,
    of more than CROWDED times that, are dealt again by the whole block and one of three blocks of the rest.
    """
    bits = max(1, min(BLOCKS[-1][1], (nodes.count() // group).bit_length()))
    parts = ", ".join(f"struct({k} as block, {_dealt('fp', low, width, str(min(bits, width)))} as bits)" for k, (low, width) in enumerate(BLOCKS))
    dealt = nodes.select("fp", F.expr(f"explode(array({parts})) as at")).select("fp", "at.block", "at.bits")
    sizes = cut(dealt.groupBy("block", "bits").count().where("count > 1"))
    shared = dealt.join(sizes.hint("merge"), ["block", "bits"])
    none = F.lit(None).cast("int")
    some = shared.where(F.col("count") <= CROWDED * group).select("block", "bits", none.alias("inner"), F.lit(0).cast("long").alias("more"), "fp")
    again = []
    for k, (low, width) in enumerate(BLOCKS):  # what is outside the block lies in two runs of bits; three blocks of them
        rest = [b for b in range(64) if not low <= b < low + width]
        inner = [rest[i * len(rest) // 3 : (i + 1) * len(rest) // 3] for i in range(3)]
        masks = ", ".join(f"struct({i} as inner, fp & {_signed(sum(1 << b for b in x))}L as more)" for i, x in enumerate(inner))
        again.append(f"when {k} then array({masks})")
    full = "case block " + " ".join(f"when {k} then fp & {_signed(((1 << width) - 1) << low)}L" for k, (low, width) in enumerate(BLOCKS)) + " end"
    many = shared.where(F.col("count") > CROWDED * group).select("block", F.expr(full).alias("bits"), "fp", F.expr(f"explode(case block {' '.join(again)} end) as at"))
    groups = some.union(many.select("block", "bits", "at.inner", "at.more", "fp")).groupBy("block", "bits", "inner", "more").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return groups.select("fps").mapInArrow(_links, "a long, b long")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, members of each row of docs.

    component_id is the smallest doc_id among all documents that links of 2 or fewer differing bits reach. Empty
    and null texts have the fingerprint zero and are linked like any other; repeated rows are in one component; a
    null doc_id is never a component_id unless its component has no other. An empty table gives no rows. Other
    columns of docs are not read.
    """
    prints = cut(fingerprints(docs))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows"))
    found = components(near_links(nodes.select("fp"))).select(F.col("node").alias("fp"), "root")
    rooted = cut(nodes.join(found.hint("merge"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "rep", "rows"))
    named = rooted.groupBy("root").agg(F.min("rep").alias("component_id"), F.sum("rows").alias("members"))
    labels = rooted.select("fp", "root").join(named.hint("merge"), "root").select("fp", "component_id", "members")
    return prints.join(labels.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "members")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs but for those in a group with a smaller doc_id: one document of each group stays.

    doc_id must be the key of docs; of repeated rows with one id, all stay or go, and rows without an id stay.
    """
    groups = simhash_groups(docs)
    go = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return without(docs, go)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read(spark, sf_dir, "documents"))
