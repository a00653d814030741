"""A Merkle manifest of a table whose nodes keep SHA-256 states, so that one changed row is folded to the root from them.

Rows are leaves. In each group, in order, every `FAN` neighbours have a parent, the digest of their digests as hex text,
until one node is left: the group's subroot. The subroots, in the order of their groups, make one more such tree, whose
last node is the root. A digest as hex text is one block of SHA-256, so the state before a child slot is the state after
the children to its left: a parent keeps a copy of each. To fold a leaf, the state before its slot takes the
replacement and the siblings to the right only; what lies to the left is never hashed again.

A level is one shuffle of the level below by (group, run), which holds FAN rows at most, and levels shrink by FAN. Paths
go down the same tables by joins of one row with one row. A group of any size is dealt out by ranges, and its rows are
numbered from the totals of ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import id_bucket, read, written

FAN = 8
#: Fixed values of SHA-256: the first 32 bits of the fractions of the square and cube roots of the first primes, from the rule.
_PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, int(p**0.5) + 1))]


def _root_bits(p: int, power: int) -> int:
    """The first 32 bits after the point of p ** (1 / power), by whole numbers alone."""
    low, high = 0, p << 40
    while low < high:
        mid = (low + high + 1) >> 1
        low, high = (mid, high) if mid**power <= p << 32 * power else (low, mid - 1)
    return low & 0xFFFFFFFF


ROUNDS = np.array([_root_bits(p, 3) for p in _PRIMES[:64]], np.uint32)
START = np.array([_root_bits(p, 2) for p in _PRIMES[:8]], np.uint32)
_HEX = np.array([[ord(c) for c in f"{b:02x}"] for b in range(256)], np.uint8)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return x >> np.uint32(n) | x << np.uint32(32 - n)


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states (n, 8) after one more block (n, 16) each: SHA-256's compression (FIPS 180-4), for many rows at once."""
    w = list(block.T)
    a, b, c, d, e, f, g, h = state.T
    for t in range(64):
        if t >= 16:
            x, y = w[t - 15], w[t - 2]
            w.append(w[t - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ x >> np.uint32(3)) + w[t - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ y >> np.uint32(10)))
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (e & f ^ ~e & g) + ROUNDS[t] + w[t]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + (a & b ^ a & c ^ b & c)
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h], 1)


def _blocks(hexes: bytes) -> np.ndarray:
    """Digests as hex text, one after the other, as blocks (n, 16)."""
    return np.frombuffer(hexes, ">u4").astype(np.uint32).reshape(-1, 16)


def _as_text(state: np.ndarray) -> np.ndarray:
    """States (n, 8) as the blocks (n, 16) of their hex text."""
    digits = _HEX[np.ascontiguousarray(state.astype(">u4")).view(np.uint8)]
    return digits.reshape(len(state), 64).view(">u4").astype(np.uint32)


def _texts(blocks: np.ndarray) -> list[str]:
    data = blocks.astype(">u4").tobytes().decode("ascii")
    return [data[k : k + 64] for k in range(0, len(data), 64)]


def _ends(count: np.ndarray) -> np.ndarray:
    """The last block of a message of `count` whole blocks: its end mark and its length in bits."""
    out = np.zeros((len(count), 16), np.uint32)
    out[:, 0], out[:, 15] = 0x80000000, count * 512
    return out


def parents(kids: list[list[str]]) -> tuple[list[str], list[list[bytes]]]:
    """For each list of digests, the digest of them all and the state before each of them."""
    sizes = np.array([len(k) for k in kids])
    blocks, first = _blocks("".join("".join(k) for k in kids).encode("ascii")), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int)
    state, kept = np.tile(START, (len(kids), 1)), [[] for _ in kids]
    for slot in range(int(sizes.max(initial=0))):
        at = np.flatnonzero(sizes > slot)
        raw = state[at].astype(">u4").tobytes()
        for k, row in enumerate(at.tolist()):
            kept[row].append(raw[32 * k : 32 * k + 32])
        state[at] = compress(state[at], blocks[first[at] + slot])
    return _texts(_as_text(compress(state, _ends(sizes)))), kept


def fold(leaves: list[str], steps: list[list[tuple[bytes, str, int]]]) -> list[str]:
    """The root above each leaf: a step resumes a kept state with the digest so far and the siblings to its right.

    A step is (state before the slot, the right siblings' digests, how many children the parent has).
    """
    now = _blocks("".join(leaves).encode("ascii")).copy()
    depth = np.array([len(s) for s in steps])
    for t in range(int(depth.max(initial=0))):
        at = np.flatnonzero(depth > t)
        here = [steps[k][t] for k in at.tolist()]
        state = np.frombuffer(b"".join(s for s, _, _ in here), ">u4").astype(np.uint32).reshape(-1, 8)
        state = compress(state, now[at])
        right = np.array([len(r) // 64 for _, r, _ in here])
        blocks, first = _blocks("".join(r for _, r, _ in here).encode("ascii")), np.concatenate([[0], np.cumsum(right)[:-1]]).astype(int)
        for slot in range(int(right.max(initial=0))):
            to = np.flatnonzero(right > slot)
            state[to] = compress(state[to], blocks[first[to] + slot])
        now[at] = _as_text(compress(state, _ends(np.array([n for _, _, n in here]))))
    return _texts(now)


def digest(*values: Column) -> Column:
    """The SHA-256, as hex text, of values in a row: `-` if null, else byte count, `:`, value."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with i, the place from 0 within grp, and n, the size of grp. Equal rows get neighbouring places.

    Rows are range-partitioned by (grp, order); only totals by (range, group) are summed over ranges.
    """
    spark = rows.sparkSession
    near = Window.partitionBy("part", "grp").orderBy(*order)
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "grp", *order)
    # Written: ranges come from a sample, so both uses must see the same ones.
    local = written(dealt.withColumn("part", F.spark_partition_id()).withColumn("i", F.row_number().over(near).cast("long") - 1))
    totals = local.groupBy("part", "grp").agg(F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("part", "grp", before.alias("before"), F.sum("rows").over(Window.partitionBy("grp")).alias("n"))
    return local.join(offsets.hint("merge"), ["part", "grp"]).withColumn("i", F.col("i") + F.col("before")).drop("part", "before")


def _level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made, states = parents([[k["digest"] for k in kids] for kids in batch.column("kids").to_pylist()])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made), pa.array(states, pa.list_(pa.binary()))], [*batch.schema.names, "digest", "states"])


def tree(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(levels, tops) over nodes (grp, i, n, digest and any more): each level's parents, and each group's last node.

    A level has grp, i, n, kids (struct of i, digest and more columns of the level below, in order), digest, states. A group of one
    node is its own top. grp is a text and not null.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, tops, below = [], nodes.where("n = 1").select("grp", "digest"), nodes
    while most > 1:
        kid = F.struct("i", "digest", *(c for c in below.columns if c not in ("grp", "i", "n", "digest", "kids", "states")))
        runs = below.where("n > 1").groupBy("grp", F.expr(f"i div {FAN}").alias("i")).agg(F.expr(f"(max(n) + {FAN - 1}) div {FAN}").alias("n"), F.array_sort(F.collect_list(kid)).alias("kids"))
        schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema), "digest string", "states array<binary>"])
        below = written(runs.mapInArrow(_level, schema))
        levels.append(below)
        tops = tops.unionByName(below.where("n = 1").select("grp", "digest"))
        most = -(-most // FAN)
    return levels, tops


#: A step of a path: the siblings to the left and right, the state before the slot, and the parent's number of children.
STEP = "struct<left string, right string, state binary, kids int>"


def _steps_down(levels: list[DataFrame], above: DataFrame) -> list[DataFrame]:
    """For each level, its nodes (grp, i) with path, the steps up from there, and what else `above` says of each group.

    above: grp, path (of the group's last node) and more columns.
    """
    more = [c for c in above.columns if c not in ("grp", "path")]
    out: list[DataFrame] = []
    down = None
    for level in reversed(levels):
        own = level.where("n = 1").select("grp", "i").join(above.hint("merge"), "grp").select("grp", "i", "path", *more)
        paths = written(own if down is None else own.unionByName(down))
        out.insert(0, paths)
        runs = level.select("grp", "i", F.expr("transform(kids, k -> k.digest)").alias("d"), "states").join(paths.hint("merge"), ["grp", "i"])
        each = runs.select("grp", "path", *more, F.col("i").alias("up"), "d", "states", F.posexplode("d").alias("slot", "own"))
        step = F.expr("struct(array_join(slice(d, 1, slot), '') as left, array_join(slice(d, slot + 2, size(d)), '') as right, states[slot] as state, size(d) as kids)")
        down = each.select("grp", (F.col("up") * FAN + F.col("slot")).alias("i"), F.concat(F.array(step), "path").alias("path"), *more)
    return out


def _checked(root: str):
    """Rows of a run: each leaf with the digest of its siblings up to the root and the root that it folds to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, leaves, subs, proofs, used, steps = [], [], [], [], [], []
            for row in batch.to_pylist():
                own, states = [k["digest"] for k in row["kids"]], row["states"]
                above = "".join(s["left"] + s["right"] for s in row["path"]).encode("ascii")
                rest = [(s["state"], s["right"], s["kids"]) for s in row["path"]]
                for slot, kid in enumerate(row["kids"]):
                    ids.append(kid["doc_id"])
                    leaves.append(kid["digest"])
                    subs.append(row["subroot"])
                    others = "".join(own[:slot] + own[slot + 1 :]).encode("ascii")
                    proofs.append(hashlib.sha256(others + above).hexdigest())
                    used.append(kid["other"] or kid["digest"])
                    # A lone leaf is its group's last node and has no run.
                    steps.append(([(states[slot], "".join(own[slot + 1 :]), len(own))] if states else []) + rest)
            folded = fold(used, steps) if used else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *(pa.array(x, pa.string()) for x in (leaves, subs, [root] * len(ids), proofs, folded)), pa.array([f == root for f in folded], pa.bool_())],
                ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )

    return run


CHECKED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(leaves: DataFrame) -> tuple[DataFrame, DataFrame, str | None]:
    """(checked rows, subroots, root) of leaves (grp, doc_id, digest, other): other is a replacement of the leaf, or null.

    Checked rows are CHECKED; subroots are grp, digest. Leaves of a group stand in the order of doc_id (nulls first), those of one id
    in that of their digests and replacements. An empty table has no rows and no root.
    """
    placed = written(ranked(leaves.select("grp", F.col("doc_id").cast("long"), "digest", "other"), ["doc_id", "digest", "other"]))
    levels, tops = tree(placed)
    subroots = written(tops)
    order = written(ranked(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("of"), "digest"), ["of"]))
    top_levels, top = tree(order)
    root = top.first()
    if root is None:
        return leaves.sparkSession.createDataFrame([], CHECKED), subroots, None
    none = F.expr(f"cast(array() as array<{STEP}>)")
    if top_levels:
        lowest = _steps_down(top_levels, top.select("grp", none.alias("path")))[0]
        runs = top_levels[0].join(lowest.hint("merge"), ["grp", "i"]).select("path", "states", F.expr("transform(kids, k -> k.digest)").alias("d"), F.posexplode("kids").alias("slot", "kid"))
        step = F.expr("struct(array_join(slice(d, 1, slot), '') as left, array_join(slice(d, slot + 2, size(d)), '') as right, states[slot] as state, size(d) as kids)")
        above = written(runs.select(F.col("kid.of").alias("grp"), F.concat(F.array(step), "path").alias("path"), F.col("kid.digest").alias("subroot")))
    else:
        above = order.select(F.col("of").alias("grp"), none.alias("path"), F.col("digest").alias("subroot"))
    kid = "struct<i bigint, digest string, doc_id bigint, other string>"
    lone = placed.where("n = 1").select("grp", F.expr(f"cast(array(struct(i, digest, doc_id, other)) as array<{kid}>)").alias("kids"), F.expr("cast(null as array<binary>)").alias("states")).join(above.hint("merge"), "grp")
    runs = lone.select("kids", "states", "path", "subroot")
    if levels:
        paths = _steps_down(levels, above)[0]
        runs = levels[0].join(paths.hint("merge"), ["grp", "i"]).select(F.expr(f"cast(kids as array<{kid}>)").alias("kids"), "states", "path", "subroot").unionByName(runs)
    return runs.mapInArrow(_checked(root.digest), CHECKED), subroots, root.digest


def document_leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """grp, doc_id, digest, other of documents: by lang (null first), and with A-Z of the text lower-cased where `tampered` holds."""
    upper = "".join(map(chr, range(65, 91)))
    with_text = lambda text: digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    changed = F.when(tampered & F.col("text").isNotNull(), with_text(F.translate("text", upper, upper.lower())))
    group = F.when(F.col("lang").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("lang").cast("string")))
    return docs.select(group.alias("grp"), "doc_id", with_text(F.col("text")).alias("digest"), changed.alias("other"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its leaf, its proof and the root it folds to.

    Nulls are `-` in a leaf, so they differ from empty texts; a null id is like the empty text in crc32 and comes first in its
    language. Rows of one id stand in the order of their leaves, equal rows next to each other. A text of any length
    is hashed as a whole where it is read. An empty table gives no rows. Other columns are not read.
    """
    docs = read(spark, sf_dir, "documents")
    return manifest(document_leaves(docs, id_bucket("doc_id", 3) == 0))[0]
