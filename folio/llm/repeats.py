"""Repeated byte strings over a whole corpus: maximal repeat groups, and texts without what smaller documents have.

Every string of `least` bytes has the smallest hashed gram (GRAM bytes) among those in it, and all its occurrences have it at one and
the same place: an anchor. So occurrences meet by their anchor's hash, about one row for 17 bytes of text, and only
anchors that two documents have go on, with the bytes around them in which a string can lie.

Equal texts are settled before, by their hash: all but those of the smallest document go as a whole, and own nothing.

What meets is searched through its common-prefix interval tree: the suffixes are sorted, a stack scan over the
common prefixes of neighbours gives each interval once, and those whose occurrences have different bytes before them (or begin where
the bytes around an anchor do) are maximal repeats. Each is a group of all its occurrences, with its smallest document.
Suffixes whose hashed beginning stands alone, or whose group goes on to the left, are left out before the sort: they begin no
maximal repeat.

A task's groups are bounded: an anchor with more than HOT rows goes through its distinct surroundings, and one with more than
GROUP of those is dealt again by halves, each keyed by the bytes that all its strings share, down to the string itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import freed, read, without, written

LEAST, GRAM = 50, 16
#: Bytes of text that are hashed together, and surroundings that are searched together.
RUN, ROWS = 1 << 20, 1 << 13
#: Rows of an anchor that one task takes as they are, and distinct surroundings that it searches together.
HOT, GROUP = 1 << 15, 1 << 14
#: Crowded anchors that are sent to all tasks at once; more are joined by a shuffle.
SENT_KEYS = 500_000
NO_ID = np.iinfo(np.int64).max
BASE = 0x9E3779B97F4A7C15


def _hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` bytes from each place on, by doubling."""
    out, power, total = None, BASE, 0
    part, width = data.astype(np.uint64) + np.uint64(1), 1
    while total < size:
        if size & width:
            if out is None:
                out, total = part, width
            else:
                n = len(data) - total - width + 1
                out = out[:n] * np.uint64(power) + part[total : total + n]
                total += width
        if total < size:
            n = len(part) - width
            part = part[:n] * np.uint64(power) + part[width:]
            power, width = power * power % (1 << 64), 2 * width
    out = (out ^ out >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    out = (out ^ out >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return out ^ out >> np.uint64(31)


def _slide(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over each `width` neighbours."""
    span = 1
    while 2 * span <= width:
        x, span = pick(x[:-span], x[span:]), 2 * span
    return pick(x[: len(x) - width + span], x[width - span :]) if span < width else x


def anchors(texts: list[bytes], least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, place) of each gram that is the smallest of some string of `least` bytes in its text; ties all count."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < least:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.cumsum([len(t) for t in texts])
    width = least - gram + 1
    found = _hashes(data, gram) | np.uint64(1)
    low = _slide(found, width, np.minimum)
    begin = np.arange(len(low))
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    low[of[begin] != of[begin + least - 1]] = 0
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(found == _slide(np.concatenate([edge, low, edge]), width, np.maximum))
    return found[at], of[at], at - (ends[of[at]] - np.array([len(t) for t in texts])[of[at]])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Texts with their documents and row numbers, in runs of about RUN bytes."""
    texts, docs, rows, total = [], [], [], 0
    for batch in batches:
        for text, doc, row in zip(batch.column("text"), batch.column("doc").to_pylist(), batch.column("rid").to_pylist(), strict=True):
            texts.append(text.as_py())
            docs.append(doc)
            rows.append(row)
            total += len(texts[-1])
            if total >= RUN:
                yield texts, np.array(docs), np.array(rows)
                texts, docs, rows, total = [], [], [], 0
    if texts:
        yield texts, np.array(docs), np.array(rows)


def _seen(least: int, gram: int):
    """h, lo, hi: a run's anchors with their smallest and largest document."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, docs, _ in _batches(batches):
            found, of, _ = anchors(texts, least, gram)
            order = np.argsort(found, kind="stable")
            found, of = found[order], docs[of[order]]
            first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
            lo, hi = (pick.reduceat(of, first) if len(first) else np.zeros(0, np.int64) for pick in (np.minimum, np.maximum))
            yield pa.RecordBatch.from_arrays([pa.array(found[first].view(np.int64)), pa.array(lo), pa.array(hi)], ["h", "lo", "hi"])

    return task


def _placed(least: int, gram: int):
    """h, rid, at: every anchor of every row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, _, rows in _batches(batches):
            found, of, at = anchors(texts, least, gram)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(rows[of]), pa.array(at.astype(np.int64))], ["h", "rid", "at"])

    return task


def suffix_array(data: np.ndarray, begins: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the given suffixes sorted, and how many bytes each has in common with the one before.

    A suffix has `room` bytes, and a shorter one comes before those that go on.
    """
    if not len(begins):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    most = int(room.max())
    order = np.argsort(room, kind="stable")
    rows = np.concatenate([data, np.zeros(most, np.uint8)])[begins[order, None] + np.arange(most, dtype=np.int32)]
    rows[np.arange(most) >= room[order, None]] = 0
    at = np.argsort(rows.view(f"S{most}").ravel(), kind="stable")
    order, rows = order[at], rows[at]
    room, common = room[order], np.zeros(len(order), np.int64)
    for k in range(1, len(rows), 1 << 15):
        differ = rows[k : k + (1 << 15)] != rows[k - 1 : k + (1 << 15) - 1][: len(rows) - k]
        common[k : k + (1 << 15)] = np.where(differ.any(1), differ.argmax(1), most)
    common[1:] = np.minimum(common[1:], np.minimum(room[1:], room[:-1]))
    return order, common


def intervals(common: np.ndarray, left: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(first, last, length) of the maximal repeats among sorted suffixes, by one stack scan.

    left: the byte before each suffix, or -1 where it is not known, which counts as different from any.
    """
    out, stack = [], []  # of open intervals: length, first, the byte before all its suffixes (-1: not one)
    lefts, lengths = left.tolist(), common.tolist() + [0]
    for k in range(1, len(lefts) + 1):
        length, first, before = lengths[k], k - 1, lefts[k - 1]
        while stack and stack[-1][0] > length:
            depth, start, byte = stack.pop()
            byte = byte if byte == before else -1
            if byte == -1:
                out.append((start, k - 1, depth))
            first, before = start, byte
        if length >= least:
            if stack and stack[-1][0] == length:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == before else -1
            else:
                stack.append([length, first, before])
    return out


def repeat_groups(parts: list[bytes], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, place, length): the maximal repeats of `least` bytes and more, each with all its occurrences.

    A place counts bytes over the parts one after the other. A repeat does not cross parts, and one that begins where a
    part begins counts as maximal to the left.
    """
    data, sizes = np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts])
    ends = np.repeat(np.cumsum(sizes), sizes)
    none = np.zeros(0, np.int64)
    if len(data) < least:
        return none, none, none
    begins = np.flatnonzero(ends - np.arange(len(data)) >= least)
    before = np.concatenate([[-1], data[:-1].astype(np.int64)])
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = -1
    _, kind, count = np.unique(_hashes(data, least)[begins], return_inverse=True, return_counts=True)
    low, high = np.full(len(count), 256), np.full(len(count), -2)
    np.minimum.at(low, kind, before[begins])
    np.maximum.at(high, kind, before[begins])
    begins = begins[((count > 1) & ((low != high) | (low == -1)))[kind]]
    if not len(begins):
        return none, none, none
    order, common = suffix_array(data, begins, ends[begins] - begins)
    begins = begins[order]
    found = np.array(intervals(common, before[begins], least), np.int64).reshape(-1, 3)
    sizes = found[:, 1] - found[:, 0] + 1
    group = np.repeat(np.arange(len(found)), sizes)
    member = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + found[group, 0]
    return group, begins[member], found[group, 2]


def smallest(parts: list[bytes], docs: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(part, at, length, doc): stretches of each part all whose strings of `least` bytes have doc as their smallest document.

    docs: the smallest document of each part, which it has as a whole. Parts are distinct.
    """
    sizes = np.array([len(p) for p in parts])
    starts = np.cumsum(sizes) - sizes
    value = np.repeat(docs, sizes)
    of = np.repeat(np.arange(len(parts)), sizes)
    group, place, length = repeat_groups(parts, least)
    if len(group):
        least_of = np.full(int(group.max()) + 1, NO_ID)
        np.minimum.at(least_of, group, docs[of[place]])
        n = length - least + 1
        to = np.repeat(place, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        np.minimum.at(value, to, np.repeat(least_of[group], n))
    at = np.arange(len(value)) - starts[of]
    begins = np.flatnonzero(at <= sizes[of] - least)
    if not len(begins):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    new = np.flatnonzero(np.concatenate([[True], (of[begins[1:]] != of[begins[:-1]]) | (value[begins[1:]] != value[begins[:-1]])]))
    first, n = begins[new], np.diff(np.concatenate([new, [len(begins)]]))
    return of[first], at[first], n + least - 1, value[first]


def _complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by key as runs of about ROWS rows that hold all rows of their keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < ROWS:
            continue
        run = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        keys = run.column("key").to_numpy()
        stop = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        if stop:
            yield run.slice(0, stop)
        held = [run.slice(stop)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _spans(least: int):
    """rid, at, n of rows key, part, doc, rid, start: what of each row's part begins in a smaller document."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _complete(batches):
            coded = run.column("part").dictionary_encode()
            parts, of = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
            doc, rid, start = (run.column(c).to_numpy() for c in ("doc", "rid", "start"))
            lo = np.full(len(parts), NO_ID)
            np.minimum.at(lo, of, doc)
            part, at, n, smaller = smallest(parts, lo, least)
            first = np.searchsorted(part, np.arange(len(parts)))
            count = np.searchsorted(part, np.arange(len(parts)), side="right") - first
            row = np.repeat(np.arange(len(of)), count[of])
            k = np.arange(len(row)) - np.repeat(np.cumsum(count[of]) - count[of], count[of]) + first[of[row]]
            keep = smaller[k] < doc[row]
            row, k = row[keep], k[keep]
            yield pa.RecordBatch.from_arrays([pa.array(rid[row]), pa.array(start[row] + at[k]), pa.array(n[k])], ["rid", "at", "n"])

    return task


RUNS = "array<struct<at bigint, n bigint, lo bigint>>"


def _judged(least: int):
    """id, runs of rows key, id, part, lo: the stretches of each part with their smallest documents."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _complete(batches):
            # Equal parts may come with several anchors.
            coded = run.column("part").dictionary_encode()
            parts, of, docs = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), run.column("lo").to_numpy()
            lo = np.full(len(parts), NO_ID)
            np.minimum.at(lo, of, docs)
            part, at, n, doc = smallest(parts, lo, least)
            ends = np.searchsorted(part, np.arange(len(parts) + 1)).astype(np.int32)
            rows = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(at), pa.array(n), pa.array(doc)], ["at", "n", "lo"]))
            yield pa.RecordBatch.from_arrays([run.column("id"), rows.take(pa.array(of))], ["id", "runs"])

    return task


def _crowded(rows: DataFrame, most: int) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows of keys with more than `most` rows, the others), written where there are any."""
    keys = written(rows.groupBy("key").count().where(F.col("count") > most).select("key"))
    n = keys.count()
    if not n:
        return None, rows
    side = F.broadcast(keys) if n <= SENT_KEYS else keys.hint("merge")
    return rows.join(side, "key", "left_semi"), rows.join(side, "key", "left_anti")


def _by_key(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key")


def verdicts(distinct: DataFrame, least: int, group: int) -> DataFrame:
    """id, runs of distinct surroundings (id, key, r0, r1, p, part, lo).

    p is the anchor's place in part, which holds the strings that begin r0 to r1 bytes before it. A key with more than
    `group` rows is dealt again: halves of r0 to r1, each by a hash of the bytes that its strings share.
    """
    wide, rest = distinct.where("r1 > r0"), distinct.where("r1 = r0")
    many, few = _crowded(wide, group)
    out = _by_key((few if many is None else few.unionByName(rest)) if many is not None else distinct).select("key", "id", "part", "lo").mapInArrow(_judged(least), f"id long, runs {RUNS}")
    if many is None:
        return out
    half = F.explode(F.array(F.struct(F.col("r0").alias("x"), F.expr("(r0 + r1) div 2").alias("y")), F.struct(F.expr("(r0 + r1) div 2 + 1").alias("x"), F.col("r1").alias("y"))))
    parts = many.select("id", "key", "p", "part", "lo", half.alias("h")).select("id", "key", "p", "part", "lo", F.col("h.x").alias("r0"), F.col("h.y").alias("r1"))
    parts = parts.withColumns({"s": F.expr("greatest(0L, p - r1)"), "e": F.expr(f"least(length(part), p - r0 + {least})")}).where(f"e - s >= {least} and p >= r0")
    shared = F.xxhash64("key", "r0", "r1", F.expr(f"substring(part, cast(p - r0 + 1 as int), cast(r0 - r1 + {least} as int))"))
    parts = parts.select("id", "s", shared.alias("key"), "r0", "r1", (F.col("p") - F.col("s")).alias("p"), F.expr("substring(part, cast(s + 1 as int), cast(e - s as int))").alias("part"), "lo")
    on = ["key", "r0", "r1", "p", "part"]
    below = written(parts.groupBy(*on).agg(F.min("lo").alias("lo")).withColumn("id", F.monotonically_increasing_id()))
    judged = written(verdicts(below, least, group))
    links = parts.select("id", "s", *on).join(below.select(F.col("id").alias("below"), *on).hint("merge"), on)
    back = links.join(judged.select(F.col("id").alias("below"), "runs").hint("merge"), "below")
    moved = F.expr(f"cast(transform(runs, r -> struct(r.at + s as at, r.n as n, r.lo as lo)) as {RUNS})")
    return out.unionByName(back.select("id", moved.alias("runs")).groupBy("id").agg(F.flatten(F.collect_list("runs")).alias("runs")))


def repeated(rows: DataFrame, least: int = LEAST, gram: int = GRAM, hot: int = HOT, group: int = GROUP) -> DataFrame:
    """rid, at, n: stretches of a row's text that are covered by strings of `least` bytes which a smaller document has too.

    rows: rid (distinct longs), doc (long, not null), text (binary, not null), read several times, so give a written table.
    """
    reach = least - gram
    both = written(rows.select("text", "doc", "rid").mapInArrow(_seen(least, gram), "h long, lo long, hi long").groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("h"))
    hits = written(rows.select("text", "doc", "rid").mapInArrow(_placed(least, gram), "h long, rid long, at long").join(both.hint("merge"), "h", "left_semi"))
    around = F.expr(f"substring(text, cast(greatest(at - {reach}, 0) + 1 as int), cast(least(at, {reach}) + {least} as int))")
    met = hits.join(rows.select("rid", "doc", "text").hint("merge"), "rid")
    met = written(met.select(F.col("h").alias("key"), F.expr(f"least(at, {reach})").alias("p"), around.alias("part"), "doc", "rid", F.expr(f"greatest(at - {reach}, 0)").alias("start")), compression="zstd")
    many, few = _crowded(met, hot)
    out = _by_key(few.select("key", "part", "doc", "rid", "start")).mapInArrow(_spans(least), "rid long, at long, n long")
    if many is None:
        return out
    on = ["key", "p", "part"]
    distinct = many.groupBy(*on).agg(F.min("doc").alias("lo")).withColumns({"r0": F.lit(0).cast("long"), "r1": F.lit(reach).cast("long"), "id": F.monotonically_increasing_id()})
    distinct = written(distinct)
    judged = written(verdicts(distinct, least, group))
    known = distinct.select("id", *on).join(judged.hint("merge"), "id").drop("id")
    spans = many.join(known.hint("merge"), on).select("doc", "rid", "start", F.explode("runs").alias("run")).where("run.lo < doc")
    return out.unionByName(spans.select("rid", (F.col("start") + F.col("run.at")).alias("at"), F.col("run.n").alias("n")))


def copies(rows: DataFrame, least: int) -> DataFrame:
    """rid, at, n: the whole texts of `least` bytes and more that a smaller document has as a whole (by SHA-256)."""
    marked = rows.where(F.length("text") >= least).select("rid", "doc", F.length("text").cast("long").alias("n"), F.sha2("text", 256).alias("mark"))
    first = marked.groupBy("mark").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("mark", "lo")
    return written(marked.join(first.hint("merge"), "mark").where("doc > lo").select("rid", F.lit(0).cast("long").alias("at"), "n"))


CLEANED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cleaned(with_text: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Few rows at a time, as each has a list of spans.
        for batch in (whole.slice(k, 128) for whole in batches for k in range(0, whole.num_rows, 128)):
            out = []
            for doc, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                text, runs, at = text.as_py(), [], 0
                for start, n in sorted((s["at"], s["n"]) for s in spans or ()):
                    if runs and start <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], start + n)
                    else:
                        runs.append([start, start + n])
                kept = []
                for start, stop in runs:
                    kept.append(text[at:start])
                    at = stop
                whole = b"".join([*kept, text[at:]])
                out.append((doc, len(text), len(text) - len(whole), len(runs), hashlib.sha256(whole).hexdigest(), whole if with_text else None))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [f.split(" ")[0] for f in CLEANED.split(", ")])

    return task


def remove_repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM, hot: int = HOT, group: int = GROUP, with_text: bool = True) -> DataFrame:
    """CLEANED: each row of docs (doc_id, text) without the bytes covered by strings of `least` bytes that also begin in a smaller document.

    Strings are judged on the texts as given. Rows of one id never take from each other; rows without an id come last, so
    they lose what any row with an id has, and nothing to each other. A null text is empty. kept is null unless with_text.
    """
    spark = docs.sparkSession
    with freed(spark):
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
        rows = written(rows.withColumns({"rid": F.monotonically_increasing_id(), "doc": F.coalesce("doc_id", F.lit(int(NO_ID)))}), compression="zstd")
        gone = copies(rows, least)
        spans = written(repeated(without(rows, gone, "rid"), least, gram, hot, group).unionByName(gone))
    each = spans.groupBy("rid").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    return rows.join(each.hint("merge"), "rid", "left").select("doc_id", "text", "spans").mapInArrow(_cleaned(with_text), CLEANED)


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of documents, without repeats of 50 bytes and more.

    Null texts are empty, texts of less than 50 bytes stay. Equal texts: that of the least id stays. Rows of one id, and rows without
    one, are as remove_repeats says. A long text is held whole by the task that has its row. An empty table gives no rows.
    """
    return remove_repeats(read(spark, sf_dir, "documents"), with_text=False).drop("kept")
