"""Greedy packing of a key's rows in order: one shuffle of sizes by key, and one pass that carries a small state.

Nothing grows with a key's rows: a task reads its sorted rows batch by batch. Texts stay where they are until the
groups are known.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _pass(n_keys: int, joins: Callable, begins: Callable, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, group = None, None, 0
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            groups = []
            for key, values in zip(zip(*columns[:n_keys], strict=True), zip(*columns[n_keys + 1 :], strict=True), strict=True):
                if key != now:
                    now, group, state = key, 0, begins(*values)
                elif (more := joins(state, *values)) is not None:
                    state = more
                else:
                    group, state = group + 1, begins(*values)
                groups.append(group)
            yield pa.RecordBatch.from_arrays([*batch.columns[: n_keys + 1], pa.array(groups, pa.int32())], names)

    return run


def number_groups(rows: DataFrame, keys: list[str], order: str, values: list[str], begins: Callable, joins: Callable, name: str) -> DataFrame:
    """keys, order, name: the number (from 0 within a key) of the group that each row goes to.

    begins(*values) is the state of a group of one row; joins(state, *values) that of the group with one more, or None
    where the row begins a new one. Null keys are a key like any other; rows of one order fall as they come.
    """
    chosen = rows.select(*keys, order, *values)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[: len(keys) + 1]), f"`{name}` int"])
    return chosen.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(_pass(len(keys), joins, begins, [*keys, order, name]), schema)


def pack(rows: DataFrame, keys: list[str], order: str, size: str, limit: int, name: str = "pack") -> DataFrame:
    """rows with the number of their pack within keys: consecutive rows whose sizes sum to `limit` at most; a larger row stands alone."""
    numbers = number_groups(rows, keys, order, [size], lambda x: x or 0, lambda held, x: None if held + (x or 0) > limit else held + (x or 0), name)
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}")) for c in (*keys, order)]
    return rows.alias("r").join(numbers.alias("g").hint("merge"), on).select("r.*", name)


def pack_twice(rows: DataFrame, key: str, inner: list[str], order: str, size: str, limit: int) -> DataFrame:
    """rows with part and pack: those of one `inner` packed into parts, and a key's parts, numbered over it, into packs.

    One shuffle and one pass, in which all columns go along. A part's pack is known when it ends, so a task holds the batches of its
    open part.
    """
    at = [rows.columns.index(c) for c in (key, *inner, size)]
    names = [*rows.columns, "part", "pack"]
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("pack", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, within, held = object(), None, 0  # the open part: its key, section, tokens
        part, pack_no, packed = -1, 0, None  # its number; the open pack and its tokens before that part
        waiting: list[tuple[pa.RecordBatch, list[int], list[int]]] = []  # batches, and the part and turn of each row
        packs: dict[int, int] = {}  # of closed parts, by turn
        turn = -1

        def close() -> None:
            nonlocal pack_no, packed
            if turn >= 0:
                pack_no, packed = (0, held) if packed is None else (pack_no, packed + held) if packed + held <= limit else (pack_no + 1, held)
                packs[turn] = pack_no

        def out(batch: pa.RecordBatch, parts: list[int], turns: list[int]) -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.int32()), pa.array([packs[t] for t in turns], pa.int32())], names)
            for t in set(turns[:-1]) - {turns[-1]}:
                del packs[t]
            return made

        for batch in batches:
            parts, turns = [], []
            columns = [batch.column(k).to_pylist() for k in at]
            for who, *where, n in zip(*columns, strict=True):
                n = n or 0
                if who == now and where == within and held + n <= limit:
                    held += n
                else:
                    close()
                    if who != now:
                        now, part, packed = who, -1, None
                    within, held, part, turn = where, n, part + 1, turn + 1
                parts.append(part)
                turns.append(turn)
            if parts:
                waiting.append((batch, parts, turns))
            while waiting and waiting[0][2][-1] < turn:
                yield out(*waiting.pop(0))
        close()
        for x in waiting:
            yield out(*x)

    return rows.repartition(key).sortWithinPartitions(key, *inner, order).mapInArrow(run, schema)
