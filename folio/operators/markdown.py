"""The block structure of Markdown text, line by line: one pass over a document that carries what is open.

After CommonMark: fences of ``` or ~~~ (closed by at least as many of the same mark; info after the opening one), code indented by
four, ATX and setext headings, thematic breaks, lists (over blank lines, with continued items), block quotes with lazy
continuation, and paragraphs; and pipe tables. What stands in a quote counts like what stands outside. Raw HTML counts as paragraphs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = " \t\n\x0b\f\r"
_QUOTE = re.compile(r" {0,3}> ?")
_FENCE = re.compile(r"( {0,3})(?:(`{3,})([^`]*)|(~{3,})(.*))$")
_UNDERLINE = re.compile(r" {0,3}(?:(=+)|-+)[ \t]*$")
_HEADING = re.compile(r" {0,3}#{1,6}(?:[ \t]|$)")
_BREAK = re.compile(r" {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")
_TABLE = re.compile(r"\|.*\|[ \t\n\x0b\f\r]*$")
_ITEM = re.compile(r"[ \t]*(?:[-*+]|(\d{1,9})[.)])[ \t]+")
_INDENTED = re.compile(r"(?: {4}|\t)")


def _unquoted(line: str, most: int | None = None) -> tuple[int, str]:
    """(depth, rest): how many quote marks a line begins with, `most` at most, and what follows them."""
    depth, at = 0, 0
    while (most is None or depth < most) and (mark := _QUOTE.match(line, at)):
        depth, at = depth + 1, mark.end()
    return depth, line[at:]


def _stripped(line: str, spaces: int) -> str:
    """line without up to `spaces` leading spaces."""
    return line[min(len(line) - len(line.lstrip(" ")), spaces) :]


def parse(text: str) -> tuple[list[tuple[int, str, list[str]]], list[bool]]:
    """(blocks, fenced): each block as (first line, kind, lines), and for each line whether it belongs to fenced code.

    A code block's lines begin with ``` and its info and end with ```; a heading is one line with # marks, whatever its form was; a
    continued item is one line.
    """
    blocks: list[tuple[int, str, list[str]]] = []
    fenced: list[bool] = []
    fence = None  # of open code: its mark, length, indent, quote depth
    kind, last, depth, blanks, numbered = "blank", "", 0, 0, False  # of the line before; of the last one that was not blank

    def begin(n: int, new: str, line: str) -> None:
        blocks.append((n, new, [line]))

    for n, line in enumerate(text.split("\n")):
        if fence:
            mark, size, indent, within = fence
            inside, rest = _unquoted(line, within)
            if inside == within:
                closing = rest.strip(" \t")
                if len(closing) >= size and not closing.strip(mark) and len(rest) - len(rest.lstrip(" ")) < 4:
                    blocks[-1][2].append("```")
                    fence, kind = None, "code"
                else:
                    blocks[-1][2].append(_stripped(rest, indent))
                fenced.append(True)
                continue
            blocks[-1][2].append("```")  # the quote ends, and the code with it
            fence, kind = None, "code"
        now, rest = _unquoted(line)
        fenced.append(False)
        if not rest.strip(SPACE):
            last, kind, blanks = (kind, "blank", 1) if kind != "blank" else (last, kind, blanks + 1)
            continue
        before = last if kind == "blank" else kind
        gap, same = kind == "blank", now == depth
        lazy = not gap and now < depth
        item, opened = _ITEM.match(rest), _FENCE.match(rest)
        after_list = before == "list" and same
        if opened:
            mark = opened[2] or opened[4]
            fence = mark[0], len(mark), len(opened[1]), now
            begin(n, "code", "```" + (opened[3] if opened[2] else opened[5]).strip(SPACE))
            fenced[-1], kind, depth = True, "code", now
            continue
        if kind == "paragraph" and same and (under := _UNDERLINE.match(rest)):
            at, _, lines = blocks.pop()
            begin(at, "heading", ("# " if under[1] else "## ") + " ".join(x.strip(SPACE) for x in lines))
            kind = "heading"
        elif _HEADING.match(rest):
            begin(n, "heading", rest.lstrip(" "))
            kind, depth = "heading", now
        elif _BREAK.match(rest):
            kind, depth = "break", now
        elif _TABLE.match(rest):
            if kind == "table" and same:
                blocks[-1][2].append(rest)
            else:
                begin(n, "table", rest)
            kind, depth = "table", now
        elif item and not (_INDENTED.match(rest) and not after_list and before != "list"):
            nested = len(rest) - len(rest.lstrip(SPACE)) >= 2
            if after_list and (not gap or nested or (item[1] is not None) == numbered):
                blocks[-1][2].append(rest)
            else:
                begin(n, "list", rest)
                numbered = item[1] is not None
            kind, depth = "list", now
        elif before == "list" and (same or lazy) and (not gap or len(rest) - len(rest.lstrip(SPACE)) >= 2):
            blocks[-1][2][-1] += " " + rest.strip(SPACE)
            kind = "list"
        elif kind == "paragraph" and (same or lazy):
            blocks[-1][2].append(rest)
        elif _INDENTED.match(rest):
            body = rest[1:] if rest[0] == "\t" else rest[4:]
            if before == "indented" and same:
                blocks[-1][2][-1:] = [*[""] * (blanks if gap else 0), body, "```"]
            else:
                begin(n, "code", "```")
                blocks[-1][2].extend([body, "```"])
            kind, depth = "indented", now
        else:
            begin(n, "paragraph", rest)
            kind, depth = "paragraph", now
    if fence:
        blocks[-1][2].append("```")
    return blocks, fenced


_HEADER = re.compile(r"(#{1,2})[ \t]+[^ \t\n\x0b\f\r]")
_MARKS = re.compile(r"^#{1,2}[ \t]+|[ \t]+#*[ \t]*$")


def sections(text: str, levels: int = 2) -> list[tuple[int, list[str | None], str]]:
    """(number, headers, content) of the sections that # lines up to `levels` deep begin outside fenced code; those without text are left out.

    headers: the title of each level that the section stands under, None where there is none.
    """
    header = _HEADER if levels == 2 else re.compile(rf"(#{{1,{levels}}})[ \t]+[^ \t\n\x0b\f\r]")
    marks = _MARKS if levels == 2 else re.compile(rf"^#{{1,{levels}}}[ \t]+|[ \t]+#*[ \t]*$")
    out: list[tuple[int, list[str | None], list[str]]] = [(0, [None] * levels, [])]
    for line, code in zip(text.split("\n"), parse(text)[1], strict=True):
        if not code and (found := header.match(line)):
            level = len(found[1])
            above = out[-1][1]
            title = marks.sub("", line).strip(" ")
            out.append((len(out), [*above[: level - 1], title, *[None] * (levels - level)], []))
        out[-1][2].append(line)
    whole = [(k, heads, "\n".join(lines).strip(SPACE)) for k, heads, lines in out]
    return [x for x in whole if x[2]]


#: Levels of nested lists.
DEPTHS = 6
_NUMBER = re.compile(r"[ \t\n\x0b\f\r]*([0-9]{1,9})[.)]")


def list_marks(lines: list[str]) -> tuple[list[int], list[int | None]]:
    """(depths, numbers) of a list's items: two spaces a level; an ordered list counts on from its first mark, and other items have none.

    Items of one list at one depth are those with no shallower item between them.
    """
    depths, numbers = [], []
    first, many = [None] * DEPTHS, [0] * DEPTHS
    for line in lines:
        depth = min(DEPTHS - 1, (len(line) - len(line.lstrip(SPACE))) // 2)
        mark = _NUMBER.match(line)
        many[depth + 1 :] = [0] * (DEPTHS - 1 - depth)
        if not many[depth]:
            first[depth] = int(mark[1]) if mark else None
        many[depth] += 1
        depths.append(depth)
        numbers.append(first[depth] + many[depth] - 1 if mark and first[depth] is not None else None)
    return depths, numbers


def document_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, blocks: one row for each document, with its blocks as parse gives them and the list_marks of lists; no shuffle."""
    chosen = docs.select(key, text)
    fields = "line_no:int,kind:string,lines:array<string>,depths:array<int>,numbers:array<int>"
    schema = f"`{key}` {chosen.schema[0].dataType.simpleString()}, blocks array<struct<{fields}>>"
    names = [f.split(":")[0] for f in fields.split(",")]
    types = [pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [parse(x or "")[0] for x in part.column(1).to_pylist()]
                flat = [(n, kind, lines, *(list_marks(lines) if kind == "list" else (None, None))) for f in found for n, kind, lines in f]
                columns = list(zip(*flat, strict=True)) or [[] for _ in names]
                blocks = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
                ends = [0]
                for f in found:
                    ends.append(ends[-1] + len(f))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), blocks)], [key, "blocks"])

    return chosen.mapInArrow(run, schema)


def each_document(docs: DataFrame, key: str, text: str, rows: Callable[[str], list[tuple]], fields: str) -> DataFrame:
    """key and fields: rows(text) of each document, where it is read, so nothing is shuffled. A null text is empty."""
    chosen = docs.select(key, text)
    names = [f.split(" ")[0] for f in fields.split(", ")]
    schema = f"`{key}` {chosen.schema[0].dataType.simpleString()}, {fields}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [rows(x or "") for x in part.column(1).to_pylist()]
                flat = [r for f in found for r in f]
                of = pa.array([k for k, f in enumerate(found) for _ in f], pa.int32())
                types = types or [_type(f) for f in fields.split(", ")]
                columns = list(zip(*flat, strict=True)) or [[] for _ in names]
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [key, *names])

    return chosen.mapInArrow(run, schema)


def _type(field: str) -> pa.DataType:
    return {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}[field.split(" ")[1]]
