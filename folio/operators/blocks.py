"""The structure of Markdown documents: their blocks (markdown.py), and what blocks hold.

Lists are nested by two spaces a level; images and `<!-- slide: ... -->` directives are found in paragraphs. Emphasis, code and
link marks go from the text of headings, paragraphs and list items. A document's blocks are made within its row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.operators.markdown import document_blocks

UNTITLED = "Untitled Presentation"
CODE_CHARS = 2400
IMAGE = r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)"
DIRECTIVE = r"<!--\s*slide:\s*(.*?)\s*-->"
ITEM = r"^\s*(?:[-*+]|\d{1,9}[.)])\s+"
#: The names of a contents section, folded.
CONTENTS = ("muc luc", "table of contents", "contents")


def plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1"), r"[*`]+|__", ""))


def line_blocks(docs: DataFrame, key: str = "doc_id", text: str = "md") -> DataFrame:
    """key, line_no (the first), kind, lines of each block, as markdown.parse gives them, and depths, numbers of a list's items; no shuffle."""
    return document_blocks(docs, key, text).select(key, F.inline("blocks"))


def list_items(lined: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, line_no, item, depth, ordered, number, text: an ordered list counts on from its first number."""
    items = lined.where("kind = 'list'").select(key, "line_no", F.posexplode(F.arrays_zip("lines", "depths", "numbers")).alias("item", "x"))
    ordered = F.regexp_extract("x.lines", r"^\s*(\d{1,9})[.)]", 1) != ""
    return items.select(key, "line_no", "item", F.col("x.depths").alias("depth"), ordered.alias("ordered"), F.col("x.numbers").alias("number"), _item(F.col("x.lines")).alias("text"))


def _item(line: Column) -> Column:
    return plain(F.regexp_replace(line, ITEM, ""))


def list_text(block: Column) -> Column:
    """The text of a list (lines, depths, numbers): a line for each item, indented and marked anew."""
    mark = lambda x: F.coalesce(F.concat(x.numbers.cast("string"), F.lit(".")), F.lit("-"))
    line = lambda x: F.concat(F.repeat(F.lit("  "), x.depths), mark(x), F.lit(" "), _item(x.lines))
    return F.array_join(F.transform(F.arrays_zip(block.lines.alias("lines"), block.depths.alias("depths"), block.numbers.alias("numbers")), line), "\n")


def cells(line: Column) -> Column:
    inner = F.regexp_replace(F.replace(F.trim(line), F.lit("\\|"), F.lit("\x01")), r"^\||\|$", "")
    return F.transform(F.split(inner, r"\|"), lambda c: F.trim(F.replace(c, F.lit("\x01"), F.lit("|"))))


def _table_rows(lines: Column) -> Column:
    return F.transform(F.filter(F.slice(lines, 2, F.size(lines)), lambda x: ~x.rlike(r"^\|[\s:|-]*\|\s*$")), cells)


def _table_text(lines: Column) -> Column:
    return F.concat(F.lit("Table with headers: "), F.array_join(cells(F.get(lines, F.lit(0))), ", "))


def extract_tables(lined: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, line_no, headers, rows (lists of cells; the delimiter line goes), text."""
    lines = F.col("lines")
    return lined.where("kind = 'table'").select(key, "line_no", cells(lines[0]).alias("headers"), _table_rows(lines).alias("rows"), _table_text(lines).alias("text"))


FIELD_TYPES = {"kind": "string", "text": "string", "level": "int", "language": "string", "url": "string", "alt": "string", "headers": "array<string>", "rows": "array<array<string>>"}
BLOCKS = f"array<struct<{','.join(f'{n}:{t}' for n, t in FIELD_TYPES.items())}>>"


def _block(kind: str, text: Column, **more: Column) -> Column:
    given = {"kind": F.lit(kind), "text": text, **more}
    return F.struct(*(given.get(n, F.lit(None)).cast(t).alias(n) for n, t in FIELD_TYPES.items()))


def _paragraph_parts(lines: Column) -> Column:
    """The blocks of a paragraph: its prose, its images, its directives."""

    def parts(text: Column) -> Column:
        images, directives, none = F.contains(text, F.lit("![")), F.contains(text, F.lit("<!--")), F.array().cast(BLOCKS)
        prose = F.when(images, F.regexp_replace(text, IMAGE, "")).otherwise(text)
        prose = F.when(directives, F.regexp_replace(prose, DIRECTIVE, "")).otherwise(prose)
        prose = plain(F.regexp_replace(F.regexp_replace(prose, r"[ \t]+\n", "\n"), r"\n{2,}|[ \t]{2,}", " "))
        image = F.zip_with(F.regexp_extract_all(text, F.lit(IMAGE), F.lit(1)), F.regexp_extract_all(text, F.lit(IMAGE), F.lit(2)), lambda alt, url: _block("image", F.coalesce(F.nullif(alt, F.lit("")), url), url=url, alt=alt))
        directive = F.transform(F.regexp_extract_all(text, F.lit(DIRECTIVE), F.lit(1)), lambda x: _block("directive", x))
        said = F.filter(F.array(_block("paragraph", prose)), lambda x: x.text != "")
        return F.concat(said, F.when(images, image).otherwise(none), F.when(directives, directive).otherwise(none))

    return F.flatten(F.transform(F.array(F.array_join(lines, "\n")), parts))


def _parts(block: Column) -> Column:
    """What a block of lines holds, as BLOCKS."""
    kind, lines = block.kind, block.lines
    first = F.get(lines, F.lit(0))
    code = F.regexp_replace(F.array_join(F.slice(lines, F.lit(2), F.size(lines) - 2), "\n"), r"^\s+|\s+$", "")
    return (
        F.when(kind == "heading", F.array(_block("heading", plain(F.regexp_replace(first, r"^#{1,6}(?:[ \t]+|$)|[ \t]+#*[ \t]*$", "")), level=F.length(F.regexp_extract(first, r"^(#{1,6})", 1)))))
        .when(kind == "code", F.array(_block("code", code, language=F.substring(first, 4, 1 << 30))))
        .when(kind == "list", F.array(_block("list", list_text(block))))
        .when(kind == "table", F.array(_block("table", _table_text(lines), headers=cells(first), rows=_table_rows(lines))))
        .otherwise(_paragraph_parts(lines))
    )


def extract_blocks(docs: DataFrame, key: str = "doc_id", text: str = "md") -> DataFrame:
    """key, block_no (from 1), id, kind, text, level, language, url, alt, headers, rows of each block in order, and its line_no; none of a blank text."""
    parts = F.flatten(F.transform("blocks", lambda x: F.transform(_parts(x), lambda b: F.struct(x.line_no.alias("line_no"), b.alias("b")))))
    found = document_blocks(docs, key, text).select(key, F.posexplode(parts).alias("at", "x")).select(key, F.col("x.line_no").alias("line_no"), (F.col("at") + 1).alias("block_no"), "x.b.*")
    return found.withColumn("id", F.format_string("src-%04d", "block_no"))


def with_section_path(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """blocks with section_path: the titles of the headings that a block stands under, itself included."""
    upto = Window.partitionBy(key).orderBy("block_no")
    path = []
    for k in range(1, 7):
        last = F.last(F.when(F.col("level") <= k, F.struct("level", "text")), ignorenulls=True).over(upto)
        path.append(F.when(last.level == k, F.nullif(last.text, F.lit(""))))
    return blocks.withColumn("section_path", F.filter(F.array(*path), lambda x: x.isNotNull()))


def doc_titles(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, title: the first H1 with a text, else the first heading with one, else a fixed title."""
    head = F.when((F.col("kind") == "heading") & (F.col("text") != ""), F.col("block_no"))
    one = F.when(F.col("level") == 1, head)
    return blocks.groupBy(key).agg(F.coalesce(F.min_by("text", one), F.min_by("text", head), F.lit(UNTITLED)).alias("title"))


def fold(text: Column) -> Column:
    """Lower case without accents, and without ` #:.-` at the ends; đ stays."""
    return F.btrim(F.regexp_replace(F.translate(F.lower(text), ACCENTED, BARE), r"\p{M}+", ""), F.lit(" #:.-"))


def _accents() -> tuple[str, str]:
    import unicodedata

    pairs = [(c, b) for c in map(chr, range(0xC0, 0x1F00)) if (b := unicodedata.normalize("NFD", c)[0]) != c and unicodedata.combining(unicodedata.normalize("NFD", c)[-1]) and ord(b) < 0x250 and c == c.lower()]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, BARE = _accents()


def is_toc(path: Column) -> Column:
    return F.exists(path, lambda p: fold(p).isin(*CONTENTS))


def compact_sections(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Blocks (with section_path) without headings and contents, numbered by section_no where the path changes."""
    kept = blocks.where((F.col("kind") != "heading") & ~is_toc(F.col("section_path")))
    order = Window.partitionBy(key).orderBy("block_no")
    new = F.when(F.lag("section_path").over(order).eqNullSafe(F.col("section_path")), 0).otherwise(1)
    return kept.withColumn("_new", new).withColumn("section_no", F.sum("_new").over(order).cast("int")).drop("_new")


def compact_block(blocks: DataFrame) -> DataFrame:
    """blocks with compact: the JSON of the fields that a block's kind needs."""
    opts = {"ignoreNullFields": "false"}
    base = (F.col("id"), F.col("kind"))
    compact = (
        F.when(F.col("kind") == "list", F.to_json(F.struct(*base, F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("items")), opts))
        .when(F.col("kind") == "table", F.to_json(F.struct(*base, F.col("headers"), F.col("rows")), opts))
        .when(F.col("kind") == "image", F.to_json(F.struct(*base, F.col("alt"), F.col("url")), opts))
        .when(F.col("kind") == "code", F.to_json(F.struct(*base, F.col("language"), F.substring("text", 1, CODE_CHARS).alias("code")), opts))
        .otherwise(F.to_json(F.struct(*base, F.col("text")), opts))
    )
    return blocks.withColumn("compact", compact)
