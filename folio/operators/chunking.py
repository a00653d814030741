"""Chunks of Markdown documents, for whole corpora.

Tables are set apart, documents cut at headers, long sections cut at paragraphs, lines and sentences, small ones
merged, and what is still too long cut where the vocabulary changes or, failing that, at a fixed number of tokens.
Sizes are in estimated tokens (functions.text.token_count). All of it is column functions and windows by document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import token_count
from folio.operators.index import chunk_id
from folio.operators.markdown import each_document, sections
from folio.operators.packing import number_groups
from folio.operators.sentences import next_cosines, number_sentences, split_sentences

SMALL, IDEAL, LARGE, CAP, OVERLAP = 200, 700, 1200, 1500, 100
#: Characters of a structural piece.
PIECE = 2000


def _joined(order: str, text: Column | str, by: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("t")))), lambda x: x.t), by)


def isolate_tables(text: Column | str) -> Column:
    """Each run of lines that begin and end with | gets a blank line before and after."""
    return F.regexp_replace(text, r"(?m)((?:^\|.*\|$\n)*^\|.*\|$)\n?", "\n\n$1\n\n")


def split_headers(docs: DataFrame, key: str = "doc_id", text: str = "md", levels: int = 2) -> DataFrame:
    """key, section, h1 to h{levels}, content: a section from each header line of those levels on, without those in code fences.

    The header's line stays in the text; a new header ends those of deeper levels; sections without text are left out; nulls for
    headers that are not there.
    """
    names = [f"h{k + 1}" for k in range(levels)]
    rows = lambda md: [(k, *heads, content) for k, heads, content in sections(md, levels)]
    return each_document(docs, key, text, rows, ", ".join(["section long", *(f"{n} string" for n in names), "content string"]))


def structural_pieces(text: Column | str, size: int = PIECE) -> Column:
    """The text in pieces of at most `size` characters, packed greedily from its paragraphs.

    Only paragraphs that are too long are cut at lines, and only such lines at sentences. What marks a cut stays with
    what follows. A sentence that is too long stands alone.
    """
    # Before each blank line; of more newlines in a row, before every second one.
    pieces = F.split(text, r"(?=\n\n)(?<=(?:^|[^\n])(?:\n\n){0,64})")

    def cut_long(mark: str):
        return lambda p: F.when(F.length(p) > size, F.split(p, mark)).otherwise(F.array(p))

    for mark in (r"(?=\n)", r"(?=\. )"):
        pieces = F.flatten(F.transform(pieces, cut_long(mark)))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(s: Column, p: Column) -> Column:
        full = (F.length(s.now) > 0) & (F.length(s.now) + F.length(p) > size)
        return F.struct(F.when(full, F.concat(s.done, F.array(s.now))).otherwise(s.done).alias("done"), F.when(full, p).otherwise(F.concat(s.now, p)).alias("now"))

    return F.aggregate(pieces, start, step, lambda s: F.when(F.length(s.now) > 0, F.concat(s.done, F.array(s.now))).otherwise(s.done))


def split_structural(sections: DataFrame, by: tuple[str, ...] = ("doc_id", "section")) -> DataFrame:
    """sections (by, h1, h2, content) with piece: those of more than LARGE tokens in pieces, the others as they are."""
    pieces = F.when(token_count("content") > LARGE, structural_pieces("content")).otherwise(F.array("content"))
    return sections.select(*by, "h1", "h2", F.posexplode(pieces).alias("piece", "content"))


def _tokens(chars: int) -> int:
    return max(1, (chars + 2) // 3)


def _merges(held: tuple, chars: int, h1: str | None) -> tuple | None:
    """The next section goes to the current one if both have one H1, they have less than CAP tokens together, and the
    current one has less than SMALL or both have less than IDEAL. Texts are joined by two characters."""
    now, both = _tokens(held[0]), _tokens(held[0]) + _tokens(chars)
    return (held[0] + 2 + chars, h1) if h1 == held[1] and both < CAP and (now < SMALL or both < IDEAL) else None


def merge_small(sections: DataFrame, key: str, idx: str, keep: tuple[str, ...] = ("h1",)) -> DataFrame:
    """key, idx (of the first section in it), merged, keep, content, n_sections: small neighbours joined by a blank line.

    The first section's metadata hold. Only sizes and H1 come together to decide; texts join once the groups are known.
    """
    sizes = sections.select(key, idx, F.length("content").cast("long").alias("chars"), "h1")
    ids = number_groups(sizes, [key], idx, ["chars", "h1"], lambda chars, h1: (chars, h1), _merges, "merged")
    first = [F.min_by(c, idx).alias(c) for c in keep]
    return sections.join(ids.hint("merge"), [key, idx]).groupBy(key, "merged").agg(F.min(idx).alias("idx"), F.count(F.lit(1)).cast("int").alias("n_sections"), *first, _joined(idx, "content", "\n\n").alias("content"))


def _vector_cosines(rows: DataFrame, by: tuple[str, ...], load: Callable) -> DataFrame:
    """rows (by, sentences) with cosines, from an encoder's vectors: each sentence is encoded once, in batches, and meets the next one's vector in the window's order."""
    from folio.functions.plugs import vectorize

    order = Window.partitionBy(*by).orderBy("n")
    each = vectorize(rows.select(*by, F.posexplode("sentences").alias("n", "sentence")), load, "sentence", "v").withColumn("w", F.lead("v").over(order))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot(F.col("v"), F.col("v"))) * F.sqrt(dot(F.col("w"), F.col("w")))
    cosine = F.coalesce(dot(F.col("v"), F.col("w")) / F.nullif(norm, F.lit(0.0)), F.lit(0.0))
    made = each.select(*by, "n", "sentence", cosine.alias("cosine")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("n", "sentence", "cosine"))).alias("x"))
    return made.select(*by, F.col("x.sentence").alias("sentences"), F.col("x.cosine").alias("cosines"))


def _cuts(cosines: Column) -> Column:
    """The places (from 0) of the sentences after which a cut falls. In whole numbers, so that equal slopes are equal."""

    def slope(d: Column, k: Column) -> Column:
        before, behind, now = F.get(d, k - 1), F.get(d, k + 1), F.get(d, k)
        return F.when(before.isNull() & behind.isNull(), F.lit(0).cast("long")).when(behind.isNull(), 2 * (now - before)).when(before.isNull(), 2 * (behind - now)).otherwise(behind - before)

    def above(slopes: Column) -> Column:
        place = F.lit(95) * (F.size(slopes) - 1)
        low, share = F.floor(place / 100).cast("int"), F.pmod(place, F.lit(100))
        bar = lambda x: F.get(x, low) * (100 - share) + F.coalesce(F.get(x, low + 1), F.lit(0).cast("long")) * share
        return F.flatten(F.transform(F.array(bar(F.array_sort(slopes))), lambda t: F.filter(F.transform(slopes, lambda s, k: F.when(100 * s > t, k)), lambda k: k.isNotNull())))

    within = lambda make, x: F.flatten(F.transform(F.array(x), make))
    distances = F.transform(F.slice(cosines, 1, F.greatest(F.size(cosines) - 1, F.lit(0))), lambda c: F.floor((F.lit(1.0) - c) * 1e9 + 0.5))
    return within(above, within(lambda d: F.transform(d, lambda _, k: slope(d, k)), distances))


def semantic_parts(rows: DataFrame) -> DataFrame:
    """rows (sentences, cosines) with parts, the texts between the cuts, in place of these two."""
    cut = rows.withColumn("_cuts", _cuts(F.col("cosines")))
    starts, ends = F.concat(F.array(F.lit(0)), F.transform("_cuts", lambda k: k + 1)), F.concat(F.transform("_cuts", lambda k: k + 1), F.array(F.size("sentences")))
    return cut.withColumn("parts", F.zip_with(starts, ends, lambda a, b: F.array_join(F.slice("sentences", a + 1, b - a), " "))).drop("sentences", "cosines", "_cuts")


def split_semantic(sections: DataFrame, by: tuple[str, ...], least: int = LARGE, load: Callable | None = None) -> DataFrame:
    """by, part, content: sections of more than `least` tokens cut where neighbouring sentences differ.

    The distance of two neighbours is 1 less the cosine of their vectors, in whole billionths (halves up): of term counts, or of an
    encoder's where load is given (as plugs.vectorize takes it). A cut falls after a sentence whose distance's gradient (central differences)
    lies above the section's 95th percentile (between two values in proportion), both exactly. Other sections are left out.
    """
    rows = sections.where(token_count("content") > least).select(*by, split_sentences("content").alias("sentences"))
    rows = _vector_cosines(rows, by, load) if load else number_sentences(rows, "cosines", next_cosines)
    return semantic_parts(rows).select(*by, F.posexplode("parts").alias("part", "content"))


def hard_cap(text: Column | str, cap: int = CAP, overlap: int = OVERLAP) -> Column:
    """The text's words in runs of at most `cap` estimated tokens, which share up to `overlap` with the one before.

    A token is three characters (functions.text.token_count). Runs begin every cap - overlap tokens and hold the words
    that lie in them as a whole; a word of more than the overlap, 200 characters at most, counts as several.
    """
    size, step, longest = 3 * cap, 3 * (cap - overlap), min(200, 3 * overlap - 2)
    edge = "\x01"
    marked = F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), rf"(\S{{{longest}}})", f"$1{edge}")

    def run(m: Column, s: Column) -> Column:
        part = F.substr(m, s + 1, F.lit(size))
        part = F.when((s > 0) & ~F.substr(m, s, F.lit(1)).isin(" ", edge), F.regexp_replace(part, f"^[^ {edge}]+", "")).otherwise(part)
        part = F.when((s + size < F.length(m)) & ~F.substr(m, s + size + 1, F.lit(1)).isin(" ", edge), F.regexp_replace(part, f"[^ {edge}]+$", "")).otherwise(part)
        return F.trim(F.replace(part, F.lit(edge), F.lit("")))

    def runs(m: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.length(m), F.lit(1)) - 1, F.lit(step)), lambda s: (s == 0) | (s + 3 * overlap < F.length(m)))
        return F.transform(starts, lambda s: run(m, s))

    return F.flatten(F.transform(F.array(marked), runs))


def inject_context(text: Column | str, *headers: Column | str) -> Column:
    """The headers there are, before the text, unless they stand in its first 300 characters."""
    text = F.col(text) if isinstance(text, str) else text
    path = F.concat_ws(" > ", *headers)
    return F.when((path != "") & ~F.contains(F.substring(text, 1, 300), path), F.concat(F.lit("**Bối cảnh: "), path, F.lit("**\n\n"), text)).otherwise(text)


def label_method(tokens: Column) -> Column:
    """How a chunk that was not cut came about."""
    return F.when(tokens > LARGE, "hybrid_semantic").when(tokens > SMALL, "markdown_adaptive").otherwise("merged_small")


def chunk_documents(docs: DataFrame) -> DataFrame:
    """tenant_id, src_file, chunk_idx, chunk_id, content, method, token_count, h1, h2, h3 of every document.

    docs: doc_id, tenant_id, src_file, md. token_count is of the text before its headers are put before it; h3 is ''.
    """
    sections = split_structural(split_headers(docs.withColumn("md", isolate_tables("md"))))
    numbered = sections.withColumn("idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("section", "piece")) - 1)
    merged = merge_small(numbered, "doc_id", "idx", ("h1", "h2")).drop("n_sections", "merged")
    fits = token_count("content") <= LARGE
    kept = merged.where(fits).select("doc_id", "idx", F.lit(0).alias("part"), F.lit(0).alias("run"), "h1", "h2", "content", label_method(token_count("content")).alias("method"))
    cut = split_semantic(merged.where(~fits), ("doc_id", "idx", "h1", "h2"))
    too_long = token_count("content") > CAP
    runs = cut.select("doc_id", "idx", "part", F.posexplode(F.when(too_long, hard_cap("content")).otherwise(F.array("content"))).alias("run", "piece"), "h1", "h2", F.when(too_long, "hard_cap_fallback").otherwise("hybrid_semantic").alias("method"))
    both = kept.unionByName(runs.withColumnRenamed("piece", "content"))
    order = Window.partitionBy("doc_id").orderBy("idx", "part", "run")
    named = both.withColumn("chunk_idx", F.row_number().over(order) - 1).join(docs.select("doc_id", "tenant_id", "src_file").hint("merge"), "doc_id")
    none = lambda c: F.coalesce(c, F.lit(""))
    return named.select("tenant_id", "src_file", "chunk_idx", chunk_id("tenant_id", "src_file", "chunk_idx").alias("chunk_id"), inject_context("content", "h1", "h2").alias("content"), "method", token_count("content").alias("token_count"), none("h1").alias("h1"), none("h2").alias("h2"), F.lit("").alias("h3"))
