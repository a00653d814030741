"""Packing sections under a token budget, and extractive digests of the packs, kept by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import token_count
from folio.operators.markdown import each_document
from folio.operators.packing import pack_twice
from folio.operators.sentences import mean_weights, number_sentences, split_sentences
from folio.sources.shared import shared_folder

BUDGET, PACK, VERSION = 3600, 4200, "v1"
TITLE, SUMMARY, KEYS, FACTS, SOURCES = 120, 600, 6, 8, 12


def pack_sections(blocks: DataFrame, key: str = "doc_id", limit: int = PACK, size: str = "size") -> DataFrame:
    """blocks (key, section_no, block_no, size in tokens) with part and pack.

    A section's blocks are packed into its parts first, and then a document's parts into packs, both in order and of
    `limit` tokens at most; what is larger by itself stands alone. Parts are numbered over the document.
    """
    return pack_twice(blocks, key, ["section_no"], "block_no", size, limit)


def budget_gate(docs: DataFrame, text: str, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """Those of docs that fit the budget whole, and those to be digested."""
    fits = token_count(text) <= budget
    return docs.where(fits), docs.where(~fits)


def cache_key(model: str, body: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{VERSION}:{model}:"), body), 256)


def pending(chunks: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """chunks (with cache_key) whose digest is not yet known, and the known ones with their digest."""
    return chunks.join(cache.select("cache_key").distinct(), "cache_key", "left_anti"), chunks.join(cache, "cache_key")


def digest(packs: DataFrame, key: tuple[str, ...], sources: str | None = None) -> DataFrame:
    """key, title, summary, key_points, facts, source_block_ids: the sentences of a pack (key, content) with the heaviest terms.

    sources: a column of packs with the ids of its blocks, the first SOURCES of which are kept; without it there are none.

    A sentence weighs the mean over its terms of ln(1 + count in the pack); facts are sentences with digits. Sentences
    come in the text's order, and ties go to the earlier one.
    """
    ids = F.slice(F.col(sources), 1, SOURCES) if sources else F.array().cast("array<string>")
    split = packs.select(*key, ids.alias("source_block_ids"), F.filter(split_sentences("content"), lambda x: F.trim(x) != "").alias("sentences")).where(F.size("sentences") > 0)
    weighed = number_sentences(split, "weights", mean_weights)
    heaviest = F.array_sort(F.transform("weights", lambda w, n: F.struct((-F.round(w, 9)).alias("w"), n.alias("n"))))
    weighed = weighed.withColumn("_best", F.transform(heaviest, lambda x: x.n))

    def listed(places: Column, many: int) -> Column:
        return F.transform(F.array_sort(F.slice(places, 1, many)), lambda n: F.get("sentences", n))

    made = weighed.withColumn("key_points", listed(F.col("_best"), KEYS)).withColumn("facts", listed(F.filter("_best", lambda n: F.get("sentences", n).rlike("[0-9]")), FACTS))
    return made.select(*key, F.substring(F.get("sentences", F.lit(0)), 1, TITLE).alias("title"), F.substring(F.array_join("key_points", " "), 1, SUMMARY).alias("summary"), "key_points", "facts", "source_block_ids")


def _packs(text: str) -> list[tuple[int, str]]:
    """A text's lines in packs of at most PACK tokens, in order; a larger line stands alone."""
    packs: list[list[str]] = []
    held = 0
    for line in text.split("\n"):
        size = max(1, (len(line) + 2) // 3)
        if packs and held + size <= PACK:
            packs[-1].append(line)
            held += size
        else:
            packs.append([line])
            held = size
    return [(k, "\n".join(lines)) for k, lines in enumerate(packs)]


def tree_reduce(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = 2, budget: int = BUDGET) -> DataFrame:
    """key, text, rounds: documents over the budget are packed by paragraph and digested, `rounds` times at most."""
    now, done = docs.select(key, F.col(text).alias("text")), None
    for k in range(rounds + 1):
        fits, rest = budget_gate(now, "text", budget) if k < rounds else (now, None)
        finished = fits.select(key, "text", F.lit(k).alias("rounds"))
        done = finished if done is None else done.unionByName(finished)
        if rest is not None:
            packs = each_document(rest, key, "text", _packs, "pack int, content string")
            made = digest(packs, (key, "pack"))
            now = made.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pack", "summary"))), lambda x: x.summary), "\n").alias("text"))
            # Digests are small and read twice, by those that fit and by the next round.
            shared_folder(docs.sparkSession)
            now = now.checkpoint()
    return done
