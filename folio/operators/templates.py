"""Text templates with `{{ name }}` markers, filled from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKER = r"\{\{\s*(.+?)\s*\}\}"
SUMMARY_PARTS, SUMMARY_CHARS = 10, 800

#: Template parts that are broadcast.
SENT_PARTS = 10_000


def placeholders(parts: DataFrame) -> DataFrame:
    """tpl_id, fields: the distinct names in a template's parts (tpl_id, part_no, part), in the order first seen."""
    # Each part's distinct names first, so that a name goes to its template once for each part and nothing is joined.
    names = F.array_distinct(F.regexp_extract_all("part", F.lit(MARKER), F.lit(1)))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part_no", F.coalesce(names, F.array().cast("array<string>")).alias("names")))), lambda x: x["names"])
    return parts.groupBy("tpl_id").agg(F.array_distinct(F.flatten(ordered)).alias("fields"))


def fill(text: str, values: str) -> Column:
    """Column text with each marker of a key of map `values` replaced by its value, as it is written; null gives ''."""
    key = r"concat('\\{\\{\\s*\\Q', e.key, '\\E\\s*\\}\\}')"
    value = r"replace(replace(coalesce(e.value, ''), '\\', '\\\\'), '$', '\\$')"
    return F.expr(f"aggregate(map_entries({values}), {text}, (t, e) -> regexp_replace(t, {key}, {value}))")


def normalize_mapping(fields: str, values: str) -> Column:
    """A map with each of the fields and its value, '' where there is none, and nothing else."""
    return F.expr(f"map_from_arrays({fields}, transform({fields}, f -> coalesce({values}[f], '')))")


def template_summary(parts: DataFrame, key: str = "tpl_id") -> DataFrame:
    """key, summary: the non-blank ones of the first parts, trimmed and joined."""
    kept = parts.where((F.col("part_no") < SUMMARY_PARTS) & (F.trim("part") != ""))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_no", F.trim("part").alias("p")))), lambda x: x.p), " ")
    return kept.groupBy(key).agg(F.substring(text, 1, SUMMARY_CHARS).alias("summary"))


def place_paragraphs(parts: DataFrame, made: DataFrame, key: str = "tpl_id") -> DataFrame:
    """key, part_no, part: each made text (key, made_no, marker, text) in its marker's place, where that first occurs.

    A text whose marker is nowhere comes after the last part, unless it is empty. Of two texts for one part, the
    one of smaller made_no is placed first.
    """
    hits = parts.join(made.hint("merge"), key).where(F.contains("part", F.col("marker"))).groupBy(key, "made_no").agg(F.min("part_no").alias("part_no"))
    placed = made.join(hits.hint("merge"), [key, "made_no"]).groupBy(key, "part_no").agg(F.array_sort(F.collect_list(F.struct("made_no", "marker", "text"))).alias("edits"))
    edited = F.expr("aggregate(coalesce(edits, array()), part, (t, e) -> replace(t, e.marker, e.text))")
    kept = parts.join(placed.hint("merge"), [key, "part_no"], "left").select(key, "part_no", edited.alias("part"))
    last = parts.groupBy(key).agg(F.max("part_no").alias("last"))
    rest = made.join(hits.select(key, "made_no").hint("merge"), [key, "made_no"], "left_anti").where("text <> ''").join(last.hint("merge"), key, "left")
    return kept.unionByName(rest.select(key, (F.coalesce("last", F.lit(-1)) + 1 + F.col("made_no")).cast("int").alias("part_no"), F.col("text").alias("part")))


def mail_merge(parts: DataFrame, records: DataFrame, stamp: str, stem: str = "letter") -> DataFrame:
    """rec_id, tpl_id, name, text: every record (rec_id, tpl_ids, values) in each template that it asks for."""
    # Few templates go to the records; many are joined by a shuffle.
    side = F.broadcast if parts.count() <= SENT_PARTS else (lambda rows: rows.hint("merge"))
    asked = records.select("rec_id", "values", F.explode("tpl_ids").alias("tpl_id")).join(side(placeholders(parts)), "tpl_id")
    filled = asked.select("rec_id", "tpl_id", normalize_mapping("fields", "values").alias("values")).join(side(parts), "tpl_id").select("rec_id", "tpl_id", "part_no", fill("part", "values").alias("part"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_no", "part"))), lambda x: x.part), "\n")
    uid = F.substring(F.md5(F.concat_ws("_", F.col("tpl_id").cast("string"), F.col("rec_id").cast("string"))), 1, 8)
    return filled.groupBy("rec_id", "tpl_id").agg(text.alias("text")).select("rec_id", "tpl_id", F.concat(F.lit(f"{stem}_generated_{stamp}_"), uid).alias("name"), "text")
