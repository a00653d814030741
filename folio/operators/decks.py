"""Slide decks as tables: limits, pagination, composition, quality rules, and checks of packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ITEMS, CHARS = 6, 500
#: How many items a diagram takes, and how many of them are drawn.
DIAGRAMS = {"paired_grid": (4, 6, 6), "three_columns": (3, 3, 3), "relationship": (2, 3, 3), "hub_spoke": (4, 6, 6), "timeline": (4, 7, 7)}
#: Characters of a title and a description, of a slide and a block, and blocks of a slide.
TITLE, DESCRIPTION, SLIDE_CHARS, BLOCK_CHARS, BLOCKS = 50, 120, 900, 650, 4
VISUAL = ("diagram", "chart", "table", "image_text")
PALETTE = 5


def _case(column: str, pick: int) -> Column:
    found = None
    for name, limits in DIAGRAMS.items():
        found = F.when(F.col(column) == name, limits[pick]) if found is None else found.when(F.col(column) == name, limits[pick])
    return found


def validate_deck(items: DataFrame) -> DataFrame:
    """deck_id, slide_no, rule, n: diagrams (items with diagram_type, title, description) beyond their limits."""
    per = items.groupBy("deck_id", "slide_no", "diagram_type").agg(F.count(F.lit(1)).alias("n"), F.sum((F.length("title") > TITLE).cast("long")).alias("titles"), F.sum((F.length("description") > DESCRIPTION).cast("long")).alias("descriptions"))
    rules = F.array(
        F.when(_case("diagram_type", 0).isNull(), F.struct(F.lit("diagram_type").alias("rule"), F.col("n").alias("n"))),
        F.when(~F.col("n").between(_case("diagram_type", 0), _case("diagram_type", 1)), F.struct(F.lit("item_count").alias("rule"), F.col("n").alias("n"))),
        F.when(F.col("titles") > 0, F.struct(F.lit("title_length").alias("rule"), F.col("titles").alias("n"))),
        F.when(F.col("descriptions") > 0, F.struct(F.lit("description_length").alias("rule"), F.col("descriptions").alias("n"))),
    )
    return per.select("deck_id", "slide_no", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("x")).select("deck_id", "slide_no", "x.rule", "x.n")


def text_items(text: Column | str) -> Column:
    """The non-blank lines without bullets and numbers; one line alone splits at its semicolons (two at least), or,
    if it is longer than a page, at its sentences."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    items = F.transform(lines, lambda x: F.regexp_replace(x, r"^(?:[-*•]|\d+[.)])\s*", ""))
    one = F.try_element_at(items, F.lit(1))
    parts = F.filter(F.transform(F.split(one, ";"), lambda x: F.trim(x)), lambda x: x != "")
    listed = F.when((F.size(items) == 1) & (F.size(F.split(one, ";")) >= 3), parts).otherwise(items)
    only = F.try_element_at(listed, F.lit(1))
    return F.when((F.size(listed) == 1) & (F.length(only) > CHARS), F.split(only, r"(?<=[.!?])\s+")).otherwise(listed)


def paginate(items: str) -> Column:
    """A column's items in pages of at most ITEMS items and CHARS characters; a longer item stands alone."""
    full = f"size(s.now) >= {ITEMS} or s.chars + length(x) > {CHARS}"
    step = f"if(size(s.now) > 0 and ({full}), named_struct('done', concat(s.done, array(s.now)), 'now', array(x), 'chars', length(x)), named_struct('done', s.done, 'now', concat(s.now, array(x)), 'chars', s.chars + length(x)))"
    return F.expr(f"aggregate({items}, named_struct('done', cast(array() as array<array<string>>), 'now', cast(array() as array<string>), 'chars', 0), (s, x) -> {step}, s -> if(size(s.now) > 0, concat(s.done, array(s.now)), s.done))")


def slide_components(blocks: DataFrame) -> DataFrame:
    """deck_id, slide_no, kind, shown_kind, title, body, chart, table, diagram from blocks (with block_no, type, text, payload).

    Texts follow each other; of several charts, tables or diagrams the last holds.
    """
    texts = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == "text", F.struct("block_no", text_items("text").alias("items"))))), lambda x: x["items"]))
    last = {k: F.max_by("payload", F.when(F.col("type") == k, F.col("block_no"))).alias(k) for k in ("chart", "table", "diagram")}
    made = blocks.groupBy("deck_id", "slide_no").agg(F.first("kind").alias("kind"), F.first("title").alias("title"), texts.alias("body"), *last.values())
    shown = F.when(F.col("diagram").isNotNull(), "diagram").when(F.col("chart").isNotNull(), "chart").when(F.col("table").isNotNull(), "table").otherwise(F.col("kind"))
    return made.withColumn("shown_kind", shown)


def _cover(body: Column, kind: Column) -> tuple[Column, Column]:
    cover = (kind == "cover") & (F.size(body) > 0)
    return F.when(cover, F.try_element_at(body, F.lit(1))), F.when(cover, F.slice(body, F.lit(2), F.greatest(F.size(body), F.lit(1)))).otherwise(body)


def with_subtitle(slides: DataFrame) -> DataFrame:
    """slides with subtitle (a cover's first item) and the body without it."""
    subtitle, body = _cover(F.col("body"), F.col("shown_kind"))
    return slides.withColumn("subtitle", subtitle).withColumn("body", body)


def compose_plan(slides: DataFrame) -> DataFrame:
    """deck_id, id, kind, title, subtitle, body, visual, notes of the slides to draw: long text slides in numbered parts.

    What a slide shows besides its text, and its notes (column notes, if there is one), come on its first part.
    Numbers run on over the deck.
    """
    chars = F.aggregate("body", F.lit(0), lambda s, x: s + F.length(x))
    long = F.col("kind").isin("text", "image_text") & ((F.size("body") > ITEMS) | (chars > CHARS))
    pages = F.when(long, paginate("body")).otherwise(F.array("body"))
    parts = slides.withColumn("pages", pages).select("*", F.posexplode("pages").alias("part", "page"))
    shown = F.when(F.col("part") == 0, F.col("shown_kind")).otherwise(F.col("kind"))
    title = F.when(F.size("pages") > 1, F.concat("title", F.lit(" (Phần "), (F.col("part") + 1).cast("string"), F.lit(")"))).otherwise(F.col("title"))
    visual = F.when(F.col("part") == 0, F.coalesce("diagram", "chart", "table"))
    notes = F.when(F.col("part") == 0, F.coalesce("notes", F.lit(""))).otherwise("") if "notes" in slides.columns else F.lit("")
    subtitle, body = _cover(F.col("page"), shown)
    number = F.row_number().over(Window.partitionBy("deck_id").orderBy("slide_no", "part"))
    return parts.select("deck_id", F.format_string("s%02d", number).alias("id"), shown.alias("kind"), title.alias("title"), subtitle.alias("subtitle"), body.alias("body"), visual.alias("visual"), notes.alias("notes"))


def slide_range(options: DataFrame) -> DataFrame:
    """options (min_slides, max_slides) with low, high, and reject: bounds outside 2 to 30 or the wrong way round."""
    low = F.greatest(F.lit(2), F.coalesce("min_slides", F.lit(5)))
    bad = ~F.coalesce("min_slides", F.lit(5)).between(2, 30) | ~F.coalesce("max_slides", F.lit(8)).between(2, 30) | (F.coalesce("min_slides", F.lit(5)) > F.coalesce("max_slides", F.lit(8)))
    return options.withColumn("low", low).withColumn("high", F.greatest(low, F.coalesce("max_slides", F.lit(8)))).withColumn("reject", bad)


def deck_quality(slides: DataFrame, low: int = 5, high: int = 8, dividers: bool = False, visuals: int | None = None, slide_chars: int = SLIDE_CHARS, block_chars: int = BLOCK_CHARS, blocks: int = BLOCKS) -> DataFrame:
    """deck_id, slide_no (-1 for the deck), rule: what breaks a rule in decks of slides (kind, title, text_block, n_blocks).

    dividers lets covers stand inside a deck. visuals is how many slides must show something; without it 1, in decks
    of 6 slides and more. A cover may have any number of blocks and characters but for those of one block.
    """
    order = Window.partitionBy("deck_id").orderBy("slide_no")
    rows = slides.withColumn("place", F.row_number().over(order)).withColumn("before", F.lag("title").over(order))
    text = F.coalesce("text_block", F.lit(""))
    on_slide = F.array(
        F.when((F.col("place") == 1) & (F.col("kind") != "cover"), F.lit("first_not_cover")),
        F.when((F.col("place") > 1) & (F.col("kind") == "cover") & ~F.lit(dividers), F.lit("extra_cover")),
        F.when((F.col("before") != "") & (F.lower("title") == F.lower("before")), F.lit("same_title")),
        F.when((F.col("kind") != "cover") & (F.col("n_blocks") > blocks), F.lit("block_count")),
        F.when((F.col("kind") != "cover") & (F.length(text) > slide_chars), F.lit("slide_chars")),
        F.when(F.length(text) > block_chars, F.lit("block_chars")),
        F.when(F.size(F.regexp_extract_all(text, F.lit(r"(?m)^\s*1\.\s+"), F.lit(0))) >= 2, F.lit("numbering")),
    )
    single = rows.select("deck_id", F.col("slide_no").cast("long").alias("slide_no"), F.explode(F.filter(on_slide, lambda x: x.isNotNull())).alias("rule"))
    decks = slides.groupBy("deck_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("kind").isin(*VISUAL).cast("int")).alias("visuals"))
    on_deck = F.array(F.when(~F.col("n").between(low, high), F.lit("slide_count")), F.when(F.col("visuals") < (F.when(F.col("n") >= 6, 1).otherwise(0) if visuals is None else F.lit(visuals)), F.lit("few_visuals")))
    whole = decks.select("deck_id", F.lit(-1).cast("long").alias("slide_no"), F.explode(F.filter(on_deck, lambda x: x.isNotNull())).alias("rule"))
    return single.unionByName(whole)


def chart_to_long(charts: DataFrame, key: str = "deck_id") -> DataFrame:
    """key, series, label, value from charts (categories, series: list of name and values)."""
    each = charts.select(key, "categories", F.explode("series").alias("s"))
    cells = F.explode(F.zip_with("categories", "s.values", lambda c, v: F.struct(c.alias("label"), v.alias("value"))))
    return each.select(key, F.col("s.name").alias("series"), cells.alias("x")).select(key, "series", "x.label", "x.value")


def diagram_cap(items: DataFrame) -> DataFrame:
    """items that are drawn, with label (two digits, in grids and timelines) and colour."""
    place = F.row_number().over(Window.partitionBy("deck_id", "slide_no").orderBy("item_no"))
    kept = items.withColumn("place", place).where(F.col("place") <= _case("diagram_type", 2))
    label = F.when(F.col("diagram_type").isin("paired_grid", "timeline"), F.lpad(F.col("place").cast("string"), 2, "0"))
    return kept.select("deck_id", "slide_no", "item_no", label.alias("label"), ((F.col("place") - 1) % PALETTE).cast("int").alias("colour"))


def resolve_target(owner: Column, target: Column) -> Column:
    """The package path of a reference: from the root, or from the folder above its owner's _rels folder."""
    folder = F.regexp_replace(F.regexp_replace(owner, r"/?[^/]*$", ""), r"(^|/)_rels(?=/|$)", "")
    joined = F.when(target.startswith("/"), target).otherwise(F.concat(folder, F.lit("/"), target))
    parts = F.filter(F.split(joined, "/"), lambda x: ~x.isin("", "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda s, x: F.when(x == "..", F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(x))))
    return F.array_join(kept, "/")


def dangling_refs(refs: DataFrame, members: DataFrame) -> DataFrame:
    """The internal references (pkg_id, owner, target, target_mode) whose target no member is or begins with."""
    inner = refs.where("coalesce(target_mode, '') <> 'External' and target <> '' and not startswith(target, 'http')")
    found = inner.withColumn("path", resolve_target(F.col("owner"), F.col("target")))
    missing = found.join(members.select("pkg_id", F.col("member").alias("path")).distinct(), ["pkg_id", "path"], "left_anti")
    held = members.select(F.col("pkg_id").alias("p"), "member")
    return missing.join(held, (F.col("p") == F.col("pkg_id")) & F.startswith("member", F.col("path")), "left_anti").select("pkg_id", "owner", "target", "path")


def qa_rollup(packages: DataFrame, members: DataFrame, broken: DataFrame) -> DataFrame:
    """pkg_id, passed, total_checks, blockers, warnings of packages (pkg_id, size, expected: null if not asked for)."""
    slide = F.startswith("member", F.lit("ppt/slides/slide")) & F.endswith("member", F.lit(".xml"))
    per = members.groupBy("pkg_id").agg(F.max((F.col("member") == "[Content_Types].xml").cast("int")).alias("types"), F.sum(slide.cast("int")).alias("slides"))
    refs = broken.groupBy("pkg_id").agg(F.count(F.lit(1)).alias("broken"))
    rows = packages.join(per, "pkg_id", "left").join(refs, "pkg_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    inside = (n("types") == 0).cast("int") + (n("slides") == 0).cast("int") + F.coalesce((n("slides") != F.col("expected")).cast("int"), F.lit(0))
    blockers = F.when(F.col("size").isNull() | (F.col("size") == 0), 1).otherwise(inside)
    checks = F.when(F.col("size").isNull(), 1).when(F.col("size") == 0, 2).otherwise(6 + F.col("expected").isNotNull().cast("int"))
    warnings = F.when(n("size") == 0, 0).otherwise((n("broken") > 0).cast("int"))
    return rows.select("pkg_id", (blockers == 0).alias("passed"), checks.alias("total_checks"), blockers.alias("blockers"), warnings.alias("warnings"))


def safe_name(name: Column | str) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^A-Za-z0-9_-]+", "-"), r"^-+|-+$", "")
    return F.when(bare == "", "presentation").otherwise(bare)
