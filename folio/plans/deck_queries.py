"""Registered queries of templates and decks."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import decks as J
from folio.operators import templates as T
from folio.sources.fixtures import fixture, oracle, table

TPL, REC, SLIDE, ITEM = "fx_template", "fx_record", "fx_slide", "fx_diagram_item"


def _records(s, d):
    values = F.create_map(F.lit("name"), "name", F.lit("segment"), "segment", F.lit("balance"), "balance", F.lit("extra"), F.lit("x"))
    return fixture(s, d, REC).select("rec_id", F.array(F.lit(1), F.lit(2)).alias("tpl_ids"), values.alias("values"))


def _asked(s, d):
    return _records(s, d).select("rec_id", "values", F.explode("tpl_ids").alias("tpl_id"))


def _normalized(s, d):
    rows = _asked(s, d).join(T.placeholders(fixture(s, d, TPL)).hint("merge"), "tpl_id").withColumn("m", T.normalize_mapping("fields", "values"))
    return rows.select("rec_id", "tpl_id", F.expr("array_join(transform(fields, f -> f || '=' || m[f]), '|')").alias("mapping"))


def _lines(s, d):
    return table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("part_no", "part"))


def _placed(s, d):
    conv = table(s, d, "conversations")
    parts = conv.select(F.col("conv_id").alias("tpl_id"), F.col("turn").cast("int").alias("part_no"), F.when(F.col("turn") >= 1, F.concat("text", F.lit(" [[A]]"))).otherwise(F.col("text")).alias("part"))
    made = conv.select(F.col("conv_id").alias("tpl_id")).distinct().select("tpl_id", F.explode(F.expr("array(struct(0 as made_no, '[[A]]' as marker, 'made a' as text), struct(1 as made_no, '[[B]]' as marker, 'made b' as text), struct(2 as made_no, '[[C]]' as marker, '' as text))")).alias("x")).select("tpl_id", "x.*")
    return T.place_paragraphs(parts, made)


def _slide_blocks(s, d):
    base = fixture(s, d, SLIDE).select("deck_id", "slide_no", "kind", "title", "text_block")
    n = F.col("slide_no")
    blocks = F.array(
        F.struct(F.lit(0).alias("block_no"), F.lit("text").alias("type"), F.col("text_block").alias("text"), F.lit(None).cast("string").alias("payload")),
        F.when(n % 6 == 3, F.struct(F.lit(1).alias("block_no"), F.lit("table").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("t1").alias("payload"))),
        F.when(F.col("kind") == "chart", F.struct(F.lit(2).alias("block_no"), F.lit("chart").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("bar").alias("payload"))),
        F.when(F.col("kind") == "chart", F.struct(F.lit(3).alias("block_no"), F.lit("chart").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("line").alias("payload"))),
        F.when(n % 5 == 2, F.struct(F.lit(4).alias("block_no"), F.lit("diagram").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("timeline").alias("payload"))),
    )
    return base.select("deck_id", "slide_no", "kind", "title", F.explode(F.filter(blocks, lambda x: x.isNotNull())).alias("b")).select("deck_id", "slide_no", "kind", "title", "b.*")


def _components(s, d):
    return J.with_subtitle(J.slide_components(_slide_blocks(s, d))).select("deck_id", "slide_no", "shown_kind", "title", "subtitle", F.array_join("body", "|").alias("body"), "chart", "table", "diagram")


def _plan(s, d):
    slides = J.slide_components(_slide_blocks(s, d)).withColumn("notes", F.concat(F.lit("say "), "title"))
    return J.compose_plan(slides).withColumn("body", F.array_join("body", "|"))


def _options(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", F.nullif(F.col("turn") * 5 - 1, F.lit(4)).alias("min_slides"), F.nullif(F.col("conv_id") % 35, F.lit(7)).alias("max_slides"))


def _charts(s, d):
    rows = table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n"), F.length("role").alias("r")))).alias("l"))
    cats = F.transform("l", lambda x: F.concat(F.lit("turn "), x.turn.cast("string")))
    series = F.array(F.struct(F.lit("text").alias("name"), F.col("l.n").alias("values")), F.struct(F.lit("role").alias("name"), F.col("l.r").alias("values")))
    return J.chart_to_long(rows.select(F.col("conv_id").alias("deck_id"), cats.alias("categories"), series.alias("series")))


def _rollup(s, d):
    pages = table(s, d, "pages").select(F.col("page_id").alias("pkg_id"), F.when(F.col("page_id") % 11 > 0, F.length("html") * (F.col("page_id") % 13 > 0).cast("int")).alias("size"), F.when(F.col("page_id") % 3 > 0, (F.col("page_id") % 4).cast("int")).alias("expected"))
    members = fixture(s, d, "fx_member")
    return J.qa_rollup(pages, members, J.dangling_refs(fixture(s, d, "fx_ref"), members))


QUERIES = {
    "i1_placeholders": lambda s, d: T.placeholders(_lines(s, d).select(F.col("doc_id").alias("tpl_id"), "part_no", F.regexp_replace("part", r"(\w{5,})", "{{ $1 }}").alias("part"))),
    "i2_fill_template": lambda s, d: _asked(s, d).join(fixture(s, d, TPL).hint("merge"), "tpl_id").select("rec_id", "tpl_id", "part_no", T.fill("part", "values").alias("part")),
    "i3_normalize_mapping": _normalized,
    "i4_template_summary": lambda s, d: T.template_summary(_lines(s, d), "doc_id"),
    "i5_place_paragraphs": _placed,
    "i6_mail_merge": lambda s, d: T.mail_merge(fixture(s, d, TPL), _records(s, d), "20240101"),
    "j1_validate_deck": lambda s, d: J.validate_deck(fixture(s, d, ITEM)),
    "j2_text_items": lambda s, d: table(s, d, "conversations").select("conv_id", "turn", J.text_items("text").alias("items")),
    "j3_paginate": lambda s, d: table(s, d, "documents").select("doc_id", F.split("text", r"(?<=[.!?])\s+").alias("items")).select("doc_id", F.posexplode(J.paginate("items")).alias("page", "lines")).select("doc_id", "page", F.array_join("lines", "|").alias("body")),
    "j4_slide_components": _components,
    "j5_compose_plan": _plan,
    "j6_deck_quality": lambda s, d: J.deck_quality(fixture(s, d, SLIDE).withColumn("n_blocks", F.col("slide_no") % 7)),
    "j7_slide_range": lambda s, d: J.slide_range(_options(s, d)).select("conv_id", "turn", "low", "high", "reject"),
    "j8_chart_to_long": _charts,
    "j9_diagram_cap": lambda s, d: J.diagram_cap(fixture(s, d, ITEM)),
    "j10_dangling_refs": lambda s, d: J.dangling_refs(fixture(s, d, "fx_ref"), fixture(s, d, "fx_member")),
    "j11_qa_rollup": _rollup,
    "j12_safe_name": lambda s, d: fixture(s, d, "fx_file").select("page_id", J.safe_name("filename").alias("name")),
}

_FILLED = r"""regexp_replace(regexp_replace(regexp_replace({0}, '\{{\{{\s*name\s*\}}\}}', r.name, 'g'), '\{{\{{\s*segment\s*\}}\}}', r.segment, 'g'), '\{{\{{\s*balance\s*\}}\}}', r.balance, 'g')"""
_BLANK = r"regexp_replace(regexp_replace({0}, '\{{\{{\s*missing\s*\}}\}}', '', 'g'), '\{{\{{\s*intro\s*\}}\}}', '', 'g')"
_L = "list_transform(list_filter(list_transform(string_split({0}, chr(10)), lambda x: trim(x)), lambda x: x <> ''), lambda x: regexp_replace(x, '^(?:[-*•]|\\d+[.)])\\s*', ''))"


def _items(text: str) -> str:
    """SQL for text_items of a column, as a scalar over nested selects."""
    semi = "case when len(l) = 1 and len(string_split(l[1], ';')) >= 3 then list_filter(list_transform(string_split(l[1], ';'), lambda x: trim(x)), lambda x: x <> '') else l end"
    sent = "case when len(m) = 1 and length(m[1]) > 500 then string_split(regexp_replace(m[1], '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) else m end"
    return f"(select {sent} from (select {semi} as m from (select {_L.format(text)} as l)))"


def _pages(source: str, keys: str) -> str:
    """Recursive greedy pages over source (keys, items): the CTEs it, pg."""
    on = " and ".join(f"it.{k} = pg.{k}" for k in keys.split(", "))
    full = "pg.n_items >= 6 or pg.chars + length(it.item) > 500"
    first, rest = ", ".join(f"it.{k}" for k in keys.split(", ")), keys
    return f"""it as (select {keys}, unnest(items) as item, generate_subscripts(items, 1) as n from ({source})),
      pg as (select {rest}, n, item, 0 as page, 1 as n_items, length(item)::bigint as chars from it where n = 1
        union all select {first}, it.n, it.item, case when {full} then pg.page + 1 else pg.page end, case when {full} then 1 else pg.n_items + 1 end, case when {full} then length(it.item) else pg.chars + length(it.item) end from pg join it on {on} and it.n = pg.n + 1)"""


_COMP = f"""select deck_id, slide_no, kind, title, {_items('text_block')} as body, case when kind = 'chart' then 'line' end as chart, case when slide_no % 6 = 3 then 't1' end as "table", case when slide_no % 5 = 2 then 'timeline' end as diagram from fx_slide"""
_SHOWN = """case when diagram is not null then 'diagram' when chart is not null then 'chart' when "table" is not null then 'table' else kind end"""
_PATH = "case when target like '/%' then substr(target, 2) else 'ppt/' || substr(target, 4) end"
_DANGLING = f"""select pkg_id, owner, target, {_PATH} as path from fx_ref r where coalesce(target_mode, '') <> 'External' and target not like 'http%'
  and not exists (select 1 from fx_member m where m.pkg_id = r.pkg_id and starts_with(m.member, {_PATH}))"""

ORACLES = {
    "i1_placeholders": r"""with p as (select doc_id, unnest(l) as part, generate_subscripts(l, 1) as n from (select doc_id, string_split(text, chr(10)) as l from documents)),
        w as (select doc_id, n, unnest(ws) as name, generate_subscripts(ws, 1) as i from (select doc_id, n, regexp_extract_all(part, '[a-zA-Z0-9_]{5,}') as ws from p)),
        f as (select doc_id, name, min(n * 1000000 + i) as at_place from w group by all)
        select d.doc_id as tpl_id, coalesce(list(name order by at_place) filter (where name is not null), []) as fields from documents d left join f using (doc_id) group by d.doc_id""",
    "i2_fill_template": oracle(f"select r.rec_id, t.tpl_id, t.part_no, {_FILLED.format('t.part')} as part from fx_record r, fx_template t", REC, TPL),
    "i3_normalize_mapping": oracle("select rec_id, 1 as tpl_id, 'name=' || name || '|segment=' || segment || '|balance=' || balance || '|missing=' as mapping from fx_record union all select rec_id, 2, 'intro=' from fx_record", REC),
    "i4_template_summary": "select doc_id, substr(array_to_string(list_filter(list_transform(string_split(text, chr(10))[1:10], lambda x: trim(x)), lambda x: x <> ''), ' '), 1, 800) as summary from documents where len(list_filter(string_split(text, chr(10))[1:10], lambda x: trim(x) <> '')) > 0",
    "i5_place_paragraphs": """select conv_id as tpl_id, turn::int as part_no, case when turn >= 1 then text || ' ' || case when turn = m then 'made a' else '[[A]]' end else text end as part from (select *, min(case when turn >= 1 then turn end) over (partition by conv_id) as m from conversations)
        union all select conv_id, (max(turn) + 2)::int, 'made b' from conversations group by conv_id
        union all select conv_id, (max(turn) + 1)::int, 'made a' from conversations group by conv_id having max(turn) < 1""",
    "i6_mail_merge": oracle(
        f"select r.rec_id, t.tpl_id, 'letter_generated_20240101_' || substr(md5(t.tpl_id::varchar || '_' || r.rec_id::varchar), 1, 8) as name, string_agg({_BLANK.format(_FILLED.format('t.part'))}, chr(10) order by t.part_no) as text from fx_record r, fx_template t group by r.rec_id, t.tpl_id",
        REC, TPL,
    ),
    "j1_validate_deck": oracle(
        """with p as (select deck_id, slide_no, diagram_type as t, count(*) as n, count(*) filter (where length(title) > 50) as a, count(*) filter (where length(description) > 120) as b from fx_diagram_item group by all)
        select deck_id, slide_no, 'item_count' as rule, n from p where n < case t when 'three_columns' then 3 when 'relationship' then 2 else 4 end or n > case t when 'three_columns' then 3 when 'relationship' then 3 when 'timeline' then 7 else 6 end
        union all select deck_id, slide_no, 'title_length', a from p where a > 0 union all select deck_id, slide_no, 'description_length', b from p where b > 0""",
        ITEM,
    ),
    "j2_text_items": f"select conv_id, turn, {_items('text')} as items from conversations",
    "j3_paginate": f"""with recursive {_pages("select doc_id, string_split(regexp_replace(text, '([.!?])" + chr(92) + "s+', '" + chr(92) + "1' || chr(1), 'g'), chr(1)) as items from documents", "doc_id")}
        select doc_id, page::int as page, string_agg(item, '|' order by n) as body from pg group by doc_id, page""",
    "j4_slide_components": oracle(
        f"""select deck_id, slide_no, k as shown_kind, title, case when k = 'cover' and len(body) > 0 then body[1] end as subtitle, coalesce(array_to_string(case when k = 'cover' and len(body) > 0 then body[2:] else body end, '|'), '') as body, chart, "table", diagram
        from (select *, {_SHOWN} as k from ({_COMP}))""",
        SLIDE,
    ),
    "j5_compose_plan": oracle(
        f"""with c as (select *, {_SHOWN} as shown, kind in ('text', 'image_text') and (len(body) > 6 or list_sum(list_transform(body, lambda x: length(x))) > 500) as long from ({_COMP})),
        {_pages('select deck_id, slide_no, body as items from c where long', 'deck_id, slide_no')},
        parts as (select deck_id, slide_no, page, list(item order by n) as body from pg group by deck_id, slide_no, page union all select deck_id, slide_no, 0, body from c where not coalesce(long, false)),
        z as (select p.deck_id, p.slide_no, p.page, p.body, c.title, coalesce(c.diagram, c.chart, c."table") as v, case when p.page = 0 then c.shown else c.kind end as k, count(*) over (partition by p.deck_id, p.slide_no) as n, row_number() over (partition by p.deck_id order by p.slide_no, p.page) as i from parts p join c on c.deck_id = p.deck_id and c.slide_no = p.slide_no)
        select deck_id, 's' || lpad(i::varchar, greatest(2, length(i::varchar))::int, '0') as id, k as kind, case when n > 1 then title || ' (Phần ' || (page + 1)::varchar || ')' else title end as title,
          case when k = 'cover' and len(body) > 0 then body[1] end as subtitle, coalesce(array_to_string(case when k = 'cover' and len(body) > 0 then body[2:] else body end, '|'), '') as body, case when page = 0 then v end as visual, case when page = 0 then 'say ' || title else '' end as notes from z""",
        SLIDE,
    ),
    "j6_deck_quality": oracle(
        r"""with s as (select *, row_number() over w as place, lag(title) over w as before, length(text_block) as chars from fx_slide window w as (partition by deck_id order by slide_no)),
        d as (select deck_id, count(*) as n, count(*) filter (where kind in ('diagram', 'chart', 'table', 'image_text')) as v from fx_slide group by all)
        select deck_id, slide_no::bigint as slide_no, 'first_not_cover' as rule from s where place = 1 and kind <> 'cover' union all select deck_id, slide_no, 'extra_cover' from s where place > 1 and kind = 'cover'
        union all select deck_id, slide_no, 'same_title' from s where lower(title) = lower(before) union all select deck_id, slide_no, 'slide_chars' from s where kind <> 'cover' and chars > 900
        union all select deck_id, slide_no, 'block_count' from s where kind <> 'cover' and slide_no % 7 > 4
        union all select deck_id, slide_no, 'block_chars' from s where chars > 650 union all select deck_id, slide_no, 'numbering' from s where len(regexp_extract_all(text_block, '(?m)^\s*1\.\s+')) >= 2
        union all select deck_id, -1, 'slide_count' from d where n not between 5 and 8 union all select deck_id, -1, 'few_visuals' from d where n >= 6 and v < 1""",
        SLIDE,
    ),
    "j7_slide_range": """select conv_id, turn, greatest(2, a) as low, greatest(2, a, b) as high, not (a between 2 and 30) or not (b between 2 and 30) or a > b as reject
        from (select conv_id, turn, coalesce(nullif(turn * 5 - 1, 4), 5) as a, coalesce(nullif(conv_id % 35, 7), 8) as b from conversations)""",
    "j8_chart_to_long": "select conv_id as deck_id, 'text' as series, 'turn ' || turn::varchar as label, length(text)::int as value from conversations union all select conv_id, 'role', 'turn ' || turn::varchar, length(role)::int from conversations",
    "j9_diagram_cap": oracle(
        """select deck_id, slide_no, item_no, case when diagram_type in ('paired_grid', 'timeline') then lpad(p::varchar, 2, '0') end as label, ((p - 1) % 5)::int as colour
        from (select *, row_number() over (partition by deck_id, slide_no order by item_no) as p from fx_diagram_item) where p <= case diagram_type when 'three_columns' then 3 when 'relationship' then 3 when 'timeline' then 7 else 6 end""",
        ITEM,
    ),
    "j10_dangling_refs": oracle(_DANGLING, "fx_ref", "fx_member"),
    "j11_qa_rollup": oracle(
        f"""with g as ({_DANGLING}), p as (select page_id as pkg_id, case when page_id % 11 > 0 then length(html) * (page_id % 13 > 0)::int end as size, case when page_id % 3 > 0 then (page_id % 4)::int end as expected from pages),
        m as (select pkg_id, max((member = '[Content_Types].xml')::int) as types, count(*) filter (where member like 'ppt/slides/slide%.xml') as slides from fx_member group by all),
        x as (select p.*, coalesce(types, 0) as types, coalesce(slides, 0) as slides, (select count(*) from g where g.pkg_id = p.pkg_id) as broken from p left join m using (pkg_id)),
        y as (select *, case when size is null or size = 0 then 1 else (types = 0)::int + (slides = 0)::int + coalesce((slides <> expected)::int, 0) end as blockers from x)
        select pkg_id, blockers = 0 as passed, (case when size is null then 1 when size = 0 then 2 else 6 + (expected is not null)::int end)::int as total_checks, blockers::int as blockers, (case when coalesce(size, 0) = 0 then 0 else (broken > 0)::int end)::int as warnings from y""",
        "fx_ref", "fx_member",
    ),
    "j12_safe_name": oracle("select page_id, coalesce(nullif(trim(regexp_replace(filename, '[^A-Za-z0-9_-]+', '-', 'g'), '-'), ''), 'presentation') as name from fx_file", "fx_file"),
}
