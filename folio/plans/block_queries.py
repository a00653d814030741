"""Registered queries of document structure, packing and digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions.text import token_count
from folio.operators import blocks as B
from folio.operators import digests as G
from folio.plans.markdown_sql import blocks_sql
from folio.sources.fixtures import fixture, oracle, table

MD = "fx_md"


def _lined(s, d):
    return B.line_blocks(fixture(s, d, MD))


def _blocks(s, d):
    return B.extract_blocks(fixture(s, d, MD))


def _paths(s, d):
    return B.with_section_path(_blocks(s, d))


def _docs(s, d):
    return table(s, d, "documents").select("doc_id", F.col("source").alias("tenant_id"), F.col("text").alias("content"), token_count("text").alias("tokens"))


def _packed(s, d):
    # Sizes come first, so that of the texts only headings go to the windows.
    sized = B.compact_block(_blocks(s, d)).withColumn("size", token_count("compact"))
    sized = sized.select("doc_id", "block_no", "kind", "level", F.when(F.col("kind") == "heading", F.col("text")).alias("text"), "size")
    blocks = B.compact_sections(B.with_section_path(sized)).select("doc_id", "section_no", "block_no", "size")
    return G.pack_sections(blocks, limit=250).select("doc_id", "section_no", "block_no", "size", "part", "pack")


def _gate(s, d):
    whole, rest = G.budget_gate(_docs(s, d), "content")
    return whole.select("doc_id", F.lit("whole").alias("way")).union(rest.select("doc_id", F.lit("digest")))


def _cache(s, d):
    keyed = _docs(s, d).withColumn("cache_key", G.cache_key("m", F.col("content")))
    known = keyed.where("doc_id % 3 = 0").select("cache_key", F.lit("known").alias("digest")).distinct()
    new, old = G.pending(keyed, known)
    return new.select("doc_id", "cache_key", F.lit(None).cast("string").alias("digest")).unionByName(old.select("doc_id", "cache_key", "digest"))


def _digest(s, d):
    ids = F.transform(F.split("content", "\n"), lambda x, i: F.format_string("src-%04d", i + 1))
    return G.digest(_docs(s, d).select("doc_id", "content", ids.alias("ids")), ("doc_id",), "ids").select("doc_id", "title", "summary", F.size("key_points").alias("n_keys"), F.size("facts").alias("n_facts"), F.array_join("source_block_ids", " ").alias("sources"))


QUERIES = {
    "c1_extract_blocks": lambda s, d: _blocks(s, d).drop("line_no"),
    "c2_section_path": lambda s, d: _paths(s, d).select("doc_id", "block_no", "section_path"),
    "c3_list_items": lambda s, d: B.list_items(_lined(s, d)),
    "c4_table_extract": lambda s, d: B.extract_tables(_lined(s, d)).select("doc_id", "line_no", "headers", "rows", "text"),
    "c5_image_extract": lambda s, d: _blocks(s, d).where("kind = 'image'").select("doc_id", "id", "url", "alt", "text"),
    "c6_directive_extract": lambda s, d: _blocks(s, d).where("kind = 'directive'").select("doc_id", "id", "text"),
    "c7_code_extract": lambda s, d: _blocks(s, d).where("kind = 'code'").select("doc_id", "id", "language", "text"),
    "c8_doc_title": lambda s, d: B.doc_titles(_blocks(s, d)),
    "c9_compact_sections": lambda s, d: B.compact_sections(_paths(s, d)).select("doc_id", "block_no", "section_no", "section_path"),
    "c10_is_toc": lambda s, d: _paths(s, d).select("doc_id", "block_no", B.is_toc(F.col("section_path")).alias("toc"), F.transform("section_path", B.fold).alias("folded")),
    "c11_compact_block": lambda s, d: B.compact_block(_blocks(s, d)).select("doc_id", "block_no", "compact"),
    "c12_pack_sections": _packed,
    "c13_budget_gate": _gate,
    "c14_digest_cache": _cache,
    "c15_extractive_digest": _digest,
    "c16_reduce_rounds": lambda s, d: G.tree_reduce(table(s, d, "documents").select("doc_id", "text"), budget=900),
}

_PLAIN = r"trim(regexp_replace(regexp_replace({0}, '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[*`]+|__', '', 'g'))"
_IMG, _DIR, _ITEM = r"'!\[([^\]]*)\]\(([^)\s]+)[^)]*\)'", r"'<!--\s*slide:\s*(.*?)\s*-->'", r"'^\s*(?:[-*+]|\d{1,9}[.)])\s+'"
#: Lines, then runs of lines of one kind (lb), list items (li), tables (tb), blocks (bl), and blocks with paths (bp).
_CHAIN = rf"""{blocks_sql("select doc_id, md from fx_md")},
  i1 as (select doc_id, line_no, unnest(lines) as line, generate_subscripts(lines, 1) - 1 as item from lb where kind = 'list'),
  i2 as (select doc_id, line_no, item::int as item, least(5, length(regexp_extract(line, '^(\s*)', 1)) // 2)::int as depth, regexp_extract(line, '^\s*(\d{{1,9}})[.)]', 1) <> '' as ordered, try_cast(nullif(regexp_extract(line, '^\s*(\d{{1,9}})[.)]', 1), '') as int) as mark, {_PLAIN.format(f"regexp_replace(line, {_ITEM}, '')")} as text from i1),
  i3 as (select a.*, (select count(*) from i2 b where b.doc_id = a.doc_id and b.line_no = a.line_no and b.item <= a.item and b.depth < a.depth) as parent from i2 a),
  li as (select doc_id, line_no, item, depth, ordered, case when ordered then (first_value(mark) over w + row_number() over w - 1)::int end as number, text from i3 window w as (partition by doc_id, line_no, depth, parent order by item)),
  lt as (select doc_id, line_no, string_agg(repeat('  ', depth) || coalesce(number::varchar || '.', '-') || ' ' || text, chr(10) order by item) as list_text from li group by all),
  tb as (select doc_id, line_no, hs as headers, list_transform(list_filter(lines[2:], lambda x: not regexp_matches(x, '^\|[\s:|-]*\|\s*$')), lambda x: list_transform(string_split(regexp_replace(trim(x), '^\||\|$', '', 'g'), '|'), lambda c: trim(c))) as rows, 'Table with headers: ' || array_to_string(hs, ', ') as text
    from (select *, list_transform(string_split(regexp_replace(trim(lines[1]), '^\||\|$', '', 'g'), '|'), lambda c: trim(c)) as hs from lb where kind = 'table')),
  pt as (select *, array_to_string(lines, chr(10)) as t from lb where kind = 'paragraph'),
  b0 as (
    select doc_id, line_no, 0 as part, 'heading' as kind, {_PLAIN.format(r"regexp_replace(lines[1], '^#{1,6}(?:[ \t]+|$)|[ \t]+#*[ \t]*$', '', 'g')")} as text, length(regexp_extract(lines[1], '^(#{{1,6}})', 1))::int as level, null as language, null as url, null as alt from lb where kind = 'heading'
    union all select doc_id, line_no, 0, 'code', regexp_replace(array_to_string(lines[2:len(lines) - 1], chr(10)), '^\s+|\s+$', '', 'g'), null, substr(lines[1], 4), null, null from lb where kind = 'code'
    union all select doc_id, line_no, 0, 'list', list_text, null, null, null, null from lt
    union all select doc_id, line_no, 0, 'table', text, null, null, null, null from tb
    union all select doc_id, line_no, 0, 'paragraph', p, null, null, null, null from (select *, {_PLAIN.format(rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, {_IMG}, '', 'g'), {_DIR}, '', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{{2,}}|[ \t]{{2,}}', ' ', 'g')")} as p from pt) where p <> ''
    union all select doc_id, line_no, 1000 + generate_subscripts(urls, 1), 'image', unnest(list_transform(list_zip(alts, urls), lambda x: coalesce(nullif(x[1], ''), x[2]))), null, null, unnest(urls), unnest(alts) from (select doc_id, line_no, regexp_extract_all(t, {_IMG}, 1) as alts, regexp_extract_all(t, {_IMG}, 2) as urls from pt)
    union all select doc_id, line_no, 2000 + generate_subscripts(ds, 1), 'directive', unnest(ds), null, null, null, null from (select doc_id, line_no, regexp_extract_all(t, {_DIR}, 1) as ds from pt)),
  bl as (select b0.doc_id, b0.line_no, row_number() over (partition by b0.doc_id order by b0.line_no, part)::int as block_no, kind, b0.text, level, language, url, alt, tb.headers, tb.rows from b0 left join tb on tb.doc_id = b0.doc_id and tb.line_no = b0.line_no),
  bp as (select *, list_filter([{", ".join(f"case when last_value(case when level <= {k} then level end ignore nulls) over w = {k} then nullif(last_value(case when level <= {k} then text end ignore nulls) over w, '') end" for k in range(1, 7))}], lambda x: x is not null) as section_path from bl window w as (partition by doc_id order by block_no)),
  bf as (select *, list_transform(section_path, lambda p: trim(strip_accents(lower(p)), ' #:.-')) as folded from bp)"""
_ID = "'src-' || lpad(block_no::varchar, 4, '0')"
_TOC = "len(list_filter(folded, lambda x: x in ('muc luc', 'table of contents', 'contents'))) > 0"


def _of(sql: str) -> str:
    """sql, or more common table expressions and sql, over the chain."""
    return oracle(f"with {_CHAIN}{' ' if sql.startswith('select') else ', '}{sql}", MD)


_COMPACT = f"""(case kind when 'list' then to_json({{'id': {_ID}, 'kind': kind, 'items': list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')}})
        when 'table' then to_json({{'id': {_ID}, 'kind': kind, 'headers': headers, 'rows': rows}})
        when 'image' then to_json({{'id': {_ID}, 'kind': kind, 'alt': alt, 'url': url}}) when 'code' then to_json({{'id': {_ID}, 'kind': kind, 'language': language, 'code': substr(text, 1, 2400)}})
        else to_json({{'id': {_ID}, 'kind': kind, 'text': text}}) end)::varchar"""
_TOK = "greatest(1, (length(text) + 2) // 3)"
ORACLES = {
    "c1_extract_blocks": _of(f"select doc_id, block_no, {_ID} as id, kind, text, level, language, url, alt, headers, rows from bl"),
    "c2_section_path": _of("select doc_id, block_no, section_path from bp"),
    "c3_list_items": _of("select * from li"),
    "c4_table_extract": _of("select * from tb"),
    "c5_image_extract": _of(f"select doc_id, {_ID} as id, url, alt, text from bl where kind = 'image'"),
    "c6_directive_extract": _of(f"select doc_id, {_ID} as id, text from bl where kind = 'directive'"),
    "c7_code_extract": _of(f"select doc_id, {_ID} as id, language, text from bl where kind = 'code'"),
    "c8_doc_title": _of("select doc_id, coalesce(arg_min(text, block_no) filter (where kind = 'heading' and level = 1 and text <> ''), arg_min(text, block_no) filter (where kind = 'heading' and text <> ''), 'Untitled Presentation') as title from bl group by doc_id"),
    "c9_compact_sections": _of(f"select doc_id, block_no, sum(new) over (partition by doc_id order by block_no)::int as section_no, section_path from (select *, case when lag(section_path) over (partition by doc_id order by block_no) is not distinct from section_path then 0 else 1 end as new from bf where kind <> 'heading' and not ({_TOC}))"),
    "c10_is_toc": _of(f"select doc_id, block_no, {_TOC} as toc, folded from bf"),
    "c11_compact_block": _of(
        f"select doc_id, block_no, {_COMPACT} as compact from bl"
    ),
    "c12_pack_sections": _of(
        f"""sz as (select doc_id, block_no, sum(new) over (partition by doc_id order by block_no)::int as section_no, greatest(1, (length({_COMPACT}) + 2) // 3)::int as size, row_number() over (partition by doc_id order by block_no) as n
          from (select *, case when lag(section_path) over (partition by doc_id order by block_no) is not distinct from section_path then 0 else 1 end as new from bf where kind <> 'heading' and not ({_TOC}))),
        r1 as (select *, 0 as part, size::bigint as total from sz where n = 1
          union all select s.*, case when s.section_no <> r.section_no or r.total + s.size > 250 then r.part + 1 else r.part end, case when s.section_no <> r.section_no or r.total + s.size > 250 then s.size else r.total + s.size end from r1 r join sz s on s.doc_id = r.doc_id and s.n = r.n + 1),
        ps as (select doc_id, part, sum(size)::bigint as size from r1 group by all),
        r2 as (select doc_id, part, 0 as pack, size as total from ps where part = 0
          union all select p.doc_id, p.part, case when r.total + p.size > 250 then r.pack + 1 else r.pack end, case when r.total + p.size > 250 then p.size else r.total + p.size end from r2 r join ps p on p.doc_id = r.doc_id and p.part = r.part + 1)
        select r1.doc_id, section_no, block_no, size, r1.part::int as part, pack::int as pack from r1 join r2 on r2.doc_id = r1.doc_id and r2.part = r1.part"""
    ),
    "c13_budget_gate": f"select doc_id, case when {_TOK} <= 3600 then 'whole' else 'digest' end as way from documents",
    "c14_digest_cache": "select doc_id, k as cache_key, case when k in (select sha256('v1:m:' || text) from documents where doc_id % 3 = 0) then 'known' end as digest from (select doc_id, sha256('v1:m:' || text) as k from documents)",
    "c15_extractive_digest": r"""with s as (select doc_id, unnest(l) as sentence, generate_subscripts(l, 1) - 1 as n from (select doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') as l from documents)),
        e as (select doc_id, n, unnest(list_filter(regexp_split_to_array(lower(sentence), '[^\p{L}\p{N}]+'), lambda x: x <> '')) as term from s),
        c as (select doc_id, term, ln(1 + count(*)) as w from e group by all),
        m as (select doc_id, n, round(avg(w), 9) as weight from e join c using (doc_id, term) group by all),
        r as (select s.*, coalesce(weight, 0) as weight, regexp_matches(sentence, '[0-9]') as fact from s left join m using (doc_id, n)),
        k as (select r.*, row_number() over (partition by r.doc_id order by weight desc, n) as best, len(string_split(text, chr(10))) as lines from r join documents using (doc_id))
        select doc_id, substr(arg_min(sentence, n), 1, 120) as title, substr(string_agg(sentence, ' ' order by n) filter (where best <= 6), 1, 600) as summary, least(6, count(*))::int as n_keys, least(8, count(*) filter (where fact))::int as n_facts,
          (select string_agg('src-' || lpad(i::varchar, 4, '0'), ' ' order by i) from range(1, 13) t(i) where i <= any_value(k.lines)) as sources from k group by doc_id""",
}


def _reduced(source: str, k: int, budget: int, pack: int = 4200) -> str:
    """One round of digests over source (doc_id, text), as common table expressions: d{k} (doc_id, text) of what is over the budget."""
    tok = "greatest(1, (length({0}) + 2) // 3)"
    return rf"""p{k} as (select doc_id, unnest(l) as piece, generate_subscripts(l, 1) - 1 as n from (select doc_id, string_split(text, chr(10)) as l from {source} where {tok.format('text')} > {budget})),
  k{k} as (select doc_id, n, 0 as pack, {tok.format('piece')}::bigint as total, piece from p{k} where n = 0
    union all select p.doc_id, p.n, case when r.total + {tok.format('p.piece')} > {pack} then r.pack + 1 else r.pack end, case when r.total + {tok.format('p.piece')} > {pack} then {tok.format('p.piece')} else r.total + {tok.format('p.piece')} end, p.piece
    from k{k} r join p{k} p on p.doc_id = r.doc_id and p.n = r.n + 1),
  c{k} as (select doc_id, pack, string_agg(piece, chr(10) order by n) as content from k{k} group by doc_id, pack),
  s{k} as (select doc_id, pack, unnest(l) as sentence, generate_subscripts(l, 1) - 1 as n from (select doc_id, pack, list_filter(string_split(regexp_replace(content, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') as l from c{k})),
  e{k} as (select doc_id, pack, n, unnest(list_filter(regexp_split_to_array(lower(sentence), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) as term from s{k}),
  w{k} as (select doc_id, pack, term, ln(1 + count(*)) as w from e{k} group by all),
  m{k} as (select doc_id, pack, n, round(avg(w), 9) as weight from e{k} join w{k} using (doc_id, pack, term) group by all),
  b{k} as (select s.*, row_number() over (partition by s.doc_id, s.pack order by coalesce(weight, 0) desc, s.n) as best from s{k} s left join m{k} m on m.doc_id = s.doc_id and m.pack = s.pack and m.n = s.n),
  d{k} as (select doc_id, string_agg(summary, chr(10) order by pack) as text from (select doc_id, pack, substr(string_agg(sentence, ' ' order by n) filter (where best <= 6), 1, 600) as summary from b{k} group by doc_id, pack) group by doc_id)"""


ORACLES["c16_reduce_rounds"] = f"""with recursive {_reduced("documents", 1, 900)}, {_reduced("d1", 2, 900)}
  select doc_id, text, 0 as rounds from documents where {_TOK} <= 900 union all select doc_id, text, 1 from d1 where {_TOK} <= 900 union all select doc_id, text, 2 from d2"""
