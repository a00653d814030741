"""Registered queries of chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions.text import token_count
from folio.operators import chunking as K
from folio.plans.markdown_sql import lines_sql
from folio.sources.fixtures import fixture, oracle, table

MD = "fx_md"


def _sections(s, d):
    return K.split_headers(fixture(s, d, MD))


def _documents(s, d):
    """Documents as sections without headers."""
    return table(s, d, "documents").select("doc_id", F.lit(0).alias("section"), F.col("lang").alias("h1"), F.lit(None).cast("string").alias("h2"), F.col("text").alias("content"))


QUERIES = {
    "b1_isolate_tables": lambda s, d: fixture(s, d, MD).select("doc_id", K.isolate_tables("md").alias("md")),
    "b2_split_by_header": _sections,
    "b3_split_structural": lambda s, d: K.split_structural(_documents(s, d)).select("doc_id", "piece", "content"),
    "b5_merge_small": lambda s, d: K.merge_small(fixture(s, d, "fx_section"), "tenant_id", "idx"),
    "b6_split_semantic": lambda s, d: K.split_semantic(_documents(s, d), ("doc_id",)),
    "b7_hard_cap_split": lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(K.hard_cap("text", 300, 20)).alias("run", "content")),
    "b8_inject_header_context": lambda s, d: _sections(s, d).select("doc_id", "section", K.inject_context("content", "h1", "h2").alias("content")),
    "b9_chunk_method": lambda s, d: fixture(s, d, "fx_doc").select("doc_id", K.label_method(token_count("content")).alias("method")),
    "b11_chunk_documents": lambda s, d: K.chunk_documents(fixture(s, d, MD)),
}

_ISOLATED = r"regexp_replace(md, '(?m)((?:^\|.*\|$\n)*^\|.*\|$)\n?', chr(10) || chr(10) || '\1' || chr(10) || chr(10), 'g')"


def _headers(source: str) -> str:
    return rf"""with recursive {lines_sql(source)} select doc_id, section, first(h1) as h1, first(h2) as h2, content from (select doc_id, section, any_value(h1) as h1, any_value(h2) as h2, regexp_replace(string_agg(line, chr(10) order by n), '^\s+|\s+$', '', 'g') as content from (
      select doc_id, n, line, count(level) over w as section, last_value(case when level = 1 then title end ignore nulls) over w as h1,
        case when last_value(level ignore nulls) over w = 2 then last_value(case when level is not null then title end ignore nulls) over w end as h2
      from (select *, case when not code and regexp_matches(line, '^#{{1,2}}[ \t]+\S') then case when line like '##%' then 2 else 1 end end as level, trim(regexp_replace(line, '^#{{1,2}}[ \t]+|[ \t]+#*[ \t]*$', '', 'g')) as title from md_lines)
      window w as (partition by doc_id order by n)) group by doc_id, section) where content <> '' group by doc_id, section, content"""


def _merged(source: str, key: str) -> str:
    """Greedy merging as a recursion over the sections' places."""
    tok = "greatest(1, ({} + 2) // 3)"
    now, new = tok.format("r.chars"), tok.format("length(s.content)")
    joins = f"r.h1 is not distinct from s.h1 and {now} + {new} < 1500 and ({now} < 200 or {now} + {new} < 700)"
    return f"""src as ({source}), r as (
      select {key}, idx, 0 as merged, length(content)::bigint as chars, h1 from src where idx = 0
      union all select s.{key}, s.idx, case when {joins} then r.merged else r.merged + 1 end, case when {joins} then r.chars + 2 + length(s.content) else length(s.content) end, s.h1
      from r join src s on s.{key} = r.{key} and s.idx = r.idx + 1)"""


def _capped(source: str, keys: str, cap: int, overlap: int) -> str:
    """Runs of at most cap * 3 characters of whole words, every (cap - overlap) * 3 characters, of source (keys, content)."""
    size, step, longest = 3 * cap, 3 * (cap - overlap), min(200, 3 * overlap - 2)
    edge, inner = "chr(1)", "'[^ ' || chr(1) || ']+'"
    before = f"start > 0 and substr(m, start, 1) not in (' ', {edge})"
    after = f"start + {size} < length(m) and substr(m, start + {size} + 1, 1) not in (' ', {edge})"
    left = f"case when {before} then regexp_replace(p, '^' || {inner}, '') else p end"
    right = f"case when {after} then regexp_replace(q, {inner} || '$', '') else q end"
    return rf"""select {keys}, (start // {step})::int as run, trim(replace({right}, {edge}, '')) as content from (select *, {left} as q from (select *, substr(m, start + 1, {size}) as p from (
      select *, unnest(range(0, greatest(length(m), 1), {step})) as start from (select *, regexp_replace(trim(regexp_replace(content, '\s+', ' ', 'g')), '(\S{{{longest}}})', '\1' || {edge}, 'g') as m from ({source}))) where start = 0 or start + {3 * overlap} < length(m)))"""


ORACLES = {
    "b1_isolate_tables": oracle(f"select doc_id, {_ISOLATED} as md from fx_md", MD),
    "b2_split_by_header": oracle(_headers("select doc_id, md from fx_md"), MD),
    "b5_merge_small": oracle(
        f"""with {_merged('select * from fx_section', 'tenant_id')}
        select r.tenant_id, r.merged::int as merged, min(r.idx)::int as idx, count(*)::int as n_sections, any_value(r.h1) as h1, string_agg(s.content, chr(10) || chr(10) order by r.idx) as content
        from r join src s on s.tenant_id = r.tenant_id and s.idx = r.idx group by r.tenant_id, r.merged""",
        "fx_section",
    ),
    "b7_hard_cap_split": _capped("select doc_id, text as content from documents", "doc_id", 300, 20),
    "b8_inject_header_context": oracle(
        f"""select doc_id, section, case when p <> '' and not contains(substr(content, 1, 300), p) then '**Bối cảnh: ' || p || '**' || chr(10) || chr(10) || content else content end as content
        from (select *, concat_ws(' > ', h1, h2) as p from ({_headers('select doc_id, md from fx_md')}))""",
        MD,
    ),
    "b9_chunk_method": oracle("select doc_id, case when t > 1200 then 'hybrid_semantic' when t > 200 then 'markdown_adaptive' else 'merged_small' end as method from (select doc_id, greatest(1, (length(content) + 2) // 3) as t from fx_doc)", "fx_doc"),
}



def _cut(source: str, mark: str) -> str:
    """Pieces p (by d, i) of more than 2,000 characters cut before a mark."""
    parts = f"case when length(p) > 2000 then string_split(replace(p, {mark}, chr(1) || {mark}), chr(1)) else [p] end"
    return f"select d, i * 10000 + j as i, p from (select d, i, unnest({parts}) as p, generate_subscripts({parts}, 1) as j from ({source}))"


def _structural(source: str) -> str:
    """The CTEs of greedy packing over source (d, text): ps the pieces, pk (d, piece, content) the packed ones."""
    marked = "string_split(replace(text, chr(10) || chr(10), chr(1) || chr(10) || chr(10)), chr(1))"
    pieces = _cut(_cut(f"select d, unnest({marked}) as p, generate_subscripts({marked}, 1) as i from ({source}) where (length(text) + 2) // 3 > 1200", "chr(10)"), "'. '")
    return f"""ps as (select d, p, row_number() over (partition by d order by i) as n from ({pieces}) where p <> ''),
      pr as (select d, n, 0 as piece, length(p)::bigint as size from ps where n = 1
        union all select s.d, s.n, case when r.size + length(s.p) > 2000 then r.piece + 1 else r.piece end, case when r.size + length(s.p) > 2000 then length(s.p) else r.size + length(s.p) end from pr r join ps s on s.d = r.d and s.n = r.n + 1),
      pk as (select r.d, r.piece::int as piece, string_agg(ps.p, '' order by r.n) as content from pr r join ps on ps.d = r.d and ps.n = r.n group by r.d, r.piece
        union all select d, 0, text from ({source}) where (length(text) + 2) // 3 <= 1200)"""


def _semantic(source: str) -> str:
    """The CTEs of semantic cuts over source (d, text): sp (d, part, content)."""
    return rf"""s1 as (select d, unnest(l) as sentence, generate_subscripts(l, 1) - 1 as n from (select d, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) as l from ({source}) where (length(text) + 2) // 3 > 1200)),
      s2 as (select d, n, term, count(*)::double as c from (select d, n, unnest(list_filter(regexp_split_to_array(lower(sentence), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) as term from s1) group by all),
      s3 as (select d, n, sqrt(sum(c * c)) as norm from s2 group by all),
      s4 as (select a.d, a.n, sum(a.c * b.c) as dot from s2 a join s2 b on a.d = b.d and b.n = a.n + 1 and a.term = b.term group by all),
      s5 as (select s1.d, s1.n, s1.sentence, case when s1.n < count(*) over (partition by s1.d) - 1 then floor((1 - coalesce(dot / (m.norm * m2.norm), 0)) * 1e9::double + 0.5)::bigint end as distance
        from s1 left join s3 m on m.d = s1.d and m.n = s1.n left join s3 m2 on m2.d = s1.d and m2.n = s1.n + 1 left join s4 on s4.d = s1.d and s4.n = s1.n),
      s6 as (select *, lag(distance) over w as b, lead(distance) over w as f from s5 window w as (partition by d order by n)),
      s7 as (select *, case when distance is not null then coalesce(case when f is null then 2 * (distance - b) when b is null then 2 * (f - distance) else f - b end, 0) end as slope from s6),
      sq as (select d, 95 * (count(slope) - 1) as place, list(slope order by slope) filter (where slope is not null) as l from s7 group by d),
      s8 as (select s7.*, coalesce(100 * slope > l[place // 100 + 1] * (100 - place % 100) + coalesce(l[place // 100 + 2], 0) * (place % 100), false)::int as cut from s7 join sq using (d)),
      s9 as (select *, coalesce(sum(cut) over (partition by d order by n rows between unbounded preceding and 1 preceding), 0)::int as part from s8),
      sp as (select d, part, string_agg(sentence, ' ' order by n) as content from s9 group by all)"""


_ALL = "select doc_id as d, text from documents"
ORACLES["b3_split_structural"] = f"with recursive {_structural(_ALL)} select d as doc_id, piece, content from pk"
ORACLES["b6_split_semantic"] = f"with recursive {_semantic(_ALL)} select d as doc_id, part, content from sp"


def chunks_sql(source: str) -> str:
    """Whole chunks of the documents of a view (doc_id, tenant_id, src_file, md)."""
    return rf"""with sec as ({_headers(f"select doc_id, {_ISOLATED} as md from {source}")}),
      keyed as (select *, doc_id * 100000 + section as d, content as text from sec), {_structural("select d, text from keyed")},
      num as (select k.doc_id, row_number() over (partition by k.doc_id order by k.section, p.piece) - 1 as idx, k.h1, k.h2, p.content from pk p join keyed k on k.d = p.d),
      {_merged("select * from num", "doc_id")},
      mg as (select r.doc_id, min(r.idx) as idx, first(s.h1 order by r.idx) as h1, first(s.h2 order by r.idx) as h2, string_agg(s.content, chr(10) || chr(10) order by r.idx) as content from r join src s on s.doc_id = r.doc_id and s.idx = r.idx group by r.doc_id, r.merged),
      mk as (select *, doc_id * 100000 + idx as d, content as text, greatest(1, (length(content) + 2) // 3) as tok from mg), {_semantic("select d, text from mk")},
      sx as (select k.doc_id, k.idx, sp.part, k.h1, k.h2, sp.content, greatest(1, (length(sp.content) + 2) // 3) as tok from sp join mk k on k.d = sp.d),
      hc as ({_capped("select * from sx where tok > 1500", "doc_id, idx, part, h1, h2", 1500, 100)}),
      fin as (select doc_id, idx, 0 as part, 0 as run, h1, h2, content, case when tok > 200 then 'markdown_adaptive' else 'merged_small' end as method from mk where tok <= 1200
        union all select doc_id, idx, part, 0, h1, h2, content, 'hybrid_semantic' from sx where tok <= 1500
        union all select doc_id, idx, part, run, h1, h2, content, 'hard_cap_fallback' from hc),
      nm as (select f.*, m.tenant_id, m.src_file, row_number() over (partition by f.doc_id order by idx, part, run) - 1 as chunk_idx, concat_ws(' > ', h1, h2) as p from fin f join {source} m using (doc_id))
      select tenant_id, src_file, chunk_idx::int as chunk_idx, regexp_replace(md5(tenant_id || '_' || src_file || '_' || chunk_idx::varchar), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\1-\2-\3-\4-\5') as chunk_id,
        case when p <> '' and not contains(substr(content, 1, 300), p) then '**Bối cảnh: ' || p || '**' || chr(10) || chr(10) || content else content end as content, method, greatest(1, (length(content) + 2) // 3)::int as token_count, coalesce(h1, '') as h1, coalesce(h2, '') as h2, '' as h3 from nm"""


ORACLES["b11_chunk_documents"] = oracle(chunks_sql("fx_md"), MD)
