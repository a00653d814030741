"""The block structure of Markdown in DuckDB SQL: a recursion over the lines of all documents at once. Fences in quotes: one mark deep."""

from __future__ import annotations

_SPACE = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"


def lines_sql(source: str) -> str:
    """md_lines (doc_id, n from 0, line, act, code, block, starts, txt) of source (doc_id, md), as more common table expressions."""
    return rf"""md_ln as (select doc_id, unnest(l) as line, (generate_subscripts(l, 1) - 1)::int as n from (select doc_id, string_split(md, chr(10)) as l from ({source}))),
  md_r as (select doc_id, -1 as n, '' as line, '' as act, false as code, 0 as block, false as starts, '' as txt, 'blank' as kind, '' as last, 0 as depth, 0 as blanks, false as numbered, '' as fm, 0 as fl, 0 as fi, 0 as fd from (select distinct doc_id from md_ln)
    union all select doc_id, n, line, act, still or act = 'fence', block + starts::int, starts,
      case act when 'in' then substr(frest, least(length(frest) - length(ltrim(frest, ' ')), fi) + 1)
        when 'fence' then '```' || trim(regexp_replace(rest, '^ *(`+|~+)', ''), {_SPACE}) when 'heading' then ltrim(rest, ' ') when 'cont' then trim(rest, {_SPACE})
        when 'icode' then case when starts or not gap then '' else repeat(chr(10), blanks) end || regexp_replace(rest, '^(\t|    )', '') else rest end,
      case act when 'in' then kind when 'close' then 'code' when 'fence' then 'code' when 'under' then 'heading' when 'cont' then 'list' when 'more' then 'paragraph' when 'para' then 'paragraph' when 'icode' then 'indented' else act end,
      case when act = 'blank' and kind1 <> 'blank' then kind1 else last end,
      case when act in ('fence', 'heading', 'break', 'table', 'list', 'icode', 'para') then now else depth end,
      case when act = 'blank' then case when kind1 <> 'blank' then 1 else blanks + 1 end else blanks end,
      case when act = 'list' and starts then inum else numbered end,
      case when act = 'fence' then substr(ltrim(rest, ' '), 1, 1) when act = 'in' then fm else '' end,
      case when act = 'fence' then length(regexp_extract(rest, '^ *(`+|~+)', 1)) else fl end, case when act = 'fence' then length(rest) - length(ltrim(rest, ' ')) else fi end, case when act = 'fence' then now else fd end
    from (select *, case when still then false when act in ('fence', 'heading', 'para') then true when act = 'table' then not (kind1 = 'table' and same)
        when act = 'list' then not (before = 'list' and same and (not gap or lead >= 2 or inum = numbered)) when act = 'icode' then not (before = 'indented' and same) else false end as starts
      from (select *, case when still then case when closes then 'close' else 'in' end when trim(rest, {_SPACE}) = '' then 'blank' when regexp_matches(rest, '^ {{0,3}}(`{{3,}}[^`]*|~{{3,}}.*)$') then 'fence'
          when kind1 = 'paragraph' and same and regexp_matches(rest, '^ {{0,3}}(=+|-+)[ \t]*$') then 'under' when regexp_matches(rest, '^ {{0,3}}#{{1,6}}([ \t]|$)') then 'heading'
          when regexp_matches(rest, '^ {{0,3}}((-[ \t]*){{3,}}|(\*[ \t]*){{3,}}|(_[ \t]*){{3,}})$') then 'break' when regexp_matches(rest, '^\|.*\|\s*$') then 'table'
          when regexp_matches(rest, '^[ \t]*([-*+]|[0-9]{{1,9}}[.)])[ \t]+') and (not ind or before = 'list') then 'list' when before = 'list' and (same or lazy) and (not gap or lead >= 2) then 'cont'
          when kind1 = 'paragraph' and (same or lazy) then 'more' when ind then 'icode' else 'para' end as act
        from (select *, case when kind1 = 'blank' then last else kind1 end as before, kind1 = 'blank' as gap, now = depth as same, kind1 <> 'blank' and now < depth as lazy, regexp_matches(rest, '^(    |\t)') as ind,
            regexp_matches(rest, '^[ \t]*[0-9]') as inum, length(rest) - length(ltrim(rest, {_SPACE})) as lead,
            length(trim(frest, ' ' || chr(9))) >= fl and trim(trim(frest, ' ' || chr(9)), fm) = '' and length(frest) - length(ltrim(frest, ' ')) < 4 as closes
          from (select *, fm <> '' and (fd = 0 or regexp_matches(line, '^ {{0,3}}>')) as still, case when fm <> '' then 'code' else kind end as kind1, case when fd = 0 then line else regexp_replace(line, '^ {{0,3}}> ?', '') end as frest,
              length(mq) - length(replace(mq, '>', '')) as now, substr(line, length(mq) + 1) as rest
            from (select r.* exclude (line, n, act, starts, txt, code), ln.line, ln.n, regexp_extract(ln.line, '^( {{0,3}}> ?)*') as mq from md_r r join md_ln ln on ln.doc_id = r.doc_id and ln.n = r.n + 1)))))),
  md_lines as (select * from md_r where n >= 0)"""


def blocks_sql(source: str) -> str:
    """lb (doc_id, line_no, kind, lines) of source (doc_id, md), as more common table expressions over md_lines."""
    return rf"""{lines_sql(source)},
  md_items as (select doc_id, block, item, min(n) as n, string_agg(case when act <> 'under' then case when kind = 'paragraph' then txt else txt end end, ' ' order by n) as txt, bool_or(act = 'under') as under, max(case when act = 'under' then trim(txt, ' ' || chr(9)) end) as mark, any_value(act) filter (where starts) as opened
    from (select *, sum((act not in ('cont', 'under'))::int) over (partition by doc_id, block order by n) as item from md_lines where act not in ('blank', 'break', 'close')) group by doc_id, block, item),
  lb as (select doc_id, min(n)::int as line_no, case any_value(opened) when 'fence' then 'code' when 'icode' then 'code' when 'para' then case when bool_or(under) then 'heading' else 'paragraph' end else any_value(opened) end as kind,
      case when bool_or(under) then [case when max(mark) like '=%' then '# ' else '## ' end || string_agg(trim(txt, {_SPACE}), ' ' order by n)]
        when any_value(opened) = 'icode' then list_concat(['```'], list(txt order by n), ['```']) when any_value(opened) = 'fence' then list_append(list(txt order by n), '```') else list(txt order by n) end as lines
    from md_items group by doc_id, block)"""
