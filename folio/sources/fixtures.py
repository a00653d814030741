"""Test inputs derived from the given tables, by SQL that reads the same in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

FIXTURES: dict[str, str] = {
    "fx_doc": r"""select source as tenant_id, 'doc_' || cast(doc_id as string) || '.md' as src_file,
       case when doc_id % 3 = 0 then '1,2,3' when doc_id % 3 = 1 then '2' else '1, 3' end as roles_csv,
       doc_id, text as content, n_chars, lang
from documents""",
    "fx_q": r"""select item_id * 4 + t.n as qid, text as question, 'src' || cast((item_id * 4 + t.n) % 20 as string) as tenant_id,
       cast(1 + (item_id + t.n) % 3 as int) as role_id, 'u' || cast(item_id as string) as user_id
from benchmark cross join (select 0 as n union all select 1 union all select 2 union all select 3) t""",
    "fx_md": r"""select doc_id, source as tenant_id, 'doc_' || cast(doc_id as string) || '.md' as src_file,
  case when doc_id % 10 = 9 then '' else '# ' || source || chr(10) || chr(10) end
  || case when doc_id % 6 = 0 then '## Mục lục' || chr(10) || chr(10) || '- a' || chr(10) || '- b' || chr(10) || chr(10) else '' end
  || '## ' || lang || ' ' || cast(doc_id % 4 as string) || chr(10) || chr(10)
  || replace(substr(text, 1, cast(floor(n_chars / 2) as int)), chr(10), chr(10) || chr(10)) || chr(10) || chr(10)
  || case when doc_id % 3 = 0 then '| id | chars |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || cast(doc_id as string) || ' | ' || cast(n_chars as string) || ' |' || chr(10) || chr(10) else '' end
  || '### part' || chr(10) || chr(10)
  || case when doc_id % 5 = 0 then '- one' || chr(10) || '  - nested' || chr(10) || '- two' || chr(10) || chr(10) || 'mid' || chr(10) || chr(10) || '3. three' || chr(10) || '4. four' || chr(10) || chr(10) else '' end
  || case when doc_id % 7 = 0 then '```sql' || chr(10) || '# not a header' || chr(10) || 'select 1' || chr(10) || '```' || chr(10) || chr(10) else '' end
  || case when doc_id % 4 = 1 then 'See ![alt ' || lang || '](img/' || cast(doc_id as string) || '.png) <!-- slide: break -->' || chr(10) || chr(10) else '' end
  || case when doc_id % 8 = 2 then '# second' || chr(10) || chr(10) else '' end
  || case doc_id % 11
    when 3 then '~~~~ python x' || chr(10) || '```' || chr(10) || '# not a header' || chr(10) || '~~~' || chr(10) || '  two' || chr(10) || '~~~~' || chr(10) || chr(10)
    when 5 then '    code' || chr(10) || chr(10) || '      more' || chr(10) || chr(10) || 'text' || chr(10) || '    lazy' || chr(10) || chr(10)
    when 7 then 'Title in' || chr(10) || 'two lines' || chr(10) || '=====' || chr(10) || chr(10) || 'Sub' || chr(10) || '---' || chr(10) || chr(10)
    when 9 then '> quoted' || chr(10) || '> more' || chr(10) || 'lazy' || chr(10) || '>' || chr(10) || '> - item' || chr(10) || '> ~~~' || chr(10) || '> # code' || chr(10) || '> ~~~' || chr(10) || '> ## inner' || chr(10) || chr(10)
    when 1 then '***' || chr(10) || '- x' || chr(10) || 'goes on' || chr(10) || chr(10) || '- y' || chr(10) || '  and on' || chr(10) || chr(10) || '7) z' || chr(10) || chr(10) || '> ```' || chr(10) || '> open' || chr(10) || 'out' || chr(10) || chr(10)
    else '' end
  || substr(text, cast(floor(n_chars / 2) as int) + 1)
  || case when doc_id % 12 = 7 then chr(10) || '~~~' || chr(10) || '# never closed' else '' end as md
from documents""",
    "fx_vec": r"""select vec_id, embedding, 't' || cast(label % 3 as string) as tenant_id,
       case when vec_id % 2 = 0 then '1,2' else '2,3' end as roles_csv
from embeddings""",
    "fx_employee": r"""select c.c_custkey as id, c.c_mktsegment as tenant_id, c.c_name as full_name,
  case c.c_custkey % 3 when 0 then 'Nam' when 1 then 'Nữ' end as gender,
  o.d as hire_date, c.c_custkey % 5 as work_position_id,
  case c.c_custkey % 4 when 0 then '' when 1 then 'Đại học' when 2 then 'Cao đẳng' end as education_level,
  case when c.c_custkey % 11 = 0 then null else c.c_nationkey end as work_department_id
from customer c left join (select o_custkey, min(o_orderdate) as d from orders group by o_custkey) o on c.c_custkey = o.o_custkey""",
    "fx_department": r"""select n.n_nationkey as id, s.tenant_id, n.n_name as display_name
from nation n cross join (select distinct c_mktsegment as tenant_id from customer) s where n.n_nationkey % 6 <> 0""",
    "fx_asset": r"""select o.o_orderkey as id, 'asset ' || cast(o.o_orderkey as string) as name, cast(substr(o.o_orderpriority, 1, 1) as int) as asset_category_id,
  o.o_orderdate as purchase_date, o.o_totalprice as purchase_price, case when o.o_orderkey % 9 = 0 then '' else o.o_orderstatus end as status,
  case when o.o_orderkey % 10 = 0 then null else cast(o.o_orderkey % 10 - 1 as int) end as quantity,
  c.c_nationkey as work_department_id, c.c_mktsegment as tenant_id
from orders o join customer c on o.o_custkey = c.c_custkey""",
    "fx_category": r"""select distinct cast(substr(o_orderpriority, 1, 1) as int) as id, substr(o_orderpriority, 3) as name from orders where o_orderpriority not like '5%'""",
    "fx_conv": r"""select cast(conv_id % 7 as string) as tenant_id, conv_id as employee_id, conv_id * 100 + turn as seq, role, text as content from conversations""",
    "fx_llm": r"""select conv_id, turn,
  case turn % 4
    when 0 then '{"answer": "' || replace(replace(substr(text, 1, 40), '"', ''), chr(10), ' ') || '", "citation": "doc_' || cast(conv_id as string) || '.md"}'
    when 1 then 'Result: {"answer": "ok"} done'
    when 2 then 'no json here'
    else '{"answer": 1' end as raw_answer,
  case turn % 4
    when 0 then '```sql' || chr(10) || 'select TOP 3 n_name from dbo.nation' || chr(10) || '```'
    when 1 then 'SQL: SELECT r_name FROM region;'
    when 2 then 'DROP TABLE nation'
    else '' end as raw_sql
from conversations""",
    "fx_template": r"""select 1 as tpl_id, 0 as part_no, 'Dear {{ name }} of {{segment}}' as part union all
select 1, 1, 'Balance {{  balance  }}; again {{name}}; {{ missing }}' union all
select 2, 0, '{{intro}}' union all select 2, 1, 'No fields, cost ' || chr(92) || '1 $5'""",
    "fx_record": r"""select c_custkey as rec_id, c_name as name, c_mktsegment as segment, cast(c_nationkey as string) as balance from customer""",
    "fx_slide": r"""select conv_id as deck_id, turn as slide_no, 's' || cast(turn + 1 as string) as slide_id,
  case when turn = 0 and conv_id % 4 <> 3 then 'cover' when turn % 5 = 2 then 'diagram' when turn % 5 = 4 then 'chart' else 'text' end as kind,
  case when turn % 3 = 2 then 'Same title' when turn % 3 = 0 and turn > 0 then 'SAME TITLE' else 'Title ' || cast(turn as string) end as title,
  case when turn % 4 = 1 then '1. a' || chr(10) || '1. b' || chr(10) || text when turn % 4 = 3 then '- x; y; z' else text end as text_block
from conversations""",
    "fx_diagram_item": r"""select s.conv_id as deck_id, s.turn as slide_no, i.n as item_no,
  case s.conv_id % 5 when 0 then 'paired_grid' when 1 then 'three_columns' when 2 then 'relationship' when 3 then 'hub_spoke' else 'timeline' end as diagram_type,
  substr(s.text, 1, 40 + 5 * i.n) as title, substr(s.text, 1, 100 + 10 * i.n) as description
from conversations s join (select 0 as n union all select 1 union all select 2 union all select 3 union all select 4 union all select 5 union all select 6 union all select 7) i on i.n < 2 + s.turn
where s.turn % 5 = 2 or s.turn = 6""",
    "fx_member": r"""select page_id as pkg_id, 'ppt/slides/slide' || cast(i.n as string) || '.xml' as member
from pages join (select 1 as n union all select 2 union all select 3) i on i.n <= page_id % 4
union all select page_id, '[Content_Types].xml' from pages where page_id % 9 <> 0
union all select page_id, 'ppt/charts/chart1.xml' from pages where page_id % 2 = 0""",
    "fx_ref": r"""select page_id as pkg_id, 'ppt/slides/_rels/slide' || cast(i.n as string) || '.xml.rels' as owner,
  case i.n when 1 then '../charts/chart1.xml' when 2 then '/ppt/charts/chart1.xml' else 'https://example.com/x' end as target,
  case when i.n = 3 and page_id % 2 = 0 then 'External' end as target_mode
from pages join (select 1 as n union all select 2 union all select 3) i on i.n <= page_id % 4""",
    "fx_file": r"""select page_id, case page_id % 5 when 0 then 'Report ' || cast(page_id as string) || '.PDF' when 1 then 'a.pdf' when 2 then 'Kế hoạch.md' when 3 then '' else 'x.docx' end as filename,
  length(html) * (page_id % 3) * 20000 as size_bytes,
  case page_id % 4 when 0 then '1,2' when 1 then ' 3 , 4' when 2 then '1,x' else '' end as roles_csv
from pages""",
    "fx_request": r"""select c_custkey as req_id, c_custkey + c_custkey % 7 as employee_id, case when c_custkey % 3 = 0 then 'BUILDING' else c_mktsegment end as tenant_id from customer""",
    "fx_section": r"""select doc_id, source || '-' || cast(cast(floor(doc_id / 64) as int) as string) as tenant_id, row_number() over (partition by source, floor(doc_id / 64) order by doc_id) - 1 as idx, greatest(1, cast(floor((n_chars + 2) / 3) as int)) as tokens, lang as h1, text as content from documents""",
    "fx_message": r"""select conv_id, turn, role, case when turn % 5 = 4 then ' ' else text end as content, case when turn % 3 = 0 then 1.5 when turn % 3 = 1 then 0.5 end as relevance from conversations""",
}

#: Each document is one of four uploads of a file; some are refused, some delete it.
FIXTURES["fx_upload"] = f"""select doc_id, doc_id as seq, 'src' || cast(cast(floor(doc_id / 4) as int) % 20 as string) as tenant_id,
  'doc_' || cast(cast(floor(doc_id / 4) as int) as string) || case when doc_id % 13 = 5 then '.exe' else '.md' end as src_file,
  case when doc_id % 17 = 3 then '1,x' when doc_id % 3 = 0 then '1,2,3' when doc_id % 3 = 1 then '2' else '1, 3' end as roles_csv,
  case when doc_id % 19 = 1 then '' else md end as md, doc_id % 9 = 8 as deleted from ({FIXTURES["fx_md"]}) m"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = FIXTURES[name]
    for t in TABLES:
        if t in sql:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(sql)


def oracle(sql: str, *names: str) -> str:
    """sql after the named fixtures as common table expressions."""
    parts = ", ".join(f"{n} as ({FIXTURES[n]})" for n in names)
    sql = sql.strip()
    sql = sql.replace("with recursive ", "with ", 1) if sql.startswith("with recursive ") else sql
    return f"with recursive {parts}, {sql[5:]}" if sql.startswith("with ") else f"with recursive {parts} {sql}"
