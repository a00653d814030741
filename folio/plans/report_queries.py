"""Registered queries of the department reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import report as R
from folio.sources.fixtures import fixture, oracle

E, D, A, C = "fx_employee", "fx_department", "fx_asset", "fx_category"
#: Words that occur in the questions of the fixtures, so that both routes have rows.
FIXTURE_WORDS = ("thble", "ción", "auf")


def _listing(s, d):
    return R.asset_listing(fixture(s, d, A), fixture(s, d, C))


def _charts(s, d):
    return R.chart_series(R.distributions(fixture(s, d, E)), R.asset_distributions(_listing(s, d)))


def _summary(s, d):
    emp, listing = fixture(s, d, E), _listing(s, d)
    return R.summary_lines(R.distributions(emp), R.headcount(emp), R.hires_by_year(emp), R.asset_distributions(listing), R.asset_total(listing))


def _report(s, d):
    return R.department_report(fixture(s, d, "fx_request"), fixture(s, d, E), fixture(s, d, D), fixture(s, d, A), fixture(s, d, C))


def _asked(s, d):
    """Questions, every third with one of the engine's own words in capitals or as it is, every fifth with half of one."""
    words = F.array(*map(F.lit, R.REPORT_WORDS))
    word = F.element_at(words, (F.col("qid") % len(R.REPORT_WORDS) + 1).cast("int"))
    spoken = F.when(F.col("qid") % 2 == 0, F.upper(word)).otherwise(word)
    more = F.when(F.col("qid") % 3 == 0, F.concat(F.lit(" "), spoken)).when(F.col("qid") % 5 == 0, F.concat(F.lit(" "), F.substring(word, 1, 3))).otherwise("")
    return fixture(s, d, "fx_q").select("qid", F.concat("question", more).alias("question"))


QUERIES = {
    "f1_resolve_requester": lambda s, d: R.resolve(fixture(s, d, "fx_request"), fixture(s, d, E)),
    "f2_department_name": lambda s, d: R.department_names(fixture(s, d, E).where("work_department_id is not null").select(*R.DEPARTMENT).distinct(), fixture(s, d, D)),
    "f3_headcount": lambda s, d: R.headcount(fixture(s, d, E)),
    "f4_distribution": lambda s, d: R.distributions(fixture(s, d, E)),
    "f5_hires_by_year": lambda s, d: R.hires_by_year(fixture(s, d, E)),
    "f6_asset_listing": _listing,
    "f7_total_quantity": lambda s, d: R.asset_total(_listing(s, d)),
    "f8_quantity_by": lambda s, d: R.asset_distributions(_listing(s, d)),
    "f9_percent_share": lambda s, d: R.percent_share(R.distributions(fixture(s, d, E))),
    "f10_chart_series": _charts,
    "f11_summary_lines": _summary,
    "f12_department_report": _report,
    "f13_report_intent_words": lambda s, d: R.report_intent(_asked(s, d)),
    "f13_report_intent": lambda s, d: R.report_intent(fixture(s, d, "fx_q"), words=FIXTURE_WORDS).select("qid", "route"),
}

_DIST = """select tenant_id, work_department_id, kind, part, count(*)::bigint as value from (
  select tenant_id, work_department_id, 'position' as kind, case when coalesce(work_position_id, 0) = 0 then '0' else work_position_id::varchar end as part from fx_employee
  union all select tenant_id, work_department_id, 'gender', coalesce(nullif(gender, ''), 'Khác') from fx_employee
  union all select tenant_id, work_department_id, 'education', coalesce(nullif(education_level, ''), 'Khác') from fx_employee
) where work_department_id is not null group by all"""
_LIST = """select a.id, a.tenant_id, a.work_department_id, a.name, c.name as category, a.status, a.purchase_price, (case when coalesce(a.quantity, 0) = 0 then 1 else a.quantity end)::bigint as quantity
  from fx_asset a left join fx_category c on a.asset_category_id = c.id"""
_ADIST = f"""select tenant_id, work_department_id, kind, part, sum(quantity)::bigint as value from (
  select tenant_id, work_department_id, quantity, 'category' as kind, coalesce(category, 'Khác') as part from ({_LIST})
  union all select tenant_id, work_department_id, quantity, 'status', coalesce(nullif(status, ''), 'Không rõ') from ({_LIST})) group by all"""
_HEAD = "select tenant_id, work_department_id, count(*) as headcount from fx_employee where work_department_id is not null group by all"
_HIRES = "select tenant_id, work_department_id, strftime(hire_date, '%Y') as year, count(*) as hires from fx_employee where work_department_id is not null and hire_date is not null group by all"
_TOTAL = f"select tenant_id, work_department_id, sum(quantity)::bigint as total from ({_LIST}) group by all"
_LINES = f"""select tenant_id, work_department_id, line_no, kind || ': ' || line as line from (
  select tenant_id, work_department_id, kind, string_agg(part || ':' || value::varchar, ', ' order by value desc, part) as line,
    case kind when 'position' then 2 when 'gender' then 3 when 'education' then 4 when 'hires' then 5 when 'category' then 7 else 8 end as line_no
  from ({_DIST} union all select tenant_id, work_department_id, 'hires', year, hires from ({_HIRES}) union all select * from ({_ADIST})) group by all
  union all select tenant_id, work_department_id, 'headcount', headcount::varchar, 1 from ({_HEAD})
  union all select tenant_id, work_department_id, 'total', total::varchar, 6 from ({_TOTAL}))"""
_RESOLVE = """select r.req_id, r.employee_id, r.tenant_id, case when coalesce(e.work_department_id, 0) <> 0 then e.work_department_id end as work_department_id,
  case when e.id is null then 'no_employee' when coalesce(e.work_department_id, 0) = 0 then 'no_department' else 'ok' end as status
  from fx_request r left join fx_employee e on r.employee_id = e.id and r.tenant_id = e.tenant_id"""
_NAMES = """select k.tenant_id, k.work_department_id, coalesce(d.display_name, 'ID phòng ' || k.work_department_id::varchar) as department
  from (select distinct tenant_id, work_department_id from fx_employee where work_department_id is not null) k
  left join fx_department d on d.id = k.work_department_id and d.tenant_id = k.tenant_id"""

ORACLES = {
    "f1_resolve_requester": oracle(_RESOLVE, "fx_request", E),
    "f2_department_name": oracle(_NAMES, E, D),
    "f3_headcount": oracle(_HEAD, E),
    "f4_distribution": oracle(_DIST, E),
    "f5_hires_by_year": oracle(_HIRES, E),
    "f6_asset_listing": oracle(_LIST, A, C),
    "f7_total_quantity": oracle(_TOTAL, A, C),
    "f8_quantity_by": oracle(_ADIST, A, C),
    "f9_percent_share": oracle(f"select *, round(100 * value / sum(value) over (partition by tenant_id, work_department_id, kind), 1) as share from ({_DIST})", E),
    "f10_chart_series": oracle(
        f"""select tenant_id, work_department_id, case kind when 'position' then 'position_bar' when 'gender' then 'gender_pie' when 'category' then 'category_bar' else 'status_pie' end as chart, part as category, value
        from ({_DIST} union all select * from ({_ADIST})) where kind <> 'education'""",
        E, A, C,
    ),
    "f11_summary_lines": oracle(_LINES, E, A, C),
    "f12_department_report": oracle(
        f"""with r as ({_RESOLVE}), l as (select tenant_id, work_department_id, string_agg(line, chr(10) order by line_no) as lines from ({_LINES}) group by all)
        select r.req_id, r.status, case when l.lines is not null then coalesce(d.display_name, 'ID phòng ' || r.work_department_id::varchar) end as department, l.lines
        from r left join l on l.tenant_id = r.tenant_id and l.work_department_id = r.work_department_id
        left join fx_department d on d.id = r.work_department_id and d.tenant_id = r.tenant_id""",
        "fx_request", E, D, A, C,
    ),
    "f13_report_intent_words": oracle(
        f"""with w as (select {list(R.REPORT_WORDS)!r} as words), q as (select qid, question || case when qid % 3 = 0 then ' ' || case when qid % 2 = 0 then upper(word) else word end when qid % 5 = 0 then ' ' || substr(word, 1, 3) else '' end as question, words
          from (select *, words[qid % len(words) + 1] as word from fx_q, w))
        select qid, question, case when len(list_filter(words, lambda x: contains(lower(question), x))) > 0 then 'report' else 'retrieval' end as route from q""",
        "fx_q",
    ),
    "f13_report_intent": oracle("select qid, case when contains(lower(question), 'thble') or contains(lower(question), 'ción') or contains(lower(question), 'auf') then 'report' else 'retrieval' end as route from fx_q", "fx_q"),
}
