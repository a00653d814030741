"""What the gate for SQL lets through."""

import pytest

from folio.operators import sqlgate as S


@pytest.fixture(scope="module")
def views(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("gate") / "file")
    spark.createDataFrame([(9, 9)], "k int, v int").write.parquet(path)
    spark.createDataFrame([(9, 9)], "k int, v int").createOrReplaceTempView("hidden")
    spark.createDataFrame([(8, 8)], "k int, v int").createOrReplaceTempView("ok")
    spark.sql("drop table if exists saved")
    spark.sql(f"create table saved using parquet location '{path}'")
    yield {"ok": spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "k int, v int"), "other": spark.createDataFrame([(1, "a;b")], "k int, s string")}, path
    spark.sql("drop table saved")


def run(spark, views, sql):
    return sorted(map(tuple, S.guarded_select(spark, sql, views[0]).collect()))


def test_lets_selects_through(spark, views):
    assert run(spark, views, "select k from ok where v > 10") == [(2,), (3,)]
    assert run(spark, views, "SELECT TOP 2 k FROM dbo.ok ORDER BY k DESC;") == [(2,), (3,)]
    assert run(spark, views, "select o.k from ok o join other using (k) where s = N'a;b'") == [(1,)]
    assert run(spark, views, "select k from ok where k in (select k from other) union all select max(v) over () from ok where exists (select 1 from other where other.k = ok.k)") == [(1,), (10,)]
    assert run(spark, views, "select t.n from (select count(*) n, v % 20 as m from ok group by v % 20 having count(*) > 1) t") == [(2,)]
    assert run(spark, views, "select cast(s as int) from other") == [(None,)]
    assert run(spark, views, "select sum(v) over w, row_number() over w from ok window w as (partition by k % 2 order by v)") == [(10, 1), (20, 1), (40, 2)]
    assert S.guarded_select(spark, "select k, k, k + 1 as `a b` from ok", views[0]).columns == ["k", "k", "a b"]


FINE = [
    "select upper(s) || lower('X') as x, substring(s, 1, 2), trim(s), replace(s, ';', ','), length(s), left(s, 1), s like 'a%' from other",
    "select round(avg(v), 2), min(v), max(v), count(distinct k), stddev(v), count_if(v > 10), any_value(v) from ok",
    "select case when v > 10 then 'big' else 'small' end as size, coalesce(nullif(v, 10), 0), floor(v / 3), ceil(v / 3), abs(-v), v % 7, v div 7, sqrt(v), greatest(k, v) from ok",
    "select year(date '2024-02-03'), month(d), datediff(d, date '2024-01-01'), date_add(d, 1), date_trunc('month', d), extract(day from d) from (select date '2024-02-03' as d from ok)",
    "select k, rank() over (order by v desc), lag(v, 1) over (order by v), ntile(2) over (order by v), sum(v) over (order by v rows between 1 preceding and current row) from ok",
    "select k from ok union select k from other except select 7 intersect select k from ok",
    "select k, sum(v), grouping(k) from ok group by rollup(k) having sum(v) > 10 order by 2 desc nulls last limit 3 offset 1",
    "select a.k from ok a left join ok b on a.k = b.k + 1 where b.k is null or b.v between 10 and 20 and a.k in (1, 2)",
    "select k from ok where v > (select avg(v) from ok) and not exists (select 1 from other o where o.k = ok.k)",
    "select 1 + 1",
]


@pytest.mark.parametrize("sql", FINE)
def test_gives_what_the_session_would(spark, views, sql):
    other = spark.newSession()
    other.conf.set("spark.sql.ansi.enabled", "false")
    other.createDataFrame([(1, 10), (2, 20), (3, 30)], "k int, v int").createOrReplaceTempView("ok")
    other.createDataFrame([(1, "a;b")], "k int, s string").createOrReplaceTempView("other")
    want = sorted(map(str, map(tuple, other.sql(sql).collect())))
    assert want and sorted(map(str, run(spark, views, sql))) == want


@pytest.mark.parametrize(
    "sql",
    [
        "select * from/**/hidden",
        "select * from ok, hidden",
        "select k from ok union table hidden",
        "select * from ok, parquet.`{path}`",
        "select * from parquet.`{path}`",
        "select k from ok where k in (select k from hidden)",
        "select (select max(k) from hidden) from ok",
        "select * from ok where exists (select 1 from hidden)",
        "select * from (with x as (select * from hidden) select * from x)",
        "with ok as (select * from hidden) select * from ok",
        "select * from range(5)",
        "select * from ok lateral view explode(array(1)) t as x, lateral (select * from hidden)",
        "select transform(k) using 'cat' from ok",
        "select reflect('java.lang.System', 'getProperty', 'user.dir') from ok",
        "select * from default.hidden",
        "select * from values (1)",
        "select 1; select 2",
        "drop table ok",
        "select k from ok order by (select max(k) from hidden)",
        "select max(k) filter (where k in (select k from hidden)) from ok",
        "select identifier('reflect')('java.lang.System', 'getProperty', 'user.home') from ok",
        "select identifier('ref' || 'lect')('java.lang.System', 'getProperty', 'user.home') from ok",
        "select * from identifier('hidden')",
        "select identifier('k') from ok",
        "select java_method('java.lang.System', 'getProperty', 'user.home') from ok",
        "select try_reflect('java.lang.System', 'getProperty', 'user.home') from ok",
        "select count(*) over w from ok window w as (partition by k + (select max(k) from hidden))",
        "select count(*) over w from ok window w as (order by k + (select max(k) from hidden))",
        "select count(*) over w from ok window w as (partition by k + (select max(k) from saved))",
        "select * from saved",
        "select input_file_name() from ok",
        "select current_user(), session_user() from ok",
        "select current_database(), current_catalog() from ok",
        "select version() from ok",
        "select current_timestamp(), now(), rand(), uuid() from ok",
        "select raise_error('x') from ok",
        "select assert_true(k > 5) from ok",
        "select k + (select k from ok) from ok",
        "select spark_partition_id(), monotonically_increasing_id() from ok",
        "select from_json(s, 'a int') from other",
        "select k from ok where hidden.k = 1",
        "select explode(array(k)) from ok",
        "select _metadata.file_path from ok",
        "select transform(array(k), x -> x + (select max(k) from hidden)) from ok",
        "select k from ok tablesample (50 percent)",
        "select k from ok limit (select max(k) from hidden)",
        "select :k from ok",
        "select * from ok pivot (max(v) for k in (1, 2))",
        "",
    ],
)
def test_refuses(spark, views, sql):
    assert run(spark, views, sql.replace("{path}", views[1])) == []
