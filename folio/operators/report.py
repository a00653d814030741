"""Department reports over whole tables of employees and assets, for all departments and requests at once.

Missing values follow one rule: null, empty text and 0 alike count as missing where the text says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHER, UNKNOWN_STATUS = "Khác", "Không rõ"
#: A question with one of these goes to the report.
REPORT_WORDS = (
    "nhân sự", "nhan su", "trang thiết bị", "thiet bi", "thiết bị", "báo cáo", "kiểm kê", "kiem ke", "tình trạng",
    "tinh trang", "báo cáo kiểm kê", "báo cáo phòng", "tổng hợp", "tổng hợp nhân sự", "tổng hợp trang thiết bị",
)
DEPARTMENT = ("tenant_id", "work_department_id")


def resolve(requests: DataFrame, employees: DataFrame) -> DataFrame:
    """requests (req_id, employee_id, tenant_id) with work_department_id and status: ok, no_employee, no_department."""
    known = employees.select(F.col("id").alias("employee_id"), "tenant_id", "work_department_id", F.lit(True).alias("known"))
    joined = requests.join(known, ["employee_id", "tenant_id"], "left")
    status = F.when(F.col("known").isNull(), "no_employee").when(F.coalesce("work_department_id", F.lit(0)) == 0, "no_department").otherwise("ok")
    return joined.select("req_id", "employee_id", "tenant_id", F.when(status == "ok", F.col("work_department_id")).alias("work_department_id"), status.alias("status"))


def department_names(keys: DataFrame, departments: DataFrame) -> DataFrame:
    """keys (tenant_id, work_department_id) with the department's name, or one made of its id."""
    named = departments.select("tenant_id", F.col("id").alias("work_department_id"), F.nullif("display_name", F.lit("")).alias("display_name"))
    made = F.concat(F.lit("ID phòng "), F.col("work_department_id").cast("string"))
    return keys.join(named.hint("merge"), list(DEPARTMENT), "left").select(*DEPARTMENT, F.coalesce("display_name", made).alias("department"))


def headcount(employees: DataFrame) -> DataFrame:
    return employees.where("work_department_id is not null").groupBy(*DEPARTMENT).agg(F.count(F.lit(1)).alias("headcount"))


def _given(column: str, missing: str) -> Column:
    text = F.col(column).cast("string")
    return F.when(text.isNull() | text.isin("", "0"), missing).otherwise(text)


def _long(groups: DataFrame, kinds: dict[str, Column], value: Column) -> DataFrame:
    """One pass: each row counts once for every kind."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("part")) for k, c in kinds.items()))).alias("x")
    return groups.where("work_department_id is not null").select(*DEPARTMENT, each, value.alias("v")).groupBy(*DEPARTMENT, F.col("x.kind").alias("kind"), F.col("x.part").alias("part")).agg(F.sum("v").alias("value"))


def distributions(employees: DataFrame) -> DataFrame:
    """tenant_id, work_department_id, kind (position, gender, education), part, value."""
    kinds = {"position": _given("work_position_id", "0"), "gender": _given("gender", OTHER), "education": _given("education_level", OTHER)}
    return _long(employees, kinds, F.lit(1).cast("long"))


def hires_by_year(employees: DataFrame) -> DataFrame:
    """Dates give their year, texts their first four characters; missing dates count nowhere."""
    text = dict(employees.dtypes)["hire_date"] == "string"
    year = F.substring("hire_date", 1, 4) if text else F.date_format("hire_date", "yyyy")
    found = employees.where("work_department_id is not null").withColumn("year", F.nullif(year, F.lit("")))
    return found.where("year is not null").groupBy(*DEPARTMENT, "year").agg(F.count(F.lit(1)).alias("hires"))


def asset_listing(assets: DataFrame, categories: DataFrame) -> DataFrame:
    """Assets with their category's name (null without one); a quantity of null or 0 counts as 1."""
    named = categories.select(F.col("id").alias("asset_category_id"), F.col("name").alias("category"))
    quantity = F.when(F.coalesce("quantity", F.lit(0)) == 0, 1).otherwise(F.col("quantity")).cast("long")
    return assets.join(named, "asset_category_id", "left").select("id", *DEPARTMENT, "name", "category", "status", "purchase_price", quantity.alias("quantity"))


def asset_total(listing: DataFrame) -> DataFrame:
    return listing.groupBy(*DEPARTMENT).agg(F.coalesce(F.sum("quantity"), F.lit(0)).alias("total"))


def asset_distributions(listing: DataFrame) -> DataFrame:
    """tenant_id, work_department_id, kind (category, status), part, value."""
    missing = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    return _long(listing, {"category": missing("category", OTHER), "status": missing("status", UNKNOWN_STATUS)}, F.col("quantity"))


def percent_share(parts: DataFrame, by: tuple[str, ...] = (*DEPARTMENT, "kind"), value: str = "value") -> DataFrame:
    """parts with share: value in percent of its group, to one decimal."""
    totals = parts.groupBy(*by).agg(F.sum(value).alias("_total"))
    return parts.join(totals.hint("merge"), list(by)).withColumn("share", F.round(F.col(value) * 100 / F.col("_total"), 1)).drop("_total")


def chart_series(staff: DataFrame, assets: DataFrame) -> DataFrame:
    """tenant_id, work_department_id, chart, category, value: a bar of positions and categories, a pie of genders and states."""
    charts = F.create_map(*(F.lit(x) for kv in {"position": "position_bar", "gender": "gender_pie", "category": "category_bar", "status": "status_pie"}.items() for x in kv))
    both = staff.where("kind <> 'education'").unionByName(assets)
    return both.select(*DEPARTMENT, charts[F.col("kind")].alias("chart"), F.col("part").alias("category"), "value")


def _listed(parts: DataFrame) -> DataFrame:
    """`part:value, part:value` for each kind, largest first, then by name."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("n"), F.col("part").alias("p"))))
    text = F.array_join(F.transform(ordered, lambda x: F.concat(x.p, F.lit(":"), (-x.n).cast("string"))), ", ")
    return parts.groupBy(*DEPARTMENT, "kind").agg(text.alias("line"))


def summary_lines(staff: DataFrame, heads: DataFrame, hires: DataFrame, assets: DataFrame, totals: DataFrame, report_types: tuple[str, ...] = ("personnel", "assets")) -> DataFrame:
    """tenant_id, work_department_id, line_no, line. A type that is left out gives N/A."""
    years = hires.select(*DEPARTMENT, F.lit("hires").alias("kind"), F.col("year").alias("part"), F.col("hires").alias("value"))
    order = ("headcount", "position", "gender", "education", "hires", "total", "category", "status")
    simple = heads.select(*DEPARTMENT, F.lit("headcount").alias("kind"), F.col("headcount").cast("string").alias("line")).union(totals.select(*DEPARTMENT, F.lit("total"), F.col("total").cast("string")))
    lines = _listed(staff.unionByName(years).unionByName(assets)).select(*DEPARTMENT, "kind", "line").union(simple)
    of = F.when(F.col("kind").isin("total", "category", "status"), "assets").otherwise("personnel")
    number = F.array_position(F.array(*map(F.lit, order)), F.col("kind")).cast("int")
    return lines.select(*DEPARTMENT, number.alias("line_no"), F.concat("kind", F.lit(": "), F.when(of.isin(*report_types), F.col("line")).otherwise("N/A")).alias("line"))


def department_report(requests: DataFrame, employees: DataFrame, departments: DataFrame, assets: DataFrame, categories: DataFrame, report_types: tuple[str, ...] = ("personnel", "assets")) -> DataFrame:
    """req_id, status, department, lines for every request; a request that fails has no lines."""
    listing = asset_listing(assets, categories)
    lines = summary_lines(distributions(employees), headcount(employees), hires_by_year(employees), asset_distributions(listing), asset_total(listing), report_types)
    whole = lines.groupBy(*DEPARTMENT).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x.line), "\n").alias("lines"))
    named = department_names(whole.select(*DEPARTMENT), departments)
    done = whole.join(named.hint("merge"), list(DEPARTMENT))
    return resolve(requests, employees).join(done.hint("merge"), list(DEPARTMENT), "left").select("req_id", "status", "department", "lines")


def report_intent(questions: DataFrame, text: str = "question", words: tuple[str, ...] = REPORT_WORDS) -> DataFrame:
    """questions with route: report if the question has any of the words, else retrieval."""
    low = F.lower(text)
    has = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    return questions.withColumn("route", F.when(has, "report").otherwise("retrieval"))
