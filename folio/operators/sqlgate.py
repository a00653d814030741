"""Read-only SQL over named views, and rows as text."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.sources.shared import new_folder

SOURCE = "mssql_database_result"


def clean_sql(text: str = "raw_sql") -> Column:
    """The bare SELECT of a model's output, with a semicolon; '' if it is none."""
    bare = F.regexp_replace(F.col(text), "(?i)```sql|```", "")
    bare = F.trim(F.regexp_replace(F.translate(bare, "`", ""), r"(?i)SQL:", ""))
    bare = F.regexp_replace(F.regexp_replace(bare, r"^\s+", ""), r"[\s;]+$", "")
    return F.when(F.upper(bare).startswith("SELECT"), F.concat(bare, F.lit(";"))).otherwise("")


#: What a parsed SELECT may consist of, by the parser's names. Commands, scripts, time travel, functions as tables, inline
#: files and WITH (whose names could hide others) are not among it.
PARSED = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "SubqueryAlias", "Join", "Union", "Intersect", "Except",
    "UnresolvedHaving", "WithWindowDefinition", "UnresolvedSubqueryColumnAliases", "UnresolvedHint", "UnresolvedRelation", "OneRowRelation",
}
#: What the analysed one may consist of, besides the views.
ANALYSED = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "SubqueryAlias", "Join", "Union", "Intersect", "Except",
    "Window", "Expand", "OneRowRelation", "ResolvedHint",
}
#: The expressions that an analysed statement may hold, by Spark's names: plain functions of values, which read nothing but their
#: arguments, raise nothing of their own and give the same at any time.
EXPRESSIONS = set(
    """Alias AttributeReference OuterReference Literal Cast SortOrder NamedExpression
    Add Subtract Multiply Divide IntegralDivide Remainder Pmod UnaryMinus UnaryPositive Abs Signum Greatest Least
    EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan GreaterThanOrEqual Between In InSubquery And Or Not IsNull IsNotNull IsNaN
    BitwiseAnd BitwiseOr BitwiseXor BitwiseNot ShiftLeft ShiftRight TypedNullLiteral With CommonExpressionDef CommonExpressionRef
    If CaseWhen Coalesce NullIf Nvl Nvl2 NaNvl NullIfZero ZeroIfNull
    Floor Ceil FloorExpressionBuilder CeilExpressionBuilder RoundFloor RoundCeil Round BRound Sqrt Cbrt Pow Exp Log Log10 Log2 Logarithm
    Upper Lower Length OctetLength Substring Left Right Concat ConcatWs StringTrim StringTrimLeft StringTrimRight StringTrimBoth StringLPad StringRPad
    StringReplace StringInstr StringLocate StringTranslate SubstringIndex Reverse InitCap Contains StartsWith EndsWith Like LikeAll LikeAny NotLikeAll NotLikeAny
    ContainsExpressionBuilder StartsWithExpressionBuilder EndsWithExpressionBuilder
    Year Quarter Month WeekOfYear DayOfMonth DayOfYear DayOfWeek WeekDay Hour Minute Second LastDay DateAdd DateSub DateDiff AddMonths MonthsBetween
    TruncDate TruncTimestamp ParseToDate DatePart Extract
    AggregateExpression Count Sum Average Min Max StddevSamp StddevPop VarianceSamp VariancePop CountIf BoolAnd BoolOr AnyValue First Last Median Percentile
    Grouping GroupingID BaseGroupingSets GroupingSets Cube Rollup
    WindowExpression WindowSpecDefinition SpecifiedWindowFrame UnspecifiedFrame CurrentRow UnboundedPreceding UnboundedFollowing RowFrame RangeFrame
    RowNumber Rank DenseRank PercentRank CumeDist NTile Lag Lead FirstValue LastValue NthValue
    ScalarSubquery ListQuery Exists""".split()
)


def guarded_select(spark: SparkSession, sql: str, views: dict[str, DataFrame], empty: str = "row_no long") -> DataFrame:
    """The rows of one SELECT over `views` (already filtered for the caller); anything else gives no rows.

    `TOP n` becomes LIMIT, N'...' a plain literal, and dbo. goes. The statement is read three times, and each time one thing
    that is not on a list ends it: as parsed, where every relation must be a view by its bare name and no name may
    be computed (IDENTIFIER); as analysed, in a session of its own that has these views, where every node and expression, those of named
    windows and subqueries included, must be of ANALYSED and EXPRESSIONS and every leaf one of the views; and as it runs:
    its rows are written to the shared folder, so that what fails while rows are made gives no rows either. A cast that
    fails gives null.

    Plans are reached through the JVM objects of a classic session; a Spark Connect session has none, and gets an error.
    """
    none = spark.createDataFrame([], empty)
    one = sql.strip().rstrip(";").strip()
    if not re.match(r"(?is)select\b", one):
        return none
    one = re.sub(r"(?i)\bdbo\.", "", re.sub(r"(?i)\bN'", "'", one))
    if top := re.match(r"(?is)select\s+top\s*\(?(\d+)\)?\s+(.*)", one):
        one = f"select {top[2]} limit {top[1]}"
    names = {v.lower() for v in views}
    try:
        if not _named(spark._jsparkSession.sessionState().sqlParser().parsePlan(one), names):
            return none
        session = spark.newSession()
        session.conf.set("spark.sql.ansi.enabled", "false")
        for name, rows in views.items():
            spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, rows._jdf.queryExecution().analyzed()).createOrReplaceTempView(name)
        found = session.sql(one)
        if not _known(found._jdf.queryExecution().analyzed(), names):
            return none
        # Columns by place, as two may have one name.
        places = [f"c{k}" for k in range(len(found.columns))]
        folder = new_folder(spark, "select")
        found.toDF(*places).write.parquet(folder)
        return spark.read.schema(found.toDF(*places).schema).parquet(folder).toDF(*found.columns)
    except (PySparkException, Py4JJavaError):  # what fails while rows are written comes as the latter
        return none


def _each(sequence) -> list:
    return [sequence.apply(k) for k in range(sequence.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _named(plan, names: set[str]) -> bool:
    """Whether a parsed plan and its subqueries consist of PARSED over the given names, none of them computed."""
    kind = _kind(plan)
    if kind not in PARSED:
        return False
    if kind == "UnresolvedRelation":
        parts = _each(plan.multipartIdentifier())
        return len(parts) == 1 and parts[0].lower() in names
    return all(_named(x, names) for x in _each(plan.children())) and all(_plain(x, names) for x in _each(plan.expressions()))


def _plain(expression, names: set[str]) -> bool:
    kind = _kind(expression)
    if kind in ("ScalarSubquery", "ListQuery", "Exists") and not _named(expression.plan(), names):
        return False
    if "UnresolvedIdentifier" in kind or "Parameter" in kind or "Subquery" in kind and kind not in ("ScalarSubquery", "InSubquery") or kind == "UnresolvedFunction" and expression.nameParts().size() > 1:
        return False
    return all(_plain(x, names) for x in _each(expression.children()))


def _known(plan, names: set[str]) -> bool:
    """Whether an analysed plan and its subqueries consist of ANALYSED and EXPRESSIONS over the views of the given names."""
    kind = _kind(plan)
    if kind == "View":
        return plan.isTempView() and plan.desc().identifier().table().lower() in names
    if kind not in ANALYSED or not plan.children().size() and kind != "OneRowRelation":
        return False
    return all(_known(x, names) for x in _each(plan.children())) and all(_allowed(x, names) for x in _each(plan.expressions()))


def _allowed(expression, names: set[str]) -> bool:
    kind = _kind(expression)
    if kind not in EXPRESSIONS or kind in ("ScalarSubquery", "ListQuery", "Exists") and not _known(expression.plan(), names):
        return False
    return all(_allowed(x, names) for x in _each(expression.children()))


def rows_to_context(rows: DataFrame, columns: list[str], key: str) -> DataFrame:
    """key, content (`col: value; col: value`, nulls left out), source; rows of nulls alone are left out."""
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns]
    return rows.select(key, F.concat_ws("; ", *parts).alias("content"), F.lit(SOURCE).alias("source")).where("content <> ''")
