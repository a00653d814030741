"""Texts for a model's prompt, and what its answers hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.operators.history import NO_HISTORY

NO_CONTEXT, NO_SOURCE = "Không có thông tin ngữ cảnh.", "Không xác định"
BAD_JSON = "Không đọc được câu trả lời."
INTRO = "Bạn trả lời câu hỏi của nhân viên dựa trên tài liệu của công ty."
RULES = "Chỉ dùng thông tin có trong ngữ cảnh và lịch sử; nếu không đủ thì nói rõ là không biết, và luôn nêu nguồn."
OUTPUT_RULE = 'Chỉ trả về JSON: {"question": "...", "answer": "...", "citation": "..."}'


def _joined(rows: DataFrame, by: str, order: str, text: Column, name: str) -> DataFrame:
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))), lambda x: x.t), "\n\n").alias(name))


def context_text(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """qid, context: a numbered block for each hit (qid, rank, content, text, src_file, filename), in rank order."""
    content = F.trim(F.coalesce(F.nullif("content", F.lit("")), "text", F.lit("")))
    source = F.coalesce("src_file", "filename", F.lit(NO_SOURCE))
    number = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    block = F.concat(F.lit("--- TÀI LIỆU SỐ ["), F.col("i").cast("string"), F.lit("] ---\n(Nguồn: "), source, F.lit(")\nNội dung:\n"), content, F.lit("\n"))
    made = _joined(hits.withColumn("i", number), "qid", "i", block, "context")
    return questions.select("qid").join(made, "qid", "left").select("qid", F.coalesce("context", F.lit(NO_CONTEXT)).alias("context"))


def db_context(groups: DataFrame, rows: DataFrame, by: str) -> DataFrame:
    """by, db_context: numbered blocks of rows (by, row_no, content) between marks; '' for a group without rows."""
    number = F.row_number().over(Window.partitionBy(by).orderBy("row_no"))
    block = F.concat(F.lit("--- KẾT QUẢ MSSQL SỐ ["), F.col("i").cast("string"), F.lit("] ---\n"), F.col("content"))
    made = _joined(rows.withColumn("i", number), by, "i", block, "body")
    text = F.concat(F.lit("BẮT ĐẦU DỮ LIỆU MSSQL\n"), F.col("body"), F.lit("\nKẾT THÚC DỮ LIỆU MSSQL"))
    return groups.select(by).distinct().join(made, by, "left").select(by, F.coalesce(text, F.lit("")).alias("db_context"))


def build_messages(questions: DataFrame, contexts: DataFrame, histories: DataFrame, rows: DataFrame) -> DataFrame:
    """qid, messages: a system text (introduction, rules, history, context, database rows, output rule) and the question.

    contexts (qid, context), histories (qid, history) and rows (qid, db_context) may lack a question, and a part that
    is empty is left out.
    """
    parts = questions
    for more in (contexts, histories, rows):
        parts = parts.join(more.hint("merge"), "qid", "left")
    history, context = F.coalesce("history", F.lit(NO_HISTORY)), F.coalesce("context", F.lit(NO_CONTEXT))
    system = F.concat_ws("\n\n", F.lit(INTRO), F.lit(RULES), F.lit("LỊCH SỬ TRÒ CHUYỆN:"), history, F.lit("NGỮ CẢNH:"), context, F.nullif("db_context", F.lit("")), F.lit(OUTPUT_RULE))
    pair = F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("human").alias("role"), F.col("question").alias("content")))
    return parts.select("qid", pair.alias("messages"))


def append_sources(hits: DataFrame, rows: DataFrame) -> DataFrame:
    """qid, rank, content, source: each question's hits, then its database rows in order."""
    last = hits.groupBy("qid").agg(F.max("rank").alias("last"))
    after = rows.join(last, "qid", "left").select("qid", (F.coalesce("last", F.lit(0)) + F.col("row_no")).cast("int").alias("rank"), "content", F.lit("mssql_database_result").alias("source"))
    return hits.select("qid", F.col("rank").cast("int").alias("rank"), "content", "source").unionByName(after)


def parse_answer(outputs: DataFrame, text: str = "raw_answer") -> DataFrame:
    """outputs with answer and citation: '' where the JSON lacks them; a fixed text where it is no JSON object."""
    good = F.expr(f"try_variant_get(try_parse_json(`{text}`), '$', 'map<string,variant>')").isNotNull()
    get = lambda k: F.coalesce(F.get_json_object(text, f"$.{k}"), F.lit(""))
    return outputs.withColumn("answer", F.when(good, get("answer")).otherwise(BAD_JSON)).withColumn("citation", F.when(good, get("citation")).otherwise(""))


def recover_json(outputs: DataFrame, text: str = "raw_answer") -> DataFrame:
    """outputs with json (the whole text, or from its first { to its last }, whichever parses) and ok."""
    inner = F.nullif(F.regexp_extract(text, r"(\{[\s\S]*\})", 1), F.lit(""))
    whole = F.when(F.expr(f"try_parse_json(`{text}`)").isNotNull(), F.col(text))
    part = F.when(F.try_parse_json(inner).isNotNull(), inner)
    found = F.coalesce(F.nullif(whole, F.lit("")), part)
    return outputs.withColumn("json", found).withColumn("ok", found.isNotNull())


def answer_records(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """tenant_id, employee_id, conversation_id, question, answer, citation, report_file (null without a report)."""
    joined = questions.join(answers, ["conv_id", "turn"])
    key = F.concat_ws(":", F.col("tenant_id"), F.col("employee_id").cast("string"))
    report = F.when(F.col("citation").endswith(".docx"), F.col("citation"))
    return joined.select("tenant_id", "employee_id", "turn", key.alias("conversation_id"), "question", "answer", "citation", report.alias("report_file"))
