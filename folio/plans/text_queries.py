"""Registered queries of gates, history, context and guarded SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import context as X
from folio.operators import history as H
from folio.operators import sqlgate as S
from folio.sources import gates as A
from folio.sources.shared import new_folder
from folio.sources.fixtures import fixture, oracle, table

CONV = "fx_conv"
SELECT = "SELECT TOP 20 n.n_name, count(*) AS n_customers, sum(c.c_acctbal) AS balance FROM dbo.customer c JOIN dbo.nation n ON c.c_nationkey = n.n_nationkey WHERE c.c_mktsegment <> N'BUILDING' GROUP BY n.n_name ORDER BY n.n_name;"


def _hits(s, d):
    """The turns of each conversation as the hits of a question."""
    q, doc = fixture(s, d, "fx_conv"), table(s, d, "conversations")
    return q.select(F.col("employee_id").cast("string").alias("qid"), F.col("seq").alias("rank"), "content", F.lit(None).cast("string").alias("text"), F.when(F.col("role") == "user", F.concat(F.lit("doc_"), F.col("employee_id").cast("string"), F.lit(".md"))).alias("src_file"), F.lit(None).cast("string").alias("filename")), doc


def _context(s, d):
    hits, _ = _hits(s, d)
    ids = hits.select("qid").distinct().union(s.createDataFrame([("none",)], "qid string"))
    return X.context_text(ids, hits)


def _people(s, d):
    return S.rows_to_context(fixture(s, d, "fx_employee"), ["full_name", "gender", "education_level", "work_department_id"], "id")


def _db(s, d):
    orders = table(s, d, "orders").withColumn("k", F.struct("o_custkey", "o_orderkey"))
    rows = S.rows_to_context(orders, ["o_orderstatus", "o_orderpriority"], "k").select(F.col("k.o_custkey").alias("c_custkey"), F.col("k.o_orderkey").alias("row_no"), "content")
    return X.db_context(table(s, d, "customer"), rows, "c_custkey")


def _append(s, d):
    hits, _ = _hits(s, d)
    rows = table(s, d, "conversations").where("role = 'system'").select(F.col("conv_id").cast("string").alias("qid"), F.col("turn").alias("row_no"), F.col("text").alias("content"))
    ranked = hits.select("qid", F.expr("row_number() over (partition by qid order by rank)").alias("rank"), "content", F.coalesce("src_file", F.lit("?")).alias("source"))
    return X.append_sources(ranked, rows)


def _messages(s, d):
    conv = fixture(s, d, CONV)
    q = _hits(s, d)[0].select("qid").distinct().withColumn("question", F.concat(F.lit("? "), "qid"))
    history = H.transcript(conv, conv.select("tenant_id", "employee_id").distinct()).select(F.col("employee_id").cast("string").alias("qid"), F.col("transcript").alias("history"))
    rows = table(s, d, "conversations").where("role = 'system'").select(F.col("conv_id").cast("string").alias("qid"), F.col("turn").alias("row_no"), F.col("text").alias("content"))
    return X.build_messages(q, _context(s, d), history, X.db_context(q, rows, "qid"))


def _records(s, d):
    answers = X.parse_answer(fixture(s, d, "fx_llm")).select("conv_id", "turn", "answer", "citation")
    questions = table(s, d, "conversations").select("conv_id", "turn", (F.col("conv_id") % 7).cast("string").alias("tenant_id"), (F.col("conv_id") % 5).alias("employee_id"), F.col("text").alias("question"))
    return X.answer_records(answers, questions)


def _cleared(s, d):
    conv = fixture(s, d, CONV)
    return H.clear(conv, conv.where("employee_id = 3").select("tenant_id", "employee_id"))


def _transcript(s, d):
    conv = fixture(s, d, CONV)
    keys = conv.select("tenant_id", "employee_id").union(s.createDataFrame([("none", 1)], "tenant_id string, employee_id long"))
    return H.transcript(conv, keys)


def _append_trim(s, d):
    conv = fixture(s, d, CONV)
    return H.append_trim(conv.where("seq % 2 = 0"), conv.where("seq % 2 = 1"), 10)


def _markdown(s, d):
    docs = fixture(s, d, "fx_doc").withColumn("document_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")))
    root = new_folder(s, "markdown")
    files = A.read_markdown(A.write_markdown(docs, root), root)
    return files.select("tenant_id", "path", F.octet_length("content").alias("size"), F.md5("content").alias("md5"))


def _texts(s, d):
    """Documents as files of several names; some empty, some with a byte that is no UTF-8."""
    kind = F.element_at(F.array(*(F.lit(x) for x in (".md", ".TXT", ".markdown", ".pdf", "", ".md.exe"))), (F.col("doc_id") % 6 + 1).cast("int"))
    bad, body = F.expr("unhex('C328')"), F.col("text").cast("binary")
    content = F.when(F.col("doc_id") % 7 == 3, F.concat(body, bad)).when(F.col("doc_id") % 11 == 5, F.expr("cast('' as binary)")).otherwise(body)
    files = table(s, d, "documents").select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), kind).alias("filename"), content.alias("content"))
    return files.withColumn("size_bytes", F.octet_length("content").cast("long"))


QUERIES = {
    "a1_upload_gate": lambda s, d: A.upload_gate(fixture(s, d, "fx_file"), "pdf").select("page_id", "filename", "size_bytes", "reject_reason"),
    "a1_upload_gate_markdown": lambda s, d: A.upload_gate(_texts(s, d), "markdown").select("doc_id", "filename", "size_bytes", "reject_reason"),
    "a2_parse_role_list": lambda s, d: fixture(s, d, "fx_file").select("page_id", A.parse_roles("roles_csv").alias("roles")),
    "a3_relational_scan": lambda s, d: A.read_table(s, {"path": f"{d}/customer.parquet"}, "c_custkey long", "parquet").where("c_acctbal > 0").select("c_custkey", "c_name", "c_nationkey"),
    "a4_markdown_sink": _markdown,
    "a5_page_join": lambda s, d: A.assemble_pages(table(s, d, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page_no"), "text")),
    "a6_plan_sink": lambda s, d: A.plan_documents(fixture(s, d, "fx_slide").select("deck_id", F.concat(F.lit("Deck "), F.col("deck_id").cast("string")).alias("deck_title"), F.lit("vi").alias("language"), "slide_no", "slide_id", "kind", "title")),
    "a7_text_gate": lambda s, d: A.text_gate(fixture(s, d, "fx_message")).select("conv_id", "turn", "question_reason", "content_reason", "relevance_reason"),
    "g1_append_trim": _append_trim,
    "g2_last_n": lambda s, d: H.last_n(fixture(s, d, CONV), 5).select("tenant_id", "employee_id", "seq", "role", "place"),
    "g3_clear": _cleared,
    "g4_transcript": _transcript,
    "g5_conversation_rollup": lambda s, d: H.conversations(table(s, d, "conversations")).select("conv_id", "created_at", "updated_at", "n_messages", F.to_json("messages").alias("messages")),
    "g6_conversation_key": lambda s, d: H.conversation_keys(fixture(s, d, CONV)),
    "g7_turn_order": lambda s, d: H.with_context(fixture(s, d, CONV), 3).select("tenant_id", "employee_id", "seq", F.array_join("context", "|").alias("context")),
    "h1_context_blocks": _context,
    "h2_db_context": _db,
    "h3_message_build": _messages,
    "h4_append_sources": _append,
    "h5_parse_answer": lambda s, d: X.parse_answer(fixture(s, d, "fx_llm")).select("conv_id", "turn", "answer", "citation"),
    "h6_recover_json": lambda s, d: X.recover_json(fixture(s, d, "fx_llm")).select("conv_id", "turn", "json", "ok"),
    "h7_answer_record": _records,
    "e1_guarded_select": lambda s, d: S.guarded_select(s, SELECT, {t: table(s, d, t) for t in ("customer", "nation")}).withColumn("balance", F.round("balance", 2)),
    "e2_clean_sql": lambda s, d: fixture(s, d, "fx_llm").select("conv_id", "turn", S.clean_sql("raw_sql").alias("sql")),
    "e3_rows_to_context": _people,
}

_BLOCKS = """select qid, string_agg('--- TÀI LIỆU SỐ [' || i::varchar || '] ---' || chr(10) || '(Nguồn: ' || source || ')' || chr(10) || 'Nội dung:' || chr(10) || content || chr(10), chr(10) || chr(10) order by i) as context
  from (select employee_id::varchar as qid, trim(content) as content, case when role = 'user' then 'doc_' || employee_id::varchar || '.md' else 'Không xác định' end as source, row_number() over (partition by employee_id order by seq) as i from fx_conv) group by qid
  union all select 'none', 'Không có thông tin ngữ cảnh.'"""
_PEOPLE = "select id, concat_ws('; ', 'full_name: ' || full_name, 'gender: ' || gender, 'education_level: ' || education_level, 'work_department_id: ' || work_department_id::varchar) as content, 'mssql_database_result' as source from fx_employee"
_LINE = "case when role = 'user' then 'user' else 'assistant' end || ': ' || content || chr(10)"
_ANSWER = """select conv_id, turn, case when turn % 4 = 0 then coalesce(json_extract_string(raw_answer, '$.answer'), '') else 'Không đọc được câu trả lời.' end as answer,
  case when turn % 4 = 0 then coalesce(json_extract_string(raw_answer, '$.citation'), '') else '' end as citation from fx_llm"""
_EMPTY = "nullif(array_to_string(%s, ''), '')"

ORACLES = {
    "a6_plan_sink": oracle("select deck_id, to_json({'schema_version': '2.0', 'deck_title': 'Deck ' || deck_id::varchar, 'language': 'vi', 'total_slides': count(*), 'slides': list({'slide_no': slide_no, 'slide_id': slide_id, 'kind': kind, 'title': title} order by slide_no)})::varchar as plan from fx_slide group by deck_id", "fx_slide"),
    "h3_message_build": oracle(
        f"""select c.qid, [{{'role': 'system', 'content': concat_ws(chr(10) || chr(10), '{X.INTRO}', '{X.RULES}', 'LỊCH SỬ TRÒ CHUYỆN:', h.transcript, 'NGỮ CẢNH:', c.context, nullif(coalesce(s.body, ''), ''), '{X.OUTPUT_RULE}')}}, {{'role': 'human', 'content': '? ' || c.qid}}] as messages
        from ({_BLOCKS}) c join (select employee_id::varchar as qid, string_agg({_LINE}, '' order by seq) as transcript from fx_conv group by all) h on h.qid = c.qid
        left join (select conv_id::varchar as qid, 'BẮT ĐẦU DỮ LIỆU MSSQL' || chr(10) || string_agg('--- KẾT QUẢ MSSQL SỐ [' || i::varchar || '] ---' || chr(10) || text, chr(10) || chr(10) order by i) || chr(10) || 'KẾT THÚC DỮ LIỆU MSSQL' as body
          from (select conv_id, text, row_number() over (partition by conv_id order by turn) as i from conversations where role = 'system') group by conv_id) s on s.qid = c.qid where c.qid <> 'none'""",
        CONV,
    ),
    "a1_upload_gate_markdown": """with f as (select doc_id, 'doc_' || doc_id || (['.md', '.TXT', '.markdown', '.pdf', '', '.md.exe'])[doc_id % 6 + 1] as filename,
        case when doc_id % 7 = 3 then octet_length(encode(text)) + 2 when doc_id % 11 = 5 then 0 else octet_length(encode(text)) end::bigint as size_bytes from documents)
        select *, case when not regexp_matches(lower(filename), '\\.(md|markdown|txt)$') then 'suffix' when size_bytes = 0 then 'empty' when size_bytes > 5242880 then 'too_large' when doc_id % 7 = 3 then 'not_utf8' end as reject_reason from f""",
    "a1_upload_gate": oracle("select page_id, filename, size_bytes, case when filename = '' then 'no_name' when not lower(filename) like '%.pdf' then 'suffix' when size_bytes > 52428800 then 'too_large' end as reject_reason from fx_file", "fx_file"),
    "a2_parse_role_list": oracle("select page_id, case when len(list_filter(l, lambda x: x is null)) = 0 then l end as roles from (select page_id, list_transform(string_split(roles_csv, ','), lambda x: try_cast(trim(x) as int)) as l from fx_file)", "fx_file"),
    "a3_relational_scan": "select c_custkey, c_name, c_nationkey from customer where c_acctbal > 0",
    "a4_markdown_sink": oracle("select tenant_id, 'ocr/' || tenant_id || '/' || case when doc_id % 2 = 0 then doc_id::varchar else 'doc_' || doc_id::varchar end || '.md' as path, strlen(content)::int as size, md5(content) as md5 from fx_doc", "fx_doc"),
    "a5_page_join": "select conv_id as document_id, string_agg(text, chr(10) || chr(10) order by turn) as text from conversations group by conv_id",
    "a7_text_gate": oracle(
        """select conv_id, turn, case when length(t) < 3 then 'short' end as question_reason, case when t = '' then 'blank' end as content_reason,
        case when relevance < 0 or relevance > 1 then 'range' end as relevance_reason from (select *, regexp_replace(content, '^\\s+|\\s+$', '', 'g') as t from fx_message)""",
        "fx_message",
    ),
    "g1_append_trim": oracle("select * from fx_conv qualify row_number() over (partition by tenant_id, employee_id order by seq desc) <= 10", CONV),
    "g2_last_n": oracle("select tenant_id, employee_id, seq, role, row_number() over (partition by tenant_id, employee_id order by seq)::int as place from (select * from fx_conv qualify row_number() over (partition by tenant_id, employee_id order by seq desc) <= 5)", CONV),
    "g3_clear": oracle("select * from fx_conv where employee_id <> 3", CONV),
    "g4_transcript": oracle(f"select tenant_id, employee_id, string_agg({_LINE}, '' order by seq) as transcript from fx_conv group by all union all select 'none', 1, 'Không có lịch sử trò chuyện'", CONV),
    "g5_conversation_rollup": "select conv_id, min(turn) as created_at, max(turn) as updated_at, count(*) as n_messages, to_json(list({'role': role, 'content': text} order by turn))::varchar as messages from conversations group by conv_id",
    "g6_conversation_key": oracle("select distinct tenant_id, employee_id, tenant_id || ':' || employee_id::varchar as conversation_id, 'chat_history:' || tenant_id || ':' || employee_id::varchar as store_key from fx_conv", CONV),
    "g7_turn_order": oracle("select tenant_id, employee_id, seq, coalesce(array_to_string(list(content) over (partition by tenant_id, employee_id order by seq rows between 3 preceding and 1 preceding), '|'), '') as context from fx_conv", CONV),
    "h1_context_blocks": oracle(_BLOCKS, CONV),
    "h2_db_context": """select c_custkey, coalesce('BẮT ĐẦU DỮ LIỆU MSSQL' || chr(10) || string_agg('--- KẾT QUẢ MSSQL SỐ [' || i::varchar || '] ---' || chr(10) || content, chr(10) || chr(10) order by i) || chr(10) || 'KẾT THÚC DỮ LIỆU MSSQL', '') as db_context
        from customer left join (select o_custkey, 'o_orderstatus: ' || o_orderstatus || '; o_orderpriority: ' || o_orderpriority as content, row_number() over (partition by o_custkey order by o_orderkey) as i from orders) on o_custkey = c_custkey group by c_custkey""",
    "h4_append_sources": oracle(
        """select employee_id::varchar as qid, row_number() over (partition by employee_id order by seq)::int as rank, content, case when role = 'user' then 'doc_' || employee_id::varchar || '.md' else '?' end as source from fx_conv
        union all select conv_id::varchar, ((select count(*) from fx_conv f where f.employee_id = c.conv_id) + turn)::int, text, 'mssql_database_result' from conversations c where role = 'system'""",
        CONV,
    ),
    "h5_parse_answer": oracle(_ANSWER, "fx_llm"),
    "h6_recover_json": oracle(
        """select conv_id, turn, j as json, j is not null as ok from (select conv_id, turn, case when turn % 4 = 0 then raw_answer when turn % 4 = 1 then '{"answer": "ok"}' end as j from fx_llm)""",
        "fx_llm",
    ),
    "h7_answer_record": oracle(
        f"""select (c.conv_id % 7)::varchar as tenant_id, c.conv_id % 5 as employee_id, c.turn, (c.conv_id % 7)::varchar || ':' || (c.conv_id % 5)::varchar as conversation_id, c.text as question, a.answer, a.citation,
        case when a.citation like '%.docx' then a.citation end as report_file from conversations c join ({_ANSWER}) a on a.conv_id = c.conv_id and a.turn = c.turn""",
        "fx_llm",
    ),
    "e1_guarded_select": "select n.n_name, count(*) as n_customers, round(sum(c.c_acctbal), 2) as balance from customer c join nation n on c.c_nationkey = n.n_nationkey where c.c_mktsegment <> 'BUILDING' group by n.n_name order by n.n_name limit 20",
    "e2_clean_sql": oracle("select conv_id, turn, case turn % 4 when 0 then 'select TOP 3 n_name from dbo.nation;' when 1 then 'SELECT r_name FROM region;' else '' end as sql from fx_llm", "fx_llm"),
    "e3_rows_to_context": oracle(_PEOPLE, "fx_employee"),
}
