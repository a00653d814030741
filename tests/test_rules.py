"""Values at the edges of the rules."""

from pyspark.sql import functions as F

from folio.functions.text import token_count
from folio.operators import blocks as B
from folio.operators import chunking as K
from folio.operators import context as X
from folio.operators import decks as J
from folio.operators import history as H
from folio.operators import index as I
from folio.operators import report as R
from folio.operators import retrieval as V
from folio.operators import sqlgate as S
from folio.operators import templates as T
from folio.sources import gates as A


def one(spark, column, schema="x string", row=("",)):
    return spark.createDataFrame([row], schema).select(column).first()[0]


def test_chunk_sizes(spark):
    assert [one(spark, K.label_method(F.lit(n))) for n in (199, 200, 201, 1200, 1201)] == ["merged_small", "merged_small", "markdown_adaptive", "markdown_adaptive", "hybrid_semantic"]
    assert [one(spark, token_count("x"), row=("a" * n,)) for n in (0, 1, 3, 4, 6)] == [1, 1, 1, 2, 2]
    words = [f"{i:05d}" for i in range(2900)]
    runs = one(spark, K.hard_cap("x"), row=(" ".join(words),))
    assert max(map(len, runs)) <= 3 * K.CAP and set(" ".join(runs).split()) == set(words)
    assert all(0 < len(set(a.split()) & set(b.split())) <= K.OVERLAP * 3 // 6 for a, b in zip(runs, runs[1:]))
    assert one(spark, K.hard_cap("x"), row=("a b",)) == ["a b"] and one(spark, K.hard_cap("x"), row=("",)) == [""]
    long = one(spark, K.hard_cap("x", 20, 5), row=("y" * 500 + " end",))
    assert max(map(len, long)) <= 60 and sum(r.count("y") for r in long) >= 500 and long[-1].endswith("end")


def test_merge_keeps_topics_and_sizes(spark):
    def merged(*sections):
        frame = spark.createDataFrame([("d", i, h1, "x" * (3 * tokens - 2)) for i, (tokens, h1) in enumerate(sections)], "k string, idx int, h1 string, content string")
        return [r.n_sections for r in K.merge_small(frame, "k", "idx").orderBy("merged").collect()]

    assert merged((199, "a"), (1300, "a")) == [2] and merged((199, "a"), (1301, "a")) == [1, 1]
    assert merged((200, "a"), (499, "a")) == [2] and merged((200, "a"), (500, "a")) == [1, 1]
    assert merged((10, "a"), (10, "b")) == [1, 1] and merged((10, None), (10, None)) == [2]


def test_header_context(spark):
    inject = lambda text: one(spark, K.inject_context("x", F.lit("A"), F.lit(None)), row=(text,))
    assert inject("b" * 299 + "A") == "b" * 299 + "A"
    assert inject("b" * 300 + "A") == "**Bối cảnh: A**\n\n" + "b" * 300 + "A"
    assert one(spark, K.inject_context("x", F.lit(None), F.lit(None)), row=("t",)) == "t"


def test_structural_pieces_keep_all_text(spark):
    text = "\n\n".join("Sentence here. " * n for n in (10, 200, 3, 400)) + "\n" + "y" * 3000
    pieces = one(spark, K.structural_pieces("x"), row=(text,))
    assert "".join(pieces) == text and sum(len(p) > 2000 for p in pieces) == 1


def test_chunks_hold_their_document(spark):
    md = "# T\n\n" + "\n\n".join(f"## S{i}\n\n" + f"Word{i} and more. " * 30 for i in range(12))
    docs = spark.createDataFrame([(1, "t", "f.md", md), (2, "t", "g.md", ""), (3, "t", "h.md", None)], "doc_id long, tenant_id string, src_file string, md string")
    rows = K.chunk_documents(docs).orderBy("src_file", "chunk_idx").collect()
    assert {r.src_file for r in rows} == {"f.md"} and [r.chunk_idx for r in rows] == list(range(len(rows)))
    assert all(f"Word{i}" in "".join(r.content for r in rows) for i in range(12))


def test_blocks(spark):
    md = "# A\n```py\n# no\n```\n| a | b\\|c |\n|---|---|\n| 1 | 2 |\n\n3. x\n  - y\n4. z\n\n![](u.png) text <!-- slide: cut -->\n## B\nend"
    docs = spark.createDataFrame([(1, md), (2, ""), (3, None)], "doc_id long, md string")
    rows = B.with_section_path(B.extract_blocks(docs)).orderBy("block_no").collect()
    assert [(r.kind, r.text) for r in rows] == [("heading", "A"), ("code", "# no"), ("table", "Table with headers: a, b|c"), ("list", "3. x\n  - y\n4. z"), ("paragraph", "text"), ("image", "u.png"), ("directive", "cut"), ("heading", "B"), ("paragraph", "end")]
    assert rows[1].language == "py" and rows[-1].section_path == ["A", "B"] and rows[0].id == "src-0001"
    assert one(spark, B.fold(F.lit("Mục Lục:"))) == "muc luc" and one(spark, B.fold(F.lit("Đà"))) == "đa"


def test_pages(spark):
    page = lambda items: [len(p) for p in one(spark, J.paginate("x"), "x array<string>", (items,))]
    assert page(["a"] * 6) == [6] and page(["a"] * 7) == [6, 1]
    assert page(["a" * 250, "b" * 250]) == [2] and page(["a" * 250, "b" * 251]) == [1, 1]
    assert page(["a" * 600, "b"]) == [1, 1] and page([]) == []
    items = lambda text: one(spark, J.text_items("x"), row=(text,))
    assert items("- x; y; z") == ["x", "y", "z"] and items("- x; y") == ["x; y"] and items("1. a\n\n2) b") == ["a", "b"]
    assert items("A. " * 200)[:2] == ["A.", "A."] and items(" ") == []


def test_report_defaults(spark):
    emp = spark.createDataFrame([(1, "t", 7, "", 0, None, "2020-05-01"), (2, "t", 7, None, None, "x", ""), (3, "t", None, "f", 1, "x", "2021")], "id int, tenant_id string, work_department_id int, gender string, work_position_id int, education_level string, hire_date string")
    got = {(r.kind, r.part): r.value for r in R.distributions(emp).collect()}
    assert got == {("position", "0"): 2, ("gender", "Khác"): 2, ("education", "Khác"): 1, ("education", "x"): 1}
    assert [(r.year, r.hires) for r in R.hires_by_year(emp).collect()] == [("2020", 1)]
    assert [r.route for r in R.report_intent(spark.createDataFrame([("Báo cáo quý",), ("xin chào",)], "question string")).collect()] == ["report", "retrieval"]


def test_history_and_context(spark):
    rows = spark.createDataFrame([("t", 1, s, r, c) for s, r, c in ((1, "user", "q"), (2, "tool", None), (3, "assistant", "a"))], "tenant_id string, employee_id long, seq long, role string, content string")
    assert H.transcript(rows, rows).first().transcript == "user: q\nassistant: \nassistant: a\n"
    assert {r.seq: r.context for r in H.with_context(rows, 1).collect()} == {1: [], 2: ["q"], 3: [""]}
    assert H.append_trim(rows, rows.withColumn("seq", F.col("seq") + 10), 4).agg(F.min("seq")).first()[0] == 3
    out = spark.createDataFrame([('{"answer": "x", "citation": null}',), ("{}",), ("[1]",), (None,), ('a {"b": {"c": 1}} d',), ("} {",)], "raw_answer string")
    assert [(r.answer, r.citation) for r in X.parse_answer(out).collect()][:3] == [("x", ""), ("", ""), (X.BAD_JSON, "")]
    assert [r.json for r in X.recover_json(out).collect()][3:] == [None, '{"b": {"c": 1}}', None]


def test_templates_are_literal(spark):
    fill = lambda text, value: one(spark, T.fill("x", "m"), "x string, m map<string,string>", (text, {"a.b": value}))
    assert fill("{{ a.b }}-{{a.b}}-{{ axb }}", "c\\1 $5") == "c\\1 $5-c\\1 $5-{{ axb }}" and fill("{{a.b}}", None) == ""


def test_gates(spark):
    files = spark.createDataFrame([("a.PDF", 1), ("", 1), ("a.txt", 1), ("a.pdf", A.PDF_BYTES + 1), (None, 1)], "filename string, size_bytes long")
    assert [r.reject_reason for r in A.upload_gate(files, "pdf").collect()] == [None, "no_name", "suffix", "too_large", "no_name"]
    texts = spark.createDataFrame([("a.md", 3, b"abc"), ("a.md", 2, b"\xff\xfe"), ("a.md", 0, b""), ("a.doc", 1, b"a")], "filename string, size_bytes long, content binary")
    assert [r.reject_reason for r in A.upload_gate(texts, "markdown").collect()] == [None, "not_utf8", "empty", "suffix"]
    assert [one(spark, A.parse_roles("x"), row=(v,)) for v in ("1, 2,3", "1,x", "")] == [[1, 2, 3], None, None]
    assert A.read_table(spark, {"path": "/no/such/path"}, "a long", "parquet").columns == ["a"]


def test_guarded_select(spark):
    spark.createDataFrame([(9,)], "a int").createOrReplaceTempView("secret")
    views = {"t": spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")}
    run = lambda sql: sorted(map(tuple, S.guarded_select(spark, sql, views).collect()))
    assert run("SELECT TOP 1 a FROM dbo.t WHERE b = N'y';") == [(2,)]
    assert run("select x.a from t x join t as y on x.a = y.a") == [(1,), (2,)]
    assert [run(q) for q in ("select * from secret", "drop table t", "select 1; select 2", "select a from t where a in (select a from secret)", "select nope from t", "")] == [[]] * 6


def test_upserts_and_access(spark):
    held = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "chunk_id string, v int, version int")
    new = spark.createDataFrame([("b", 2, 2), ("b", 3, 3), ("c", 2, 2)], "chunk_id string, v int, version int")
    got = I.upsert(held, new)
    assert sorted((r.chunk_id, r.v) for r in got.collect()) == [("a", 1), ("b", 3), ("c", 2)]
    assert sorted(map(tuple, I.upsert(got, new).collect())) == sorted(map(tuple, got.collect()))
    chunks = spark.createDataFrame([(1, "t", [1], "red cat", [1.0, 0.0]), (2, "t", [2], "red dog", [0.0, 1.0]), (3, "u", [1], "red cat", [1.0, 0.0]), (4, "t", [1], "", None)], "point_id long, tenant_id string, accessed_role array<int>, content string, vector array<double>")
    q = spark.createDataFrame([(7, "t", 1, "a red cat", [2.0, 0.0])], "qid long, tenant_id string, role_id int, question string, vector array<double>")
    assert [(r.point_id, r.score) for r in V.dense_topk(q, chunks, 9).collect()] == [(1, 1.0)]
    assert [r.point_id for r in V.sparse_topk(q, chunks, 9).collect()] == [1]
    assert [(r.point_id, r.rank) for r in V.hybrid_search(q, chunks).collect()] == [(1, 1)]
    full = spark.createDataFrame([(1, "t", [1], [1.0, 0.0]), (2, "t", [2], [0.0, 1.0])], "point_id long, tenant_id string, accessed_role array<int>, vector array<double>")
    approx = V.approx_topk(q, full, 9).collect()
    assert [r.point_id for r in approx] == [1]
