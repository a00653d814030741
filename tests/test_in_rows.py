"""Work that stays in a document's row, or in one shuffle: plans, and results against plain versions."""

import random

from pyspark.sql import functions as F

from folio.operators import blocks as B
from folio.operators import digests as G
from folio.operators import templates as T
from folio.operators.markdown import list_marks


def moves(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hash"), plan.count("Join")


def test_blocks_are_made_without_a_shuffle(spark):
    docs = spark.createDataFrame([(1, "# a\n\n3. x\n4. y\n  - z\n\n| h |\n| - |\n| 1 |\n\n![](u.png) <!-- slide: b -->"), (2, None)], "doc_id long, md string")
    found = B.extract_blocks(docs)
    assert moves(found) == (0, 0)
    assert [(r.block_no, r.kind, r.text) for r in sorted(found.collect(), key=lambda r: r.block_no)] == [(1, "heading", "a"), (2, "list", "3. x\n4. y\n  - z"), (3, "table", "Table with headers: h"), (4, "image", "u.png"), (5, "directive", "b")]


def test_titles_take_one_shuffle(spark):
    docs = spark.createDataFrame([(1, "## a\n\n# b")], "doc_id long, md string")
    assert moves(B.doc_titles(B.extract_blocks(docs))) == (1, 0)


def test_section_numbers_take_one_shuffle(spark):
    docs = spark.createDataFrame([(1, "# a\n\nx\n\n# b\n\ny")], "doc_id long, md string")
    found = B.compact_sections(B.with_section_path(B.extract_blocks(docs)))
    assert moves(found)[0] == 1 and [r.section_no for r in found.orderBy("block_no").collect()] == [1, 2]


def test_list_marks():
    assert list_marks(["3. a", "9. b", "  - c", "    1. d", "  7. e", "- f", "1. g"]) == ([0, 0, 1, 2, 1, 0, 0], [3, 4, None, 1, None, None, 6])


def test_sections_are_packed_in_one_pass(spark):
    rng, rows, want = random.Random(3), [], {}
    for doc in range(30):
        part, parts, held = -1, [], None
        for block in range(rng.randint(1, 120)):
            section, size = block // 7, rng.choice([0, None, 1, 5, 9, 30])
            n = size or 0
            if held and held[0] == section and held[1] + n <= 20:
                held = section, held[1] + n
                parts[-1] += n
            else:
                part, held = part + 1, (section, n)
                parts.append(n)
            rows.append((doc, section, block, size, "t"))
            want[doc, block] = [part, None]
        pack, total, packs = 0, None, []
        for n in parts:
            pack, total = (0, n) if total is None else (pack, total + n) if total + n <= 20 else (pack + 1, n)
            packs.append(pack)
        for k in want:
            if k[0] == doc:
                want[k][1] = packs[want[k][0]]
    data = spark.createDataFrame(rows, "doc_id long, section_no int, block_no int, size int, text string").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = G.pack_sections(data, limit=20)
        got = {(r.doc_id, r.block_no): [r.part, r.pack] for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == want and found.columns == [*data.columns, "part", "pack"]
    assert moves(found)[1] == 0


def test_digests_stay_in_their_row(spark):
    packs = spark.createDataFrame([(1, "B b 1. A a. A b 2! c"), (2, " "), (3, None)], "doc_id long, content string")
    found = G.digest(packs, ("doc_id",))
    assert moves(found) == (0, 0)
    assert [(r.doc_id, r.title, r.summary, r.facts) for r in found.collect()] == [(1, "B b 1.", "B b 1. A a. A b 2! c", ["B b 1.", "A b 2!"])]


def test_reduction_packs_by_line(spark):
    text = "\n".join(["x" * 9000, "y" * 3600, "z. " * 1000])
    assert [k for k, _ in G._packs(text)] == [0, 1]
    out = G.tree_reduce(spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string"), budget=900).collect()
    assert {r.doc_id: r.rounds for r in out} == {1: 1, 2: 0}


def test_placeholders_take_one_shuffle_and_no_join(spark):
    parts = spark.createDataFrame([(1, 1, "{{b}} {{ c }}"), (1, 0, "{{a}} {{b}} {{a}}"), (2, 0, "none"), (3, 0, None)], "tpl_id int, part_no int, part string")
    found = T.placeholders(parts)
    assert moves(found) == (1, 0)
    assert {r.tpl_id: r.fields for r in found.collect()} == {1: ["a", "b", "c"], 2: [], 3: []}
