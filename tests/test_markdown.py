"""The kinds of Markdown blocks, one case for each, and documents of random lines against the SQL recursion."""

import random

import duckdb
import pytest

from folio.operators import blocks as B
from folio.operators import chunking as K
from folio.operators.markdown import parse, sections
from folio.plans.markdown_sql import blocks_sql

CASES = [
    ("", []),
    (" \n\t\n", []),
    ("# A\n#\n###### B ##\n####### no\n#no", [("heading", ["# A"]), ("heading", ["#"]), ("heading", ["###### B ##"]), ("paragraph", ["####### no", "#no"])]),
    ("   # in\n    # code", [("heading", ["# in"]), ("code", ["```", "# code", "```"])]),
    ("```py x\na\n```\nb", [("code", ["```py x", "a", "```"]), ("paragraph", ["b"])]),
    ("~~~\n```\n# a\n~~~~\nb", [("code", ["```", "```", "# a", "```"]), ("paragraph", ["b"])]),
    ("````\n```\n````", [("code", ["```", "```", "```"])]),
    ("~~~\nnever\n\nclosed", [("code", ["```", "never", "", "closed", "```"])]),
    ("  ```\n    a\n b\n  ```", [("code", ["```", "  a", "b", "```"])]),
    ("``` a`b\ntext", [("paragraph", ["``` a`b", "text"])]),
    ("text\n```\na\n```\ntext", [("paragraph", ["text"]), ("code", ["```", "a", "```"]), ("paragraph", ["text"])]),
    ("    a\n\n\n      b\n\nc", [("code", ["```", "a", "", "", "  b", "```"]), ("paragraph", ["c"])]),
    ("\ta", [("code", ["```", "a", "```"])]),
    ("text\n    lazy", [("paragraph", ["text", "    lazy"])]),
    ("One\ntwo\n===\nSub\n-\nx", [("heading", ["# One two"]), ("heading", ["## Sub"]), ("paragraph", ["x"])]),
    ("===\n\n---\n***\n_ _ _\nx", [("paragraph", ["==="]), ("paragraph", ["x"])]),
    ("> a\n> b\nc\n\nd", [("paragraph", ["a", "b", "c"]), ("paragraph", ["d"])]),
    ("> # h\n> ```\n> x\ny", [("heading", ["# h"]), ("code", ["```", "x", "```"]), ("paragraph", ["y"])]),
    ("> > deep\n> less\nnone", [("paragraph", ["deep", "less", "none"])]),
    ("a\n> b", [("paragraph", ["a"]), ("paragraph", ["b"])]),
    ("- a\n  - b\n- c\nlazy\n\n- d\n\n  more\n\ntext", [("list", ["- a", "  - b", "- c lazy", "- d more"]), ("paragraph", ["text"])]),
    ("- a\n\n1. b\n2. c", [("list", ["- a"]), ("list", ["1. b", "2. c"])]),
    ("* * *\n* a", [("list", ["* a"])]),
    ("| a | b |\n| - | - |\n| 1 | 2 |\nx", [("table", ["| a | b |", "| - | - |", "| 1 | 2 |"]), ("paragraph", ["x"])]),
]


@pytest.mark.parametrize("text, want", CASES)
def test_kinds(text, want):
    assert [(kind, lines) for _, kind, lines in parse(text)[0]] == want


def test_fields_of_blocks(spark):
    md = "Title\n=====\n\n~~~ sql\n\nselect 1\n\n~~~\n\n    a\n      b\n\n> - q\n\n"
    docs = spark.createDataFrame([(1, md), (2, None), (3, "x")], "doc_id long, md string")
    got = [(r.doc_id, r.id, r.kind, r.text, r.level, r.language) for r in B.extract_blocks(docs).orderBy("doc_id", "block_no").collect()]
    assert got == [(1, "src-0001", "heading", "Title", 1, None), (1, "src-0002", "code", "select 1", None, "sql"), (1, "src-0003", "code", "a\n  b", None, ""), (1, "src-0004", "list", "- q", None, None), (3, "src-0001", "paragraph", "x", None, None)]


def test_headers_in_fences_and_three_levels(spark):
    md = "intro\n# A\n~~~\n# no\n```\n# no\n~~~\n## B\nx\n### C ###\ny\n# D"
    docs = spark.createDataFrame([(1, md), (2, None)], "doc_id long, md string")
    two = [(r.section, r.h1, r.h2) for r in K.split_headers(docs).orderBy("section").collect()]
    assert two == [(0, None, None), (1, "A", None), (2, "A", "B"), (3, "D", None)]
    three = [(r.section, r.h1, r.h2, r.h3, r.content) for r in K.split_headers(docs, levels=3).orderBy("section").collect()]
    assert three[3] == (3, "A", "B", "C", "### C ###\ny") and three[4] == (4, "D", None, None, "# D")
    assert "\n".join(c for _, _, c in sections(md)) == md


def test_random_lines_like_the_recursion_in_sql():
    rng = random.Random(8)
    lines = ["", " ", "a", "  b c", "    d", "\te", "# f", "## g #", "```", "~~~", "```` x", "~~~~", "  ```", "===", "---", "- h", "  - i", "* j", "2. k", "3) l", "> m", "> # n", "> ```", "> - o", ">", "> >  p", "| q | r |", "***", "-", "> ~~~"]
    con = duckdb.connect()
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 14))) for _ in range(1500)]
    # The SQL knows fences in quotes of one mark only.
    texts = [t for t in texts if "> >" not in t or "```" not in t and "~~~" not in t]
    con.execute("create table md as select unnest(?::int[]) as doc_id, unnest(?::varchar[]) as md", [list(range(len(texts))), texts])
    got: dict[int, list] = {}
    for d, n, kind, found in con.execute(f"with recursive {blocks_sql('select * from md')} select * from lb").fetchall():
        got.setdefault(d, []).append((n, kind, "\n".join(found)))
    for k, t in enumerate(texts):
        assert sorted(got.get(k, [])) == [(n, kind, "\n".join(found)) for n, kind, found in parse(t)[0]], t
