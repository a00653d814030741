"""Small tables that hold the cases each operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, words string, shard int, row string"


def docs(spark, texts, start=1):
    """Documents with extra columns whose names clash with the operators' own."""
    rows = [(i, t, "en", "src", len(t or ""), "x", "y", 7, "z") for i, t in enumerate(texts, start)]
    return spark.createDataFrame(rows, DOCS)


HARD = [None, "", " ", "\n\t ", "a", "a", "The cat sat on the mat.", "The cat sat on the mat.", "x" * 5000, "é漢字😀 ▁▁ \x00", "word " * 3000]
