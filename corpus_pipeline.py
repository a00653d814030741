"""A corpus pipeline: documents of good quality, one of each group of near copies, free of benchmark passages, with
pseudonyms for personal data, as pieces of a public vocabulary.

Each stage takes (spark, docs, sf_dir) and returns the next stage's docs. All but the last keep the columns of
documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from folio.llm import decontaminate, near_copies, pii, quality, sentencepiece_scan
from folio.llm.common import read, shared_folder

KEY = "an example key; give your own"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the classifier, fitted on docs, does not reject. Null and empty texts are judged like texts without words."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the least doc_id: five-word shingles, similarity 0.8 or more.

    Candidates come from SimHash prints and their Gray-order index and, as these are too coarse for this bound alone (README, 2), from
    MinHash bands; near_copies verifies each.
    Rows without an id count after those with one.
    """
    return near_copies.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that overlap no test text of benchmark. Null and empty texts stay."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with pseudonyms for the personal data in their texts. A null text stays null."""
    return pii.pseudonymise(docs, KEY)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, decoded_crc32, round_trip, ids."""
    return sentencepiece_scan.round_trip(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("PII pseudonyms", pseudonymised),
    ("SentencePiece", pieces),
]

#: Most stages are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's rows are written to the shared folder and read again by the next."""
    out = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{k}")
        docs = spark.read.parquet(f"{out}/{k}")
    return docs
