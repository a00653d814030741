"""What comes in and goes out: gates for files and texts, role lists, table reads, page joins and sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.sources.shared import new_folder

PDF_BYTES, MARKDOWN_BYTES = 50 * 1024 * 1024, 5 * 1024 * 1024
MARKDOWN_SUFFIXES = (".md", ".markdown", ".txt")


def upload_gate(files: DataFrame, kind: str) -> DataFrame:
    """files (filename, size_bytes, and for Markdown perhaps content) with reject_reason; null if accepted."""
    name, suffix = F.coalesce("filename", F.lit("")), F.lower(F.regexp_extract(F.coalesce("filename", F.lit("")), r"(\.[^.]*)$", 1))
    if kind == "pdf":
        reason = F.when(name == "", "no_name").when(suffix != ".pdf", "suffix").when(F.col("size_bytes") > PDF_BYTES, "too_large")
    else:
        reason = F.when(~suffix.isin(*MARKDOWN_SUFFIXES), "suffix").when(F.col("size_bytes") == 0, "empty").when(F.col("size_bytes") > MARKDOWN_BYTES, "too_large")
        if "content" in files.columns:
            reason = reason.when(~F.is_valid_utf8("content"), "not_utf8")
    return files.withColumn("reject_reason", reason)


def parse_roles(column: str) -> Column:
    """`1, 2,3` as a list of ints; null if any part is none."""
    parts = F.transform(F.split(column, ","), lambda x: F.trim(x).try_cast("int"))
    return F.when(~F.exists(parts, lambda x: x.isNull()), parts)


def text_gate(rows: DataFrame) -> DataFrame:
    """rows (content, relevance) with question_reason, content_reason and relevance_reason, null where accepted."""
    text = F.regexp_replace(F.coalesce("content", F.lit("")), r"^\s+|\s+$", "")
    question = F.when(F.length(text) < 3, "short")
    content = F.when(text == "", "blank")
    relevance = F.when(~F.col("relevance").between(0, 1), "range")
    return rows.withColumns({"question_reason": question, "content_reason": content, "relevance_reason": relevance})


def scan_uploads(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """path, filename, size_bytes, reject_reason, content of the files under folder; content of accepted ones alone.

    Names and lengths decide first and no content is read for that. Only Markdown files that pass are then opened, with the size
    limit pushed to the source, so a file that is too large never is; a PDF's content is not judged. Spark's source does not list
    empty files, so these have no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    listed = files.select("path", name.alias("filename"), F.col("length").alias("size_bytes"))
    first = upload_gate(listed, kind)
    limit = PDF_BYTES if kind == "pdf" else MARKDOWN_BYTES
    opened = files.where(f"length <= {limit}").select("path", name.alias("filename"), F.col("length").alias("size_bytes"), "content")
    late = upload_gate(opened.where(_named(kind)), kind).select("path", "filename", "size_bytes", "reject_reason", F.when(F.col("reject_reason").isNull(), F.col("content")).alias("content"))
    return first.where("reject_reason is not null").withColumn("content", F.lit(None).cast("binary")).select(*late.columns).unionByName(late)


def _named(kind: str) -> Column:
    """Whether a file (filename, size_bytes) passes the rules for name and length."""
    name = F.coalesce("filename", F.lit(""))
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    if kind == "pdf":
        return (name != "") & (suffix == ".pdf") & ~(F.col("size_bytes") > PDF_BYTES)
    return suffix.isin(*MARKDOWN_SUFFIXES) & ~(F.col("size_bytes") == 0) & ~(F.col("size_bytes") > MARKDOWN_BYTES)


def read_table(spark: SparkSession, options: dict[str, str], schema: str, fmt: str = "jdbc") -> DataFrame:
    """A business table; if it can't be read, an empty one of that schema.

    For jdbc, filters and columns reach the source. What fails only when rows are read does so there; scan_table reads within.
    """
    try:
        return spark.read.format(fmt).options(**options).load()
    except PySparkException:
        return spark.createDataFrame([], schema)


def scan_table(spark: SparkSession, options: dict[str, str], schema: str, key: str | None = None, partitions: int = 8, where: str | None = None, columns: list[str] | None = None, accuracy: float = 0.01) -> DataFrame:
    """A business table read through JDBC into the shared folder; if anything fails, also while rows are read, an empty one of that schema.

    options are those of Spark's jdbc source (url, dbtable, driver, ...). With key, the rows come in `partitions` ranges of
    near equal counts, however skewed the key is: their bounds are quantiles of the key (within `accuracy`), which one scan of that column gives. Rows with
    a null key go with the first range. where and columns reach the source.
    """
    try:
        source = spark.read.format("jdbc").options(**options)
        if key:
            ranks = [k / partitions for k in range(1, partitions)]
            whole = source.load()
            name = next(c for c in whole.columns if c.lower() == key.lower())
            cuts = whole.select(F.col(name).cast("double").alias("k")).stat.approxQuantile("k", ranks, accuracy)
            quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(options["url"]).quoteIdentifier(name)
            ranges = _ranges(quoted, sorted(set(cuts)))
            rest = {k: v for k, v in options.items() if k not in ("url", "dbtable")}
            rows = spark.read.jdbc(options["url"], options["dbtable"], predicates=ranges, properties=rest)
        else:
            rows = source.load()
        rows = rows.where(where) if where else rows
        rows = rows.select(*columns) if columns else rows
        folder = new_folder(spark, "table")
        rows.write.parquet(folder)
        return spark.read.schema(rows.schema).parquet(folder)
    except (PySparkException, Py4JJavaError, StopIteration):
        return spark.createDataFrame([], schema)


def _ranges(key: str, cuts: list[float]) -> list[str]:
    """Conditions that part the rows at the cuts; each row meets exactly one."""
    if not cuts:
        return ["1 = 1"]
    middle = [f"{key} >= {a!r} AND {key} < {b!r}" for a, b in zip(cuts, cuts[1:], strict=False)]
    return [f"{key} < {cuts[0]!r} OR {key} IS NULL", *middle, f"{key} >= {cuts[-1]!r}"]


def markdown_paths(docs: DataFrame) -> DataFrame:
    """docs (tenant_id, src_file, document_id, content) with path and size of the file each becomes."""
    stem = F.coalesce(F.nullif("document_id", F.lit("")), F.regexp_replace("src_file", r"\.[^.]*$", ""))
    return docs.withColumn("path", F.concat(F.lit("ocr/"), "tenant_id", F.lit("/"), stem, F.lit(".md"))).withColumn("size", F.octet_length(F.coalesce("content", F.lit(""))))


def write_markdown(docs: DataFrame, root: str) -> DataFrame:
    """tenant_id, path, size of the Markdown files written under root: one for each document, with its content as UTF-8.

    Each task writes the documents it has, so nothing is shuffled; a task that is run again writes the same files
    again. root is a folder that executors reach, by path or URI. The rows are those of markdown_paths; of documents
    with one path, any is what stays.
    """
    schema = "tenant_id string, path string, size int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root)
        made = set()
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                folder = f"{base}/{path}".rsplit("/", 1)[0]
                if folder not in made:
                    files.create_dir(folder, recursive=True)
                    made.add(folder)
                with files.open_output_stream(f"{base}/{path}") as out:
                    out.write((content.as_py() or "").encode())
            yield batch.select(["tenant_id", "path", "size"])

    written = markdown_paths(docs).select("tenant_id", "path", F.col("size").cast("int"), "content").mapInArrow(run, schema)
    written.write.format("noop").mode("overwrite").save()
    return markdown_paths(docs).select("tenant_id", "path", F.col("size").cast("int"))


def read_markdown(written: DataFrame, root: str) -> DataFrame:
    """written (tenant_id, path, ...) with content, the bytes of each file under root, read by the tasks that have its row.

    Nothing lists the folders, as their files may be as many as the documents.
    """
    schema = "tenant_id string, path string, content binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                content = []
                for path in part.column("path").to_pylist():
                    with files.open_input_stream(f"{base}/{path}") as held:
                        content.append(held.read())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(content, pa.binary())], ["tenant_id", "path", "content"])

    return written.select("tenant_id", "path").distinct().mapInArrow(run, schema)


def assemble_pages(pages: DataFrame) -> DataFrame:
    """document_id, text: a document's page texts (document_id, page_no, text) in order, a blank line between them."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda x: F.coalesce(x.text, F.lit("")))
    return pages.groupBy("document_id").agg(F.array_join(ordered, "\n\n").alias("text"))


def plan_documents(slides: DataFrame) -> DataFrame:
    """deck_id, plan: each deck's slides as one JSON text, with nulls written out.

    deck_title and language, columns of slides that are the same over a deck, stand once at the top.
    """
    fields = [c for c in slides.columns if c not in ("deck_id", "deck_title", "language")]
    ordered = F.array_sort(F.collect_list(F.struct(*fields)))
    plan = F.struct(F.lit("2.0").alias("schema_version"), F.first("deck_title").alias("deck_title"), F.first("language").alias("language"), F.size(ordered).alias("total_slides"), ordered.alias("slides"))
    return slides.groupBy("deck_id").agg(F.to_json(plan, {"ignoreNullFields": "false"}).alias("plan"))
