"""Registered queries of the streams, run over all input that is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators.history import KEPT
from folio.plans.chunking_queries import chunks_sql
from folio.sources.fixtures import fixture, oracle, table
from folio.sources.shared import new_folder
from folio.streaming import ingest as L1
from folio.streaming import streams as L


def _folder(s) -> str:
    return new_folder(s, "stream")


def _stream(s, d, name):
    """The table as a stream; the pattern also takes a table that is one file."""
    return s.readStream.schema(table(s, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def _ingest(s, d):
    """The uploads by ranges of their numbers, in four micro-batches of as many files as the input has partitions: no task has a quarter of all."""
    to = _folder(s)
    uploads = fixture(s, d, "fx_upload").drop("doc_id")
    each = max(1, uploads.rdd.getNumPartitions())
    uploads.repartitionByRange(4 * each, "seq").write.parquet(f"{to}/in")
    rows = s.read.parquet(f"{to}/in")
    held = len(rows.inputFiles())
    L1.ingest_stream(s.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, -(-held // 4))).parquet(f"{to}/in"), f"{to}/index", f"{to}/log").awaitTermination()
    return L1.ingested(s, f"{to}/index").withColumn("accessed_role", F.array_join("accessed_role", ","))


def _with_state(s, run):
    before = s.conf.get("spark.sql.streaming.stateStore.providerClass")
    s.conf.set("spark.sql.streaming.stateStore.providerClass", L.STATE_STORE)
    try:
        run()
    finally:
        s.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def _history(s, d):
    to = _folder(s)
    conv = _stream(s, d, "conversations")
    messages = conv.select((F.col("conv_id") % 7).cast("string").alias("tenant_id"), F.col("conv_id").alias("employee_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("seq"), "role", F.col("text").alias("content"))
    _with_state(s, lambda: L.history_stream(messages, f"{to}/history", f"{to}/log").awaitTermination())
    return L.history(s, f"{to}/history")


#: A day idle, and rows up to an hour late.
TTL, LATE = 86_400, 3600


def _expiry(s, d):
    """Events as messages of their users, in four micro-batches by time: each quarter is written, in as many files as the input has partitions, and taken whole."""
    to = _folder(s)
    events = table(s, d, "events").select(F.lit("t").alias("tenant_id"), F.col("user_id").alias("employee_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("role"), F.col("event_type").alias("content"), F.col("ts").cast("timestamp").alias("ts"))
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    files = max(1, events.rdd.getNumPartitions())
    for k in range(4 if first else 0):
        begin, end = (first + (last - first) / 4 * (k + x) for x in (0, 1))
        part = events.where((F.col("ts") >= begin if k else F.lit(True)) & (F.col("ts") < end if k < 3 else F.lit(True)))
        part.coalesce(files).write.mode("append").parquet(f"{to}/in")
        rows = s.readStream.schema(events.schema).parquet(f"{to}/in")
        _with_state(s, lambda rows=rows: L.history_stream(rows, f"{to}/history", f"{to}/log", ttl=TTL, delay=f"{LATE} seconds").awaitTermination())
    return L.history(s, f"{to}/history")


QUERIES = {"l1_ingest_stream": _ingest, "l2_history_stream": _history, "l2_history_expiry": _expiry}

_ACCEPTED = """acc as (select doc_id, tenant_id, src_file, case when deleted then null else md end as md, replace(roles_csv, ' ', '') as roles, deleted from fx_upload
  where deleted or src_file like '%.md' and octet_length(encode(md)) between 1 and 5242880 and roles_csv not like '%x%'),
  up as (select * from acc qualify row_number() over (partition by tenant_id, src_file order by doc_id desc) = 1),
  live as (select doc_id, tenant_id, src_file, md, roles from up where not deleted)"""

ORACLES = {
    "l1_ingest_stream": oracle(f"with {_ACCEPTED}, ch as (with recursive {chunks_sql('live')[5:]}) select ch.*, roles as accessed_role from ch join live using (tenant_id, src_file)", "fx_upload"),
    "l2_history_expiry": f"""with g as (select *, coalesce(epoch_ms(ts) - lag(epoch_ms(ts)) over w >= {TTL * 1000}, false)::int as gap, max(epoch_ms(ts)) over (partition by user_id) as last from events window w as (partition by user_id order by epoch_ms(ts), event_id)),
      s as (select *, sum(gap) over (partition by user_id order by epoch_ms(ts), event_id) as session from g)
      select 't' as tenant_id, user_id as employee_id, event_id as seq, event_type as role, event_type as content from s where last + {TTL * 1000} > (select max(epoch_ms(ts)) from events) - {LATE * 1000}
      qualify session = max(session) over (partition by user_id) and row_number() over (partition by user_id order by epoch_ms(ts) desc, event_id desc) <= {KEPT}""",
    "l2_history_stream": oracle(f"select * from fx_conv qualify row_number() over (partition by tenant_id, employee_id order by seq desc) <= {KEPT}", "fx_conv"),
}
