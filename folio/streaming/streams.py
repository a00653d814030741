"""Continuous history, equal to its batch form once all input is there. Ingestion is in ingest.py."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from folio.operators.history import KEPT, KEY

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MESSAGES = "tenant_id string, employee_id long, seq long, role string, content string"


class Newest(StatefulProcessor):
    """Keeps the newest messages of a key in state and gives them all whenever some are new.

    With ttl (seconds) it needs the messages' event time in `ts`: a key that stands idle for so long is emptied by a timer
    and gives one row without seq, and a message that comes after such a gap starts afresh.
    """

    def __init__(self, kept: int, ttl: int | None = None) -> None:
        self.kept, self.ttl = kept, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("messages", "seq long, role string, content string, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = {m[0]: tuple(m) for m in self.state.get()}
        before = max((m[3] for m in held.values()), default=None)
        for part in rows:
            for m in zip(*(part[c].tolist() for c in ("seq", "role", "content", "at")), strict=True):
                held.setdefault(m[0], m)
        kept = sorted(held.values(), key=lambda m: (m[3], m[0]))  # rows of a batch come in any order
        if self.ttl:
            idle = self.ttl * 1000
            gaps = [k for k in range(1, len(kept)) if kept[k][3] - kept[k - 1][3] >= idle]
            kept = kept[gaps[-1] :] if gaps else kept
            if before != kept[-1][3]:  # a key has one timer, at its last message
                if before is not None:
                    self.handle.deleteTimer(before + idle)
                self.handle.registerTimer(kept[-1][3] + idle)
        kept = kept[-self.kept :]
        self.state.put(kept)
        seq, role, content, _ = (list(x) for x in zip(*kept, strict=True))
        yield pd.DataFrame({"tenant_id": key[0], "employee_id": key[1], "seq": seq, "role": role, "content": content})

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        empty = pd.DataFrame({"tenant_id": [key[0]], "employee_id": [key[1]]})
        yield empty.assign(seq=pd.Series([None], dtype="Int64"), role=None, content=None)

    def close(self) -> None:
        pass


def history_stream(messages: DataFrame, path: str, checkpoint: str, kept: int = KEPT, ttl: int | None = None, delay: str = "0 seconds") -> StreamingQuery:
    """The newest `kept` messages of each key, written whenever a key changes. Needs STATE_STORE as provider.

    With ttl, messages have ts. Time is the watermark: the latest ts of the batches before, less `delay`. A key whose last message is ttl
    seconds before it is empty; a message later than that by its own ts is left out, as Spark does with late rows. Order is by ts, then seq. Without
    ttl, order is by seq and nothing expires. The state is in the checkpoint, so a stream that starts again goes on.
    """
    at = F.unix_millis(F.col("ts").cast("timestamp")) if ttl else F.lit(0).cast("long")
    rows = (messages.withWatermark("ts", delay) if ttl else messages).withColumn("at", at)
    newest = rows.groupBy(*KEY).transformWithStateInPandas(Newest(kept, ttl), MESSAGES, "Update", "EventTime" if ttl else "None")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return newest.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def history(spark: SparkSession, path: str) -> DataFrame:
    """Each key's messages as of its last batch; expired keys have none."""
    rows = spark.read.parquet(path).drop("batch")
    last = rows.join(rows.groupBy(*KEY).agg(F.max("version").alias("version")), [*KEY, "version"])
    return last.where("seq is not null").drop("version")
