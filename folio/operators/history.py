"""Conversation history as a table (tenant_id, employee_id, seq, role, content), for all keys at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEPT = 40
NO_HISTORY = "Không có lịch sử trò chuyện"
KEY = ("tenant_id", "employee_id")


def append_trim(history: DataFrame, new: DataFrame, kept: int = KEPT) -> DataFrame:
    """Both tables' messages, the newest `kept` of each key. The rank limit is applied before the shuffle."""
    newest = Window.partitionBy(*KEY).orderBy(F.desc("seq"))
    both = history.unionByName(new)
    return both.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= kept).drop("_n")


def last_n(history: DataFrame, n: int = 2) -> DataFrame:
    """The newest n messages of each key with place, from 1 for the oldest of them."""
    newest = Window.partitionBy(*KEY).orderBy(F.desc("seq"))
    held = history.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n)
    return held.withColumn("place", F.max("_n").over(Window.partitionBy(*KEY)) - F.col("_n") + 1).drop("_n")


def clear(history: DataFrame, keys: DataFrame) -> DataFrame:
    return history.join(keys.select(*KEY).distinct(), list(KEY), "left_anti")


def _line() -> Column:
    who = F.when(F.col("role") == "user", "user").otherwise("assistant")
    return F.concat(who, F.lit(": "), F.coalesce("content", F.lit("")), F.lit("\n"))


def transcript(history: DataFrame, keys: DataFrame) -> DataFrame:
    """keys with transcript: a line for each message in order; a fixed text where there is none."""
    lines = history.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", _line().alias("line")))), lambda x: x.line), "").alias("transcript"))
    return keys.select(*KEY).distinct().join(lines, list(KEY), "left").select(*KEY, F.coalesce("transcript", F.lit(NO_HISTORY)).alias("transcript"))


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, created_at and updated_at (first and last turn), n_messages, messages in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x.role.alias("role"), x.text.alias("content")))
    return messages.groupBy("conv_id").agg(F.min("turn").alias("created_at"), F.max("turn").alias("updated_at"), F.count(F.lit(1)).alias("n_messages"), ordered.alias("messages"))


def conversation_keys(history: DataFrame) -> DataFrame:
    """The distinct keys with conversation_id (tenant:user) and store_key."""
    text = [F.col(k).cast("string") for k in KEY]
    return history.select(*KEY).distinct().select(*KEY, F.concat_ws(":", *text).alias("conversation_id"), F.concat_ws(":", F.lit("chat_history"), *text).alias("store_key"))


def with_context(history: DataFrame, n: int = KEPT) -> DataFrame:
    """Each message with context: the texts of the n messages before it, itself left out."""
    before = Window.partitionBy(*KEY).orderBy("seq").rowsBetween(-n, -1)
    return history.withColumn("context", F.collect_list(F.coalesce("content", F.lit(""))).over(before))
