"""Where intermediate data goes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The context's checkpoint folder, or the one that spark.checkpoint.dir names: driver and executors share it.

    Where the session names none, a local master gets a folder of this machine, as in tests, and any other an error.
    """
    context = spark.sparkContext
    if (held := context._jsc.sc().getCheckpointDir()).isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
        held = context._jsc.sc().getCheckpointDir()
    return held.get()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
