"""Where files of a job go that it reads back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder below the one that all executors share (spark.checkpoint.dir); a local session without
    one gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
        elif spark.sparkContext.master.startswith("local"):
            root = "file://" + tempfile.mkdtemp(prefix="spark-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/harrow-{what}-{uuid.uuid4().hex}"
