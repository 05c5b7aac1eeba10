"""Where tables go that outlive a task but not the work: a folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path below ``spark.checkpoint.dir``. Only a local session without the setting gets a folder of its own machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file:///tmp/checkpoints/tidemark"
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
