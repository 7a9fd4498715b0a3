"""New folders that driver and executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import SparkSession


@functools.cache
def _own(app: str) -> str:
    return tempfile.mkdtemp(prefix=f"trackspark-{app}-")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below ``spark.checkpoint.dir`` that nothing uses yet.

    A cluster has to set it; a local session without it gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or "cluster" in master:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{_own(spark.sparkContext.applicationId)}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
