"""Places for tables that all executors can read: the folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; in local mode without one, in a folder of this session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return f"{folder.rstrip('/')}/{app}/{name}-{uuid.uuid4().hex}"
