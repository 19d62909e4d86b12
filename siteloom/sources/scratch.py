"""Folders for round trips: below the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below spark.checkpoint.dir, or below a temporary folder in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="siteloom-"))
            atexit.register(shutil.rmtree, _LOCAL[0], True)
        found = f"file://{_LOCAL[0]}"
    return f"{found.rstrip('/')}/siteloom/{label}-{uuid.uuid4().hex}"
