"""Folders that all executors reach, for tables that a job writes and reads again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``; in a folder of this machine only where that is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="tracklens-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        root = _own[app]
    return f"{root.rstrip('/')}/tracklens/{name}-{uuid.uuid4().hex}"
