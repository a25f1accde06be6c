"""Where jobs may write intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_local_root: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    Only a local-mode session may go without the setting; it then gets one temporary folder per process. On a cluster
    a machine-local folder would be lost with its executor, so a missing setting is an error there.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not (spark.conf.get("spark.master", None) or "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="searchlog-")
    return _local_root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the scratch root that nothing else uses."""
    return f"{scratch_root(spark)}/searchlog/{name}-{uuid.uuid4().hex}"
