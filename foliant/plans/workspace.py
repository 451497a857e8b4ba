"""Intermediate tables in the folder that all executors share.

A stored table cuts the lineage and survives the loss of executors. The folder is
the session's `spark.checkpoint.dir` or the context's checkpoint folder; only where both are unset
and all tasks run in this process (tests, laptops) a temporary folder is made. On a cluster
that would put the tables on the machines' own disks, so it is an error there.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}

#: Rows up to which a summary table may be broadcast. Such tables hold a handful of
#: short columns, so this bounds a broadcast to a few tens of MB.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    given = context._jsc.sc().getCheckpointDir()
    at = spark.conf.get("spark.checkpoint.dir", None) or (given.get() if given.isDefined() else None)
    app = context.applicationId
    if at:
        folder = f"{at.rstrip('/')}/foliant-{app}"
        if app not in _own:
            _own[app] = folder
            atexit.register(_remove, spark, folder)
        return folder
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="foliant-")
        atexit.register(shutil.rmtree, _own[app], True)
    return _own[app]


def _remove(spark: SparkSession, folder: str) -> None:
    """Remove the application's folder when its driver ends."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have been stopped before
        pass


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back; `discard` removes it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Remove stored tables that nothing lazy reads any more."""
    for df in frames:
        if (path := getattr(df, "_stored_at", None)) is not None:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, name: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """Store a summary and mark it for broadcast if it has at most `most` rows; else it joins by shuffle."""
    out = store(df, name)
    return F.broadcast(out) if out.count() <= most else out
