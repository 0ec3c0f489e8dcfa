"""Intermediate results that are computed once: reliable checkpoints in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_shared(spark: SparkSession) -> None:
    """Let checkpoints go to ``spark.checkpoint.dir`` of the session; only a ``local`` master may do without that."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='lumenspan-')}"
    context.setCheckpointDir(root)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows as they are now, partition by partition, without their lineage."""
    ensure_shared(df.sparkSession)
    return df.checkpoint(eager=True)


_FOLDERS: dict[str, list[str]] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI next to the checkpoints, for files that an operator writes and reads; it goes when the application ends."""
    ensure_shared(spark)
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = []
        atexit.register(_release, spark, app)
    _FOLDERS[app].append(f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}")
    return _FOLDERS[app][-1]


def _release(spark: SparkSession, app: str) -> None:
    for uri in _FOLDERS.pop(app, []):
        try:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001 - the session may be gone at exit; then the cluster's own clean-up has the folder
            return
