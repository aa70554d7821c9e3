"""The folder that all executors share: checkpoints and written tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Only where that is unset and all runs in one process, as in tests, a
    temporary folder is set and used; on a cluster that is an error, because
    executors would write to disks of their own.  Checkpoints that nothing
    refers to any more are deleted.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), f"leadline-{uuid.uuid4().hex}")
        sc.setCheckpointDir(f"file://{root}")
        root = sc.getCheckpointDir()
        _written.append((spark, root))
    return root


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, removed when the program ends."""
    path = f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, with its lineage cut by a reliable checkpoint."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system and path objects of ``path``."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    """Delete ``path`` and all below it, if it exists."""
    fs, at = filesystem(spark, path)
    fs.delete(at, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
            elif path.startswith("file:"):
                shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass
    _written.clear()
