"""Paths for files that a query writes and reads again: in the folder that all executors see."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_WRITTEN: dict[str, SparkSession] = {}
_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a session of one machine gets a temporary folder;
    on a cluster that is an error, as executors would not see each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return _LOCAL[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own, removed when the driver ends, or before by `discard`."""
    path = f"{shared_folder(spark)}/rivulet-{uuid.uuid4().hex[:12]}/{name}"
    _WRITTEN[path] = spark
    return path


def paths() -> set[str]:
    """What new_path has given and nothing has removed."""
    return set(_WRITTEN)


def discard(*paths: str) -> None:
    """Removes what was written at paths of new_path, once nothing reads it any more."""
    for path in paths:
        spark = _WRITTEN.pop(path, None)
        if spark is not None:
            own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
            own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)


@atexit.register
def _clean() -> None:
    for path in list(_WRITTEN):
        try:
            discard(path)
        except Exception:  # the session is gone: the cluster's own cleaning applies
            return
