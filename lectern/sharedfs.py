"""Cutting lineage with tables written to the folder that all executors share.

The folder is the session's ``spark.checkpoint.dir``; what a session wrote there is
removed when its driver ends, or by :func:`clear`. Only where that setting is
absent and all work is done in one process (a local master, as in tests) a folder of
its own is made, once per session, and removed when the process ends; on a cluster
that is an error, as each executor would write to a folder that no other one sees.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MARKED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The session's own part of the shared folder, without a trailing slash."""
    app = spark.sparkContext.applicationId
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if given:
        return f"{given.rstrip('/')}/lectern-{app}"
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="lectern-")
        atexit.register(shutil.rmtree, own, True)
        _OWN[app] = "file://" + own
    return _OWN[app]


def _remove_at_exit(spark: SparkSession) -> None:
    """Have the session's folder removed when the driver ends, if its JVM still answers then."""
    app = spark.sparkContext.applicationId
    if app in _MARKED:
        return
    _MARKED.add(app)
    path, conf = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark)), spark._jsc.hadoopConfiguration()

    def remove() -> None:
        try:
            path.getFileSystem(conf).delete(path, True)
        except Exception:  # noqa: BLE001 - the JVM went first
            return

    atexit.register(remove)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Unlike a cached or locally checkpointed frame the table survives the loss of
    any executor, and its readers have a short plan.
    """
    spark = df.sparkSession
    _remove_at_exit(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove all tables that the session wrote; frames that read them can't be used after that."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
