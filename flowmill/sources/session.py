"""Session settings and the shared working folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings results depend on: hours and days are UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder, which goes when the
    process ends.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "flowmill.shared.dir", None
    )
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        path = tempfile.mkdtemp(prefix="flowmill-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("flowmill.shared.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


_made: dict[str, list[str]] = {}


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder (not created yet); :func:`clean` deletes it."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clean(spark: SparkSession) -> int:
    """Delete what this application has put below its shared folder; for the end of a job, when its
    results are written elsewhere. Returns the number of folders."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def discard(spark: SparkSession, path: str) -> None:
    """Delete one folder that :func:`new_dir` named, once nothing reads it any more."""
    _made[spark.sparkContext.applicationId].remove(path)
    _delete(spark, path)


def pinned_at(df: DataFrame, name: str = "pinned") -> tuple[DataFrame, str]:
    """``df`` written as Parquet to the shared folder and read back, and where it is."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def pinned(df: DataFrame, name: str = "pinned") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back, so its values no longer change."""
    return pinned_at(df, name)[0]
