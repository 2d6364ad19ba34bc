"""Where intermediate results and gate state live: the cluster's shared folder, or a folder that the caller names."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
LIKE_S3 = {"s3a": "s3", "s3n": "s3"}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where that is unset, and all runs on this machine, a folder of our own."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="millrace-")
        got = _own[app]
    return got.rstrip("/")


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files in a folder of any file system, sorted."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return sorted(f.getPath().getName() for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p) if f.isFile())


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder of any file system, sorted."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return sorted(f.getPath().getName() for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p) if f.isDirectory() and "=" in f.getPath().getName())


def file_system(path: str):
    """(file system, path in it) of a URI or a plain path, for Python tasks; s3a and s3n are s3 there."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    scheme, rest = path.split("://", 1)
    return fs.FileSystem.from_uri(f"{LIKE_S3.get(scheme, scheme)}://{rest}")


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file of any file system that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _remove_late(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session has ended
        pass


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove_late, spark, path)
    return path


def stash(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again, so that it neither runs twice nor is lost with an executor."""
    path = work_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
