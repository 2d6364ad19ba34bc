"""Working storage that outlives executors, and small helpers shared by the operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
LIKE_S3 = {"s3a": "s3", "s3n": "s3"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, only where that is unset and all runs on this machine, one of our own."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="millrace-")
        got = _own[app]
    return got.rstrip("/")


def file_system(path: str):
    """(file system, path in it) of a URI or a plain path, for Python tasks; s3a and s3n are s3 there."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    scheme, rest = path.split("://", 1)
    return fs.FileSystem.from_uri(f"{LIKE_S3.get(scheme, scheme)}://{rest}")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone, and the folder with it or left to its owner
        pass


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder for one query's intermediate files; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_drop, spark, path)
    return path


def stash(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: it is computed once, and lost executors don't lose it."""
    path = work_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


BATCH_ROWS = 1500


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of fewer rows than Spark's default, where nobody has set another number: texts are long, and two copies of a batch are held at once."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def give_back() -> None:
    """Freed memory goes back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(f):
    """A mapInArrow function that gives memory back when its task ends: Python workers outlive tasks and stages."""

    def run(batches):
        yield from f(batches)
        give_back()

    return run


def pick(df: DataFrame, *columns: str) -> DataFrame:
    """Only the needed columns, so that others with whatever names can't clash."""
    small_batches(df.sparkSession)
    return df.select(*[F.col(f"`{c}`") for c in columns])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, nor any that begins with it."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name += "_"
    return name


def as_batch(schema, **columns):
    """An Arrow batch by column name, cast to a schema."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], (pa.Array, pa.ChunkedArray)) else columns[f.name].cast(f.type) for f in schema], schema=schema)
