"""The cluster's shared folder, and the size of what goes between Spark and its Python workers."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

from pyspark.sql import SparkSession

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch between Spark and its Python workers; Spark's own default is 64 MB, several copies of which live at once.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Batches of BATCH_BYTES in this session, where it has Spark's default."""
    if spark.conf.get(BATCH) in ("67108864b", "64MB", "64m"):
        spark.conf.set(BATCH, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where none is set (local tests)."""
    small_batches(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base or "file://" + tempfile.mkdtemp(prefix="graphloom-"))
    return base or context.getCheckpointDir()


def scratch(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """A new path in the shared folder, or in a folder there."""
    return posixpath.join(folder or shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def discard(spark: SparkSession, path: str) -> None:
    """Delete working files that nothing reads any more."""
    gone = spark._jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def trim() -> None:
    """Give memory that a worker has freed back to the system, between batches."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass
