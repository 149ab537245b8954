"""Shared plumbing: the cluster's shared folder, materialised steps, file access, row helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.shared import discard, scratch, shared_dir, small_batches, trim  # noqa: F401

WHITE = b" \t\n\r\x0b\x0c"
WHITE_STR = " \t\n\r\x0b\x0c"


def materialize(df: DataFrame, name: str, path: str | None = None, folder: str | None = None) -> DataFrame:
    """Write df to the shared folder (or a folder there) and read it back: cuts lineage, survives lost executors."""
    path = path or scratch(df.sparkSession, name, folder)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def open_fs(uri: str):
    """(file system, path) of a URI, for workers: local and any store that pyarrow knows."""
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(uri)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) only, whatever further columns there are."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
