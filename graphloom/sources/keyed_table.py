"""A stored table of one row a key, changed by upserts that rewrite only the hash buckets they touch.

    path/rows/bucket=B    the table
    path/log/N            what upsert N makes of the buckets it touches, written first
    path/applied/N        one row, written once path/rows has it

Last wins: of rows with one key, the one of the largest stamp stays; among equal stamps the new one, so that an upsert
that runs twice changes nothing. An upsert that is lost while it replaces buckets is finished from its log by the next
one, or by repair(). One writer at a time. Null keys are one key.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, key: str, stamp: str, buckets: int = 64):
        self.spark, self.path, self.key, self.stamp, self.buckets = spark, path.rstrip("/"), key, stamp, buckets
        #: Buckets that the last upsert has rewritten.
        self.touched: list[int] = []

    def _read(self, what: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{what}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def rows(self) -> DataFrame | None:
        """The table, None before the first upsert."""
        found = self._read("rows")
        return None if found is None else found.drop("bucket")

    def _last(self, what: str) -> int:
        found = self._read(f"{what}/*")
        return -1 if found is None else found.agg(F.max("__n")).first()[0]

    def repair(self) -> int:
        """Finish an upsert that was logged but not applied; gives the number of the last one."""
        n, done = self._last("log"), self._last("applied")
        if n > done:
            self._apply(n)
        return max(n, done)

    def _apply(self, n: int) -> None:
        staged = self.spark.read.parquet(f"{self.path}/log/{n}").where("bucket is not null").drop("__n")
        staged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/rows")
        self.spark.range(1).select(F.lit(n).alias("__n")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/applied/{n}")

    def merged(self, new: DataFrame) -> DataFrame:
        """What the buckets that new has keys of become: the last row of each key, with its bucket."""
        new = new.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
        self.touched = sorted(r[0] for r in new.select("bucket").distinct().collect())
        both, old = new.withColumn("__new", F.lit(1)), self._read("rows")
        if old is not None:
            both = both.unionByName(old.where(F.col("bucket").isin(self.touched)).withColumn("__new", F.lit(0)), allowMissingColumns=True)
        names = [c for c in both.columns if c not in ("__new", "bucket", self.key)]
        # A key's rows meet in a partial aggregate, so that a key with many updates is no large group.
        best = both.groupBy("bucket", self.key).agg(F.max_by(F.struct(*names), F.struct(F.col(self.stamp), F.col("__new"))).alias("__r"))
        return best.select("bucket", self.key, *(F.col("__r")[c].alias(c) for c in names))

    def upsert(self, new: DataFrame) -> None:
        """Put new (key, stamp, further columns) into the table."""
        n = self.repair() + 1
        self.merged(new).withColumn("__n", F.lit(n)).write.mode("overwrite").parquet(f"{self.path}/log/{n}")
        self._apply(n)
