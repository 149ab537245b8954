"""Incremental work with exactly-once output: a ledger of the keys that are done, and one commit an epoch.

    path/data/epoch=E              what the work gave for E's new keys
    path/keys/epoch=E/bucket=B     those keys, by hash bucket
    path/filters/epoch=E/bucket=B  their bits: (slot, word), 64 bits a word, two bits a key
    path/commits/epoch=E           one row, written last

An epoch counts once its commit is there. Epochs follow each other, so all up to the last commit count, and
readers prune by that number. A run that is killed before its commit leaves files of an epoch that nobody
reads; when it runs again it writes the same folders anew, and a batch that runs again after its commit does
nothing. So no key is worked on twice in what counts.

A batch looks only at buckets that it has keys of, and of these it reads keys only where some key's two bits
are set; other keys are certainly new. What comes to the driver is a batch's bucket numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Ledger:
    """The output and done keys of incremental work under path. buckets and slots must stay the same for a path."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64, slots: int = 1 << 14, format: str = "parquet"):
        self.spark, self.path, self.keys, self.buckets, self.slots, self.format = spark, path.rstrip("/"), keys, buckets, slots, format
        #: Buckets whose keys the last batch has read.
        self.read_buckets: list[int] = []

    def last(self) -> int:
        """The last epoch that counts, -1 before the first."""
        try:
            return self.spark.read.json(f"{self.path}/commits").agg(F.max("epoch")).first()[0]
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return -1
            raise

    def rows(self) -> DataFrame | None:
        """All output that counts, None before the first epoch."""
        last = self.last()
        if last < 0:
            return None
        return self.spark.read.option("basePath", f"{self.path}/data").format(self.format).load(f"{self.path}/data").where(F.col("epoch") <= last).drop("epoch")

    def epoch(self, epoch: int) -> DataFrame:
        """The output of one epoch, whether it counts yet or not."""
        return self.spark.read.format(self.format).load(f"{self.path}/data/epoch={epoch}")

    def _hash(self) -> Column:
        return F.xxhash64(*self.keys)

    def _bits(self) -> Column:
        """The two (slot, word) of a key, from parts of its hash that its bucket doesn't depend on."""
        h = F.xxhash64(F.lit("bits"), *self.keys)
        one = lambda at: F.struct(F.pmod(F.shiftrightunsigned(h, at), F.lit(self.slots)).cast("int").alias("slot"), F.expr("1L").alias("one"), F.shiftrightunsigned(h, at + 20).bitwiseAND(F.lit(63)).cast("int").alias("bit"))
        return F.array(one(0), one(32))

    def _filter_rows(self, keyed: DataFrame) -> DataFrame:
        bits = keyed.select("bucket", F.explode(self._bits()).alias("b")).select("bucket", "b.slot", F.expr("shiftleft(b.one, b.bit)").alias("word"))
        return bits.groupBy("bucket", "slot").agg(F.bit_or("word").alias("word"))

    def _stored(self, what: str, found: list[int], last: int) -> DataFrame | None:
        """Rows of these buckets and of epochs that count; only their folders are listed and read."""
        try:
            return self.spark.read.parquet(f"{self.path}/{what}").where(F.col("bucket").isin(found) & (F.col("epoch") <= last))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def new_rows(self, batch: DataFrame) -> DataFrame:
        """The batch's rows whose keys aren't done, each key once (repeated ones: any of its rows)."""
        keyed = batch.dropDuplicates(self.keys).withColumn("__bucket", F.pmod(self._hash(), F.lit(self.buckets)).cast("int"))
        self.read_buckets, last = [], self.last()
        if last < 0:
            return keyed.drop("__bucket")
        found = [r[0] for r in keyed.select("__bucket").distinct().collect()]
        words = self._stored("filters", found, last)
        if words is None:
            return keyed.drop("__bucket")
        words = words.groupBy("bucket", "slot").agg(F.bit_or("word").alias("word"))
        asked = keyed.select(*self.keys, F.col("__bucket").alias("bucket"), F.explode(self._bits()).alias("b")).select(*self.keys, "bucket", "b.*")
        met = asked.join(words, ["bucket", "slot"]).where(F.expr("shiftright(word, bit) & 1L = 1L"))
        maybe = [r[0] for r in met.groupBy("bucket", *self.keys).agg(F.count("*").alias("n")).where("n = 2").select("bucket").distinct().collect()]
        if not maybe:
            return keyed.drop("__bucket")
        self.read_buckets = sorted(maybe)
        done = self._stored("keys", maybe, last).select(*(F.col(k).alias(f"__{k}") for k in self.keys))
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.keys]
        return keyed.join(done, same, "left_anti").drop("__bucket")

    def write(self, batch: DataFrame, epoch: int, work: Callable[[DataFrame], DataFrame]) -> None:
        """Work on the batch's new keys as epoch, all but the commit. work: a function of rows; what it gives is stored."""
        new = self.new_rows(batch)
        keyed = new.select(*self.keys).withColumn("bucket", F.pmod(self._hash(), F.lit(self.buckets)).cast("int"))
        stage = f"{self.path}/keys_of/epoch={epoch}"
        keyed.write.mode("overwrite").parquet(stage)  # decided once: the steps below must see the same keys
        keyed = self.spark.read.schema(keyed.schema).parquet(stage)
        chosen = keyed.select(*(F.col(k).alias(f"__{k}") for k in self.keys))
        rows = batch.dropDuplicates(self.keys).join(chosen, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.keys], "left_semi")
        work(rows).write.mode("overwrite").format(self.format).save(f"{self.path}/data/epoch={epoch}")
        for what, table in (("keys", keyed), ("filters", self._filter_rows(keyed))):
            # All that an earlier, lost run of this epoch has left is replaced, whatever its batch was.
            table.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{self.path}/{what}/epoch={epoch}")

    def commit(self, epoch: int) -> None:
        self.spark.range(1).select(F.lit(True).alias("done")).coalesce(1).write.mode("overwrite").json(f"{self.path}/commits/epoch={epoch}")

    def process(self, batch: DataFrame, work: Callable[[DataFrame], DataFrame], epoch: int | None = None) -> bool:
        """Work on new keys and commit; False if the epoch (default: the next) has been committed before."""
        last = self.last()
        epoch = last + 1 if epoch is None else epoch
        if epoch <= last:
            return False
        self.write(batch, epoch, work)
        self.commit(epoch)
        return True

    def follow(self, stream: DataFrame, checkpoint: str, work: Callable[[DataFrame], DataFrame]) -> None:
        """process() for each batch of a stream, until its input is used up."""
        q = stream.writeStream.foreachBatch(lambda df, epoch: (self.process(df, work, epoch), None)[1]).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
