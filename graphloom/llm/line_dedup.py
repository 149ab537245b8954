"""Operator 5: reversible line deduplication with sharded cuckoo filters over exact reference counts.

A line's key is the line without white space ([\\x20\\x09-\\x0D]) at its ends and with A-Z lowered; keys of
fewer than min_chars code points are left alone. A key in at least min_docs documents is hot: all its lines
go, except in the largest doc_id that holds it.

A LineStore keeps, in a folder that all executors share,
* postings: (key, doc_id), each once. They make deletions and the choice of the keeper exact;
* references: key, number of documents, largest doc_id;
* filters: one cuckoo filter per shard of hot keys. Keys enter and leave them as documents are inserted and
  deleted, which a Bloom filter could not do.
Postings meet the filters first, at any size: workers read the filter of one shard after the other from the
folder, and hold HELD of them at most. Only postings that pass are joined with the references, which decide.
No task gets all postings of a line that very many documents share: counting starts with partial sums, and
in the join, keys of CROWD documents or more are salted.

Every change writes new tables and then a manifest that names them; opening a store on a folder goes on from
its last manifest, so a change that broke off is as if it had never begun. One writer at a time.

Null text: one empty line. Null doc_id: the row stays as it is and isn't counted. Rows that share a doc_id
are one document. Empty tables give empty results, and deletions from an empty store change nothing. Very long
texts are handled line by line.
"""

from __future__ import annotations

import functools
import hashlib
import json
import posixpath

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import WHITE_STR, materialize, open_fs, texts_of, trim, width

KEY = ["k1", "k2"]
KEYS_A_SHARD, HELD = 1 << 18, 16
CROWD, SALTS = 1 << 14, 32


class CuckooFilter:
    """Set of 64-bit hashes with deletions: 4 slots a bucket, 16-bit fingerprints, two buckets a key."""

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int = 0, table: np.ndarray | None = None):
        if table is None:
            n = 1
            while n * self.SLOTS * 0.85 < max(1, capacity):
                n *= 2
            table = np.zeros((n, self.SLOTS), np.uint16)
        self.table = table
        self.turn = 0

    @property
    def mask(self) -> int:
        return len(self.table) - 1

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = self._mix(keys.astype(np.uint64))
        mark = (h >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (h & np.uint64(self.mask)).astype(np.int64)
        return mark, first, self._other(first, mark)

    def _other(self, place, mark):
        return (place ^ (self._mix(np.asarray(mark, np.uint64)) & np.uint64(self.mask)).astype(np.int64))

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(keys)
        return (self.table[a] == mark[:, None]).any(axis=1) | (self.table[b] == mark[:, None]).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """False where no room is found; the filter must then be built anew, larger."""
        for mark, a, b in zip(*(x.tolist() for x in self._places(keys))):
            if not self._put(mark, a, b):
                return False
        return True

    def _put(self, mark: int, a: int, b: int) -> bool:
        for place in (a, b):
            row = self.table[place]
            for s in range(self.SLOTS):
                if not row[s]:
                    row[s] = mark
                    return True
        place = b
        for _ in range(self.KICKS):
            self.turn += 1
            s = self.turn % self.SLOTS
            mark, self.table[place, s] = int(self.table[place, s]), mark
            place = int(self._other(np.array([place]), np.array([mark]))[0])
            free = np.nonzero(self.table[place] == 0)[0]
            if len(free):
                self.table[place, free[0]] = mark
                return True
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that have been inserted, each once."""
        for mark, a, b in zip(*(x.tolist() for x in self._places(keys))):
            for place in (a, b):
                at = np.nonzero(self.table[place] == mark)[0]
                if len(at):
                    self.table[place, at[0]] = 0
                    break

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy())

    @classmethod
    def build(cls, keys: np.ndarray) -> CuckooFilter:
        capacity = len(keys)
        while True:
            made = cls(capacity)
            if made.insert(keys):
                return made
            capacity = 2 * max(capacity, 4)


def line_keys(text: str | None, min_chars: int) -> tuple[list[str], list[bytes | None]]:
    """The lines of a text, and each one's 16-byte key hash (None: too short)."""
    import xxhash

    lines = (text or "").split("\n")
    keys: list[bytes | None] = []
    for line in lines:
        s = line.strip(WHITE_STR)
        keys.append(xxhash.xxh3_128_digest(s.encode().lower()) if len(s) >= min_chars else None)
    return lines, keys


def postings(docs: DataFrame, min_chars: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids, keys = [], []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = set(line_keys(text, min_chars)[1]) - {None}
                ids += [doc_id] * len(own)
                keys += own
            pairs = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.array(ids, pa.int64())], [*KEY, "doc_id"])

    rows = texts_of(docs).where("doc_id is not null").mapInArrow(run, "k1 long, k2 long, doc_id long")
    return rows.groupBy(*KEY, "doc_id").agg(F.lit(1)).select(*KEY, "doc_id")


def references(posted: DataFrame) -> DataFrame:
    return posted.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))


@functools.lru_cache(maxsize=HELD)
def load_filter(path: str, shard: int) -> CuckooFilter | None:
    import pyarrow.dataset as ds
    from pyarrow.fs import FileSelector

    fs, at = open_fs(path)
    files = [f.path for f in fs.get_file_info(FileSelector(at)) if f.path.endswith(".parquet")]
    rows = ds.dataset(files, filesystem=fs).to_table(filter=ds.field("shard") == shard).to_pylist() if files else []
    return CuckooFilter.from_bytes(rows[0]["data"]) if rows else None


POSTINGS, REFERENCES, FILTERS = "k1 long, k2 long, doc_id long", "k1 long, k2 long, n_docs long, keeper long", "shard int, data binary"


class LineStore:
    """Versions of the three tables under path; every change writes a new version and keeps the old.

    min_docs and min_chars hold for a new store; one that is opened again keeps its own.
    """

    def __init__(self, spark: SparkSession, path: str, min_docs: int = 5, min_chars: int = 40):
        self.spark, self.path = spark, path
        self.state = {"version": 0, "postings": [], "references": None, "filters": None, "shards": 1, "min_docs": min_docs, "min_chars": min_chars}
        jvm = spark._jvm.org.apache.hadoop.fs
        at = jvm.Path(path)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        done = sorted(f.getPath().getParent().toString() for f in fs.globStatus(jvm.Path(at, "manifest-*/_SUCCESS")) or [])
        if done:
            self.state = json.loads(spark.read.text(done[-1]).first()["value"])
        self.min_docs, self.min_chars = self.state["min_docs"], self.state["min_chars"]

    def _read(self, schema: str, *names: str | None) -> DataFrame:
        there = [posixpath.join(self.path, n) for n in names if n]
        return self.spark.read.schema(schema).parquet(*there) if there else self.spark.createDataFrame([], schema)

    @property
    def posted(self) -> DataFrame:
        return self._read(POSTINGS, *self.state["postings"])

    @property
    def refs(self) -> DataFrame:
        return self._read(REFERENCES, self.state["references"])

    def _save(self, df: DataFrame, what: str) -> str:
        """Its name under path. What a change that broke off has left there is written over."""
        name = f"{what}-{self.state['version'] + 1:06d}"
        df.write.mode("overwrite").parquet(posixpath.join(self.path, name))
        return name

    def _commit(self, **changes) -> LineStore:
        self.state = self.state | changes | {"version": self.state["version"] + 1}
        said = self.spark.createDataFrame([(json.dumps(self.state),)], "value string")
        said.coalesce(1).write.mode("overwrite").text(posixpath.join(self.path, f"manifest-{self.state['version']:06d}"))
        return self

    def _hot(self, refs: DataFrame) -> DataFrame:
        return refs.where(F.col("n_docs") >= self.min_docs)

    def insert(self, docs: DataFrame) -> LineStore:
        """Add documents. Those whose doc_id is there already add only lines they didn't have."""
        fresh = postings(docs, self.min_chars)
        if self.state["postings"]:
            fresh = fresh.join(self.posted, [*KEY, "doc_id"], "left_anti")
        name = self._save(fresh, "postings")
        new = references(self._read(POSTINGS, name))
        if self.state["references"]:
            new = self.refs.unionByName(new).groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))
        refs = self._save(new, "references")
        return self._commit(postings=[*self.state["postings"], name], references=refs, **self._refilter(self.refs, self._read(REFERENCES, refs)))

    def delete(self, doc_ids: DataFrame) -> LineStore:
        """Take documents (doc_id) out again: as if they had never been inserted."""
        gone = doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        touched = self.posted.join(gone, "doc_id", "left_semi").select(*KEY).distinct()
        left = self._save(self.posted.join(gone, "doc_id", "left_anti"), "postings")
        again = references(self._read(POSTINGS, left).join(touched, KEY, "left_semi"))
        refs = self._save(self.refs.join(touched, KEY, "left_anti").unionByName(again), "references")
        return self._commit(postings=[left], references=refs, **self._refilter(self.refs, self._read(REFERENCES, refs)))

    def _refilter(self, old: DataFrame, refs: DataFrame) -> dict:
        """Hot keys that came enter their shard's filter, those that went leave it; full filters are rebuilt."""
        hot = self._hot(refs).select(*KEY)
        shards = max(1, -(-hot.count() // KEYS_A_SHARD))
        grown = not self.state["filters"] or shards > self.state["shards"]
        shards = shards if grown else self.state["shards"]
        shard = F.pmod("k2", F.lit(shards)).cast("int").alias("shard")
        changes = hot.select(shard, "k1", F.lit(1).alias("sign"))
        if not grown:
            was = self._hot(old).select(*KEY)
            changes = hot.join(was, KEY, "left_anti").select(shard, "k1", F.lit(1).alias("sign")).unionByName(was.join(hot, KEY, "left_anti").select(shard, "k1", F.lit(-1).alias("sign")))
        kept = self._read(FILTERS, None if grown else self.state["filters"])
        everything = hot.select(shard, "k1", F.lit(0).alias("sign"))

        def update(key, before, came, whole):
            data = before.column("data").to_pylist()
            signs, keys = came.column("sign").to_numpy(), came.column("k1").to_numpy().astype(np.int64).view(np.uint64)
            made = CuckooFilter.from_bytes(data[0]) if data else None
            if made is not None:
                made.delete(keys[signs < 0])
            if made is None or not made.insert(keys[signs > 0]):
                made = CuckooFilter.build(whole.column("k1").to_numpy().astype(np.int64).view(np.uint64))
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([made.to_bytes()], pa.binary())})

        # cogroup takes two sides: the change rows carry the whole set behind them
        rows = changes.unionByName(everything)

        def split(key, before, rows):
            whole = rows.filter(pa.compute.equal(rows.column("sign"), 0))
            return update(key, before, rows.filter(pa.compute.not_equal(rows.column("sign"), 0)), whole)

        def run(key, left, right):
            import pyarrow.compute  # noqa: F401

            return split(key, left, right)

        name = self._save(kept.groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(run, FILTERS), "filters")
        return {"filters": name, "shards": shards}

    def drops(self) -> DataFrame:
        """(k1, k2, doc_id): the documents' hot lines that go."""
        if not self.state["filters"]:
            return self.posted
        path, shards = posixpath.join(self.path, self.state["filters"]), self.state["shards"]
        shard = F.pmod("k2", F.lit(shards))
        candidates = self.posted
        if shards > HELD:  # else a task would read every filter again and again
            candidates = candidates.repartition(width(self.spark), shard, F.pmod("doc_id", F.lit(SALTS))).sortWithinPartitions(shard)

        def gate(batches):
            for batch in batches:
                k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
                own, passed = np.mod(k2, shards), np.zeros(len(k1), bool)
                for s in np.unique(own).tolist():
                    f = load_filter(path, s)
                    if f is not None:
                        at = np.nonzero(own == s)[0]
                        passed[at] = f.contains(k1[at].view(np.uint64))
                yield batch.filter(pa.array(passed))

        candidates = candidates.select(*KEY, "doc_id").mapInArrow(gate, POSTINGS)
        hot = self._hot(self.refs)
        crowded = materialize(hot.where(F.col("n_docs") >= CROWD).select(*KEY, F.lit(SALTS).alias("salts")), "crowded")  # written: Spark knows its size
        salted = candidates.join(crowded, KEY, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id"), "salts"), F.lit(0)).cast("int"))
        last = F.when(F.col("n_docs") >= CROWD, SALTS - 1).otherwise(0)
        hot = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), last)))
        return salted.join(hot, [*KEY, "salt"]).where("doc_id <> keeper").select(*KEY, "doc_id")


ADDED = ("__n_lines", "__n_dropped", "__kept_sha256")


def rewrite(docs: DataFrame, drops: DataFrame, min_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines in drops (k1, k2, doc_id) gone from the text, and the columns ADDED."""
    keys = drops.groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_list(F.struct(*KEY)).alias("__keys"))
    joined = docs.join(keys, F.col(id_col).cast("long") == F.col("__doc"), "left").drop("__doc")
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(ADDED[0], T.LongType()), T.StructField(ADDED[1], T.LongType()), T.StructField(ADDED[2], T.StringType())])

    def run(batches):
        for batch in batches:
            gone = batch.column(batch.num_columns - 1).to_pylist()
            texts, extra = [], ([], [], [])
            for text, keys in zip(batch.column(at).to_pylist(), gone):
                n = (text or "").count("\n") + 1
                if keys:
                    out = {np.array([k["k1"], k["k2"]], "<i8").tobytes() for k in keys}
                    kept = [line for line, key in zip(*line_keys(text, min_chars)) if key not in out]
                    text, left = "\n".join(kept), len(kept)
                else:
                    left = n
                texts.append(text)
                for c, v in zip(extra, (n, n - left, hashlib.sha256((text or "").encode()).hexdigest())):
                    c.append(v)
            cols = [pa.array(texts, batch.column(i).type) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(extra[0], pa.int64()), pa.array(extra[1], pa.int64()), pa.array(extra[2], pa.string())], names=[f.name for f in schema.fields])
            trim()

    return joined.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, path: str, min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """docs after one insertion into a new store under path; with the columns ADDED."""
    store = LineStore(docs.sparkSession, path, min_docs, min_chars).insert(docs)
    return rewrite(docs, store.drops(), min_chars)
