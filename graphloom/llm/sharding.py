"""Operator 7: byte-balanced shards by Karmarkar-Karp differencing of indivisible groups.

A group is all documents of equal text. A partial partition is a vector of bin sums; differencing takes
the two partial partitions of largest spread and combines them, the largest sums of one with the smallest
of the other, until one is left. It runs twice: each task differences the groups it holds into a number of
bins (each group its own bin, where there are few), then the driver differences all these bins, at most
PIECES and one more a task whatever the number of documents, into the shards. A group far larger than
others keeps a bin nearly to itself, so that the shard that gets it gets little else.

Slots are gapless from 0 in each shard: tasks count their own rows, and the counts, one a task and shard,
give the offsets. Nothing is gathered by shard.

Null text: no bytes, in one group with empty texts. Null doc_id: carried along. Repeated rows: members of
the same group. Empty tables give empty results. A group larger than a shard's share makes shards unequal
by as much as it must: it can't be divided.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, texts_of, width

GROUP = ["g1", "g2"]
#: Bins of all tasks together that the driver differences.
PIECES = 20_000


def difference(sums: list[np.ndarray]) -> list[np.ndarray]:
    """For partial partitions (vectors of n sums), the order[i] that puts bin order[i][k] of i into shard k.

    The result is the members' final bins: shard k is made of bin order[i][k] of every i.
    """
    # a tree of combinations: leaf i, or (left, left's order, right, right's order)
    heap = [(-float(s.max() - s.min()), i, s, i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        (_, _, a, ta), (_, _, b, tb) = heapq.heappop(heap), heapq.heappop(heap)
        oa, ob = np.argsort(-a, kind="stable"), np.argsort(b, kind="stable")
        c = a[oa] + b[ob]
        heapq.heappush(heap, (-float(c.max() - c.min()), serial, c, (ta, oa, tb, ob)))
        serial += 1
    orders: list = [None] * len(sums)
    if not heap:
        return orders
    stack = [(heap[0][3], np.arange(len(heap[0][2])))]
    while stack:
        tree, at = stack.pop()
        if isinstance(tree, tuple):
            ta, oa, tb, ob = tree
            stack += [(ta, oa[at]), (tb, ob[at])]
        else:
            orders[tree] = at
    return orders


def difference_items(sizes: np.ndarray, n: int) -> np.ndarray:
    """The bin (0 to n - 1) of each item.

    Runs of n items in descending order are the partial partitions to begin with, an item a bin, so every
    bin gets equally many items; they are then differenced.
    """
    order = np.argsort(-sizes, kind="stable")
    padded = np.concatenate([order, np.full(-len(order) % n, -1, order.dtype)]).reshape(-1, n)
    values = np.where(padded >= 0, sizes[padded], 0).astype(np.int64)
    out = np.zeros(len(sizes), np.int32)
    for items, bins in zip(padded, difference(list(values))):
        real = items[bins] >= 0
        out[items[bins][real]] = np.nonzero(real)[0]
    return out


def balanced_shards(docs: DataFrame, n_shards: int = 40, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    digest = F.sha2(text, 256)
    part = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    rows = texts_of(docs).select(
        "doc_id", (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), part(1).alias("g1"), part(16).alias("g2")
    )
    rows = materialize(rows, "sizes")
    groups = rows.groupBy(*GROUP).agg(F.sum("size").alias("bytes"))

    n = width(spark)
    own_bins = max(1, PIECES // n)

    def local(batches):
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        bins = difference_items(table.column("bytes").to_numpy(), own_bins)
        task = pa.array(np.full(len(bins), TaskContext.get().partitionId(), np.int32))
        yield from pa.table([table.column("g1"), table.column("g2"), table.column("bytes"), task, pa.array(bins)], names=[*GROUP, "bytes", "task", "bin"]).to_batches(max_chunksize=1 << 16)

    binned = materialize(groups.repartition(n, F.xxhash64(*GROUP)).mapInArrow(local, "g1 long, g2 long, bytes long, task int, bin int"), "bins")
    bins = sorted(binned.groupBy("task", "bin").agg(F.sum("bytes").alias("bytes")).collect())  # at most PIECES + n rows
    singles = [np.eye(1, n_shards, dtype=np.int64)[0] * r["bytes"] for r in bins]
    moves = [(r["task"], r["bin"], int(np.nonzero(order == 0)[0][0])) for r, order in zip(bins, difference(singles))]
    shard_of = spark.createDataFrame(moves, "task int, bin int, shard int")
    placed = binned.join(F.broadcast(shard_of), ["task", "bin"]).select(*GROUP, "shard")
    assigned = rows.join(placed, GROUP)

    def number(batches):
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(n_shards, np.int64)
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            order = np.argsort(shard, kind="stable")
            counts = np.bincount(shard, minlength=n_shards)
            local = np.empty(len(shard), np.int64)
            local[order] = np.arange(len(shard)) - np.repeat(np.cumsum(counts) - counts, counts)
            slot = seen[shard] + local
            seen += counts
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "size", "text_crc32", "shard")), pa.array(slot), pa.array(np.full(len(shard), task, np.int32))], ["doc_id", "size", "text_crc32", "shard", "local", "task"])

    numbered = materialize(
        assigned.select("doc_id", "size", "text_crc32", "shard").mapInArrow(number, "doc_id long, size long, text_crc32 long, shard int, local long, task int"), "slots"
    )
    offsets, at = [], [0] * n_shards
    for r in sorted(numbered.groupBy("task", "shard").agg(F.count(F.lit(1)).alias("n")).collect()):  # one row a task and shard
        offsets.append((r["task"], r["shard"], at[r["shard"]]))
        at[r["shard"]] += r["n"]
    base = spark.createDataFrame(offsets, "task int, shard int, base long")
    return numbered.join(F.broadcast(base), ["task", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("local")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
