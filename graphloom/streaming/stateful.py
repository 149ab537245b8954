"""State that lives across micro-batches: bounded buffers, controllers and counters by key, in the state store.

Each is a stateful processor of Structured Streaming: Spark shuffles a batch by key, keeps the state of each
shuffle partition in RocksDB and saves its changes in the query's checkpoint, so that a query that starts
again, on whatever executors, goes on where it ended. No batch reads or writes what it has no key of. What a
processor holds of a key is bounded (a buffer's limit, one number); a batch's rows of a key are folded one after
the other.

Rows with a null key are one key of their own. Rows with a null order or value: see each function.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession):
    """The state store that processors need, set for queries that start inside."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write what stream has now to Parquet files under path, exactly once, and end."""
    with rocks(stream.sparkSession):
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()


def state_of(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """A state variable of a query, as its last batch left it: one row a key, or a row an entry of a list."""
    with rocks(spark):
        found = spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
        value = "value" if "value" in found.columns else "list_element"
        return found.select("key.*", f"{value}.*")


class _Buffer(StatefulProcessor):
    def __init__(self, key: str, order: str, columns: list[str], schema: str, limit: int):
        self.key, self.order, self.columns, self.schema, self.limit = key, order, columns, schema, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("buffer", self.schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        at = self.columns.index(self.order)
        place = lambda r: (r[at] is not None, 0 if r[at] is None else r[at])
        held = [(place(r), n, r) for n, r in enumerate(map(tuple, self.rows.get()))]
        heapq.heapify(held)
        number = len(held)
        for row in rows:
            r = tuple(row[c] for c in self.columns)
            heapq.heappush(held, (place(r), number, r))
            number += 1
            if len(held) > self.limit:
                yield Row(self.key, *self.columns)(key[0], *heapq.heappop(held)[2])
        self.rows.put([r for *_, r in sorted(held, key=lambda x: x[:2])])

    def close(self) -> None:
        pass


def newest_rows(stream: DataFrame, key: str, order: str, limit: int) -> DataFrame:
    """A first-in, first-out buffer of limit rows for each key, in list state `buffer`; the stream given back is what it evicts.

    Newest is the largest order; among equal ones what came last. A null order is the oldest. Rows of a batch
    come in any order, which makes no difference to what stays unless orders are equal.
    """
    columns = [c for c in stream.columns if c != key]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema if f.name != key)
    full = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (stream.schema[key], *(stream.schema[c] for c in columns)))
    processor = _Buffer(key, order, columns, schema, limit)
    return stream.groupBy(key).transformWithState(processor, full, "append", "none")


class _Controller(StatefulProcessor):
    def __init__(self, key: str, value: str, start: float, target: float, horizon: float, steps: float, clip: float):
        self.key, self.value, self.start, self.target, self.rate, self.clip = key, value, start, target, steps / horizon, clip

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("controller", "coefficient double, updates long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now, n = self.state.get() if self.state.exists() else (self.start, 0)
        for row in rows:
            if row[self.value] is not None:
                error = max(-self.clip, min(self.clip, row[self.value] / self.target - 1))
                now, n = now * (1 + error * self.rate), n + 1
        self.state.update((now, n))
        yield Row(self.key, "coefficient", "updates")(key[0], now, n)

    def close(self) -> None:
        pass


def adaptive_controller(stream: DataFrame, key: str, value: str, start: float, target: float, horizon: float, steps: float = 1, clip: float = 0.2) -> DataFrame:
    """(key, coefficient, updates) after each batch: the coefficient grows or shrinks with each value's distance from the target.

    v (1 + clip(value / target - 1) steps / horizon) for each value, in value state `controller`; a product, so a
    batch's order makes no difference. Null values are no update.
    """
    schema = f"`{key}` {stream.schema[key].dataType.simpleString()}, coefficient double, updates long"
    return stream.select(key, value).groupBy(key).transformWithState(_Controller(key, value, start, target, horizon, steps, clip), schema, "append", "none")


class _Counter(StatefulProcessor):
    def __init__(self, key: str, order: str, amount: str, reset: str):
        self.key, self.order, self.amount, self.reset = key, order, amount, reset

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("counter", "used long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        used = self.state.get()[0] if self.state.exists() else 0
        for row in sorted(rows, key=lambda r: r[self.order]):
            used = (0 if row[self.reset] else used) + (row[self.amount] or 0)
            yield Row(self.key, self.order, "used")(key[0], row[self.order], used)
        self.state.update((used,))

    def close(self) -> None:
        pass


def running_totals(stream: DataFrame, key: str, order: str, amount: str, reset: str) -> DataFrame:
    """(key, order, used): for each row the amounts of its key since the last row with reset, that row included; value state `counter`.

    Batches follow each other in order; within one, a key's rows are sorted by order, so a batch of a key fits in
    memory (bound it with maxFilesPerTrigger). A null amount adds nothing, a null reset is none.
    """
    schema = ", ".join(f"`{c}` {stream.schema[c].dataType.simpleString()}" for c in (key, order)) + ", used long"
    return stream.select(key, order, amount, reset).groupBy(key).transformWithState(_Counter(key, order, amount, reset), schema, "append", "none")
