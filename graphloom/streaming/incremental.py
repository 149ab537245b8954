"""Logs as streams, the sample-update loop, requests behind a barrier, filled batches. State: stateful.py; exactly-once output: ledger.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph import cut
from graphloom.streaming.ledger import Ledger


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only JSON log as a stream."""
    return spark.readStream.schema(schema).json(path)


def earliest(rows: DataFrame, order: list[Column], most: int) -> tuple[DataFrame, int]:
    """The first most rows by order, whose first column is a hash (long), and their number; unsorted, from all tasks.

    Rows are counted by the hash's upper 16 bits, which are all that comes to the driver; only the hash range in which the
    last place falls, about one row in 65,536, is sorted.
    """
    rows = rows.withColumn("__range", F.shiftright(order[0], 48))
    before = 0
    for at, n in sorted(map(tuple, rows.groupBy("__range").count().collect())):
        if before + n > most:
            last = rows.where(F.col("__range") == at).orderBy(*order).limit(most - before)
            return rows.where(F.col("__range") < at).unionByName(last).drop("__range"), most
        before += n
    return rows.drop("__range"), before


def train_loop(tasks: DataFrame, ledger: Ledger, key: str, batch: int, generate: Callable[[DataFrame, int], DataFrame], update: Callable[[DataFrame, int], None], seed: int = 0) -> int:
    """Draw batch tasks that aren't used yet, generate, hand the buffer to update, clear it; ends on an empty draw. Gives the number of steps.

    What is used is what the ledger holds, so a loop that starts again goes on with what is left. A draw is in the
    order of a seeded hash. update is called once for a step unless a step is lost before its commit; then it runs again
    with the same draw.
    """
    step = ledger.last() + 1
    while True:
        drawn, n = earliest(cut(ledger.new_rows(tasks)), [F.xxhash64(F.lit(seed), key), F.col(key)], batch)
        if not n:
            return step
        ledger.write(drawn, step, lambda rows, k=step: generate(rows, k))
        update(ledger.epoch(step), step)
        ledger.commit(step)
        step += 1


def in_barrier(requests: DataFrame, actors: int, run: Callable, schema: str, actor: str = "actor", order: str = "seq") -> DataFrame:
    """Run requests (actor from 0 to actors - 1, order, ...) as one batch that starts when every actor has submitted, and split it back.

    One task an actor, in a barrier stage: each says what it has, and none goes on until all have; if an actor has sent
    nothing the stage fails. run: a function of the Arrow batches of an actor, sorted by order, and the actor's offset in
    the whole batch (actors one after the other), that yields Arrow batches of schema. An actor's requests are read as
    a stream. The cluster needs as many free slots as there are actors.
    """
    sizes = requests.groupBy(actor).agg(F.count("*").alias("n")).where(F.col(actor).between(0, actors - 1)).collect()
    count = {r[0]: r[1] for r in sizes}
    offsets = [sum(count.get(i, 0) for i in range(k)) for k in range(actors)]

    def task(batches):
        from pyspark import BarrierTaskContext

        ctx = BarrierTaskContext.get()
        me, first = ctx.partitionId(), next(batches, None)
        heard = ctx.allGather("" if first is None or not first.num_rows else str(me))
        missing = sorted(set(range(actors)) - {int(x) for x in heard if x})
        if missing:
            raise ValueError(f"actors that have submitted nothing: {missing}")

        def rows():
            yield first
            yield from batches

        yield from run(rows(), offsets[me])

    parts = requests.where(F.col(actor).between(0, actors - 1)).repartitionById(actors, F.col(actor).cast("int")).sortWithinPartitions(order)
    return parts.mapInArrow(task, schema, barrier=True)


def fill_batch(tasks: DataFrame, trajectories: DataFrame, batch: int, seed: int = 0) -> DataFrame:
    """(task_id, slot, trajectory_id): a drawn number of active tasks that divides the batch, each with its share of
    trajectories, null where one must still be made."""
    from pyspark.sql import Window as W

    active = tasks.where(F.coalesce("status", F.lit(True)))
    n = min(active.count(), batch)
    k = max((x for x in range(1, n + 1) if batch % x == 0), default=0)
    chosen = active.orderBy(F.md5(F.concat_ws(":", F.col("task_id").cast("string"), F.lit(str(seed)))), "task_id").limit(k).select("task_id")
    slots = chosen.withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(batch // k)))) if k else chosen.withColumn("slot", F.lit(1))
    have = trajectories.withColumn("slot", F.row_number().over(W.partitionBy("task_id").orderBy("trajectory_id")))
    return slots.join(have.select("task_id", "slot", "trajectory_id"), ["task_id", "slot"], "left")
