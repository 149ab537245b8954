"""Returns and advantages of trajectories of any length, a row a step, by a scan across partitions.

Rows are dealt out by ranges of (trajectory, step), the last step first, so that a long trajectory lies over many
tasks. Backward in time a step's value is an affine map of what comes after it: x_t = base_t + y, where
y = gamma (V_(t+1) + lambda x_(t+1)), and base_t = r_t - V_t. A first pass gives one row a partition, the map that its
last trajectory composes to; these are put together in order, one number carried into each partition; a second pass
carries it on. No array is built and no trajectory comes to one task.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import cut


def _columns(batch: pa.RecordBatch):
    return zip(*(batch.column(c).to_pylist() for c in ("__key", "__reward", "__value")))


def _summary(gamma: float, lam: float):
    """mapInArrow: a partition to (part, first key, last key, whether it has one only, b, w, v): its last x is b + w y, its last value v."""

    def run(batches):
        from pyspark import TaskContext

        first = last = None
        n, single, b, w, v = 0, True, 0.0, 1.0, 0.0
        for batch in batches:
            for key, r, value in _columns(batch):
                if n and key == last:
                    b, w = r - value + gamma * (v + lam * b), w * gamma * lam
                else:
                    single = n == 0
                    first = key if single else first
                    b, w = r - value, 1.0
                last, v, n = key, value, n + 1
        if n:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "first": first, "last": last, "single": single, "b": b, "w": w, "v": v}], _SUMMARY)

    return run


_SUMMARY = pa.schema([("part", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("single", pa.bool_()), ("b", pa.float64()), ("w", pa.float64()), ("v", pa.float64())])


def _carried(gamma: float, lam: float, into: dict[int, float], names: list[str]):
    """mapInArrow: rows with advantage and return."""

    def run(batches):
        from pyspark import TaskContext

        y, last, n = into.get(TaskContext.get().partitionId(), 0.0), None, 0
        for batch in batches:
            advantages, returns = [], []
            for key, r, value in _columns(batch):
                if n and key != last:
                    y = 0.0
                x = r - value + y
                advantages.append(x)
                returns.append(x + value)
                y, last, n = gamma * (value + lam * x), key, n + 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(advantages, pa.float64()), pa.array(returns, pa.float64())], [*names, "advantage", "return"])

    return run


def trajectory_returns(rows: DataFrame, trajectory: str, step: str, reward: str, gamma: float, value: str | None = None, lam: float = 1.0) -> DataFrame:
    """rows with advantage and return (double).

    With a value column, generalised advantage estimates, advantage_t = delta_t + gamma lam advantage_(t+1), where the
    value beyond the end is 0, and return = advantage + value. Without, both are the discounted return
    R_t = r_t + gamma R_(t+1). Null rewards and values are 0; null trajectories are one; steps of a trajectory differ
    (equal ones come in any order). An empty table gives an empty result.
    """
    names = rows.columns
    double = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    order = [F.col("__key"), F.col(step).desc()]
    held = rows.withColumns({"__key": F.col(trajectory).cast("string"), "__reward": double(reward), "__value": double(value) if value else F.lit(0.0)})
    held = cut(held.repartitionByRange(*order).sortWithinPartitions(*order))
    found = held.select("__key", "__reward", "__value").mapInArrow(_summary(gamma, lam), "part long, first string, last string, single boolean, b double, w double, v double")
    into, before = {}, None
    for s in sorted(found.collect(), key=lambda s: s.part):  # one row a partition
        y = gamma * (before[1] + lam * before[2]) if before and before[0] == s.first else 0.0
        into[s.part] = y
        before = (s.last, s.v, s.b + (s.w * y if s.single else 0.0))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "advantage double", "`return` double"])
    return held.mapInArrow(_carried(gamma, lam, into, names), schema)
