"""Window-shaped operators: ranks, group baselines, returns over arrays, packing, shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators.numbering import numbered


def rank_desc(rows: DataFrame, group: list[str], score: str, tie: str) -> DataFrame:
    """rank 1..k by score, then by tie, both descending."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(F.desc(score), F.desc(tie))))


def group_advantage(rows: DataFrame, group: list[str], reward: str, method: str = "mean", epsilon: float = 1e-9) -> DataFrame:
    """advantage: reward less its group's mean (mean), less the others' mean (leave_one_out), or its z-score (norm, sample spread).

    A group of one has advantage 0 by its mean, and none (null) by the other two.
    """
    w = W.partitionBy(*group)
    r = F.col(reward)
    n = F.count(r).over(w)
    value = {
        "mean": r - F.avg(r).over(w),
        "leave_one_out": F.when(n > 1, r - (F.sum(r).over(w) - r) / (n - 1)),
        "norm": (r - F.avg(r).over(w)) / (F.stddev_samp(r).over(w) + epsilon),
    }[method]
    return rows.withColumn("advantage", value)


def discounted_returns(rewards: Column, gamma: float) -> Column:
    """R_t = r_t + gamma R_(t+1) of an array, from the right."""
    step = lambda s, r: F.concat(F.array(r + gamma * F.coalesce(F.try_element_at(s, F.lit(1)), F.lit(0.0))), s)
    return F.aggregate(F.reverse(rewards), F.expr("cast(array() as array<double>)"), step)


def gae(values: Column, rewards: Column, gamma: float, lam: float) -> Column:
    """Struct of arrays (advantages, returns) by generalised advantage estimation; the value beyond the end is 0."""
    nxt = F.concat(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.array(F.lit(0.0)))
    delta = F.zip_with(F.zip_with(rewards, nxt, lambda r, v: r + gamma * v), values, lambda x, v: x - v)
    adv = discounted_returns(delta, gamma * lam)
    return F.when(F.size(values) > 0, F.struct(adv.alias("advantages"), F.zip_with(adv, values, lambda a, v: a + v).alias("returns")))


def token_rewards(reward: Column, kl: Column, beta: float, clip: float | None = None) -> Column:
    """-beta kl_t for each token, the sequence's reward (clipped) added to the last."""
    r = F.greatest(F.least(reward, F.lit(clip)), F.lit(-clip)) if clip is not None else reward
    b = max(beta, 0.0)
    return F.transform(kl, lambda k, i: F.lit(0.0) - b * k + F.when(i == F.size(kl) - 1, r).otherwise(F.lit(0.0)))


def coalesce_small(chunks: Column, least: int, length=F.length) -> Column:
    """Chunks merged into the one before while both together are shorter than least; an ordered fold."""
    def step(out, c):
        last = F.try_element_at(out, F.lit(-1))
        joined = F.concat(last, F.lit("\n"), c)
        return F.when((F.size(out) > 0) & (length(last) + length(c) < least), F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(out, F.array(c)))

    return F.aggregate(chunks, F.expr("cast(array() as array<string>)"), step)


def packing_offsets(rows: DataFrame, batch: str, order: str, length: str, multiple: int) -> DataFrame:
    """offset, segment (from 1) in the batch, and the batch's padding to a multiple."""
    w = W.partitionBy(batch).orderBy(order)
    total = F.sum(length).over(W.partitionBy(batch))
    return (
        rows.withColumn("offset", F.coalesce(F.sum(length).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("segment", F.row_number().over(w))
        .withColumn("padding", F.pmod(-total, F.lit(multiple)))
    )


def position_ids(rows: DataFrame, row: str, segment: str, order: str, *ties: str) -> DataFrame:
    """position_id: places from 0 in each segment of a row by order, then by ties; rows without an order come last, as in SQL."""
    return rows.withColumn("position_id", F.row_number().over(W.partitionBy(row, segment).orderBy(*(F.col(c).asc_nulls_last() for c in (order, *ties)))) - 1)


def unpack(values: Column, lengths: Column) -> Column:
    """The flat array in slices of the given lengths."""
    return F.transform(lengths, lambda n, i: F.slice(values, F.aggregate(F.slice(lengths, 1, i), F.lit(0), lambda s, x: s + x) + 1, n))


def round_robin(rows: DataFrame, group: str, order: list[Column], group_order: str) -> DataFrame:
    """seq: the groups' first rows, then their second ones, and so on."""
    rn = rows.withColumn("__rn", F.row_number().over(W.partitionBy(group).orderBy(*order)))
    return numbered(rn, ["__rn", group_order], "seq").drop("__rn")


def repeat_rows(rows: DataFrame, n: int) -> DataFrame:
    """n contiguous copies of each row, by sample_idx from 0."""
    return rows.withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def cursor_slice(rows: DataFrame, order: str, i: int, size: int) -> DataFrame:
    return numbered(rows, [order], "__rn").where((F.col("__rn") > i * size) & (F.col("__rn") <= (i + 1) * size)).drop("__rn")


def newest(rows: DataFrame, order: str, limit: int) -> DataFrame:
    """First in, first out: the last rows by order. Spark keeps limit rows a task, not one sorted whole."""
    return rows.orderBy(F.desc(order)).limit(limit)


def strided_shard(rows: DataFrame, order: str, rank: int, n: int, consumed: int = 0) -> DataFrame:
    """Row indexes rank, rank + n, ... after the consumed ones, wrapped around so that all shards are equally long."""
    indexed = numbered(rows, [order], "idx").withColumn("idx", F.col("idx") - 1)
    total = rows.count()
    head = indexed.where(F.col("idx") < -total % n).withColumn("idx", F.col("idx") + total)
    return indexed.unionByName(head).where((F.pmod("idx", F.lit(n)) == rank) & (F.col("idx") >= consumed))
