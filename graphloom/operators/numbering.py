"""Row numbers over a whole table without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numbered(rows: DataFrame, order: list[str | Column], name: str = "rn") -> DataFrame:
    """rows with name, 1 to n (long) in the order; ties in any order among themselves.

    The table is dealt out by ranges of the order and sorted there; the ranges' sizes, one number a partition,
    give each its first number.
    """
    from graphloom.operators.graph import cut

    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    held = cut(rows.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", 33)  # the id is the partition's number, then the row's in it
    firsts, total = [], 0
    for p, n in sorted(map(tuple, held.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())):
        firsts.append((p, total))
        total += n
    base = rows.sparkSession.createDataFrame(firsts, "__p long, __first long")
    out = held.withColumn("__p", part).join(F.broadcast(base), "__p")
    return out.withColumn(name, F.col("__first") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).select(*rows.columns, name)
