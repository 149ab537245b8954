"""Operator 13: mixing sources to target weights by subset-sum budget fitting.

Targets. Sources in code point order (null last) weigh as `weights` says, repeating, and share `share` times all
words; no target is above `most` times its source's words. What is above is shared again by weight among the
others. All sources below their bound then have one level, target = level * weight, so a round recomputes the
level from two sums over the table of sources, until no more source meets its bound.

Fitting. A source's target is whole repeats of all its documents and a remaining budget below its size. Spark
counts its documents by exact length. For the budget, every length gives the same share of its documents,
rounded down, then one more of each length by largest remainder, while more than WINDOW words are left; a
bounded-knapsack dynamic programme (bit sets, counts split into powers of two, stopped once the budget is met)
over the lengths that still have documents fits the rest. A histogram has at most sqrt(2 * words) lengths,
however many documents there are; it goes to one task for each source.

Selection. Of each length the plan says how many documents to take. A seeded hash of doc_id orders them: hash
buckets are counted, buckets below the boundary are taken whole, and only the boundary bucket's rows are ranked,
so that no task ever gets all documents of a source or of a length.

Null or empty text: size 0, taken 0. Null source: a source of its own. Null doc_id: such rows hash alike, and
are chosen like any other. Repeated rows are documents of their own; which of them is taken makes no difference,
as they are equal in all columns returned. Empty table: empty result. Further columns are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import materialize
from graphloom.operators.numbering import numbered

WORD = r"[^\x20\x09-\x0D]+"
#: Words that are left to the dynamic programme.
WINDOW = 1 << 14
#: Rows of the plan, one a source and length, up to which it is sent to all tasks; beyond, it is joined by shuffle.
MOST_SENT = 500_000
#: Documents of a hash bucket, and buckets of a length at most.
BUCKET, BUCKETS = 512, 4096


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """sources (source, source_size long) with target (double)."""
    ranked = numbered(sources, [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("rn") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = materialize(ranked.select("source", "source_size", weight.alias("weight")), "weights")
    bound = F.col("source_size") * F.lit(float(most))
    level, met = None, -1
    while True:
        at = F.lit(False) if level is None else bound < F.col("weight") * F.lit(level)
        total, open_weight, held, n = ranked.agg(
            F.sum("source_size"), F.sum(F.when(~at, F.col("weight"))), F.coalesce(F.sum(F.when(at, bound)), F.lit(0.0)), F.count_if(at)
        ).first()
        if n == met or not open_weight:
            break
        level, met = (share * total - held) / open_weight, n
    return ranked.select("source", "source_size", F.least(bound, F.col("weight") * F.lit(level or 0.0)).alias("target"))


def nearest_sum(sizes: Sequence[int], counts: Sequence[int], budget: int) -> dict[int, int]:
    """How many of each size to take, at most its count, for the sum nearest to budget (the smaller of two as near).

    Bit b of a set says that the sum b is reached; sums of over twice the budget are worse than none.
    """
    if budget <= 0:
        return {}
    mask, reach, steps = (1 << (2 * budget + 1)) - 1, 1, []
    for size, count in zip(sizes, counts):
        count, part = min(count, 2 * budget // size), 1
        while count > 0:
            part = min(part, count)
            wider = reach | (reach << part * size) & mask
            if wider != reach:
                steps.append((size, part, reach))
                reach = wider
            count, part = count - part, part * 2
        if reach >> budget & 1:
            break
    below = (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1
    above = reach >> (budget + 1)
    gap = (above & -above).bit_length() if above else 2 * budget + 1
    at = below if budget - below <= gap else budget + gap
    take: dict[int, int] = {}
    for size, part, before in reversed(steps):
        if not before >> at & 1:
            take[size] = take.get(size, 0) + part
            at -= part * size
    return take


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: float, window: int = WINDOW) -> np.ndarray:
    """Documents to take of each (distinct, positive) size for a sum near budget, which is at most all of them."""
    total = int((sizes * counts).sum())
    if total == 0 or budget <= 0:
        return np.zeros(len(sizes), np.int64)
    wanted = counts * min(1.0, budget / total)
    take = np.floor(wanted).astype(np.int64)
    left = round(budget) - int((sizes * take).sum())
    for i in np.lexsort((sizes, take - wanted)).tolist():  # the largest remainder first
        if take[i] < counts[i] and sizes[i] <= left - window:
            take[i] += 1
            left -= int(sizes[i])
    for i in np.argsort(-sizes).tolist():
        more = min(int(counts[i] - take[i]), max(0, left - window) // int(sizes[i]))
        take[i] += more
        left -= more * int(sizes[i])
    rest = counts - take
    near = nearest_sum(sizes[rest > 0].tolist(), rest[rest > 0].tolist(), left)
    return take + np.array([near.get(s, 0) for s in sizes.tolist()], np.int64)


def _fit(pdf):
    """One source's histogram: (source, size, n) with repeats of all, and extra documents by size."""
    pdf = pdf.sort_values("size")
    sizes, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    whole, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    full = int(target // whole) if whole else 0
    pdf = pdf.assign(full=full, extra=fit_budget(sizes, counts, target - full * whole))
    return pdf[["source", "size", "n", "full", "extra"]]


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2, seed: int = 13) -> DataFrame:
    """(doc_id, size, source_size, target, taken, times): the words each document gives to the mix, and how often it's taken whole."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    )
    rows = materialize(rows, "sizes")
    counted = materialize(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    targets = materialize(source_targets(counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most), "targets")
    same = lambda a, b, *on: [a[c].eqNullSafe(b[c]) for c in on]
    lengths = counted.join(targets, same(counted, targets, "source")).select(counted["source"], "size", "n", "source_size", "target")
    fitted = lengths.where("size > 0").groupBy("source").applyInPandas(_fit, "source string, size long, n long, full long, extra long")
    plan = materialize(
        lengths.alias("l").join(fitted.alias("f"), F.expr("l.source <=> f.source and l.size = f.size"), "left")
        .select("l.source", "l.size", "l.n", "source_size", "target", F.coalesce("full", F.lit(0)).alias("full"), F.coalesce("extra", F.lit(0)).alias("extra"))
        .withColumn("buckets", F.greatest(F.lit(1), F.least(F.lit(BUCKETS), F.ceil(F.col("n") / BUCKET))).cast("long")), "plan"
    )
    few = plan.count() <= MOST_SENT

    def planned(plan: DataFrame) -> DataFrame:
        p = F.broadcast(plan.withColumnsRenamed({"source": "__s", "size": "__z"})) if few else plan.withColumnsRenamed({"source": "__s", "size": "__z"})
        return rows.join(p, F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__z"))).drop("__s", "__z")

    draw = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))
    bucket = F.pmod(draw, F.col("buckets"))
    # The bucket in which a length's count is met, and how many are taken of it.
    parts = planned(plan.where("extra > 0 and extra < n").select("source", "size", "extra", "buckets")).groupBy("source", "size", "extra", bucket.alias("bucket")).agg(F.count("*").alias("own"))
    upto = F.sum("own").over(Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edge = parts.withColumn("upto", upto).where("upto >= extra and upto - own < extra").select("source", "size", F.col("bucket").alias("edge"), (F.col("extra") - F.col("upto") + F.col("own")).alias("rest"), "own")
    whole = plan.alias("p").join(edge.alias("e"), F.expr("p.source <=> e.source and p.size = e.size"), "left").select(
        "p.*", F.coalesce("edge", F.when(F.col("extra") > 0, F.col("buckets")).otherwise(F.lit(-1))).alias("edge"), F.coalesce("rest", F.lit(0)).alias("rest"), F.coalesce("own", F.lit(0)).alias("own")
    )
    held = planned(materialize(whole, "plan")).withColumn("bucket", bucket).withColumn("draw", draw)
    open_ = (F.col("bucket") == F.col("edge")) & (F.col("rest") < F.col("own"))
    decided = held.where(~open_).withColumn("more", (F.col("bucket") <= F.col("edge")).cast("long"))
    place = F.row_number().over(Window.partitionBy("source", "size").orderBy("draw", "doc_id"))
    ranked = held.where(open_).withColumn("more", (place <= F.col("rest")).cast("long"))
    times = F.col("full") + F.col("more")
    return decided.unionByName(ranked).select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("times"))
