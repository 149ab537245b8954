"""Exact threshold join on vectors, pruned by bounds before a whole vector is multiplied.

Rows of a block are gathered round pivots and packed into buckets of about BUCKET_BYTES, however many rows a block or a
pivot has. A bucket's head is its centre, its radius and its longest vector. Two heads bound every dot product between
their buckets, and only pairs of buckets that can reach the threshold are brought together. Inside a pair, dot products
grow over more and more coordinates, those of most energy first; after each step what is left is bounded by the norms of
the rest (Cauchy and Schwarz), and vectors without a partner leave. Only pairs that are still possible after the last
step are candidates, whose whole products are taken, in the order of the coordinates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.vectors import dot, norm

#: Pivots at most (their vectors are sent to all tasks), bytes of a bucket, buckets of a tile's side, copies of a size.
MOST_PIVOTS, BUCKET_BYTES, TILE, SALTS = 256, 1 << 20, 256, 32
#: Shares of the coordinates after which a pair of buckets is bounded again.
STEPS = (0.25, 0.5, 0.75, 0.875)
CHUNK = 1 << 15


def choose_pivots(rows: DataFrame, vector: str, id: str, most: int) -> np.ndarray:
    """At most `most` unit vectors, far from each other: farthest first of a sample of 8 * most rows, by hash.

    Vectors of the sample's commonest length count, without zero vectors and those that aren't finite. The driver
    holds the sample, whose size doesn't grow with the rows. Without any such vector: an array of no rows.
    """
    sample = rows.select(F.col(vector).cast("array<double>").alias("v"), F.xxhash64(F.col(id), F.col(vector)).alias("h")).where("size(v) > 0").orderBy("h").limit(8 * most).toArrow()
    held = [v.values.to_numpy(zero_copy_only=False) for v in sample.column("v").combine_chunks()] if sample.num_rows else []
    lengths = [len(v) for v in held]
    if not held:
        return np.zeros((0, 0))
    d = max(sorted(set(lengths)), key=lengths.count)
    x = np.stack([v for v in held if len(v) == d])
    x = x[np.isfinite(x).all(axis=1) & (np.abs(x).sum(axis=1) > 0)]
    if not len(x):
        return np.zeros((0, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    chosen, nearest = [0], x @ x[0]
    while len(chosen) < min(most, len(x)) and nearest.min() < 1 - 1e-9:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    return x[chosen]


def to_pivots(rows: DataFrame, vector: str, pivots: np.ndarray) -> DataFrame:
    """rows with cell (number of the nearest pivot) and angle (radians to it); -1 and 0 for vectors that have none: null,
    zero, not finite or of another length than the pivots."""
    d = pivots.shape[1]

    def run(batches):
        for batch in batches:
            column = batch.column(vector)
            cell, angle = np.full(len(column), -1, np.int32), np.zeros(len(column))
            fits = pc.fill_null(pc.equal(pc.list_value_length(column), d), False)
            at = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
            if len(at) and len(pivots):
                x = column.filter(fits).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
                with np.errstate(all="ignore"):
                    length = np.linalg.norm(x, axis=1)
                    use = np.isfinite(length) & (length > 0)
                x, at = x[use] / length[use][:, None], at[use]
                near = x @ pivots.T
                cell[at] = near.argmax(axis=1)
                angle[at] = np.arccos(np.clip(near.max(axis=1, initial=-1.0), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], names=[*batch.schema.names, "cell", "angle"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())]))


def _pack(table: pa.Table) -> pa.Table:
    """One bucket as one row."""
    one = table.combine_chunks()
    d = one.column("d")[0].as_py()
    x = one.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    centre = x.mean(axis=0)
    ids = one.column("id").combine_chunks()
    lists = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    spread, longest = float(np.linalg.norm(x - centre, axis=1).max()), float(np.linalg.norm(x, axis=1).max())
    return pa.table({
        "b": one.column("b")[:1], "d": one.column("d")[:1], "no": one.column("no")[:1], "ids": lists(ids), "vectors": pa.array([x.tobytes()], pa.binary()),
        "centre": lists(pa.array(centre)), "radius": pa.array([spread]), "longest": pa.array([longest]),
    })


def possible(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of rows of x and y whose dot product the partial sums can't keep below least."""
    d = x.shape[1]
    order = np.argsort(-((x * x).sum(axis=0) * (y * y).sum(axis=0)), kind="stable")
    x, y = x[:, order], y[:, order]
    i, j, sums, done = np.arange(len(x)), np.arange(len(y)), np.zeros((len(x), len(y))), 0
    for share in STEPS:
        end = min(d, max(done + 1, int(d * share)))
        sums += x[:, done:end] @ y[:, done:end].T
        may = sums + np.outer(np.linalg.norm(x[:, end:], axis=1), np.linalg.norm(y[:, end:], axis=1)) >= least
        rows, cols = may.any(axis=1), may.any(axis=0)
        i, j, x, y, sums, may, done = i[rows], j[cols], x[rows], y[cols], sums[np.ix_(rows, cols)], may[np.ix_(rows, cols)], end
        if not len(i) or end == d:
            break
    a, b = np.nonzero(may)
    return i[a], j[b]


def _meet(threshold: float, counts: bool):
    """mapInArrow: pairs of buckets to their similar pairs, or to (pairs, candidates, found)."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                d, same = batch.column("d")[r].as_py(), batch.column("x_no")[r].as_py() == batch.column("y_no")[r].as_py()
                x, y = (np.frombuffer(batch.column(f"{s}_vectors")[r].as_buffer(), float).reshape(-1, d) for s in "xy")
                x_ids, y_ids = (batch.column(f"{s}_ids")[r].values for s in "xy")
                slack = 1e-9 * (1 + np.linalg.norm(x, axis=1).max() * np.linalg.norm(y, axis=1).max())
                i, j = possible(x, y, threshold - slack)
                if same:
                    i, j = i[i < j], j[i < j]
                found = 0
                for at in range(0, len(i), CHUNK):
                    a, b = i[at : at + CHUNK], j[at : at + CHUNK]
                    score = np.cumsum(x[a] * y[b], axis=1)[:, -1] + 0.0  # one addition after the other, as in a fold
                    hit = score >= threshold
                    src, dst, score = x_ids.take(pa.array(a[hit])), y_ids.take(pa.array(b[hit])), pa.array(score[hit])
                    two = pc.not_equal(src, dst)
                    src, dst, score = src.filter(two), dst.filter(two), score.filter(two)
                    found += len(src)
                    if not counts and len(src):
                        for names in ([src, dst, score], [dst, src, score]):
                            yield pa.RecordBatch.from_arrays(names, names=["src", "dst", "score"])
                if counts:
                    pairs = len(x) * (len(x) - 1) // 2 if same else len(x) * len(y)
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()) for n in (pairs, len(i), found)], names=["pairs", "candidates", "found"])

    return run


def similar_pairs(rows: DataFrame, threshold: float, block: str = "block", id: str = "id", vector: str = "vector", pivots: int | None = None, counts: bool = False) -> DataFrame:
    """Symmetric (src, dst, score) within blocks where the dot product is at least threshold.

    A pair of rows with one id is none; an id that repeats pairs by each of its rows. Rows whose block, id or vector is
    null, and vectors that are empty or hold null, NaN or infinity, take part in no pair, nor do vectors of different
    lengths. Further columns are left out. counts: one row for each pair of buckets that was brought together instead,
    (pairs, candidates, found), found being half of the rows.
    """
    from graphloom.operators.graph import cut

    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    base = rows.select(F.col(block).alias("b"), F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    base = base.where("b is not null and id is not null and size(v) > 0").where(fine).withColumn("d", F.size("v"))
    if pivots is None:
        pivots = base.agg(F.sum(F.col("d") * 8)).first()[0] or 0
        pivots = min(MOST_PIVOTS, max(1, pivots // BUCKET_BYTES))
    placed = base.withColumn("cell", F.lit(0))  # all rows, where there is one pivot
    if pivots > 1:
        placed = to_pivots(base, "v", choose_pivots(base, "v", "id", pivots)).drop("angle")
    placed = cut(placed.withColumn("m", F.monotonically_increasing_id()))

    key = ["b", "d", "cell"]
    sizes = placed.groupBy(*key).agg(F.ceil(F.count("*") * F.col("d") * 8 / BUCKET_BYTES).alias("parts"))
    sizes = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a crowded cell meets its size in many tasks
    no = F.shiftleft(F.col("cell").cast("long"), 32) + F.pmod(F.xxhash64("m"), F.col("parts"))
    dealt = placed.withColumn("salt", F.pmod("m", F.lit(SALTS)).cast("int")).join(sizes, [*key, "salt"]).select("b", "d", no.alias("no"), "id", "v")
    kind = lambda c: dealt.schema[c].dataType.simpleString()
    packed = cut(dealt.groupBy("b", "d", "no").applyInArrow(_pack, f"b {kind('b')}, d int, no long, ids array<{kind('id')}>, vectors binary, centre array<double>, radius double, longest double"))

    tiles = packed.groupBy("b", "d").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    heads = packed.select("b", "d", "no", "centre", "radius", "longest", norm(F.col("centre")).alias("far")).join(tiles, ["b", "d"])
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    own = F.pmod(F.xxhash64("no"), F.col("tiles")).cast("int")
    side = lambda s, mine, its: heads.select("b", "d", own.alias(mine), other.alias(its), *(F.col(c).alias(f"{s}_{c}") for c in ("no", "centre", "radius", "longest", "far")))
    reach = dot(F.col("x_centre"), F.col("y_centre")) + F.col("x_far") * F.col("y_radius") + F.col("y_far") * F.col("x_radius") + F.col("x_radius") * F.col("y_radius")
    most = F.least(reach, F.col("x_longest") * F.col("y_longest")) + (F.col("x_longest") * F.col("y_longest") + 1) * 1e-9
    met = side("x", "i", "j").join(side("y", "j", "i"), ["b", "d", "i", "j"]).where((F.col("x_no") <= F.col("y_no")) & (most >= threshold)).select("b", "d", "x_no", "y_no")
    for s in "xy":
        met = met.join(packed.select("b", "d", F.col("no").alias(f"{s}_no"), F.col("ids").alias(f"{s}_ids"), F.col("vectors").alias(f"{s}_vectors")), ["b", "d", f"{s}_no"])
    return met.drop("b").mapInArrow(_meet(threshold, counts), "pairs long, candidates long, found long" if counts else f"src {kind('id')}, dst {kind('id')}, score double")
