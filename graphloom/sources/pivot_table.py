"""A stored table of vectors, gathered round pivots, whose searches skip cells by the triangle inequality.

    path/rows/cell=C   the rows whose nearest pivot is C, in files sorted by their angle to it
    path/columns       the rows' columns, without rows
    path/cells         for each cell its pivot, number of rows, least and largest angle; written last

Angles between vectors are a metric. A row at angle a from its pivot, which is at angle p from the query, is at least
|p - a| from the query; so a cell can't hold a better cosine than its bounds allow, nor a file one outside of the ring
of angles that could. Results are those of a scan of all rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.retrieval import scored, top_k
from graphloom.operators.vector_join import choose_pivots, to_pivots

#: Cells at most (the driver reads a row of each for a search), rows that a cell should have, cells of a search with rings.
MOST_CELLS, CELL_ROWS, MOST_RINGS = 1024, 65_536, 64
#: More than angles and cosines are wrong by rounding.
SLACK = 1e-6


class PivotTable:
    """Vectors that are null, zero, not finite or of another length than the pivots are in cell -1, which each search reads."""

    def __init__(self, spark: SparkSession, path: str, id: str = "id", vector: str = "vector"):
        self.spark, self.path, self.id, self.vector = spark, path.rstrip("/"), id, vector
        #: Cells that the last search has read, of all.
        self.read: list[int] = []

    def write(self, rows: DataFrame, cells: int | None = None) -> PivotTable:
        """Put all rows (with any further columns, but none named cell or angle) into a new table."""
        if cells is None:
            cells = min(MOST_CELLS, max(1, rows.count() // CELL_ROWS))
        pivots = choose_pivots(rows, self.vector, self.id, cells)
        placed = to_pivots(rows, self.vector, pivots)
        # Ranges end with a hash, so that rows of one vector lie in as many files as they fill.
        ranged = placed.repartitionByRange("cell", "angle", F.xxhash64(self.id)).sortWithinPartitions("cell", "angle")
        ranged.write.partitionBy("cell").parquet(f"{self.path}/rows")
        rows.limit(0).write.parquet(f"{self.path}/columns")
        held = self._rows().groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect()  # a row a cell
        named = [(r.cell, r.n, r.low, r.high, pivots[r.cell].tolist() if r.cell >= 0 else None) for r in held]
        self.spark.createDataFrame(named, "cell int, n long, low double, high double, pivot array<double>").coalesce(1).write.parquet(f"{self.path}/cells")
        return self

    def _rows(self) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.path}/columns").schema.add("angle", T.DoubleType()).add("cell", T.IntegerType())
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows")  # a table without rows has no file to tell its columns

    def _bounds(self, query: list[float]) -> list[tuple[float, int, int, float]]:
        """(largest cosine, cell, rows, angle of query and pivot), best first."""
        q, out = np.array(query, dtype=float), []
        length = float(np.linalg.norm(q))
        for c in self.spark.read.parquet(f"{self.path}/cells").collect():
            most, p = 1.0, 0.0
            if c.pivot is not None and len(c.pivot) == len(q) and 0 < length < math.inf:
                p = math.acos(min(1.0, max(-1.0, float(q @ np.array(c.pivot)) / length)))
                most = math.cos(max(0.0, p - c.high - SLACK, c.low - p - SLACK))
            elif c.pivot is not None:
                most, p = math.inf, math.nan  # such a query has no angles: all is read
            else:
                most = math.inf
            out.append((most, c.cell, c.n, p))
        return sorted(out, key=lambda b: (-b[0], b[1]))

    def top_k(self, query: list[float], k: int, threshold: float | None = None) -> DataFrame:
        """The best k rows with their score (cosine), of those that reach the threshold; ties by id.

        The cells of the best bounds that hold k rows are searched first. Their k-th score, one number, is what
        another cell must be able to reach to be read.
        """
        bounds, rows = self._bounds(query), self._rows()
        least = -math.inf if threshold is None else threshold
        first, have = [], 0
        for most, cell, n, _ in bounds:
            if have >= k or most < least:
                break
            first.append(cell)
            have += n
        if k > 0 and have >= k and len(first) < len(bounds):
            best = top_k(scored(rows.where(F.col("cell").isin(first)), query, self.vector).select(self.id, "score"), k, threshold, self.id)
            n, worst = best.agg(F.count("*"), F.min("score")).first()
            if n == k and worst is not None:
                least = max(least, worst - SLACK)
        self.read = sorted(cell for most, cell, _, _ in bounds if most >= least)
        rows = rows.where(F.col("cell").isin(self.read))
        if least > -1 and 0 < len(self.read) <= MOST_RINGS:
            wide, ring = math.acos(min(1.0, least)) + SLACK, F.lit(False)
            for _, cell, _, p in bounds:
                if cell in self.read:
                    inside = F.col("cell") == cell
                    ring |= inside if cell < 0 or math.isnan(p) else inside & F.col("angle").between(p - wide, p + wide)
            rows = rows.where(ring)
        return top_k(scored(rows, query, self.vector), k, threshold, self.id).drop("cell", "angle")
