"""Set operations, deduplication, merges: first or last wins by an explicit sequence, never by partition order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.joins import first_per, last_per
from graphloom.operators.numbering import numbered


def dedupe_edges(edges: DataFrame, seq: str = "seq") -> DataFrame:
    """The first edge of each id, or of (src, dst, type) where it has no id."""
    key = F.when(F.col("id").isNotNull(), F.concat(F.lit("id:"), F.col("id").cast("string"))).otherwise(F.to_json(F.struct("src", "dst", "type"), {"ignoreNullFields": "false"}))
    return first_per(edges.withColumn("__key", key), ["__key"], [F.col(seq)]).drop("__key")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of a that b hasn't; null equals null."""
    return a.subtract(b)


def endpoints(edges: DataFrame, mode: str = "both") -> DataFrame:
    cols = {"source": ["src"], "target": ["dst"], "both": ["src", "dst"]}[mode]
    out = edges.select(F.col(cols[0]).alias("id"))
    for c in cols[1:]:
        out = out.union(edges.select(c))
    return out.distinct()


def append_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows, and the new ones whose key is not there yet; is_new tells."""
    fresh = new.join(old.select(key), key, "left_anti").select(*old.columns)
    return old.withColumn("is_new", F.lit(False)).unionByName(fresh.withColumn("is_new", F.lit(True)))


def update_column(rows: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Non-null values of updates replace those of rows with the same key; updates has each key once."""
    new = updates.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    out = rows.join(new, key, "left")
    return out.select(*(F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows by key, new before old; within new, the last by seq."""
    both = old.withColumn("__gen", F.lit(0)).unionByName(new.withColumn("__gen", F.lit(1)))
    return first_per(both, [key], [F.desc("__gen"), F.desc("seq")]).drop("__gen")


def merge_graphs(graphs: list[DataFrame], key: str = "id") -> DataFrame:
    """Nodes of several graphs: for each attribute, the last graph's value that isn't null."""
    both = None
    for i, g in enumerate(graphs):
        g = g.withColumn("__seq", F.lit(i))
        both = g if both is None else both.unionByName(g, allowMissingColumns=True)
    cols = [c for c in both.columns if c not in (key, "__seq")]
    return both.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__seq"))).alias(c) for c in cols))


def interleave(sources: dict[str, DataFrame], weights: dict[str, int], order: str) -> DataFrame:
    """Rows of several sources in rounds of weights[source] rows each, until one source is exhausted."""
    out, ends = None, None
    for k, (name, df) in enumerate(sources.items()):
        rows = numbered(df.withColumn("source", F.lit(name)), [order], "__rn").withColumn("__rn", F.col("__rn") - 1)
        rows = rows.withColumn("round", F.floor(F.col("__rn") / weights[name])).withColumn("__k", F.lit(k))
        end = rows.groupBy("source").agg(F.floor(F.count("*") / weights[name]).alias("rounds"))
        out, ends = (rows, end) if out is None else (out.unionByName(rows), ends.union(end))
    rounds = ends.agg(F.min("rounds")).first()[0]  # one number
    return numbered(out.where(F.col("round") < F.lit(rounds)), ["round", "__k", "__rn"], "seq").drop("__rn", "__k", "round")


def first_rows(rows: DataFrame, n: int, order: str) -> DataFrame:
    return rows.orderBy(order).limit(n)


def remove_position(rows: DataFrame, order: str, position: int) -> DataFrame:
    """Without the row at a place (from 0) in the order."""
    return numbered(rows, [order], "__rn").where(F.col("__rn") != position + 1).drop("__rn")


def append_and_count(old: DataFrame, new: DataFrame, key: str, stamp: str) -> DataFrame:
    """(key, last_updated, n) after appending."""
    return old.unionByName(new).groupBy(key).agg(F.max(stamp).alias("last_updated"), F.count("*").alias("n"))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges between the given ids (id)."""
    side = lambda e, c: e.join(ids.select(F.col("id").alias(c)), c, "left_semi")
    return side(side(edges, "src"), "dst").select(*edges.columns)


__all__ = ["append_and_count", "append_new", "dedupe_edges", "difference", "endpoints", "first_rows", "induced", "interleave", "last_per", "merge_graphs", "remove_position", "update_column", "upsert"]
