"""Vector and lexical retrieval, and the pipelines that combine them with graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.vectors import cosine


def scored(rows: DataFrame, query: list[float], vector: str = "vector") -> DataFrame:
    """rows with their cosine to a query vector, which is a literal of the plan: nothing is joined."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return rows.withColumn("score", cosine(F.col(vector), q))


def top_k(rows: DataFrame, k: int, threshold: float | None = None, id: str = "id") -> DataFrame:
    """The best k of those that reach the threshold."""
    if threshold is not None:
        rows = rows.where(F.col("score") >= threshold)
    return rows.orderBy(F.desc("score"), id).limit(k)


def top_k_then_threshold(rows: DataFrame, k: int, threshold: float, id: str = "id") -> DataFrame:
    """Of the best k, those beyond the threshold."""
    return rows.orderBy(F.desc("score"), id).limit(k).where(F.col("score") > threshold)


def top_k_per(rows: DataFrame, group: list[str], k: int, id: str = "id") -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(F.desc("score"), id))).where(F.col("rank") <= k)


def bm25(queries: DataFrame, corpus: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score, rank): the best k documents that share a term with a query.

    An inverted index of blocks of documents, in the scratch folder: a block's documents are scored where they lie, so that
    only a query's best k of a task are shuffled, and never its pairs. A query's repeated terms count repeatedly. doc_id is
    unique; rows without one take no part.
    """
    from graphloom.shared import scratch
    from graphloom.sources.lexical_index import LexicalIndex

    return LexicalIndex(corpus.sparkSession, scratch(corpus.sparkSession, "bm25"), k1, b).write(corpus).search(queries, k).select("query_id", "doc_id", "score", "rank")


def retrieve(rows: DataFrame, edges: DataFrame, query: list[float], per_graph: int, depth: int, limit: int, threshold: float) -> DataFrame:
    """(seq, graph, id, depth): entry nodes by vector for each graph, breadth-first expansion, round-robin over graphs.

    rows: id, graph, vector; edges: src, dst. Of the best per_graph of each graph, those beyond the threshold
    are entries; what they reach is ordered by depth, then id, within each graph.
    """
    from graphloom.operators.graph import cut
    from graphloom.operators.windows import round_robin

    hits = top_k_per(scored(rows.select("id", "graph", "vector"), query), ["graph"], per_graph).where(F.col("score") > threshold)
    seen = cut(hits.select("graph", "id", F.lit(0).alias("depth")))
    frontier, e = seen, cut(edges.select("src", "dst").distinct().repartition("src"))
    for d in range(1, depth + 1):
        reached = frontier.join(e, F.col("id") == F.col("src")).select("graph", F.col("dst").alias("id")).distinct()
        frontier = cut(reached.join(seen, ["graph", "id"], "left_anti").withColumn("depth", F.lit(d)))
        seen = cut(seen.union(frontier.select("graph", "id", "depth")))
    return round_robin(seen, "graph", [F.col("depth"), F.col("id")], "graph").where(F.col("seq") <= limit)


def choose_repository(repositories: DataFrame, response: str) -> DataFrame:
    """(name): of repositories (name, seq), the first whose name a response holds, else the first of all."""
    hit = F.contains(F.lit(response), F.col("name")) & (F.col("name") != "")
    return repositories.orderBy(F.desc(hit), "seq").limit(1).select("name")
