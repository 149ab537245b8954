"""Strongly connected components, the simple cycles inside them, and the cycle that keeps an order from existing.

Rounds write their tables to the checkpoint folder; only counts reach the driver. Repeated edges and loops are
allowed, edges with a null end are left out. Ids are of any type that can be ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import cut

#: So many paths an edge cost less than the search for strongly connected components.
PATHS = 8


def _trimmed(e: DataFrame) -> DataFrame:
    """Edges of nodes that have both in- and out-edges, again and again: what is left has a cycle, or is empty."""
    while True:
        before = e.count()
        ends = e.select(F.col("src").alias("id")).distinct().join(e.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
        e = cut(e.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"))
        if e.count() == before:
            return e


def _least_source(e: DataFrame) -> DataFrame:
    """(id, color): the least node that reaches id, itself included. Colours go along edges and also jump to the colour's colour."""
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    now = cut(nodes.select("id", F.col("id").alias("color")))
    while True:
        sent = e.join(now, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("id")).agg(F.min("color").alias("sent"))
        near = now.join(sent, "id", "left").select("id", F.col("color").alias("was"), F.least("color", "sent").alias("color"))
        jump = cut(near).alias("a").join(now.select(F.col("id").alias("c"), F.col("color").alias("further")), F.col("color") == F.col("c"))
        after = cut(jump.select("a.id", "a.was", F.least("a.color", "further").alias("color")))
        now = after.select("id", "color")
        if after.where("was <> color").isEmpty():
            return now


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): strongly connected components of nodes (id), each named by its smallest node.

    Nodes without in- or out-edges are trimmed, round by round, so that a graph without cycles ends there. In what
    is left each node takes the least node that reaches it as its colour; a node of its own colour is a root, and the
    nodes of its colour that reach it back are its component. They go, and the rest is trimmed and coloured again.
    """
    e = cut(edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct())
    found = None
    while True:
        e = _trimmed(e)
        if e.isEmpty():
            break
        color = _least_source(e)
        own = e.join(color.select(F.col("id").alias("src"), F.col("color").alias("c")), "src").join(color.select(F.col("id").alias("dst"), F.col("color").alias("d")), "dst").where("c = d")
        back = cut(own.select("dst", "src"))
        reached = cut(color.where("id = color"))
        frontier = reached
        while True:
            frontier = cut(frontier.join(back, F.col("id") == F.col("dst")).select(F.col("src").alias("id"), "color").distinct().join(reached, ["id", "color"], "left_anti"))
            if frontier.isEmpty():
                break
            reached = cut(reached.unionByName(frontier))
        found = reached if found is None else found.unionByName(reached)
        gone = reached.select("id")
        e = cut(e.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"))
    ids = nodes.select("id").distinct()
    if found is None:
        return ids.withColumn("component", F.col("id"))
    return ids.join(found.withColumnRenamed("color", "component"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def inner_edges(edges: DataFrame) -> DataFrame:
    """The distinct edges that lie on some cycle: those inside a strongly connected component, and loops."""
    e = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    part = strong_components(e.select(F.col("src").alias("id")).union(e.select("dst")).distinct(), e)
    inside = e.join(part.select(F.col("id").alias("src"), F.col("component").alias("a")), "src").join(part.select(F.col("id").alias("dst"), F.col("component").alias("b")), "dst")
    return cut(inside.where("a = b").select("src", "dst"))


def _met_half_way(e: DataFrame, max_length: int, most: int | None) -> DataFrame | None:
    """The cycles of distinct edges e by length, or None where either kind of paths becomes more than most.

    A cycle is a path out of its smallest node and one back into it that share no other node. For each length the
    kind of which there are fewer grows by an edge, and then both are joined on their two ends.
    """
    meet = (F.col("next") == F.col("back")[0]) & (F.col("path")[0] == F.col("last")) & ~F.arrays_overlap("path", "back")
    there = cut(e.where("src < dst").select(F.array("src").alias("path"), F.col("dst").alias("next")))
    back = cut(e.where("src > dst").select(F.array("src").alias("back"), F.col("dst").alias("last")))
    n, m = there.count(), back.count()
    out = e.where("src = dst").select(F.array("src").alias("cycle"))
    for length in range(2, max_length + 1):
        if length > 2 and n <= m:
            on = there.select(F.concat("path", F.array("next")).alias("path"), F.col("next").alias("src")).join(e, "src")
            there = cut(on.where((F.col("dst") > F.col("path")[0]) & ~F.array_contains("path", F.col("dst"))).select("path", F.col("dst").alias("next")))
            n = there.count()
        elif length > 2:
            on = back.withColumn("dst", F.col("back")[0]).join(e, "dst")
            back = cut(on.where((F.col("src") > F.col("last")) & ~F.array_contains("back", F.col("src"))).select(F.concat(F.array("src"), "back").alias("back"), "last"))
            m = back.count()
        if not n or not m:
            break
        if most is not None and max(n, m) > most:
            return None
        out = out.union(there.join(back, meet).select(F.concat("path", "back").alias("cycle")))
    return out


def cycles(edges: DataFrame, max_length: int) -> DataFrame:
    """(cycle): simple cycles of at most max_length edges, each once, from its smallest node.

    Paths go only from a node to larger ones, and only half way round. Where they become more than PATHS an edge, they
    are begun again inside strongly connected components only; a graph without cycles has no path there.
    """
    e = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    out = _met_half_way(e, max_length, PATHS * e.count())
    return _met_half_way(inner_edges(e), max_length, None) if out is None else out


def explicit_cycles(rest: DataFrame, edges: DataFrame) -> DataFrame:
    """(cycle, position, id): one cycle for each part of what a topological order leaves over (rest: id), in the direction of the edges.

    Each node of rest has an edge from another; its smallest such neighbour is kept. Going back along these, pointers
    double each round, so after log2(n) rounds all stand on a cycle, and the smallest node met on the way round names
    it and has position 0. Nodes only behind a cycle are in none.
    """
    ids = rest.select("id").where("id is not null").distinct()
    within = edges.select("src", "dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    before = cut(within.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("to")))
    rounds = before.count().bit_length()
    now = cut(before.select("id", "to", F.col("id").alias("least")))
    for _ in range(rounds):
        b = now.select(F.col("id").alias("mid"), F.col("to").alias("on"), F.col("least").alias("more"))
        now = cut(now.join(b, F.col("to") == F.col("mid")).select("id", F.col("on").alias("to"), F.least("least", "more").alias("least")))
    on_cycle = cut(now.select(F.col("to").alias("id")).distinct().join(now, "id").select("id", F.col("least").alias("cycle")))
    walk = on_cycle.join(before, "id")
    walk = cut(walk.select("id", "cycle", F.when(F.col("id") == F.col("cycle"), F.col("id")).otherwise(F.col("to")).alias("to"), (F.col("id") != F.col("cycle")).cast("long").alias("position")))
    for _ in range(rounds):
        b = walk.select(F.col("id").alias("mid"), F.col("to").alias("on"), F.col("position").alias("more"))
        walk = cut(walk.join(b, F.col("to") == F.col("mid")).select("id", "cycle", F.col("on").alias("to"), (F.col("position") + F.col("more")).alias("position")))
    return walk.select("cycle", "position", "id")
