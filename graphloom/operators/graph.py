"""Graph operators on edge tables (src, dst[, type]): traversal, paths, components, levels.

Loops write each round to the checkpoint folder (spark.checkpoint.dir), which cuts the plan and survives lost
executors; only row counts reach the driver. Repeated edges, loops and cycles are allowed; null ends are
never followed. Depth limits are inclusive, the start being at depth 0.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators.numbering import numbered


def cut(df: DataFrame) -> DataFrame:
    """df computed and checkpointed."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="graphloom-"))
    return df.checkpoint(eager=True)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select("dst", "src"))


def neighbours(edges: DataFrame, id, direction: str = "both") -> DataFrame:
    out = edges.where(F.col("src") == F.lit(id)).select(F.col("dst").alias("id"))
    into = edges.where(F.col("dst") == F.lit(id)).select(F.col("src").alias("id"))
    return {"out": out, "in": into, "both": out.union(into)}[direction].distinct()


def roots(nodes: DataFrame, edges: DataFrame, leaves: bool = False) -> DataFrame:
    """Nodes without in-edges (leaves: without out-edges)."""
    return nodes.join(edges.select(F.col("src" if leaves else "dst").alias("id")), "id", "left_anti")


def reachable(edges: DataFrame, starts: DataFrame, max_depth: int | None, direction: str = "out") -> DataFrame:
    """(id, depth): breadth-first from starts (id). Each round joins only the frontier with the edges."""
    e = {"out": edges.select("src", "dst"), "in": edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "both": both_ways(edges)}[direction]
    e = cut(e.distinct().repartition("src"))  # written once: rounds read it, and don't make it again
    seen = cut(starts.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        frontier = cut(frontier.join(e, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).where("id is not null").distinct().join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = cut(seen.union(frontier))
    return seen


def capped(reached: DataFrame, most: int) -> DataFrame:
    """The first nodes by (depth, id)."""
    return reached.orderBy("depth", "id").limit(most)


def hops(edges: DataFrame, hits: DataFrame, hop: int, inside: bool = False) -> DataFrame:
    """(hit, id, level, parent, relation): neighbourhoods of hits (id), each node once for a hit.

    Relation is predecessor or successor of the parent that finds it first: the smaller parent, predecessors
    before successors. inside: only hits count as neighbours.
    """
    ends = edges.select("src", "dst").distinct().where("src <> dst")
    e = ends.select("src", "dst", F.lit("successor").alias("relation")).union(ends.select("dst", "src", F.lit("predecessor")))
    if inside:
        e = e.join(hits.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst", "relation")
    e = cut(e.repartition("src"))
    found = None
    seen = cut(hits.select(F.col("id").alias("hit"), "id").distinct())
    frontier = seen
    for level in range(1, hop + 1):
        new = frontier.join(e, F.col("id") == F.col("src")).select("hit", F.col("dst").alias("new"), F.col("id").alias("parent"), "relation")
        new = new.join(seen.withColumnRenamed("id", "new"), ["hit", "new"], "left_anti")
        best = new.groupBy("hit", "new").agg(F.min(F.struct("relation", "parent")).alias("m"))
        step = cut(best.select("hit", F.col("new").alias("id"), F.lit(level).alias("level"), "m.parent", "m.relation"))
        found = step if found is None else found.union(step)
        frontier = step.select("hit", "id")
        seen = cut(seen.union(frontier))
    return found


def simple_paths(edges: DataFrame, start, max_depth: int) -> DataFrame:
    """(path, depth): simple paths from start to a node without out-edges, of at most max_depth edges.

    A path grows only to nodes from which such an end is still within reach of the depth that is left; distances
    to the nearest end are found first, backward from the ends.
    """
    e = edges.select("src", "dst").distinct()
    leaves = roots(e.select(F.col("dst").alias("id")).distinct(), e, leaves=True)
    far = reachable(e, leaves, max_depth, "in").select(F.col("id").alias("dst"), F.col("depth").alias("far"))
    e = cut(e.join(far, "dst").select("src", "dst", "far").repartition("src"))
    now = cut(edges.sparkSession.range(1).select(F.array(F.lit(start).cast("long")).alias("path")))
    out = None
    for depth in range(max_depth + 1):
        last = F.element_at("path", -1)
        done = now.join(leaves, last == F.col("id"), "left_semi").withColumn("depth", F.lit(depth))
        out = done if out is None else out.union(done)
        if depth < max_depth:
            onward = e.where(F.col("far") <= max_depth - depth - 1)
            now = cut(now.join(onward, last == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path")))
            if now.isEmpty():
                break
    return out


def call_tree(edges: DataFrame, start, max_depth: int) -> DataFrame:
    """(path, depth, truncated): the tree of calls below start; a node already on its path ends it."""
    e = cut(edges.select("src", "dst").distinct().repartition("src"))
    now = cut(edges.sparkSession.range(1).select(F.array(F.lit(start).cast("long")).alias("path")))
    out = now.select("path", F.lit(0).alias("depth"), F.lit(False).alias("truncated"))
    for depth in range(1, max_depth + 1):
        now = cut(now.join(e, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path")))
        out = out.union(now.select("path", F.lit(depth), F.lit(depth == max_depth)))
    return out


def shortest_path(edges: DataFrame, source, target) -> DataFrame:
    """(path): one shortest path, the smaller parent first; no row where there's none.

    A node keeps only its parent; the path is read back from the target, one look-up in each level's table.
    """
    e = cut(edges.select("src", "dst").distinct().repartition("src"))
    seen = cut(edges.sparkSession.range(1).select(F.lit(source).cast("long").alias("id"), F.lit(None).cast("long").alias("parent")))
    levels_ = [seen]
    while levels_[-1].where(F.col("id") == F.lit(target)).isEmpty():
        step = levels_[-1].join(e, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        levels_.append(cut(step.join(seen, "id", "left_anti")))
        if levels_[-1].isEmpty():
            return seen.limit(0).select(F.array("id").alias("path"))
        seen = cut(seen.union(levels_[-1]))
    path = [target]
    for level in reversed(levels_[1:]):
        path.append(level.where(F.col("id") == F.lit(path[-1])).first()["parent"])
    return edges.sparkSession.range(1).select(F.array(*(F.lit(x).cast("long") for x in reversed(path))).alias("path"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): weakly connected components by their smallest node. Alternating star contraction:
    rounds grow with the logarithm of a component's diameter, rows never beyond the edges."""
    now = cut(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct())
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low, "u")
        after = cut(linked.select("u", F.col("m").alias("v")).union(linked.where("v <> m").select("v", "m")).distinct())
        if after.count() == now.count() and after.exceptAll(now).isEmpty():
            break
        now = after
    label = now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    return nodes.select("id").distinct().join(label, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level): Kahn's levels, sources first; null for nodes on or behind a cycle."""
    left = cut(edges.select("src", "dst").distinct())
    todo = cut(nodes.select("id").distinct())
    out, level = None, 0
    while True:
        ready = cut(todo.join(left.select(F.col("dst").alias("id")), "id", "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            break
        out = ready if out is None else out.union(ready)
        todo = cut(todo.join(ready, "id", "left_anti"))
        left = cut(left.join(ready.select(F.col("id").alias("src")), "src", "left_anti"))
        level += 1
    rest = todo.withColumn("level", F.lit(None).cast("int"))
    return rest if out is None else out.union(rest)


def rounds(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """(id, round): callees before callers; calls of unknown nodes and of oneself don't count. Where only cycles are
    left, the pending node of fewest calls (then of smallest id) goes alone."""
    todo = cut(nodes.select("id").distinct())
    e = calls.select("src", "dst").distinct().where("src <> dst").join(todo.select(F.col("id").alias("dst")), "dst", "left_semi").join(todo.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst")
    left = cut(e)
    out, k = None, 0
    while not todo.isEmpty():
        ready = todo.join(left.select(F.col("src").alias("id")), "id", "left_anti")
        if ready.isEmpty():
            ready = left.groupBy(F.col("src").alias("id")).count().orderBy("count", "id").limit(1).select("id")
        ready = cut(ready.withColumn("round", F.lit(k)))
        out = ready if out is None else out.union(ready)
        todo = cut(todo.join(ready, "id", "left_anti"))
        left = cut(left.join(ready.select(F.col("id").alias("dst")), "dst", "left_anti").join(ready.select("id").withColumnRenamed("id", "src"), "src", "left_anti").select("src", "dst"))
        k += 1
    return out if out is not None else todo.withColumn("round", F.lit(0))


def propagate(edges: DataFrame, starts: DataFrame, changes, most_rounds: int | None = None) -> DataFrame:
    """(id, round): worklist along edges; changes (a function of a DataFrame with id) says which of the nodes reached
    change, and those pass the work on. Every node is handled once a round and passes on once. Ends when nothing
    changes, or after most_rounds."""
    seen = cut(starts.select("id").distinct().withColumn("round", F.lit(0)))
    steps = cut(edges.select(F.col("src").alias("id"), "dst").distinct())
    frontier, k = seen, 0
    while k != most_rounds and not frontier.isEmpty():
        k += 1
        reached = frontier.join(steps, "id").select(F.col("dst").alias("id")).distinct()
        frontier = cut(changes(reached.join(seen, "id", "left_anti")).select("id").withColumn("round", F.lit(k)))
        seen = cut(seen.union(frontier))
    return seen


def per_type_quota(chosen: DataFrame, candidates: DataFrame, least: int) -> DataFrame:
    """chosen (id, type) and, where a type has fewer than least, the first candidates (id, type, depth) of it."""
    have = chosen.groupBy("type").agg(F.count("*").alias("have"))
    more = candidates.join(chosen.select("id"), "id", "left_anti").join(have, "type", "left")
    rn = F.row_number().over(W.partitionBy("type").orderBy("depth", "id"))
    return chosen.select("id", "type").union(more.withColumn("rn", rn).where(F.col("rn") <= least - F.coalesce("have", F.lit(0))).select("id", "type"))


def few_neighbours(edges: DataFrame, hits: DataFrame, most: int = 3) -> DataFrame:
    """(hit, id): the first neighbours of each hit, by id."""
    pairs = hits.select(F.col("id").alias("hit")).join(both_ways(edges).distinct(), F.col("hit") == F.col("src")).select("hit", F.col("dst").alias("id")).where("hit <> id")
    return pairs.withColumn("rn", F.row_number().over(W.partitionBy("hit").orderBy("id"))).where(F.col("rn") <= most).drop("rn")


def tree_lines(tree: DataFrame, labels: DataFrame, max_depth: int) -> DataFrame:
    """(seq, line): a parent-pointer table (src parent, dst child) as an indented outline, children by id."""
    top = roots(tree.select(F.col("src").alias("id")).distinct(), tree)
    now = cut(top.select("id", F.array(F.format_string("%020d", F.col("id"))).alias("path")))
    out = now
    for _ in range(max_depth):
        now = cut(now.join(tree, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), F.concat("path", F.array(F.format_string("%020d", F.col("dst")))).alias("path")))
        out = out.union(now)
    lined = out.join(labels, "id").select(F.array_join("path", "/").alias("key"), F.concat(F.repeat(F.lit("  "), F.size("path") - 1), "label").alias("line"))
    return numbered(lined, ["key"], "seq").select("seq", "line")


def resolve(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (want) to a file (id): equal, else with slashes turned back, else forward, else the smallest id that holds
    the last part of want's path. That last look-up goes by the part's rarest run of three characters (a shorter part:
    by itself), so no want is held against all files. A want that ends in a slash has no last part, and no file."""
    want, slash, back = F.col("want"), F.lit("/"), F.lit("\\")
    forms = F.array(*(F.struct(F.lit(k).alias("score"), x.alias("id")) for k, x in enumerate((want, F.replace(want, slash, back), F.replace(want, back, slash)))))
    wanted = wanted.select("want").where("want is not null").distinct()
    equal = wanted.select("want", F.explode(forms).alias("f")).select("want", "f.*").join(files.select("id").distinct(), "id")
    equal = cut(equal.groupBy("want").agg(F.min(F.struct("score", "id"))["id"].alias("id")))
    runs = lambda text, size: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, size)))
    base = F.substring_index(F.replace(want, back, slash), "/", -1).alias("base")
    rest = wanted.join(equal, "want", "left_anti").select("want", base).where("base <> ''")
    rest = rest.select("want", "base", F.explode(runs(F.col("base"), F.least(F.lit(3), F.length("base")))).alias("run"))
    sizes = F.explode(F.sequence(F.lit(1), F.least(F.lit(3), F.length("id")))).alias("size")
    held = cut(files.select("id").distinct().select("id", sizes).select("id", F.explode(runs(F.col("id"), F.col("size"))).alias("run")).join(rest.select("run").distinct(), "run", "left_semi"))
    often = held.groupBy("run").agg(F.count("*").alias("n"))
    rarest = rest.join(often, "run").groupBy("want", "base").agg(F.min(F.struct("n", "run"))["run"].alias("run"))
    found = rarest.join(held, "run").where(F.contains("id", F.col("base"))).groupBy("want").agg(F.min("id").alias("id"))
    return equal.unionByName(found)


def guided_search(edges: DataFrame, start, can_answer, should_explore, max_depth: int = 3, max_explored: int = 20) -> DataFrame:
    """(id, depth, action): breadth-first search in both directions, led by two functions of a DataFrame with id.

    Nodes are explored level by level, in order of id, until the budget is spent: can_answer gives those that answer
    (action answer, the others explore). Of their neighbours that aren't explored yet, should_explore gives those that
    the next level explores; the others are recorded as skip, at the depth they would have had."""
    e = cut(both_ways(edges).where("src is not null and dst is not null").distinct())
    frontier = edges.sparkSession.createDataFrame([(start,)], "id long")
    steps = explored = None
    for depth in range(max_depth + 1):
        now = cut(frontier.orderBy("id").limit(max_explored))
        n = now.count()
        if not n:
            break
        max_explored -= n
        answers = can_answer(now).select("id").distinct().withColumn("yes", F.lit(True))
        action = F.when(F.col("yes"), "answer").otherwise("explore").alias("action")
        acts = now.join(answers, "id", "left").select("id", F.lit(depth).alias("depth"), action)
        steps = acts if steps is None else steps.union(acts)
        explored = now if explored is None else cut(explored.union(now))
        if depth == max_depth:
            break
        reached = cut(now.join(e, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(explored, "id", "left_anti"))
        frontier = cut(should_explore(reached).select("id").distinct())
        steps = steps.union(reached.join(frontier, "id", "left_anti").select("id", F.lit(depth + 1).alias("depth"), F.lit("skip").alias("action")))
    return steps


def order_of_visits(tree: DataFrame, start, post: bool = False) -> DataFrame:
    """(id, seq): depth-first order, children by id; sequential by nature, so one graph is one group.

    The group is what start reaches, which the caller bounds."""
    import pandas as pd

    def visit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        children: dict = {}
        for s, d in sorted(zip(rows["src"], rows["dst"])):
            children.setdefault(s, []).append(d)
        out, seen, stack = [], set(), [(key[0], False)]
        while stack:
            node, done = stack.pop()
            if done:
                out.append(node)
            elif node not in seen:
                seen.add(node)
                if post:
                    stack.append((node, True))
                else:
                    out.append(node)
                stack += [(c, False) for c in reversed(children.get(node, [])) if c not in seen]
        return pd.DataFrame({"id": out, "seq": range(len(out))})

    return tree.select(F.lit(start).cast("long").alias("start"), "src", "dst").groupBy("start").applyInPandas(visit, "id long, seq long")


def in_order(visits: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """(seq, value): what a callback would see of each visited node (id, seq), in the order of the visits."""
    return visits.join(rows, "id").select("seq", F.col(column).alias("value")).orderBy("seq")


def sweeps(nodes: DataFrame, validate, most: int) -> DataFrame:
    """(id, sweep): nodes are offered to validate (a function of a DataFrame with id and of the sweep's number, which
    gives the accepted ones) again and again until all are accepted; null after most sweeps."""
    left = cut(nodes.select("id").distinct())
    out = None
    for k in range(1, most + 1):
        done = cut(validate(left, k).select("id").withColumn("sweep", F.lit(k)))
        out = done if out is None else out.union(done)
        left = cut(left.join(done, "id", "left_anti"))
        if left.isEmpty():
            return out
    rest = left.withColumn("sweep", F.lit(None).cast("int"))
    return rest if out is None else out.union(rest)
