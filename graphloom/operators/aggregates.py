"""Aggregations of benchmark records, graphs, costs and rewards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(part: Column, total: Column) -> Column:
    """100 * part / total, 0 where total is 0 or null."""
    return F.when(F.coalesce(total, F.lit(0)) > 0, 100.0 * F.coalesce(part, F.lit(0)) / total).otherwise(F.lit(0.0))


def reuse_rate(correct: Column, incorrect: Column, reference: Column, denominator: str = "reference_count") -> Column:
    """Share of correctly reused items, of the reference's count or of what was produced (correct_plus_incorrect)."""
    return rate(correct, reference if denominator == "reference_count" else correct + incorrect)


def mean_or_zero(c: Column) -> Column:
    """Mean in which missing values count as 0."""
    return F.avg(F.coalesce(c, F.lit(0)))


def averages(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*(mean_or_zero(F.col(c)).alias(c) for c in columns))


def means_of_means(rows: DataFrame, inner: list[str], outer: list[str], columns: list[str]) -> DataFrame:
    """Unweighted means over the inner groups' means."""
    return averages(rows, [*outer, *inner], columns).groupBy(*outer).agg(*(F.avg(c).alias(c) for c in columns))


def ratio(a: Column, b: Column) -> Column:
    """sum(a) / sum(b), 0 where that's nothing."""
    return F.when(F.sum(b) > 0, F.sum(a) / F.sum(b)).otherwise(F.lit(0.0))


def precision_recall(tp: Column, fp: Column, fn: Column) -> list[Column]:
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = safe(tp, tp + fp), safe(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), safe(2 * p * r, p + r).alias("f1")]


def map_totals(rows: DataFrame, column: str, cases: str) -> DataFrame:
    """(agent, total, per_case) over a map of agents to numbers."""
    flat = rows.select(F.explode(column).alias("agent", "v"))
    n = rows.agg(F.sum(cases).alias("n"))
    totals = flat.groupBy("agent").agg(F.sum(F.coalesce("v", F.lit(0))).alias("total")).withColumn("one", F.lit(1))
    return totals.join(F.broadcast(n.withColumn("one", F.lit(1))), "one").select("agent", "total", F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(F.lit(0.0)).alias("per_case"))


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(measure, value): counts by type, totals and density."""
    n = nodes.groupBy(F.concat(F.lit("nodes:"), "type").alias("measure")).agg(F.count("*").cast("double").alias("value"))
    e = edges.groupBy(F.concat(F.lit("edges:"), "type").alias("measure")).agg(F.count("*").cast("double").alias("value"))
    totals = n.agg(F.sum("value").alias("n")).withColumn("one", F.lit(1)).join(e.agg(F.sum("value").alias("m")).withColumn("one", F.lit(1)), "one")
    density = totals.select(F.lit("density").alias("measure"), F.when(F.col("n") > 1, F.coalesce("m", F.lit(0)) / (F.col("n") * (F.col("n") - 1))).otherwise(F.lit(0.0)).alias("value"))
    return n.union(e).union(density)


def function_statistics(functions: DataFrame) -> DataFrame:
    from graphloom.operators.filters import is_declaration

    whole = F.col("body").isNotNull() & ~is_declaration(F.col("body"))
    with_body = F.count(F.when(whole, 1))
    return functions.agg(
        F.count("*").alias("total"), with_body.alias("with_body"), (F.count("*") - with_body).alias("declarations"),
        F.coalesce(F.floor(F.sum(F.when(whole, F.length("body"))) / with_body), F.lit(0)).cast("long").alias("average_length"), F.countDistinct("file").alias("files"),
    )


def layer_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src_type, dst_type, type, n)."""
    side = lambda p: nodes.select(F.col("id").alias(p), F.col("type").alias(f"{p}_type"))
    return edges.join(side("src"), "src").join(side("dst"), "dst").groupBy("src_type", "dst_type", "type").agg(F.count("*").alias("n"))


def coupling(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Per member of an owner: ca, ce and instability over edges inside the owner."""
    side = lambda p: members.select(F.col("owner").alias(f"{p}_owner"), F.col("member").alias(p))
    inside = edges.select("src", "dst").distinct().join(side("src"), "src").join(side("dst"), "dst").where("src_owner = dst_owner and src <> dst")
    ends = inside.select(F.col("src").alias("member"), F.lit(1).alias("e"), F.lit(0).alias("a")).union(inside.select("dst", F.lit(0), F.lit(1)))
    d = ends.groupBy("member").agg(F.sum("a").alias("ca"), F.sum("e").alias("ce"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = members.join(d, "member", "left").withColumn("ca", zero("ca")).withColumn("ce", zero("ce"))
    return out.withColumn("instability", F.when(F.col("ca") + F.col("ce") > 0, F.round(F.col("ce") / (F.col("ca") + F.col("ce")), 4)).otherwise(F.lit(0.0)))


def duplicates(rows: DataFrame, key: Column, member: str) -> DataFrame:
    """(key, n, members) of keys that several rows have."""
    return rows.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(member)), "|").alias("members")).where("n > 1")


def dependency_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    d = edges.groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("dependencies"))
    return nodes.select("id").join(d, "id", "left").select("id", F.coalesce("dependencies", F.lit(0)).alias("dependencies")).orderBy(F.desc("dependencies"), "id")


def document_frequency(terms: DataFrame) -> DataFrame:
    """(term, df, idf) of (doc_id, term); idf = ln((n - df + 0.5) / (df + 0.5) + 1)."""
    n = terms.agg(F.countDistinct("doc_id").alias("n")).withColumn("one", F.lit(1))
    df = terms.groupBy("term").agg(F.countDistinct("doc_id").alias("df")).withColumn("one", F.lit(1)).join(F.broadcast(n), "one")
    return df.select("term", "df", F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))


def best_of(rows: DataFrame, group: list[str], reward: str, seq: str, lowest: bool = False) -> DataFrame:
    """The row of the first highest (lowest) reward of each group."""
    from graphloom.operators.joins import first_per

    return first_per(rows, group, [F.asc(reward) if lowest else F.desc(reward), F.asc(seq)])


def preference_pairs(rows: DataFrame, group: str, reward: str, seq: str) -> DataFrame:
    """(group, chosen, chosen_reward, rejected, rejected_reward) by seq; a group of one is both."""
    pick = lambda low, p: best_of(rows, [group], reward, seq, low).select(group, F.col(seq).alias(p), F.col(reward).alias(f"{p}_reward"))
    return pick(False, "chosen").join(pick(True, "rejected"), group)


def standardized(rows: DataFrame, column: str, sample: bool = True, floor: float = 0.0) -> DataFrame:
    """column's z-score over all rows, as z; null where there's no spread and no floor."""
    s = F.stddev_samp(column) if sample else F.stddev_pop(column)
    stats = rows.agg(F.avg(column).alias("__m"), s.alias("__s")).withColumn("__one", F.lit(1))
    spread = F.greatest("__s", F.lit(floor)) if floor else F.col("__s")
    return rows.withColumn("__one", F.lit(1)).join(F.broadcast(stats), "__one").withColumn("z", F.when(spread > 0, (F.col(column) - F.col("__m")) / spread)).drop("__m", "__s", "__one")


def masked_mean(values: Column, mask: Column) -> Column:
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    n = total(F.transform(mask, lambda m: m.cast("double")))
    return F.when(n > 0, total(F.zip_with(values, mask, lambda v, m: v.cast("double") * m)) / n)


def histogram(rows: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n, density): bins of equal width, the last closed; values outside are left out."""
    v = F.col(column)
    at = F.least(F.floor((v - low) * bins / (high - low)), F.lit(bins - 1)).cast("long")
    counts = rows.where(v.between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t")).withColumn("one", F.lit(1))
    return counts.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").select("bin", "n", (F.col("n") * bins / (F.col("t") * (high - low))).alias("density"))


def referenced_groups(edges: DataFrame, group: str, target: str) -> DataFrame:
    """(group, targets): other groups referred to."""
    return edges.where(F.col(group) != F.col(target)).groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(target)), "|").alias("targets"))


def weighted_reward(rewards: Column, weights: list[float]) -> Column:
    w = F.array(*(F.lit(float(x)) for x in weights))
    return F.aggregate(F.zip_with(rewards, w, lambda r, x: F.coalesce(r, F.lit(0.0)) * x), F.lit(0.0), lambda s, x: s + x)


def votes(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """winner: a, b or Tie, by the number of metrics (a's column, b's column) in which one is higher."""
    a = sum((F.when(F.col(x) > F.col(y), 1).otherwise(0) for x, y in pairs), F.lit(0))
    b = sum((F.when(F.col(x) < F.col(y), 1).otherwise(0) for x, y in pairs), F.lit(0))
    return rows.withColumn("winner", F.when(a > b, "a").when(b > a, "b").otherwise("Tie"))


def consolidate(edges: DataFrame, key: str, seq: str) -> DataFrame:
    """Per entity: the first DEFINE row's description, else the first row's; and all candidates in order."""
    from graphloom.operators.joins import first_per

    first = first_per(edges, [key], [F.desc(F.col("relation") == "DEFINE"), F.col(seq)]).select(key, "description")
    every = edges.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq, "description"))), lambda x: x["description"]), "|").alias("candidates"))
    return first.join(every, key)


def side_by_side(rows: DataFrame, metric: str, file: str, value: str, files: list[str]) -> DataFrame:
    return rows.groupBy(metric).pivot(file, files).agg(F.round(F.avg(value), 6))
