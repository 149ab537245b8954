"""Joins that resolve ids, prefer candidates, derive edges and merge scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from graphloom.shared import small_batches


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def last_per(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key: later rows overwrite earlier ones."""
    return first_per(df, keys, [F.desc(order)])


def edges_with_bodies(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """Edges both of whose ends have a function (id, body), with both bodies."""
    side = lambda c: functions.select(F.col("id").alias(c), F.col("body").alias(f"{c}_body"))
    return edges.join(side("src"), "src").join(side("dst"), "dst")


def with_last_body(nodes: DataFrame, bodies: DataFrame, key: str, seq: str) -> DataFrame:
    """Nodes with the last body of their key, null where there's none."""
    return nodes.join(last_per(bodies, [key], seq).select(key, "body"), key, "left")


#: Ids of a bundle: what is sent together where all of two lists are paired; pairs that a task passes on at once.
BUNDLE, UNFOLDED = 2048, 1 << 16


def bundles(rows: DataFrame, key: str, id: str) -> DataFrame:
    """(key, ids): each key's ids in arrays of about BUNDLE; no key's ids meet in one task or row."""
    n = rows.groupBy(key).agg(F.ceil(F.count("*") / BUNDLE).alias("__n"))
    dealt = rows.join(n, key).withColumn("__part", F.pmod(F.xxhash64(F.lit("bundle"), id), "__n"))
    return dealt.groupBy(key, "__part").agg(F.collect_list(F.struct(id)).alias(f"{id}s")).drop("__part")  # structs: null ids are kept


def paired(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst) of distinct calls (src, symbol) and nodes (symbol, dst): bundles are joined and dealt to all tasks before they are unfolded.

    Each src gets the other bundle in runs of about UNFOLDED pairs, then that is unfolded: two explodes, one upon the other, would
    hold all pairs of two bundles at once.
    """
    small_batches(calls.sparkSession)
    n = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = bundles(calls, "symbol", "src").join(bundles(nodes, "symbol", "dst"), "symbol").select("srcs", "dsts").repartition(4 * n)

    def unfold(batches):
        for batch in batches:
            for lists in zip(*batch.columns):
                srcs, dsts = (ids.values.flatten()[0] for ids in lists)
                step = max(1, UNFOLDED // len(dsts))
                for src in (srcs.slice(i, step) for i in range(0, len(srcs), step)):
                    ends = pa.array(np.arange(len(src) + 1) * len(dsts), pa.int32())
                    yield pa.RecordBatch.from_arrays([src, pa.ListArray.from_arrays(ends, pa.concat_arrays([dsts] * len(src)))], ["src", "dsts"])

    kinds = StructType([calls.schema["src"], StructField("dsts", ArrayType(nodes.schema["dst"].dataType))])
    return met.mapInArrow(unfold, kinds).select("src", F.explode("dsts").alias("dst"))


def calls_by_symbol(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """(caller id, callee symbol) to distinct edges (src, dst): every node that has the symbol.

    There are as many edges as pairs, so these are not shuffled: both sides are made distinct before they meet. Only a
    node that has several symbols can meet a caller twice; edges to such nodes are made distinct afterwards.
    """
    calls = calls.select("src", "symbol").where("symbol is not null").distinct().join(nodes.select("symbol"), "symbol", "left_semi")
    nodes = nodes.select("symbol", F.col("id").alias("dst")).where("symbol is not null").distinct().join(calls.select("symbol"), "symbol", "left_semi")
    several = nodes.groupBy(F.col("dst").alias("__dst")).count().where("count > 1").select("__dst")
    again, once = nodes.join(several, F.col("dst").eqNullSafe(F.col("__dst")), "left_semi"), nodes.join(several, F.col("dst").eqNullSafe(F.col("__dst")), "left_anti")
    return paired(calls, once).unionByName(calls.join(again, "symbol").select("src", "dst").distinct())


def explode_members(owners: DataFrame, functions: DataFrame, owner: str, members: str, member: str) -> DataFrame:
    """(owner, member) for members of an array that exist."""
    return owners.select(owner, F.explode(members).alias(member)).join(functions.select(member), member, "left_semi").select(owner, member)


def canonical(wanted: DataFrame, candidates: DataFrame) -> DataFrame:
    """wanted (id, symbol, file) to the candidate (cid, symbol, file, seq): of the same file if there's one, else the first.

    A row of wanted is held against four rows at most, whatever its symbol has: the first candidate of its file, of
    those with a file, and of all. Candidates without a file come last, but for a row that has none either.
    """
    place = F.struct("seq", "cid")
    c = candidates.where("symbol is not null")
    of_file = c.where("file is not null").groupBy("symbol", "file").agg(F.min(place).alias("__same"))
    of_symbol = c.groupBy("symbol").agg(F.min(F.struct(F.col("file").isNull().alias("bare"), "seq", "cid")).alias("__named"), F.min(place).alias("__any"))
    met = wanted.select("id", "symbol", "file").join(of_symbol, "symbol").join(of_file, ["symbol", "file"], "left")
    other = F.when(F.col("file").isNull(), F.struct(F.lit(2).alias("k"), "__any.seq", "__any.cid")).otherwise(F.struct((F.col("__named.bare").cast("int") + 1).alias("k"), "__named.seq", "__named.cid"))
    best = F.when(F.col("__same").isNotNull(), F.struct(F.lit(0).alias("k"), "__same.seq", "__same.cid")).otherwise(other)
    return met.groupBy("id").agg(F.min(best)["cid"].alias("cid"))


def owner_dependencies(members: DataFrame, calls: DataFrame) -> DataFrame:
    """Distinct (src, dst) between owners of which one has a member that calls one of the other's; no loops."""
    a = members.select(F.col("owner").alias("src_owner"), F.col("member").alias("src"))
    b = members.select(F.col("owner").alias("dst_owner"), F.col("member").alias("dst"))
    found = calls.select("src", "dst").join(a, "src").join(b, "dst")
    return found.where("src_owner <> dst_owner").select(F.col("src_owner").alias("src"), F.col("dst_owner").alias("dst")).distinct()


def two_hop(first: DataFrame, second: DataFrame, one_parent: bool = False, seq: str | None = None) -> DataFrame:
    """(src, dst) over a middle node; one_parent keeps only the last parent of each middle node."""
    a = last_per(first, ["dst"], seq) if one_parent else first
    return a.select("src", F.col("dst").alias("__mid")).join(second.select(F.col("src").alias("__mid"), "dst"), "__mid").select("src", "dst").distinct()


def cross_dependencies(edges: DataFrame, members: DataFrame, a, b) -> DataFrame:
    """(direction, src, dst) of edges between the members of two owners."""
    own = lambda o, c: members.where(F.col("owner") == F.lit(o)).select(F.col("member").alias(c))
    there = edges.join(own(a, "src"), "src", "left_semi").join(own(b, "dst"), "dst", "left_semi").withColumn("direction", F.lit("forth"))
    back = edges.join(own(b, "src"), "src", "left_semi").join(own(a, "dst"), "dst", "left_semi").withColumn("direction", F.lit("back"))
    return there.unionByName(back).select("direction", "src", "dst").distinct()


def module_dependencies(calls: DataFrame, module_of: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, dependencies): sorted other modules that each valid module calls, empty where there are none."""
    m = module_of.join(modules.select("module"), "module", "left_semi")
    pairs = calls.join(m.select(F.col("id").alias("src"), F.col("module").alias("a")), "src").join(m.select(F.col("id").alias("dst"), F.col("module").alias("b")), "dst").where("a <> b").select("a", "b").distinct()
    deps = pairs.groupBy(F.col("a").alias("module")).agg(F.array_sort(F.collect_list("b")).alias("dependencies"))
    return modules.select("module").distinct().join(deps, "module", "left").withColumn("dependencies", F.coalesce("dependencies", F.array().cast(deps.schema["dependencies"].dataType)))


def fan_out(edges: DataFrame, scope: DataFrame) -> DataFrame:
    """(src, dsts) of the edges within a scope (id)."""
    inside = lambda e, c: e.join(scope.select(F.col("id").alias(c)), c, "left_semi")
    return inside(inside(edges, "src"), "dst").groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("dsts"))


def ranked_targets(ids: DataFrame, edges: DataFrame, most_rank: int, limit: int) -> DataFrame:
    """First-seen distinct targets of ids (id, pos) over edges (src, dst, rank) of good rank."""
    hits = ids.join(edges.where(F.col("rank") <= most_rank), F.col("id") == F.col("src"))
    seen = hits.groupBy("dst").agg(F.min(F.struct("pos", "rank")).alias("at"))
    return seen.orderBy("at.pos", "at.rank", "dst").limit(limit).select("dst")


def definers(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, seen_at) of DEFINE edges into ids (id, pos): text units in order of first sight."""
    return ids.join(edges.where("type = 'DEFINE'"), F.col("id") == F.col("dst")).groupBy("src").agg(F.min("pos").alias("seen_at"))


def combine_scores(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Full outer merge of two score tables, what's missing being 0."""
    x = a.select(key, F.col("score").alias("score_a"))
    return x.join(b.select(key, F.col("score").alias("score_b")), key, "full").select(key, F.coalesce("score_a", F.lit(0.0)).alias("score_a"), F.coalesce("score_b", F.lit(0.0)).alias("score_b"))


def checked_lookup(rows: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Inner join on a foreign key; fails where a target is missing."""
    found = rows.join(targets.withColumn("__there", F.lit(True)), key, "left")
    return found.where(F.coalesce("__there", F.raise_error(F.concat(F.lit("no row for "), F.col(key).cast("string"))).cast("boolean"))).drop("__there")


def not_done(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(done, keys, "left_anti")


def cyclic_shift(rows: DataFrame, batch: str, order: str, value: str) -> DataFrame:
    """Unmatched pairs: each row with the next row's value, the last with the first's."""
    w = W.partitionBy(batch).orderBy(order)
    nxt = F.coalesce(F.lead(value).over(w), F.first(value).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return rows.withColumn("other", nxt)


def uses_name(bodies: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, name): names (of the same keys) that occur in a body as whole words; an equi-join on words."""
    words = bodies.select(*keys, "id", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"[A-Za-z0-9_]+"), F.lit(0)))).alias("name"))
    return words.join(names, [*keys, "name"]).select(*keys, "id", "name")


def in_and_out(edges: DataFrame, id) -> DataFrame:
    """(direction, other, type) of a node's edges."""
    out = edges.where(F.col("src") == F.lit(id)).select(F.lit("out").alias("direction"), F.col("dst").alias("other"), "type")
    return out.union(edges.where(F.col("dst") == F.lit(id)).select(F.lit("in"), F.col("src"), "type"))


def neighbour_sets(edges: DataFrame, nodes: DataFrame, type: str) -> DataFrame:
    """(src, neighbours): joined sorted names of the targets over edges of a type."""
    e = edges.where(F.col("type") == type).join(nodes.select(F.col("id").alias("dst"), "name"), "dst")
    return e.groupBy("src").agg(F.array_join(F.array_sort(F.collect_list("name")), "|").alias("neighbours"))
