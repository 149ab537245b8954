"""Queries of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import joins as op
from graphloom.operators.numbering import numbered
from graphloom.operators.vector_join import similar_pairs
from graphloom.plans.base import CALLS, Registry

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

FUNCS = "select p_partkey as id, p_name as body, split_part(p_name, ' ', 1) as symbol, p_brand as file, p_size as size from part"


def funcs(t):
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("body"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("symbol"), F.col("p_brand").alias("file"), F.col("p_size").alias("size"))


@query("o_j1_edges_with_bodies", f"select e.*, a.body as src_body, b.body as dst_body from ({CALLS}) e join ({FUNCS}) a on a.id = e.src join ({FUNCS}) b on b.id = e.dst")
def _(t):
    return op.edges_with_bodies(t.calls, funcs(t))


@query("o_j2_last_body", "select c_custkey, c_name, o.body from customer left join (select o_custkey, arg_max(o_orderpriority, o_orderkey) as body from orders group by 1) o on o_custkey = c_custkey")
def _(t):
    b = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("body"), "o_orderkey")
    return op.with_last_body(t.customer.select("c_custkey", "c_name"), b, "c_custkey", "o_orderkey")


@query("o_j3_calls_by_symbol", f"select distinct c_custkey as src, f.id as dst from (select c_custkey, case c_mktsegment when 'BUILDING' then 'red widget' when 'MACHINERY' then 'small ring' else 'none' end as body from customer) c join ({FUNCS}) f using (body)")
def _(t):
    c = t.customer.select(F.col("c_custkey").alias("src"), F.when(F.col("c_mktsegment") == "BUILDING", "red widget").when(F.col("c_mktsegment") == "MACHINERY", "small ring").otherwise("none").alias("symbol"))
    return op.calls_by_symbol(c, funcs(t).select("id", F.col("body").alias("symbol")))


@query("o_j4_members", "select distinct l_orderkey as owner, l_partkey as member from lineitem where l_partkey in (select p_partkey from part where p_size < 20)")
def _(t):
    owners = t.lineitem.groupBy(F.col("l_orderkey").alias("owner")).agg(F.collect_set("l_partkey").alias("members"))
    return op.explode_members(owners, t.part.where("p_size < 20").select(F.col("p_partkey").alias("member")), "owner", "members", "member")


@query("o_j5_canonical", f"select w.id, (select c.id from ({FUNCS}) c where c.symbol = w.symbol and c.size < 20 order by (c.file = w.file) desc, c.id limit 1) as cid from ({FUNCS}) w where w.symbol in (select symbol from ({FUNCS}) where size < 20)")
def _(t):
    c = funcs(t).where("size < 20").select(F.col("id").alias("cid"), "symbol", "file", F.col("id").alias("seq"))
    return op.canonical(funcs(t).select("id", "symbol", "file"), c)


def members(t):
    return t.supplier.select(F.col("s_nationkey").alias("owner"), F.col("s_suppkey").alias("member"))


@query("o_j6_owner_dependencies", f"select distinct a.s_nationkey as src, b.s_nationkey as dst from ({CALLS}) e join supplier a on a.s_suppkey = e.src join supplier b on b.s_suppkey = e.dst where a.s_nationkey <> b.s_nationkey")
def _(t):
    return op.owner_dependencies(members(t), t.calls)


@query("o_j7_two_hop", "select distinct n_regionkey as src, c_custkey as dst from nation join customer on c_nationkey = n_nationkey")
def _(t):
    return op.two_hop(t.nation.select(F.col("n_regionkey").alias("src"), F.col("n_nationkey").alias("dst")), t.customer.select(F.col("c_nationkey").alias("src"), F.col("c_custkey").alias("dst")))


@query("o_j7_one_parent", f"with p as (select dst, max(src) as src from ({CALLS}) group by 1) select distinct p.src, e.dst from p join ({CALLS}) e on e.src = p.dst")
def _(t):
    return op.two_hop(t.calls, t.calls, one_parent=True, seq="src")


@query("o_j8_cross_dependencies", f"select distinct 'forth' as direction, src, dst from ({CALLS}) where src in (select s_suppkey from supplier where s_nationkey = 3) and dst in (select s_suppkey from supplier where s_nationkey = 7) union all select distinct 'back', src, dst from ({CALLS}) where src in (select s_suppkey from supplier where s_nationkey = 7) and dst in (select s_suppkey from supplier where s_nationkey = 3)")
def _(t):
    return op.cross_dependencies(t.calls.select("src", "dst"), members(t), 3, 7)


@query("o_j9_module_dependencies", f"with p as (select distinct a.s_nationkey as m, b.s_nationkey as d from ({CALLS}) e join supplier a on a.s_suppkey = e.src join supplier b on b.s_suppkey = e.dst where a.s_nationkey <> b.s_nationkey and a.s_nationkey < 20 and b.s_nationkey < 20) select n_nationkey as module, coalesce((select string_agg(d::varchar, '|' order by d) from p where m = n_nationkey), '') as dependencies from nation where n_nationkey < 20")
def _(t):
    m = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("module"))
    return op.module_dependencies(t.calls.select("src", "dst"), m, t.nation.where("n_nationkey < 20").select(F.col("n_nationkey").alias("module"))).withColumn("dependencies", F.array_join("dependencies", "|"))


@query("o_j10_fan_out", f"select src, string_agg(dst::varchar, '|' order by dst) as dsts from (select distinct src, dst from ({CALLS}) where src in (select s_suppkey from supplier where s_acctbal > 0) and dst in (select s_suppkey from supplier where s_acctbal > 0)) group by src")
def _(t):
    return op.fan_out(t.calls, t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"))).withColumn("dsts", F.array_join("dsts", "|"))


@query("o_j11_reference_nodes", f"select distinct e.src, f.body from ({CALLS}) e join ({FUNCS}) f on f.id = e.dst where f.file like 'Brand#1%'")
def _(t):
    return t.calls.join(funcs(t).select(F.col("id").alias("dst"), "body", "file"), "dst").where(F.col("file").startswith("Brand#1")).select("src", "body").distinct()


_DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::double * z[2]::double))"


@query("o_j12_similar_pairs", f"with p as (select a.vec_id as src, b.vec_id as dst, round({_DOT}, 6) as score from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id where true and {_DOT} >= 0.3) select * from p union all select dst, src, score from p")
def _(t):
    return similar_pairs(t.embeddings, 0.3, "label", "vec_id", "embedding").withColumn("score", F.round("score", 6))


@query("o_j15_ranked_targets", "with e as (select l_orderkey as src, l_suppkey as dst, l_linenumber as rank from lineitem), i as (select o_orderkey as id, row_number() over (order by o_orderkey desc) as pos from orders where o_orderstatus = 'P'), h as (select dst, min((pos, rank)) as place from i join e on e.src = i.id where rank <= 3 group by dst) select dst from h order by place, dst limit 25")
def _(t):
    ids = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"))
    ids = numbered(ids, [F.desc("id")], "pos")
    return op.ranked_targets(ids, t.lineitem.select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_linenumber").alias("rank")), 3, 25)


@query("o_j16_definers", f"select src, min(dst) as seen_at from ({CALLS}) where type = 'A' and dst in (select s_suppkey from supplier where s_nationkey = 3) group by src")
def _(t):
    e = t.calls.withColumn("type", F.when(F.col("type") == "A", "DEFINE").otherwise("USE"))
    return op.definers(t.supplier.where("s_nationkey = 3").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("pos")), e)


@query("o_j17_combine_scores", "select coalesce(a.user_id, b.user_id) as user_id, coalesce(a.score, 0) as score_a, coalesce(b.score, 0) as score_b from (select user_id, round(sum(value), 6) as score from events where event_type = 'error' group by 1) a full join (select user_id, round(sum(value), 6) as score from events where event_type = 'purchase' group by 1) b on a.user_id = b.user_id")
def _(t):
    s = lambda k: t.events.where(F.col("event_type") == k).groupBy("user_id").agg(F.round(F.sum("value"), 6).alias("score"))
    return op.combine_scores(s("error"), s("purchase"), "user_id")


@query("o_j18_checked_lookup", "select l_orderkey, l_linenumber, o_custkey from lineitem join orders on o_orderkey = l_orderkey")
def _(t):
    return op.checked_lookup(t.lineitem.select("l_orderkey", "l_linenumber"), t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")


@query("o_j19_not_done", "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity > 30)")
def _(t):
    return op.not_done(t.orders.select("o_orderkey"), t.lineitem.where("l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("o_j20_compare_by_name", "select b.label, round(b.m - a.m, 6) as diff from (select label, avg(vec_id) as m from embeddings where vec_id % 2 = 0 group by 1) a join (select label, avg(vec_id) as m from embeddings where vec_id % 2 = 1 group by 1) b on a.label = b.label")
def _(t):
    m = lambda k, n: t.embeddings.where(F.col("vec_id") % 2 == k).groupBy("label").agg(F.avg("vec_id").alias(n))
    return m(0, "a").join(m(1, "b"), "label").select("label", F.round(F.col("b") - F.col("a"), 6).alias("diff"))


@query("o_j21_both_ends_exist", f"select * from ({CALLS}) where src in (select s_suppkey from supplier where s_acctbal > 0) and dst in (select s_suppkey from supplier where s_acctbal > 0)")
def _(t):
    known = t.supplier.where("s_acctbal > 0").select("s_suppkey")
    return t.calls.join(known.withColumnRenamed("s_suppkey", "src"), "src", "left_semi").join(known.withColumnRenamed("s_suppkey", "dst"), "dst", "left_semi").select("src", "dst", "type")


@query("o_j22_first_match", "select c_custkey, (select min(o_orderkey) from orders where o_custkey = c_custkey) as o_orderkey from customer where c_custkey in (select o_custkey from orders)")
def _(t):
    first = op.first_per(t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), ["c_custkey"], [F.col("o_orderkey")])
    return t.customer.select("c_custkey").join(first, "c_custkey")


@query("o_j23_header_lookup", f"select w.id, (select c.id from ({FUNCS}) c where c.size < 20 and c.symbol = w.symbol order by (c.file = w.file) desc, c.id limit 1) as cid from ({FUNCS}) w where w.size >= 20")
def _(t):
    w = funcs(t).where("size >= 20").select("id", "symbol", "file")
    c = funcs(t).where("size < 20").select(F.col("id").alias("cid"), "symbol", "file", F.col("id").alias("seq"))
    return w.select("id").join(op.canonical(w, c), "id", "left")


@query("o_j24_cyclic_shift", "select event_id, coalesce(lead(event_id) over (partition by user_id order by event_id), first_value(event_id) over (partition by user_id order by event_id)) as other from events")
def _(t):
    return op.cyclic_shift(t.events.select("event_id", "user_id"), "user_id", "event_id", "event_id").select("event_id", "other")


@query("o_j25_uses_name", r"with w as (select distinct doc_id as id, source, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) as name from documents), n as (select distinct source, regexp_extract(text, '[A-Za-z0-9_]+') as name from documents) select w.source, w.id, w.name from w join n using (source, name)")
def _(t):
    b = t.documents.select("source", F.col("doc_id").alias("id"), F.col("text").alias("body"))
    n = t.documents.select("source", F.regexp_extract("text", "[A-Za-z0-9_]+", 0).alias("name")).distinct()
    return op.uses_name(b, n, ["source"])


@query("o_j26_in_and_out", f"select 'out' as direction, dst as other, type from ({CALLS}) where src = 5 union all select 'in', src, type from ({CALLS}) where dst = 5")
def _(t):
    return op.in_and_out(t.calls, 5)


@query("o_j27_neighbours_by_group", "select label, string_agg(vec_id::varchar, '|' order by vec_id) as ids from embeddings where vec_id in (select doc_id from labels) group by label")
def _(t):
    e = t.embeddings.join(t.labels.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    return e.groupBy("label").agg(F.array_join(F.array_sort(F.collect_set("vec_id")), "|").alias("ids"))


_N = "select p_partkey as id, p_name as name from part"


@query("o_j28_callee_context", f"select src, string_agg(name, '|' order by name) as neighbours from ({CALLS}) e join ({_N}) n on n.id = e.dst where type = 'A' group by src")
def _(t):
    return op.neighbour_sets(t.calls, t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "A")


@query("o_j29_user_context", f"select dst as src, string_agg(name, '|' order by name) as neighbours from ({CALLS}) e join ({_N}) n on n.id = e.src where type = 'R' group by dst")
def _(t):
    return op.neighbour_sets(t.calls.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type"), t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "R")


@query("o_j30_contained", "with recursive f as (select vec_id from embeddings where vec_id = 4 union all select e.vec_id from embeddings e join f on e.vec_id // 3 = f.vec_id where e.vec_id > 0) select vec_id as id from f")
def _(t):
    from graphloom.operators.graph import reachable

    return reachable(t.tree, t.spark.range(4, 5), max_depth=None).select("id")
