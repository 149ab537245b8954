"""Queries of set operations and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import sets as op
from graphloom.plans.base import CALLS, NODES, Registry

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

RAW = "select case when l_linenumber = 1 then l_orderkey % 500 end as id, l_suppkey as src, l_partkey % 97 as dst, l_returnflag as type, l_orderkey * 10 + l_linenumber as seq from lineitem"


@query("o_u1_dedupe_edges", f"select min(seq) as seq from ({RAW}) where id is not null group by id union all select min(seq) from ({RAW}) where id is null group by src, dst, type")
def _(t):
    e = t.lineitem.select(F.when(F.col("l_linenumber") == 1, F.col("l_orderkey") % 500).alias("id"), F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 97).alias("dst"), F.col("l_returnflag").alias("type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return op.dedupe_edges(e).select("seq")


@query("o_u2_difference", f"select src, dst from ({CALLS}) where type = 'A' except select src, dst from ({CALLS}) where type = 'N'")
def _(t):
    pick = lambda k: t.calls.where(F.col("type") == k).select("src", "dst")
    return op.difference(pick("A"), pick("N"))


for _mode, _cols in (("source", "src"), ("target", "dst")):
    query(f"o_u3_endpoints_{_mode}", f"select distinct {_cols} as id from ({CALLS})")(lambda t, _mode=_mode: op.endpoints(t.calls, _mode))
query("o_u3_endpoints_both", f"select src as id from ({CALLS}) union select dst from ({CALLS})")(lambda t: op.endpoints(t.calls))


@query("o_u4_append_new", f"with o as (select id, name from ({NODES}) where id % 3 = 0), n as (select id, upper(name) as name from ({NODES}) where id % 2 = 0) select *, false as is_new from o union all select *, true from n where id not in (select id from o)")
def _(t):
    n = t.nodes.select("id", "name")
    return op.append_new(n.where("id % 3 = 0"), n.where("id % 2 = 0").withColumn("name", F.upper("name")), "id")


@query("o_u5_update_column", f"select id, case when id % 4 = 0 then 'new' else name end as name from ({NODES})")
def _(t):
    n = t.nodes.select("id", "name")
    return op.update_column(n, n.where("id % 4 = 0").withColumn("name", F.lit("new")), "id", ["name"])


@query("o_u6_distinct_bodies", "select md5(text || lang) as id, text, lang from documents where not text like '%);' group by text, lang")
def _(t):
    return t.documents.where(~F.col("text").endswith(");")).select("text", "lang").distinct().select(F.md5(F.concat("text", "lang")).alias("id"), "text", "lang")


@query("o_u7_merge_graphs", "select coalesce(s.s_suppkey, p.p_partkey, c.c_custkey) as id, coalesce(c.c_name, s.s_name) as name, p.p_type as type from supplier s full join part p on p.p_partkey = s.s_suppkey full join customer c on c.c_custkey = coalesce(s.s_suppkey, p.p_partkey)")
def _(t):
    s = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    p = t.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("type"))
    return op.merge_graphs([s, p, t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))])


@query("o_u8_last_wins", "select user_id, arg_max(value, event_id) as value from events group by user_id")
def _(t):
    return op.last_per(t.events.select("user_id", "value", "event_id"), ["user_id"], "event_id").select("user_id", "value")


@query("o_u9_union_of_ids", "select doc_id as id from labels union select item_id from benchmark")
def _(t):
    return t.labels.select(F.col("doc_id").alias("id")).union(t.benchmark.select("item_id")).distinct()


@query("o_u10_interleave", """with a as (select o_orderkey as id, 'a' as source, row_number() over (order by o_orderkey) - 1 as rn, 2 as w, 0 as k from orders where o_orderstatus = 'P' ),
  b as (select c_custkey as id, 'b' as source, row_number() over (order by c_custkey) - 1 as rn, 3 as w, 1 as k from customer),
  r as (select *, rn // w as round from a union all select *, rn // w from b),
  l as (select least((select count(*) from a) // 2, (select count(*) from b) // 3) as rounds)
  select id, source, row_number() over (order by round, k, rn) as seq from r, l where round < rounds""")
def _(t):
    return op.interleave({"a": t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id")), "b": t.customer.select(F.col("c_custkey").alias("id"))}, {"a": 2, "b": 3}, "id").select("id", "source", "seq")


@query("o_u11_first_rows", "select event_id from events order by event_id limit 300")
def _(t):
    return op.first_rows(t.events.select("event_id"), 300, "event_id")


@query("o_u12_append_remove", "select item_id as id from benchmark where item_id <> 5 union all select vec_id from embeddings where vec_id <> 5")
def _(t):
    return t.benchmark.select(F.col("item_id").alias("id")).union(t.embeddings.select("vec_id")).where("id <> 5")


@query("o_u13_remove_position", "select item_id from (select item_id, row_number() over (order by item_id) as rn from benchmark) where rn <> 4")
def _(t):
    return op.remove_position(t.benchmark.select("item_id"), "item_id", 3)


@query("o_u14_induced", f"select * from ({CALLS}) where src in (select s_suppkey from supplier where s_acctbal > 0) and dst in (select s_suppkey from supplier where s_acctbal > 0)")
def _(t):
    return op.induced(t.calls, t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("id")))


@query("o_u15_update_non_null", "select d.doc_id, coalesce(l.quality, length(d.lang)) as quality from documents d left join labels l on l.doc_id = d.doc_id")
def _(t):
    return op.update_column(t.documents.select("doc_id", F.length("lang").alias("quality")), t.labels, "doc_id", ["quality"])


@query("o_u16_append_and_count", "select conv_id, max(turn) as last_updated, count(*) as n from (select conv_id, turn from conversations union all select distinct conv_id, 99 from conversations) group by conv_id")
def _(t):
    c = t.conversations.select("conv_id", "turn")
    return op.append_and_count(c, c.select("conv_id").distinct().withColumn("turn", F.lit(99).cast("long")), "conv_id", "turn")


@query("o_i23_upsert", "select o_orderkey, case when o_orderkey % 2 = 0 then 'X' else o_orderstatus end as status from orders")
def _(t):
    from graphloom.plans.q_sources import folder
    from graphloom.sources.keyed_table import KeyedTable

    old = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.lit(0).alias("seq"))
    new = old.where("o_orderkey % 2 = 0")
    table = KeyedTable(t.spark, folder(t, "orders"), "o_orderkey", "seq", buckets=16)
    table.upsert(old)
    table.upsert(op.upsert(new.withColumn("status", F.lit("W")), new.withColumn("status", F.lit("X")), "o_orderkey").withColumn("seq", F.lit(1)))
    return table.rows().select("o_orderkey", "status")
