"""Queries of windows, orders and limits."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators import windows as op
from graphloom.operators.scans import trajectory_returns
from graphloom.plans.base import Registry

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
r6 = lambda c, n: F.round(c, 6).alias(n)


@query("o_w1_rank", "select user_id, event_id, row_number() over (partition by user_id order by value desc, event_id desc)::int as rank from events")
def _(t):
    return op.rank_desc(t.events, ["user_id"], "value", "event_id").select("user_id", "event_id", "rank")


for _key, _m, _e, _sql in (
    ("o_w2_group_mean", "mean", 0, "value - avg(value) over w"),
    ("o_w3_leave_one_out", "leave_one_out", 0, "case when count(*) over w > 1 then value - (sum(value) over w - value) / (count(*) over w - 1) end"),
    ("o_w4_group_norm", "norm", 1e-9, "(value - avg(value) over w) / (stddev_samp(value) over w + 1e-9::double)"),
    ("o_w5_grpo", "norm", 1e-4, "(value - avg(value) over w) / (stddev_samp(value) over w + 1e-4::double)"),
):
    query(_key, f"select event_id, round(({_sql}) + 1e-7::double, 4) as advantage from events window w as (partition by user_id)")(
        lambda t, _m=_m, _e=_e: op.group_advantage(t.events, ["user_id"], "value", _m, _e).select("event_id", F.round(F.col("advantage") + 1e-7, 4).alias("advantage"))
    )


def paths(t):
    """One trajectory an order: rewards and values by line number."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("r"), (F.col("l_tax") * 100).alias("v"))
    return rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "r", "v"))).alias("s")).select("l_orderkey", F.col("s.r").alias("r"), F.col("s.v").alias("v"))


def joined(c, form="%.4f", nudge=0.0):
    """nudge moves values off the ties of decimal rounding, on both sides alike."""
    return F.array_join(F.transform(c, lambda x: F.format_string(form, x + nudge)), "|")


_FOLD = """with recursive l as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_quantity, l_tax) as k, l_quantity as r, l_tax * 100 as v from lineitem),
  d as (select *, r + {g}::double * coalesce(lead(v) over (partition by l_orderkey order by k), 0) - v as delta, count(*) over (partition by l_orderkey) as n from l),
  f as (select l_orderkey, k, {x} as a, v from d where k = n union all select d.l_orderkey, d.k, {x} + {d}::double * f.a, d.v from f join d on d.l_orderkey = f.l_orderkey and d.k = f.k - 1)
  select l_orderkey, string_agg(printf('%.2f', {out} + 1e-7), '|' order by k) as {name} from f group by 1"""


@query("o_w6_returns", _FOLD.format(g=0.9, d=0.9, x="r", out="a", name="returns").replace("select d.l_orderkey, d.k, r +", "select d.l_orderkey, d.k, d.r +"))
def _(t):
    return paths(t).select("l_orderkey", joined(op.discounted_returns(F.col("r"), 0.9), "%.2f", 1e-7).alias("returns"))


@query("o_w7_gae", _FOLD.format(g=0.9, d="(0.9 * 0.8)", x="delta", out="a + v", name="returns").replace("select d.l_orderkey, d.k, delta +", "select d.l_orderkey, d.k, d.delta +"))
def _(t):
    return paths(t).select("l_orderkey", joined(op.gae(F.col("v"), F.col("r"), 0.9, 0.8)["returns"], "%.2f", 1e-7).alias("returns"))


_STEPS = """with l as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_quantity, l_tax) as k, l_quantity as r, l_tax * 100 as v from lineitem),
  d as (select *, r + 0.9::double * coalesce(lead(v) over (partition by l_orderkey order by k), 0) - v as delta from l)
  select a.l_orderkey, a.k, round({0}, 6) as "return" from d a join d b on b.l_orderkey = a.l_orderkey and b.k >= a.k group by a.l_orderkey, a.k, a.v"""


def steps(t):
    k = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity", "l_tax")).cast("long")
    return t.lineitem.select("l_orderkey", k.alias("k"), F.col("l_quantity").alias("r"), (F.col("l_tax") * 100).alias("v"))


@query("o_w6_returns_by_step", _STEPS.format("sum(b.r * pow(0.9::double, b.k - a.k))"))
def _(t):
    return trajectory_returns(steps(t), "l_orderkey", "k", "r", 0.9).select("l_orderkey", "k", F.round("return", 6).alias("return"))


@query("o_w7_gae_by_step", _STEPS.format("a.v + sum(b.delta * pow(0.9::double * 0.8::double, b.k - a.k))"))
def _(t):
    return trajectory_returns(steps(t), "l_orderkey", "k", "r", 0.9, "v", 0.8).select("l_orderkey", "k", F.round("return", 6).alias("return"))


@query("o_w8_token_rewards", "select l_orderkey, string_agg(printf('%.4f', -0.1::double * v + case when k = n then 5.0 else 0 end), '|' order by k) as rewards from (select l_orderkey, l_tax * 100 as v, row_number() over (partition by l_orderkey order by l_linenumber, l_quantity, l_tax) as k, count(*) over (partition by l_orderkey) as n from lineitem) group by 1")
def _(t):
    return paths(t).select("l_orderkey", joined(op.token_rewards(F.lit(9.0), F.col("v"), 0.1, clip=5.0)).alias("rewards"))


@query("o_w9_coalesce_small")
def _(t):
    return t.documents.select("doc_id", F.size(op.coalesce_small(F.split("text", "\n"), 200)).alias("chunks"))


@query("o_w10_packing_offsets", "select doc_id, coalesce(sum(n_chars) over (partition by doc_id // 8 order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as \"offset\", row_number() over (partition by doc_id // 8 order by doc_id)::int as segment, ((64 - sum(n_chars) over (partition by doc_id // 8) % 64) % 64)::bigint as padding from documents")
def _(t):
    d = t.documents.withColumn("batch", F.floor(F.col("doc_id") / 8))
    return op.packing_offsets(d, "batch", "doc_id", "n_chars", 64).select("doc_id", "offset", "segment", "padding")


@query("o_w11_position_ids", "select l_orderkey, l_linenumber, l_quantity, l_extendedprice, (row_number() over (partition by l_orderkey, l_returnflag order by l_extendedprice) - 1)::int as position_id from lineitem")
def _(t):
    return op.position_ids(t.lineitem, "l_orderkey", "l_returnflag", "l_extendedprice", "l_linenumber", "l_quantity").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "position_id")


@query("o_w12_unpack", "select vec_id, round(list_sum(list_transform(embedding[1:20], lambda x: x::double)), 6) as a, round(list_sum(list_transform(embedding[21:64], lambda x: x::double)), 6) as b from embeddings")
def _(t):
    parts = op.unpack(F.col("embedding"), F.array(F.lit(20), F.lit(44)))
    total = lambda k: F.aggregate(parts[k], F.lit(0.0), lambda s, x: s + x.cast("double"))
    return t.embeddings.select("vec_id", r6(total(0), "a"), r6(total(1), "b"))


@query("o_w13_round_robin", "select label, vec_id, row_number() over (order by rn, label) as seq from (select label, vec_id, row_number() over (partition by label order by vec_id) as rn from embeddings)")
def _(t):
    return op.round_robin(t.embeddings.select("label", "vec_id"), "label", [F.col("vec_id")], "label")


@query("o_w14_repeat_rows", "select item_id, unnest(range(3))::int as sample_idx from benchmark")
def _(t):
    return op.repeat_rows(t.benchmark.select("item_id"), 3)


@query("o_w15_cursor", "select event_id from events order by event_id limit 100 offset 200")
def _(t):
    return op.cursor_slice(t.events.select("event_id"), "event_id", 2, 100)


@query("o_w16_newest", "select event_id from events order by event_id desc limit 64")
def _(t):
    return op.newest(t.events.select("event_id"), "event_id", 64)


@query("o_w17_shard", "with i as (select item_id, row_number() over (order by item_id) - 1 as idx from benchmark), n as (select count(*) as n from benchmark), p as (select * from i union all select item_id, idx + n from i, n where idx < (7 - n % 7) % 7) select item_id, idx from p where idx % 7 = 3 and idx >= 10")
def _(t):
    return op.strided_shard(t.benchmark.select("item_id"), "item_id", 3, 7, 10).select("item_id", "idx")


@query("o_w18_first_seen", "select user_id, min(event_id) as event_id from events group by 1")
def _(t):
    from graphloom.operators.joins import first_per

    return first_per(t.events.select("user_id", "event_id"), ["user_id"], [F.col("event_id")])


@query("o_k7_by_dependencies", "select l_suppkey, count(distinct l_partkey) as n from lineitem group by 1 order by n desc, 1 limit 20")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("n")).orderBy(F.desc("n"), "l_suppkey").limit(20)


@query("o_k8_limit", "select doc_id from documents order by n_chars desc, doc_id limit 15")
def _(t):
    return t.documents.orderBy(F.desc("n_chars"), "doc_id").limit(15).select("doc_id")


@query("o_k10_seeded_sample", "select item_id from benchmark order by md5(item_id::varchar || ':7'), item_id limit 12")
def _(t):
    return t.benchmark.orderBy(F.md5(F.concat(F.col("item_id").cast("string"), F.lit(":7"))), "item_id").limit(12).select("item_id")


@query("o_k11_best_cut", "select p_partkey, list_max(list_filter(range(1, least(p_size, 48) + 1), lambda x: 48 % x = 0))::int as cut from part where p_size > 0")
def _(t):
    from graphloom.functions.training import best_cut

    return t.part.where("p_size > 0").select("p_partkey", best_cut(F.col("p_size"), 48).alias("cut"))
