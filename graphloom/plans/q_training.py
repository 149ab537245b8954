"""Queries of training-data functions on arrays: divergences, padding, masks, losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import training as tr
from graphloom.plans.base import Registry

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
c = F.col


def text(a, form="%.4f"):
    return F.array_join(F.transform(a, lambda x: F.format_string(form, x)), "|")


def doubles(a):
    return F.transform(a, lambda x: x.cast("double"))


def rows_of(a, size):
    """A vector as rows of size."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / size).cast("int") - 1), lambda i: F.slice(doubles(a), i * size + 1, size))


LIST = "list_transform(embedding, lambda x: x::double)"
BASE = "list_transform(list_reverse(embedding), lambda x: x::double)"
ZIP = f"list_zip({LIST}, {BASE})"
base = lambda: doubles(F.reverse("embedding"))

for _k, _sql in (("k1", "z[1] - z[2]"), ("k2", "(z[1] - z[2]) * (z[1] - z[2]) / 2"), ("k3", "exp(z[2] - z[1]) - 1 + (z[1] - z[2])")):
    query(f"o_s44_kl_{_k}", f"select vec_id, array_to_string(list_transform({ZIP}, lambda z: printf('%.4f', {_sql})), '|') as kl from embeddings")(
        lambda t, _k=_k: t.embeddings.select("vec_id", text(tr.approximate_kl(doubles("embedding"), base(), _k)).alias("kl"))
    )


@query("o_s45_adaptive_coefficient", "with recursive s as (select user_id, value, row_number() over (partition by user_id order by event_id) as k from events), f as (select distinct user_id, 0::bigint as k, 0.1::double as v from s union all select f.user_id, s.k, f.v * (1 + greatest(least(s.value / 10.0 - 1, 0.2), -0.2) * 8 / 1000.0::double) from f join s on s.user_id = f.user_id and s.k = f.k + 1) select user_id, round(arg_max(v, k), 6) as coefficient from f group by 1")
def _(t):
    k = t.events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("s"))
    return k.select("user_id", F.round(tr.adaptive_coefficient(0.1, c("s.value"), 10.0, 1000, 8), 6).alias("coefficient"))


LSE = f"ln(list_sum(list_transform({LIST}, lambda x: exp(x))))"


@query("o_s46_log_softmax", f"select vec_id, round({LSE}, 6) as lse, round({LIST}[(label * 7 % len(embedding) + 1)::int] - {LSE}, 6) as logp from embeddings".replace("select vec_id", "select vec_id"))
def _(t):
    d = doubles("embedding")
    return t.embeddings.select("vec_id", F.round(tr.log_sum_exp(d), 6).alias("lse"), F.round(tr.log_softmax_at(d, c("label") * 7 % F.size("embedding")), 6).alias("logp"))


IDS = "range(1, p_size % 7 + 2)"


def ids():
    return F.sequence(F.lit(1), (c("p_size") % 7 + 1)).cast("array<int>")


@query("o_s47_pad", f"select p_partkey, array_to_string(list_concat(list_transform(range(8 - len({IDS})), lambda x: 0), {IDS}), '|') as lefts, array_to_string(list_concat({IDS}, list_transform(range(8 - len({IDS})), lambda x: 0)), '|') as rights from part")
def _(t):
    return t.part.select("p_partkey", F.array_join(tr.pad(ids(), F.lit(8)), "|").alias("lefts"), F.array_join(tr.pad(ids(), F.lit(8), "right"), "|").alias("rights"))


@query("o_s48_trim_padding", f"select p_partkey, array_to_string({IDS}, '|') as ids from part")
def _(t):
    padded = F.concat(F.array(F.lit(0), F.lit(0)), ids(), F.array(F.lit(0)))
    mask = F.transform(padded, lambda x: (x > 0).cast("int"))
    return t.part.select("p_partkey", F.array_join(tr.trim_padding(padded, mask), "|").alias("ids"))


@query("o_s49_masks", f"with i as (select p_partkey, list_concat({IDS}, [9, 0, 0]) as ids, len({IDS}) as n from part) select p_partkey, array_to_string(list_transform(ids, lambda x, i: (i <= n + 1)::int), '|') as attention, array_to_string(list_transform(ids[2:], lambda x, i: (i + 1 <= n + 1)::int), '|') as action from i")
def _(t):
    m = tr.masks(F.concat(ids(), F.array(F.lit(9), F.lit(0), F.lit(0))), F.lit(1), 9, 0)
    return t.part.select("p_partkey", m.alias("m")).select("p_partkey", F.array_join("m.attention", "|").alias("attention"), F.array_join("m.action", "|").alias("action"))


@query("o_s50_scatter_labels", "select p_partkey, case when p_size % 2 = 0 then '-100|1|-100|0|-100' else '-100|1|-100|0|-100|-100' end as labels from part")
def _(t):
    a = F.when(c("p_size") % 2 == 0, F.array(*map(F.lit, (5, 7, 5, 7, 5)))).otherwise(F.array(*map(F.lit, (5, 7, 5, 7, 5, 7))))
    return t.part.select("p_partkey", F.array_join(tr.scatter_labels(a, 7, F.array(F.lit(1), F.lit(0))), "|").alias("labels"))


@query("o_s51_response_ranges", "with s as (select conv_id, turn, role, length(text) as n, coalesce(sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as before from conversations) select conv_id, before::int as first, (before + n - 1)::int as last from s where role = 'assistant'")
def _(t):
    s = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n"), (c("role") == "assistant").alias("own")))).alias("s"))
    return s.select("conv_id", F.inline(tr.response_ranges(c("s.n"), c("s.own"))))


@query("o_s55_sft_labels", f"select p_partkey, array_to_string(list_transform({IDS}, lambda x, i: case when i - 1 between 1 and 3 then x else -100 end), '|') as labels from part")
def _(t):
    ranges = F.array(F.struct(F.lit(1).alias("first"), F.lit(3).alias("last")))
    return t.part.select("p_partkey", F.array_join(tr.sft_labels(ids(), F.transform(ids(), lambda x: F.lit(1)), ranges), "|").alias("labels"))


@query("o_s56_stack_pairs", f"select p_partkey, 'chosen' as side, array_to_string(list_concat({IDS}, list_transform(range(8 - len({IDS})), lambda x: 0)), '|') as ids from part union all select p_partkey, 'rejected', '1|2|0|0|0|0|0|0' from part")
def _(t):
    row = lambda side, a: t.part.select("p_partkey", F.lit(side).alias("side"), F.array_join(tr.pad(a, F.lit(8), "right"), "|").alias("ids"))
    return row("chosen", ids()).union(row("rejected", F.array(F.lit(1), F.lit(2))))


A, B, C, D = "l_tax * 10", "l_discount * 10", "l_quantity / 50", "l_linenumber / 7.0::double"
LS = "(-(ln(1 + exp(-abs({0}))) + greatest(-({0}), 0)))"


def loss(name, sql, f):
    query(name, f"select l_orderkey, l_linenumber, l_extendedprice, round({sql}, 6) as loss from lineitem")(lambda t: t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", F.round(f(c("l_tax") * 10, c("l_discount") * 10, c("l_quantity") / 50, c("l_linenumber") / 7.0), 6).alias("loss")))


loss("o_l2_policy", f"-least(exp({A} - {B}) * {C}, least(greatest(exp({A} - {B}), 0.8), 1.2) * {C})", lambda a, b, x, y: tr.policy_loss(a, b, x))
loss("o_l3_value", f"0.5 * greatest(pow({B} + least(greatest({A} - {B}, -0.2), 0.2) - {C}, 2), pow({A} - {C}, 2))", lambda a, b, x, y: tr.value_loss(a, b, x))
loss("o_l4_pairwise", "-" + LS.format(f"({A} - {B} - {C})"), lambda a, b, x, y: tr.pairwise_loss(a, b, x))
loss("o_l5_log_exp", f"ln(1 + exp({B} - {A}))", lambda a, b, x, y: tr.log_exp_loss(a, b))
loss("o_l6_dpo", "-" + LS.format(f"(0.1 * (({A} - {B}) - ({C} - {D})))") + " * 0.9 - " + LS.format(f"(-0.1 * (({A} - {B}) - ({C} - {D})))") + " * 0.1", lambda a, b, x, y: tr.dpo_loss(a, b, x, y, 0.1, 0.1))
loss("o_l6_ipo", f"pow(({A} - {B}) - ({C} - {D}) - 5, 2)", lambda a, b, x, y: tr.dpo_loss(a, b, x, y, 0.1, ipo=True))
loss("o_l7_kto_vanilla", f"1 - 1 / (1 + exp(-0.1 * ({A} - {B})))", lambda a, b, x, y: tr.kto_loss(a, b, F.lit(0.0), F.lit(True)))
loss("o_l8_kto", f"case when l_linenumber % 2 = 0 then 1 - 1 / (1 + exp(-0.1 * ({A} - {B} - greatest({C}, 0)))) else 1.5 * (1 - 1 / (1 + exp(0.1 * ({A} - {B} - greatest({C}, 0))))) end", lambda a, b, x, y: tr.kto_loss(a, b, x, c("l_linenumber") % 2 == 0, undesirable_weight=1.5))


@query("o_l1_language_model")
def _(t):
    logits = rows_of(c("embedding"), 16)
    return t.embeddings.select("vec_id", F.round(tr.language_model_loss(logits, F.array(F.lit(0), c("label") % 16, F.lit(-100), F.lit(2))), 6).alias("loss"))


@query("o_l9_distillation", f"with l as (select vec_id, {LIST} as te, {BASE} as st from embeddings), s as (select *, ln(list_sum(list_transform(te, lambda x: exp(x)))) as t, ln(list_sum(list_transform(st, lambda x: exp(x)))) as s from l) select vec_id, round(-list_sum(list_transform(range(1, len(te) + 1), lambda i: exp(te[i] - t) * (st[i] - s))), 6) as loss from s")
def _(t):
    return t.embeddings.select("vec_id", F.round(tr.distillation_loss(base(), doubles("embedding")), 6).alias("loss"))


@query("o_l10_process_reward")
def _(t):
    labels = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.when(i % 3 == 0, F.lit(1)).when(i % 3 == 1, F.lit(-100)).otherwise(c("label") % 2))
    r = tr.process_reward_loss(rows_of(c("embedding"), 2), labels)
    return t.embeddings.select("vec_id", r.alias("r")).select("vec_id", F.round("r.loss", 6).alias("loss"), F.round("r.accuracy", 6).alias("accuracy"))


@query("o_l11_sequence_log_prob", "select vec_id, round(list_sum(list_transform(embedding[3:], lambda x: x::double)), 5) as total, round(list_avg(list_transform(embedding[3:], lambda x: x::double)), 6) as mean from embeddings")
def _(t):
    d = F.transform("embedding", lambda x: x.cast("double"))
    return t.embeddings.select("vec_id", F.round(tr.sequence_log_prob(d, F.lit(2)), 5).alias("total"), F.round(tr.sequence_log_prob(d, F.lit(2), mean=True), 6).alias("mean"))
