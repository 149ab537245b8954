"""Queries of aggregations. events stand in for evaluation records: event_type a test type, user_id a file."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import aggregates as op
from graphloom.plans.base import CALLS, NODES, Registry

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
r6 = lambda c, n=None: F.round(c, 6).alias(n or c)

ZERO = "avg(case when event_id % 9 = 0 then 0 else value end)"


def scored(t):
    return t.events.withColumn("score", F.when(F.col("event_id") % 9 != 0, F.col("value")))


@query("o_a1_graph_statistics", f"""with n as ({NODES}), e as ({CALLS}) select 'nodes:' || type as measure, count(*)::double as value from n group by type union all select 'edges:' || type, count(*)::double from e group by type
  union all select 'density', round((select count(*) from e) / ((select count(*) from n)::double * ((select count(*) from n) - 1)), 9)""")
def _(t):
    return op.graph_statistics(t.nodes, t.calls).withColumn("value", F.when(F.col("measure") == "density", F.round("value", 9)).otherwise(F.col("value")))


@query("o_a2_function_statistics", """with f as (select text as body, source as file, not (trim(text) = '' or (trim(text) like '%;' and not contains(text, '{')) or (len(list_filter(string_split(trim(text), chr(10)), lambda x: trim(x) <> '' and not starts_with(trim(x), '//'))) <= 1 and not contains(text, '{'))) as whole from documents)
  select count(*) as total, count(*) filter (where whole) as with_body, count(*) filter (where not whole) as declarations, (sum(length(body)) filter (where whole) // count(*) filter (where whole))::bigint as average_length, count(distinct file) as files from f""")
def _(t):
    return op.function_statistics(t.documents.select(F.col("text").alias("body"), F.col("source").alias("file")))


@query("o_a3_case_averages", f"select round({ZERO}, 6) as score from events")
def _(t):
    return op.averages(scored(t), [], ["score"]).select(r6("score"))


@query("o_a4_file_averages", f"select user_id, round({ZERO}, 6) as score from events group by user_id")
def _(t):
    return op.averages(scored(t), ["user_id"], ["score"]).select("user_id", r6("score"))


@query("o_a5_type_averages", f"select event_type, round(avg(s), 6) as score from (select event_type, user_id, {ZERO} as s from events group by 1, 2) group by 1")
def _(t):
    return op.means_of_means(scored(t), ["user_id"], ["event_type"], ["score"]).select("event_type", r6("score"))


@query("o_a6_global_averages", f"select round(avg(s), 6) as score from (select user_id, {ZERO} as s from events group by 1)")
def _(t):
    return op.means_of_means(scored(t), ["user_id"], [], ["score"]).select(r6("score"))


@query("o_a7_map_totals", "select agent, total, round(total / (select count(*) from events), 6) as per_case from (select 'a' as agent, sum(user_id)::bigint as total from events union all select 'k', sum(json_extract(props, '$.k')::bigint)::bigint from events)")
def _(t):
    e = t.events.select(F.create_map(F.lit("a"), "user_id", F.lit("k"), F.get_json_object("props", "$.k").cast("long")).alias("m"), F.lit(1).alias("cases"))
    return op.map_totals(e, "m", "cases").select("agent", "total", r6("per_case"))


@query("o_a8_ratios", "select event_type, round(sum(value) / sum(user_id), 6) as ratio from events group by 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.round(op.ratio(F.col("value"), F.col("user_id")), 6).alias("ratio"))


for _d, _den in (("reference_count", "l_partkey % 50"), ("correct_plus_incorrect", "l_linenumber + l_suppkey % 5")):
    query(f"o_a9_reuse_rate_{_d}", f"select l_orderkey, l_linenumber, round(case when {_den} > 0 then 100.0::double * l_linenumber / ({_den}) else 0 end, 6) as rate from lineitem")(
        lambda t, _d=_d: t.lineitem.select("l_orderkey", "l_linenumber", F.round(op.reuse_rate(F.col("l_linenumber"), F.col("l_suppkey") % 5, F.col("l_partkey") % 50, _d), 6).alias("rate"))
    )


@query("o_a10_precision_recall", """with c as (select user_id, count(*) filter (where event_type = 'click') as tp, count(*) filter (where event_type = 'error') as fp, count(*) filter (where event_type = 'view') as fn from events group by 1),
  m as (select user_id, case when tp + fp > 0 then tp / (tp + fp) else 0 end as p, case when tp + fn > 0 then tp / (tp + fn) else 0 end as r from c)
  select user_id, round(p, 6) as "precision", round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f1 from m""")
def _(t):
    n = lambda k: F.count(F.when(F.col("event_type") == k, 1))
    c = t.events.groupBy("user_id").agg(n("click").alias("tp"), n("error").alias("fp"), n("view").alias("fn"))
    out = c.select("user_id", *op.precision_recall(F.col("tp"), F.col("fp"), F.col("fn")))
    return out.select("user_id", r6("precision"), r6("recall"), r6("f1"))


@query("o_a11_relevance", "select round(coalesce(avg(value), 0), 6) as relevance, round(coalesce(avg(case when value > 10 then 1 else 0 end), 0), 6) as novelty from events where event_type = 'click'")
def _(t):
    return t.events.where("event_type = 'click'").agg(F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 6).alias("relevance"), F.round(F.coalesce(F.avg(F.when(F.col("value") > 10, 1).otherwise(0)), F.lit(0.0)), 6).alias("novelty"))


@query("o_a12_layer_counts", f"select a.type as src_type, b.type as dst_type, e.type, count(*) as n from ({CALLS}) e join ({NODES}) a on a.id = e.src join ({NODES}) b on b.id = e.dst group by 1, 2, 3")
def _(t):
    return op.layer_counts(t.nodes, t.calls)


@query("o_a13_decomposition", "select count(distinct c_nationkey) as parents, round(count(*) / count(distinct c_nationkey), 6) as children from customer")
def _(t):
    return t.customer.agg(F.countDistinct("c_nationkey").alias("parents"), F.round(F.count("*") / F.countDistinct("c_nationkey"), 6).alias("children"))


@query("o_a14_graph_comparison", f"select count(*) filter (where type = 'A') as static_edges, count(*) as all_edges from ({CALLS})")
def _(t):
    return t.calls.agg(F.count(F.when(F.col("type") == "A", 1)).alias("static_edges"), F.count("*").alias("all_edges"))


@query("o_a15_coupling", f"""with i as (select distinct src, dst from ({CALLS}) e join supplier a on a.s_suppkey = src join supplier b on b.s_suppkey = dst where a.s_nationkey = b.s_nationkey and src <> dst),
  m as (select s_nationkey as owner, s_suppkey as member, (select count(*) from i where dst = s_suppkey) as ca, (select count(*) from i where src = s_suppkey) as ce from supplier)
  select *, case when ca + ce > 0 then round(ce / (ca + ce), 4) else 0 end as instability from m""")
def _(t):
    return op.coupling(t.supplier.select(F.col("s_nationkey").alias("owner"), F.col("s_suppkey").alias("member")), t.calls)


@query("o_a16_before_after", "select event_type, round(avg(value), 4) as before, round(avg(user_id), 4) as after from events where value > 5 group by 1")
def _(t):
    return t.events.where("value > 5").groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("before"), F.round(F.avg("user_id"), 4).alias("after"))


@query("o_a17_part_against_whole", "select o_orderkey, o_totalprice, round(avg(l_extendedprice), 6) as part_mean from orders join lineitem on l_orderkey = o_orderkey group by 1, 2")
def _(t):
    m = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.avg("l_extendedprice"), 6).alias("part_mean"))
    return t.orders.select("o_orderkey", "o_totalprice").join(m, "o_orderkey")


@query("o_a18_duplicates", f"select split_part(name, ' ', 1) as key, count(*) as n, string_agg(id::varchar, '|' order by id) as members from ({NODES}) group by 1 having count(*) > 1")
def _(t):
    return op.duplicates(t.nodes, F.split_part("name", F.lit(" "), F.lit(1)), "id")


@query("o_a19_dependency_counts", f"select s_suppkey as id, (select count(distinct dst) from ({CALLS}) where src = s_suppkey) as dependencies from supplier")
def _(t):
    return op.dependency_counts(t.supplier.select(F.col("s_suppkey").alias("id")), t.calls)


TERMS = "select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) as term from documents"


def terms(t):
    from graphloom.functions.text import tokens

    return t.documents.select("doc_id", F.explode(tokens(F.col("text"))).alias("term"))


@query("o_a20_idf", f"select term, count(distinct doc_id) as df, round(ln(((select count(*) from documents) - count(distinct doc_id) + 0.5::double) / (count(distinct doc_id) + 0.5::double) + 1), 6) as idf from ({TERMS}) group by term")
def _(t):
    return op.document_frequency(terms(t)).select("term", "df", r6("idf"))


@query("o_a21_term_frequency", f"select doc_id, term, count(*) as tf from ({TERMS}) group by 1, 2")
def _(t):
    return terms(t).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


@query("o_a22_best_of_n", "select user_id, event_id, value from (select *, row_number() over (partition by user_id order by value desc, event_id) as rn from events) where rn = 1")
def _(t):
    return op.best_of(t.events, ["user_id"], "value", "event_id").select("user_id", "event_id", "value")


@query("o_a23_preference_pairs", "select user_id, (array_agg(event_id order by value desc, event_id))[1] as chosen, max(value) as chosen_reward, (array_agg(event_id order by value, event_id))[1] as rejected, min(value) as rejected_reward from events group by 1")
def _(t):
    return op.preference_pairs(t.events.select("user_id", "event_id", "value"), "user_id", "value", "event_id")


@query("o_a24_reward_z", "select event_id, round((value - (select avg(value) from events)) / (select stddev_samp(value) from events), 6) as z from events")
def _(t):
    return op.standardized(t.events, "value").select("event_id", r6("z"))


@query("o_a25_masked_z", "with s as (select avg(value) as m, greatest(stddev_pop(value), 1e-8) as s from events where event_type <> 'view') select event_id, round((value - m) / s, 6) as z from events, s where event_type <> 'view'")
def _(t):
    return op.standardized(t.events.where("event_type <> 'view'"), "value", sample=False, floor=1e-8).select("event_id", r6("z"))


@query("o_a26_all_reduce", "select event_type, round(avg(value), 6) as mean, max(value) as max, round(sum(value), 4) as sum, count(*) as gathered from events group by 1")
def _(t):
    return t.events.groupBy("event_type").agg(r6(F.avg("value"), "mean"), F.max("value").alias("max"), F.round(F.sum("value"), 4).alias("sum"), F.size(F.collect_list("value")).cast("long").alias("gathered"))


@query("o_a27_masked_mean", "select vec_id, round(list_sum(list_transform(list_filter(embedding, lambda x, i: i % 3 = 0), lambda x: x::double)) / len(list_filter(embedding, lambda x, i: i % 3 = 0)), 6) as mean from embeddings")
def _(t):
    mask = F.transform("embedding", lambda x, i: ((i + 1) % 3 == 0).cast("int"))
    return t.embeddings.select("vec_id", r6(op.masked_mean(F.col("embedding"), mask), "mean"))


@query("o_a28_histogram", "with h as (select least(floor((value - 0.0) * 10 / 100.0), 9)::bigint as bin, count(*) as n from events where value between 0 and 100 group by 1) select bin, n, round(n * 10 / ((select sum(n) from h) * 100.0), 9) as density from h")
def _(t):
    return op.histogram(t.events, "value", 0.0, 100.0, 10).withColumn("density", F.round("density", 9))


@query("o_a29_pair_accuracy", "select round(avg(a), 6) as accuracy from (select event_id // 32 as batch, avg(case when value > user_id then 1 else 0 end) as a from events group by 1)")
def _(t):
    b = t.events.groupBy(F.floor(F.col("event_id") / 32).alias("batch")).agg(F.avg(F.when(F.col("value") > F.col("user_id"), 1).otherwise(0)).alias("a"))
    return b.agg(r6(F.avg("a"), "accuracy"))


@query("o_a30_referenced_groups", f"select a.s_nationkey::bigint as grp, string_agg(distinct b.s_nationkey::varchar, '|' order by b.s_nationkey::varchar) as targets from ({CALLS}) e join supplier a on a.s_suppkey = src join supplier b on b.s_suppkey = dst where a.s_nationkey <> b.s_nationkey group by 1")
def _(t):
    s = lambda c, g: t.supplier.select(F.col("s_suppkey").alias(c), F.col("s_nationkey").cast("string").alias(g))
    return op.referenced_groups(t.calls.join(s("src", "grp"), "src").join(s("dst", "target"), "dst"), "grp", "target").withColumn("grp", F.col("grp").cast("long"))


@query("o_a31_weighted_reward", "select event_id, round(0.5 * value + 0.25 * user_id, 6) as reward from events")
def _(t):
    return t.events.select("event_id", r6(op.weighted_reward(F.array(F.col("value"), F.col("user_id").cast("double"), F.lit(None).cast("double")), [0.5, 0.25, 2.0]), "reward"))


@query("o_a32_timings", "select round(sum(case when event_type = 'click' then value else 0 end), 4) as total, round(avg(case when event_type = 'click' then value else 0 end), 6) as mean from events")
def _(t):
    v = F.coalesce(F.when(F.col("event_type") == "click", F.col("value")), F.lit(0.0))
    return t.events.agg(F.round(F.sum(v), 4).alias("total"), r6(F.avg(v), "mean"))


@query("o_a33_votes", "with v as (select l_orderkey, l_linenumber, (l_quantity > 25)::int + (l_tax > l_discount)::int as a, (l_quantity < 25)::int + (l_tax < l_discount)::int as b from lineitem) select l_orderkey, l_linenumber, case when a > b then 'a' when b > a then 'b' else 'Tie' end as winner from v")
def _(t):
    return op.votes(t.lineitem.withColumn("q", F.lit(25.0)), [("l_quantity", "q"), ("l_tax", "l_discount")]).select("l_orderkey", "l_linenumber", "winner")


@query("o_a34_by_source", "select source, count(*) as units, sum(n_chars)::bigint as chars from documents group by 1")
def _(t):
    return t.documents.groupBy("source").agg(F.count("*").alias("units"), F.sum("n_chars").alias("chars"))


@query("o_a35_consolidate", "with e as (select user_id, event_id, case when event_type = 'purchase' then 'DEFINE' else 'USE' end as relation, event_type || event_id::varchar as description from events) select user_id, (array_agg(description order by (relation = 'DEFINE') desc, event_id))[1] as description, string_agg(description, '|' order by event_id) as candidates from e group by 1")
def _(t):
    e = t.events.select("user_id", "event_id", F.when(F.col("event_type") == "purchase", "DEFINE").otherwise("USE").alias("relation"), F.concat("event_type", "event_id").alias("description"))
    return op.consolidate(e, "user_id", "event_id")


@query("o_a36_qualitative", "select user_id, round(avg(value), 6) as score from events where event_type in ('click', 'purchase') group by 1")
def _(t):
    return t.events.where(F.col("event_type").isin("click", "purchase")).groupBy("user_id").agg(r6(F.avg("value"), "score"))


@query("o_a37_unit_means", "select c_custkey, round(coalesce(avg(o_totalprice), 0) + 1e-7::double, 2) as mean from customer left join orders on o_custkey = c_custkey group by 1")
def _(t):
    return t.customer.select("c_custkey").join(t.orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left").groupBy("c_custkey").agg(F.round(F.coalesce(F.avg("o_totalprice"), F.lit(0.0)) + 1e-7, 2).alias("mean"))


@query("o_a38_references", "select l_partkey, count(*) as refs, count(distinct l_suppkey) filter (where l_suppkey <> l_partkey) as files from lineitem group by 1")
def _(t):
    return t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("refs"), F.countDistinct(F.when(F.col("l_suppkey") != F.col("l_partkey"), F.col("l_suppkey"))).alias("files"))


@query("o_a39_side_by_side", "select user_id, round(avg(value) filter (where event_type = 'click'), 6) as click, round(avg(value) filter (where event_type = 'error'), 6) as error from events group by 1")
def _(t):
    return op.side_by_side(t.events, "user_id", "event_type", "value", ["click", "error"])
