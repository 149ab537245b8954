"""Queries of segmentation, streaming and plug-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import segment
from graphloom.plans import pipeline as pl
from graphloom.plans.base import Registry
from graphloom.plans.q_sources import folder
from graphloom.streaming import incremental as st
from graphloom.streaming import stateful
from graphloom.streaming.ledger import Ledger

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def marked(t):
    """Documents with headers put in."""
    return t.documents.select("doc_id", F.concat(F.lit("intro\n# A\n"), "source", F.lit("\n## B\nx\n```\n# no\n```\n# C\ny")).alias("text"))


@query("o_t1_sections", "select doc_id, unnest([0, 1, 2, 3])::bigint as ordinal, unnest(['', 'A', 'A/B', 'C']) as headers, unnest(['intro', '# A' || chr(10) || source, '## B' || chr(10) || 'x' || chr(10) || '```' || chr(10) || '# no' || chr(10) || '```', '# C' || chr(10) || 'y']) as content from documents")
def _(t):
    return segment.sections(marked(t))


@query("o_t2_recursive_split")
def _(t):
    return segment.recursive_split(t.documents.select("doc_id", "text"))


@query("o_t3_merge_small")
def _(t):
    return segment.merge_small(t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "content")))


@query("o_t4_chunk")
def _(t):
    return segment.chunk(t.documents.select("doc_id", "text"))


def in_parts(t, parts, run):
    """run(stream) after each part is added to a log: the query starts anew each time, and goes on from its checkpoint."""
    log = folder(t, "log")
    for rows in parts:
        rows.write.mode("append").json(log)
        run(st.read_log(t.spark, log, rows.schema.simpleString()[7:-1].replace(":", " ")))


@query("o_x1_incremental", "select o_orderkey from orders")
def _(t):
    out, ck = (folder(t, x) for x in ("done", "ck"))
    keys = t.orders.select("o_orderkey")
    in_parts(t, [keys.where("o_orderkey % 3 = 0"), keys.where("o_orderkey % 2 = 0 or o_orderkey % 3 <> 0")], lambda s: Ledger(t.spark, out, ["o_orderkey"], buckets=16).follow(s, ck, lambda d: d))
    return Ledger(t.spark, out, ["o_orderkey"], buckets=16).rows()


@query("o_x2_log_stream", "select event_type, count(*) as n from events group by 1")
def _(t):
    log, out, ck = (folder(t, x) for x in ("log", "copy", "ck"))
    t.events.select("event_id", "event_type").write.json(log)
    q = st.read_log(t.spark, log, "event_id long, event_type string").writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.schema("event_id long, event_type string").parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


@query("o_x3_sample_loop", "select user_id, count(*)::bigint as used, round(sum(value), 4)::double as reward from events group by 1")
def _(t):
    led, log = Ledger(t.spark, folder(t, "steps"), ["event_id"], buckets=8), folder(t, "updates")
    tasks = t.events.select("event_id", "user_id", "value")
    update = lambda buffer, step: buffer.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("r")).withColumn("step", F.lit(step)).write.mode("append").parquet(log)
    st.train_loop(tasks, led, "event_id", -(-tasks.count() // 3), lambda rows, step: rows, update)
    return t.spark.read.schema("user_id long, n long, r double").parquet(log).groupBy("user_id").agg(F.sum("n").alias("used"), F.round(F.sum("r"), 4).alias("reward"))


@query("o_x4_bounded_buffer", "select user_id, event_id from (select *, row_number() over (partition by user_id order by event_id desc) as rn from events) where rn <= 3")
def _(t):
    out, ck = (folder(t, x) for x in ("evicted", "ck"))
    rows = t.events.select("user_id", "event_id")
    in_parts(t, [rows.where(f"event_id % 2 = {k}") for k in range(2)], lambda s: stateful.run_to_end(stateful.newest_rows(s, "user_id", "event_id", 3), out, ck))
    return stateful.state_of(t.spark, ck, "buffer").select("user_id", "event_id")


@query("o_x5_controller_state", "select user_id, round(0.2::double * exp(sum(ln(1 + greatest(-0.2::double, least(0.2::double, value / 20.0::double - 1)) * 4 / 10000.0::double))), 6) as coefficient, count(value) as updates from events group by 1")
def _(t):
    out, ck = (folder(t, x) for x in ("steps", "ck"))
    rows = t.events.select("user_id", "value", "event_id")
    in_parts(t, [rows.where(f"event_id % 2 = {k}") for k in range(2)], lambda s: stateful.run_to_end(stateful.adaptive_controller(s, "user_id", "value", 0.2, 20.0, 10_000, 4), out, ck))
    return stateful.state_of(t.spark, ck, "controller").select("user_id", F.round("coefficient", 6).alias("coefficient"), "updates")


@query("o_x6_fill_batch", """with a as (select c_custkey as task_id, row_number() over (order by md5(c_custkey::varchar || ':0'), c_custkey) as rn from customer where coalesce(c_acctbal > 0, true)), k as (select task_id from a where rn <= (select max(x) from (select unnest(range(1, 65)) as x) where 64 % x = 0 and x <= least(64, (select count(*) from a)))),
  s as (select task_id, unnest(range(1, (64 / (select count(*) from k) + 1)::bigint)) as slot from k), h as (select o_custkey as task_id, o_orderkey as trajectory_id, row_number() over (partition by o_custkey order by o_orderkey) as slot from orders)
  select s.task_id, s.slot::int as slot, h.trajectory_id from s left join h on h.task_id = s.task_id and h.slot = s.slot""")
def _(t):
    tasks = t.customer.select(F.col("c_custkey").alias("task_id"), (F.col("c_acctbal") > 0).alias("status"))
    return st.fill_batch(tasks, t.orders.select(F.col("o_custkey").alias("task_id"), F.col("o_orderkey").alias("trajectory_id")), 64)


@query("o_x7_barrier", "select actor, seq, place // 100 as batch, place from (select user_id % 2 as actor, event_id as seq, row_number() over (order by user_id % 2, event_id) - 1 as place from events)")
def _(t):
    def run(batches, offset):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            place = np.arange(offset, offset + b.num_rows)
            offset += b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("actor"), b.column("seq"), pa.array(place // 100), pa.array(place)], ["actor", "seq", "batch", "place"])

    requests = t.events.select((F.col("user_id") % 2).alias("actor"), F.col("event_id").alias("seq"))
    return st.in_barrier(requests, 2, run, "actor long, seq long, batch long, place long")


@query("o_x8_resume_offset", "select event_id from events where event_id >= 500")
def _(t):
    from graphloom.operators.windows import strided_shard

    return strided_shard(t.events.select("event_id"), "event_id", 0, 1, 500).select("event_id")


@query("o_x9_token_accounting", "select user_id, event_id, sum(json_extract(props, '$.k')::bigint) over (partition by user_id order by event_id)::bigint as used from events")
def _(t):
    from pyspark.sql import Window as W

    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.select("user_id", "event_id", F.sum(k).over(W.partitionBy("user_id").orderBy("event_id")).alias("used"))


@query("o_x9_token_stream", "select user_id, event_id, sum(k) over (partition by user_id, part order by event_id)::bigint as used from (select *, json_extract(props, '$.k')::bigint as k, count(*) filter (where event_type = (select min(event_type) from events)) over (partition by user_id order by event_id) as part from events)")
def _(t):
    out, ck = (folder(t, x) for x in ("used", "ck"))
    first = t.events.agg(F.min("event_type")).first()[0]
    half = t.events.agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0]
    rows = t.events.select("user_id", "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), (F.col("event_type") == first).alias("again"))
    in_parts(t, [rows.where(F.col("event_id") <= half), rows.where(F.col("event_id") > half)], lambda s: stateful.run_to_end(stateful.running_totals(s, "user_id", "event_id", "k", "again"), out, ck))
    return t.spark.read.parquet(out)


def samples(t):
    return t.events.select(F.concat(F.lit("u"), "user_id").alias("input"), F.col("event_type").alias("output"), F.col("value").alias("reward"), F.col("event_id").alias("seq"))


@query("o_p1_steps", "select 'u' || user_id::varchar as input, max(value) as reward from events where value > 1.5 group by 1")
def _(t):
    steps = pl.Steps()
    steps.register("keep")(lambda d, least, **_: d.where(F.col("reward") > least))
    steps.register("best")(lambda d, **_: d.groupBy("input").agg(F.max("reward").alias("reward")))
    return steps.run([{"name": "keep", "input": "rows", "output": "kept", "least": 1.5}, {"name": "best", "input": "kept", "output": "out"}], {"rows": samples(t)}, {"least": 0.0})["out"]


@query("o_p2_processor_rs", "select 'u' || user_id::varchar as input, max(value) as reward from events group by 1")
def _(t):
    return pl.PROCESSORS["rs"](samples(t)).select("input", "reward")


@query("o_p2_processor_csft", "select 'u' || user_id::varchar || ' <reward>' || printf('%.2f', value) as input, event_id as seq from events")
def _(t):
    return pl.PROCESSORS["csft"](samples(t)).select("input", "seq")


@query("o_p2_processor_iter_dpo", "select 'u' || user_id::varchar as input, max(value) as chosen_reward, min(value) as rejected_reward from events group by 1")
def _(t):
    return pl.PROCESSORS["iter_dpo"](samples(t)).select("input", "chosen_reward", "rejected_reward")


@query("o_p3_scorer", "select event_id as seq, length(event_type)::double as reward from events")
def _(t):
    return samples(t).select("seq", pl.scorer(lambda p, c: [float(len(x)) for x in c], F.col("input"), F.col("output")).alias("reward"))


@query("o_p4_weighted_scorers", "select event_id as seq, round(0.5 * value + 2 * length(event_type), 6) as reward from events")
def _(t):
    return samples(t).select("seq", F.round(pl.weighted_scores([(F.col("reward"), 0.5), (F.length("output").cast("double"), 2.0)]), 6).alias("reward"))


@query("o_p7_extractor", "select p_partkey, upper(p_name) as name, length(p_name)::bigint as n from part")
def _(t):
    return t.part.select("p_partkey", pl.extractor(lambda x: {"name": x.upper(), "n": len(x)}, "name string, n long", F.col("p_name")).alias("e")).select("p_partkey", "e.name", "e.n")


@query("o_p8_cached_map", "select distinct md5(p_name) as key, case when p_name like 'r%' then 'cached' else p_name end as value from part")
def _(t):
    cache = t.part.where("p_name like 'r%'").select(F.md5("p_name").alias("key"), F.lit("cached").alias("value")).distinct()
    return pl.cached_map(t.part, cache, "p_name", lambda d: d.withColumn("value", F.col("p_name")))


@query("o_p9_one_to_many", "select p_partkey, unnest(string_split(p_name, ' ')) as word from part")
def _(t):
    return pl.explode_extracted(t.part.select("p_partkey", "p_name"), lambda x: [{"word": w} for w in x.split(" ")], "word: string", "p_name").select("p_partkey", "word")


@query("o_p5_tools", "select p_partkey as id, p_name as name from part where p_type = 'ECONOMY'")
def _(t):
    tools = pl.Tools()
    tools.register("by_type", type=(str, True))(lambda d, type: d.where(F.col("type") == type).select("id", "name"))
    return tools.call("by_type", t.nodes, type="ECONOMY")
