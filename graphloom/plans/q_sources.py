"""Queries of sources and sinks: what is read is first written to the checkpoint folder, from the tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from graphloom.operators.joins import last_per
from graphloom.plans.base import CALLS, Registry
from graphloom.sources import files as io

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def folder(t, name):
    base = t.spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.gettempdir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("o_i1_markdown", "select source, doc_id, md5(text) as digest from documents")
def _(t):
    at = folder(t, "md")  # a folder a source, with at most 128 documents in a file, parted by a control character
    rows = t.documents.select("source", F.concat(F.col("doc_id").cast("string"), F.lit(":"), "text").alias("value"))
    rows.hint("rebalance", "source").write.partitionBy("source").option("maxRecordsPerFile", 128).option("lineSep", "\x03").text(at)
    d = io.read_markdown(t.spark, at, "*.txt").select(F.replace("source", F.lit("source="), F.lit("")).alias("source"), F.explode(F.split("content", "\x03")).alias("doc")).where("doc <> ''")
    return d.select("source", F.regexp_extract("doc", "^(\\d+):", 1).cast("long").alias("doc_id"), F.md5(F.regexp_replace("doc", "^\\d+:", "")).alias("digest"))


@query("o_i2_scan_files")
def _(t):
    return io.list_files(t.spark, t.dir, [".parquet"]).select("name", "length")


@query("o_i3_scan_excluding")
def _(t):
    return io.without_names(io.list_files(t.spark, t.dir, [".parquet"]), ["lineitem.parquet"]).select("name")


@query("o_i4_folders")
def _(t):
    return io.within_depth(io.list_files(t.spark, t.dir), t.dir, 2).select("name", "folder", "depth")


def events_json(t, corrupt=False):
    at = folder(t, "jsonl")
    rows = t.events.select(F.to_json(F.struct("event_id", "value")).alias("value"))
    if corrupt:
        rows = rows.union(t.benchmark.select(F.concat(F.lit("{broken "), F.col("item_id").cast("string")).alias("value")))
    rows.union(t.benchmark.select(F.lit("").alias("value"))).write.text(at)
    return at


@query("o_i5_jsonl", "select event_id, value from events")
def _(t):
    return io.read_jsonl(t.spark, events_json(t), "event_id long, value double")


@query("o_i6_corrupt_jsonl", "select event_id, value from events")
def _(t):
    return io.read_jsonl(t.spark, events_json(t, corrupt=True), "event_id long, value double")


@query("o_i7_result_files")
def _(t):
    return io.result_files(io.list_files(t.spark, t.dir), [".parquet"], ["item"], ["part", "order", "nation"]).select("name")


@query("o_i8_dual_shape", "select case when user_id % 2 = 0 then 'even' else 'unknown' end as test_type, event_id from events")
def _(t):
    at = folder(t, "results")
    even = (F.col("user_id") % 2 == 0).alias("even")  # a file holds the events of one parity in a run of 2000 ids
    r = t.events.groupBy(even, F.floor(F.col("event_id") / 2000).alias("run")).agg(F.to_json(F.collect_list(F.struct("event_id"))).alias("r"))
    shape = F.when(F.col("even"), F.concat(F.lit('{"metadata":{"test_type":"even"},"results":'), "r", F.lit("}"))).otherwise(F.col("r"))
    r.select(shape.alias("value")).write.option("maxRecordsPerFile", 1).text(at)
    return io.read_results(t.spark, at, "event_id: bigint").select("test_type", "result.event_id")


@query("o_i9_yaml", "select 'item ' || item_id::varchar as query, text as ground_truth, length(text)::varchar as end_line from benchmark")
def _(t):
    at = folder(t, "yaml")
    block = F.concat(F.lit("    "), F.replace("text", F.lit("\n"), F.lit("\n    ")))
    rows = t.benchmark.select(F.concat(F.lit("- query: 'item "), "item_id", F.lit("'\n  end_line: "), F.length("text"), F.lit("\n  ground_truth: |\n"), block).alias("value"))
    rows.repartition(4).write.option("lineSep", "\n").text(at)
    t.spark.dataSource.register(io.YamlSource)
    parts = [r["path"] for r in io.list_files(t.spark, at, [".txt"]).select("path").collect()]
    d = t.spark.read.format("yaml_cases").option("path", ",".join(parts)).load()
    return d.select(*(F.col("case")[c].alias(c) for c in ("query", "ground_truth", "end_line")))


def graph_json(t, u, v):
    nodes = t.part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_type").alias("type"), F.col("p_name").alias("label"), F.lit(None).cast("string").alias("body"))
    e = t.calls.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "type")
    n, m = io.graph_to_json(nodes, e, u, v)
    whole = n.select(F.concat(F.lit('{"nodes":['), "value", F.lit('],"edges":[]}')).alias("g")).union(m.select(F.concat(F.lit('{"nodes":[],"edges":['), "value", F.lit("]}"))))
    at = folder(t, "graph")
    whole.write.text(at)
    return io.graph_of_json(t.spark.read.text(at), "value", u, v)


@query("o_i10_graph_json", f"select src::varchar as src, dst::varchar as dst, type from ({CALLS})")
def _(t):
    return graph_json(t, "u", "v")[1]


@query("o_i11_graph_json_nodes", "select p_partkey::varchar as id, p_type as type, p_name as label from part")
def _(t):
    return graph_json(t, "source", "target")[0].drop("body")


@query("o_i12_step_storage", "select label, count(*) as n from embeddings group by 1")
def _(t):
    at = folder(t, "step")
    t.embeddings.groupBy("label").agg(F.count("*").alias("n")).write.parquet(at)
    return t.spark.read.parquet(at)


@query("o_i13_graphml", f"select distinct src::varchar as src, dst::varchar as dst from ({CALLS})")
def _(t):
    at = folder(t, "graphml")
    io.write_graphml(t.part.select(F.col("p_partkey").alias("id")), t.calls.select("src", "dst").distinct(), at)
    return io.read_graphml(t.spark, at)[1].select("src", "dst")


@query("o_i14_gexf", f"select distinct src::varchar as src, dst::varchar as dst from ({CALLS})")
def _(t):
    at = folder(t, "gexf")
    io.write_gexf(t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label")), t.calls.select("src", "dst").distinct(), at)
    return io.read_graphml(t.spark, at)[1].select("src", "dst")


@query("o_i18_paged", "select page_id as id, url as title from pages where page_id % 7 <> 0")
def _(t):
    path = f"{t.dir}/pages.parquet"

    def fetch(page, size):  # stands for a remote interface, a page a call
        import pyarrow.dataset as ds

        at = ds.field("page_id")
        rows = ds.dataset(path).to_table(columns=["page_id", "url"], filter=(at >= (page - 1) * size) & (at < page * size)).sort_by("page_id").to_pylist()
        return [{"id": r["page_id"], "title": r["url"]} | ({"pull_request": {}} if r["page_id"] % 7 == 0 else {}) for r in rows]

    return io.read_issues(t.spark, fetch, 100)


@query("o_i15_vector_overwrite", "select vec_id as id, label as graph from embeddings where label <> 3")
def _(t):
    at = folder(t, "vectors")
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("graph"), F.lit("Entity").alias("class_name"), F.when(F.col("label") != 3, F.col("embedding")).alias("vector"))
    io.write_vectors(rows, at)
    io.write_vectors(rows, at)
    return t.spark.read.parquet(at).select("id", "graph")


@query("o_i16_vector_append", "select vec_id as id from embeddings union all select vec_id from embeddings where vec_id % 2 = 0")
def _(t):
    at = folder(t, "vectors")
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("graph"), F.lit("Entity").alias("class_name"), F.col("embedding").alias("vector"))
    io.write_vectors(rows, at, "append")
    io.write_vectors(rows.where("id % 2 = 0"), at, "append")
    return t.spark.read.parquet(at).select("id")


@query("o_i17_by_extension", "select item_id, text from benchmark")
def _(t):
    at = folder(t, "csv")
    t.benchmark.write.option("header", True).option("multiLine", True).option("escape", '"').csv(at)
    return t.spark.read.schema("item_id long, text string").option("header", True).option("multiLine", True).option("escape", '"').csv(at)


@query("o_i19_sharded_write", "select event_id from events where event_id % 4 < 2")
def _(t):
    at = folder(t, "ranks")
    for rank in range(2):
        t.events.where(f"event_id % 4 = {rank}").select("event_id").write.json(f"{at}/rank={rank}")
    return t.spark.read.schema("event_id long").json(f"{at}/rank=*")


@query("o_i20_table_sinks")
def _(t):
    rows = [r.asDict() for r in t.events.groupBy("event_type").agg(F.count("*").alias("n")).orderBy("event_type").limit(20).collect()]
    return t.spark.createDataFrame([("markdown", io.markdown_table(rows, ["event_type", "n"])), ("latex", io.latex_table(rows, ["event_type", "n"]))], "format string, text string")


@query("o_i21_action_log", "select event_id, event_type from events")
def _(t):
    at = folder(t, "log")
    for k in range(2):
        t.events.where(f"event_id % 2 = {k}").select("event_id", "event_type").write.mode("append").json(at)
    return t.spark.read.schema("event_id long, event_type string").json(at)


@query("o_i22_sidecar", "select user_id, max(event_id) as event_id from events group by 1")
def _(t):
    from graphloom.sources.keyed_table import KeyedTable

    table, rows = KeyedTable(t.spark, folder(t, "sidecar"), "user_id", "event_id", buckets=8), t.events.select("user_id", "event_id")
    for part in (rows.where("event_id % 3 <> 0"), rows.where("event_id % 3 = 0")):
        table.upsert(part)
    return table.rows()


@query("o_i24_cache_misses", "select doc_id from documents where md5(text) not in (select md5(text) from documents where doc_id % 3 = 0)")
def _(t):
    return io.cache_misses(t.documents, t.documents.where("doc_id % 3 = 0").select(F.md5("text").alias("key")).distinct(), "text").select("doc_id")


@query("o_i25_file_digests")
def _(t):
    return io.file_digests(t.spark, f"{t.dir}/nation.parquet").select("md5")


@query("o_i26_answered", "select p_partkey, p_type as label from part where p_size > 10")
def _(t):
    rows = t.part.select("p_partkey", F.col("p_name").alias("question"), F.when(F.col("p_size") > 10, F.concat(F.lit("so #### "), "p_type")).otherwise(F.col("p_name")).alias("answer"))
    return io.answered(rows).select("p_partkey", "label")


@query("o_i27_as_strings")
def _(t):
    return t.part.select("p_partkey", io.as_strings(F.struct("p_name", "p_size")).alias("json"))


@query("o_i28_resume", "select o_orderkey, o_custkey from orders")
def _(t):
    from graphloom.streaming.ledger import Ledger

    at, rows = folder(t, "bodies"), t.orders.select("o_orderkey", "o_custkey")
    for part in (rows.where("o_orderkey % 3 = 0"), rows):  # what is done comes from what the first run has stored
        Ledger(t.spark, at, ["o_orderkey"], buckets=16, format="json").process(part, lambda d: d)
    return Ledger(t.spark, at, ["o_orderkey"], buckets=16, format="json").rows()
