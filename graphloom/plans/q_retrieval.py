"""Queries of retrieval. The flagship: graph-augmented retrieval over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import retrieval as op
from graphloom.operators.numbering import numbered
from graphloom.plans.base import RING, Registry
from graphloom.plans.q_sources import folder
from graphloom.sources.lexical_index import LexicalIndex
from graphloom.sources.pivot_table import PivotTable

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

_DOT = "list_sum(list_transform(list_zip({0}.embedding, {1}.embedding), lambda z: z[1]::double * z[2]::double))"
_NORM = "sqrt(list_sum(list_transform({0}.embedding, lambda x: x::double * x::double)))"
SCORED = f"select e.vec_id as id, e.label as graph, {_DOT.format('e', 'q')} / ({_NORM.format('e')} * {_NORM.format('q')}) as score from embeddings e, (select embedding from embeddings where vec_id = 0) q"


def rows(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("graph"), F.col("embedding").alias("vector"))


def vector(t, i=0):
    return [float(x) for x in t.embeddings.where(f"vec_id = {i}").select("embedding").first()[0]]  # one vector


def scored(t):
    return op.scored(rows(t), vector(t)).drop("vector")


def stored(t):
    return PivotTable(t.spark, folder(t, "vectors")).write(rows(t))


def rounded(d):
    return d.withColumn("score", F.round("score", 6))


R = "select id, graph, round(score, 6) as score from"


@query("o_k1_top_k", f"{R} ({SCORED}) where score >= 0.1 order by score desc, id limit 20")
def _(t):
    return rounded(op.top_k(scored(t), 20, 0.1))


@query("o_k1_stored_top_k", f"{R} ({SCORED}) where score >= 0.1 order by score desc, id limit 20")
def _(t):
    return rounded(stored(t).top_k(vector(t), 20, 0.1)).drop("vector")


@query("o_k3_limit_then_threshold", f"{R} (select * from ({SCORED}) order by score desc, id limit 30) where score > 0.2")
def _(t):
    return rounded(op.top_k_then_threshold(scored(t), 30, 0.2))


@query("o_k4_top_k_per_table", f"{R} (select *, row_number() over (partition by graph order by score desc, id) as rn from ({SCORED})) where rn <= 3")
def _(t):
    return rounded(op.top_k_per(scored(t), ["graph"], 3)).drop("rank")


@query("o_k5_typed_top_n", f"{R} ({SCORED}) where graph = 4 order by score desc, id limit 10")
def _(t):
    return rounded(op.top_k(scored(t).where("graph = 4"), 10))


@query("o_k6_merged_sort", f"select id, graph, round(score, 6) as score, row_number() over (order by score desc, id) as seq from (select *, row_number() over (partition by graph order by score desc, id) as rn from ({SCORED})) where rn <= 5")
def _(t):
    m = op.top_k_per(scored(t), ["graph"], 5).drop("rank")
    return rounded(numbered(m, [F.desc("score"), F.col("id")], "seq"))


@query("o_k9_ready_or_fewest", "select min(l_suppkey) as id from (select l_suppkey, count(*) as n from lineitem group by 1 qualify n = min(n) over ())")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n")).orderBy("n", "l_suppkey").limit(1).select(F.col("l_suppkey").alias("id"))


@query("o_j13_query_scores", f"{R} ({SCORED})")
def _(t):
    return rounded(scored(t))


BM25 = """with d as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') as x from documents), l as (select doc_id, len(x) as n, avg(len(x)) over () as mean from d),
  tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(x) as term from d) group by 1, 2), idf as (select term, ln(((select count(*) from (select distinct doc_id from tf)) - count(*) + 0.5::double) / (count(*) + 0.5::double) + 1) as idf from tf group by 1),
  q as (select item_id as query_id, term, count(*) as qf from (select item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) as term from benchmark) group by 1, 2),
  p as (select query_id, tf.doc_id, sum(qf * idf * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * n / mean))) as score from q join tf using (term) join idf using (term) join l on l.doc_id = tf.doc_id group by 1, 2),
  r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id desc)::int as rank from p)"""


def asked(t):
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


def ranked(t, k):
    return op.bm25(asked(t), t.documents.select("doc_id", "text"), k)


def indexed(t):
    return LexicalIndex(t.spark, folder(t, "lexical")).write(t.documents)


@query("o_k2_bm25_top", BM25 + " select query_id, doc_id, rank from r where rank <= 10")
def _(t):
    return ranked(t, 10).select("query_id", "doc_id", "rank")


@query("o_k2_stored_index", BM25 + " select query_id, doc_id, rank from r where rank <= 10")
def _(t):
    return indexed(t).search(asked(t), 10).select("query_id", "doc_id", "rank")


@query("o_s8_bm25_scores", BM25 + " select query_id, doc_id, round(score, 4) as score from r where rank <= 5")
def _(t):
    return ranked(t, 5).select("query_id", "doc_id", F.round("score", 4).alias("score"))


@query("o_j14_bm25_join", BM25 + " select query_id, count(*) as docs from p group by 1")
def _(t):
    return indexed(t).scores(asked(t)).groupBy("query_id").agg(F.count("*").alias("docs"))


@query("o_t11_bm25_pipeline", BM25 + " select doc_id, count(*) as queries, min(rank) as best from r where rank <= 20 group by 1")
def _(t):
    return indexed(t).search(asked(t), 20).groupBy("doc_id").agg(F.count("*").alias("queries"), F.min("rank").alias("best"))


@query("o_t5_entities_per_graph", f"{R} (select *, row_number() over (partition by graph order by score desc, id) as rn from ({SCORED})) where rn <= 10 and score > 0.2")
def _(t):
    return rounded(op.top_k_per(scored(t), ["graph"], 10).where("score > 0.2")).drop("rank")


RETRIEVE = f"""with recursive s as ({SCORED}), e as ({RING}), h as (select graph, id from (select *, row_number() over (partition by graph order by score desc, id) as rn from s) where rn <= 5 and score > 0.0),
  f as (select graph, id, 0 as depth from h union select f.graph, e.dst, f.depth + 1 from f join e on e.src = f.id where f.depth < 2),
  g as (select graph, id, min(depth) as depth from f group by 1, 2), r as (select *, row_number() over (partition by graph order by depth, id) as rn from g)
  select seq, graph, id, depth from (select *, row_number() over (order by rn, graph) as seq from r) where seq <= 100"""


@query("retrieve_flagship", RETRIEVE)
def _(t):
    return op.retrieve(rows(t), t.ring, vector(t), 5, 2, 100, 0.0)


@query("o_t6_retrieve", RETRIEVE.replace("<= 100", "<= 50"))
def _(t):
    return op.retrieve(rows(t), t.ring, vector(t), 5, 2, 50, 0.0)


@query("o_t7_units", f"select id, round(score, 6) as score from (select * from ({SCORED}) order by score desc, id limit 20) where score > 0.3")
def _(t):
    return rounded(op.top_k_then_threshold(scored(t), 20, 0.3)).select("id", "score")


DECOMPOSED = f"with s as (select e.vec_id as id, q.vec_id as q, {_DOT.format('e', 'q')} / ({_NORM.format('e')} * {_NORM.format('q')}) as score from embeddings e, (select vec_id, embedding from embeddings where vec_id in (0, 1, 2)) q), k as (select *, row_number() over (partition by q order by score desc, id) as rn from s) select id, round(max(score), 6) as score from k where rn <= 10 group by id"


def best_of_queries(found):
    out = None
    for part in found:
        out = part if out is None else out.union(part)
    return out.groupBy("id").agg(F.round(F.max("score"), 6).alias("score"))


@query("o_t8_decomposed", DECOMPOSED)
def _(t):
    return best_of_queries(op.top_k(op.scored(rows(t), vector(t, i)).drop("vector"), 10) for i in (0, 1, 2))


@query("o_t8_stored", DECOMPOSED)
def _(t):
    held = stored(t)
    return best_of_queries(held.top_k(vector(t, i), 10).drop("vector") for i in (0, 1, 2))


@query("o_t9_select_indices", "select pos, id from (select row_number() over (order by vec_id) as pos, vec_id as id from embeddings where label = 5) where pos in (1, 3, 4)")
def _(t):
    units = numbered(t.embeddings.where("label = 5").select(F.col("vec_id").alias("id")), ["id"], "pos")
    picked = t.spark.createDataFrame([(1,), (3,), (4,), (10**9,)], "pos long")  # what a selector named
    return units.join(F.broadcast(picked), "pos")


@query("o_t12_embedding_text", "select doc_id, 'What: ' || lang || chr(10) || 'How: ' || source as text from documents")
def _(t):
    return t.documents.select("doc_id", F.concat(F.lit("What: "), "lang", F.lit("\nHow: "), "source").alias("text"))


@query("o_t13_memory", f"{R} ({SCORED}) order by score desc, id limit 3")
def _(t):
    return rounded(op.top_k(scored(t), 3))


@query("o_t10_repository", "select source as name from (select source, min(doc_id) as seq from documents group by 1) order by contains('take src7 please', source) desc, seq limit 1")
def _(t):
    return op.choose_repository(t.documents.groupBy(F.col("source").alias("name")).agg(F.min("doc_id").alias("seq")), "take src7 please")
