"""The registered queries of this subpackage: thin, whole-table applications of its operators."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import documents, scratch


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.token_files import token_records

    return token_records(documents(spark, sf_dir), tokenizer_file())


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.token_counts import token_counts

    return token_counts(documents(spark, sf_dir), tokenizer_file(), limit=1024)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.packing import pack_documents

    return pack_documents(documents(spark, sf_dir), tokenizer_file(), limit=1024)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.simhash import simhash_components

    return simhash_components(documents(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.line_dedup import ADDED, dedup_lines

    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = dedup_lines(docs, scratch(spark, "lines"), min_docs=5, min_chars=40)
    return out.select("doc_id", *(F.col(c).alias(c[2:]) for c in ADDED))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.chat import chat_digests

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat_digests(rows.unionByName(more), tokenizer_file())


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.sharding import balanced_shards

    return balanced_shards(documents(spark, sf_dir), n_shards=40)


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.decontaminate import benchmark_overlaps

    return benchmark_overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.url_filter import filter_urls

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.quality import FEATURES, quality_rules

    out = quality_rules(documents(spark, sf_dir).select("doc_id", "lang", "text"), ["doc_id"])
    return out.select("doc_id", *(F.col(f"__{c}").alias(c) for c in (*FEATURES, "base_failed", "kept")))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.lexical import ranked_search

    return ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=20)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.alignment import align_tokenizers

    return align_tokenizers(documents(spark, sf_dir), tokenizer_file(), tokenizer_file("piece_bpe_32k.model"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.mixing import mix_sources

    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_token_counts": op2_token_counts,
    "op3_packing": op3_packing,
    "op4_simhash": op4_simhash,
    "op5_line_dedup": op5_line_dedup,
    "op6_chat": op6_chat,
    "op7_sharding": op7_sharding,
    "op8_decontaminate": op8_decontaminate,
    "op9_url_filter": op9_url_filter,
    "op10_quality": op10_quality,
    "op11_ranked_search": op11_ranked_search,
    "op12_alignment": op12_alignment,
    "op13_mixing": op13_mixing,
}

_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: Escaping as in chat.py: a backslash after the first character of each control string.
_ESCAPED = """
regexp_replace(regexp_replace({0},
  '<(\\\\*(?:\\|turn\\|>|\\|body\\|>|\\|end\\|>|\\|endoftext\\|>|\\|im_start\\|>|\\|im_end\\|>|s>|/s>|<SYS>>|</SYS>>))', '<\\\\\\1', 'g'),
  '\\[(\\\\*(?:INST\\]|/INST\\]))', '[\\\\\\1', 'g')
"""



def _url_filter_sql(order: int = 4, folds: int = 5, alphabet: int = 128) -> str:
    """The rules and the Markov models of url_filter.py in SQL."""
    ranked = sorted(URL_RULES, key=lambda x: (-len(x[1]), x[0] != "block", x[1]))
    fits = [(v, r, "(host = '{0}' or ends_with(host, '.{0}')) and starts_with(path, '/{1}')".format(*r.split("/", 1))) for v, r in ranked]
    rule = "case " + " ".join(f"when {f} then '{r}'" for _, r, f in fits) + " end"
    by_rule = "case " + " ".join(f"when {f} then '{v}'" for v, _, f in fits) + " end"
    gram = f"select url, by_rule, held, substr(repeat(chr(2), {order}) || url, pos, {order + 1}) as gram from (select *, unnest(range(1, length(url) + 1)) as pos from urls)"
    levels = f"p_0 as (select distinct gram, {1 / alphabet}::double as a, {1 / alphabet}::double as r from judged)"
    for k in range(order + 1):
        p = lambda c: f"case when coalesce(h.n_{c}, 0) > 0 then (coalesce(s.{c}, 0) + h.t_{c} * p.{c}) / (h.n_{c} + h.t_{c}) else p.{c} end as {c}"
        levels += f""",
  s_{k} as (select right(gram, {k + 1}) as g, sum(a)::double as a, sum(r)::double as r from counts group by 1),
  h_{k} as (select left(g, length(g) - 1) as h, sum(a) as n_a, sum(r) as n_r, count(*) filter (where a > 0) as t_a, count(*) filter (where r > 0) as t_r from s_{k} group by 1),
  p_{k + 1} as (select p.gram, {p("a")}, {p("r")} from p_{k} p left join s_{k} s on s.g = right(p.gram, {k + 1}) left join h_{k} h on h.h = left(right(p.gram, {k + 1}), {k}))"""
    return f"""
with split as (select page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
  ruled as (select *, {rule} as rule, {by_rule} as by_rule from split),
  urls as (select distinct url, by_rule, ('0x' || substr(md5(url), 1, 8))::bigint % {folds} = 0 as held from ruled where contains(url, '://')),
  grams as materialized ({gram}),
  counts as (select gram, count(*) filter (where by_rule = 'allow') as a, count(*) filter (where by_rule = 'block') as r from grams where by_rule is not null and not held group by 1),
  judged as (select * from grams where by_rule is null or held),
  {levels},
  scores as (select url, any_value(by_rule) as by_rule, avg(ln(p.a) - ln(p.r)) as score from judged join p_{order + 1} p using (gram) group by 1),
  spread as (select avg(score) filter (where by_rule = 'allow') as ma, avg(score) filter (where by_rule = 'block') as mr, coalesce(stddev_pop(score) filter (where by_rule = 'allow'), 0) + 1e-6 as sa,
    coalesce(stddev_pop(score) filter (where by_rule = 'block'), 0) + 1e-6 as sr from scores)
select page_id, host, path, rule, coalesce(r.by_rule, case when s.score < (select (ma * sr + mr * sa) / (sa + sr) from spread) then 'block' else 'allow' end) as verdict
from ruled r left join scores s on s.url = r.url and r.by_rule is null
"""


def _ranked_search_sql(k: int = 20) -> str:
    """Every document's score for every item, from all terms."""
    terms = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"
    return f"""
with words as (select doc_id, {terms.replace(chr(92) * 2, chr(92))} as term from documents where doc_id is not null),
  tf as (select doc_id, term, count(*) as tf from words group by all),
  sizes as (select doc_id, count(*) as n from words group by all),
  stat as (select count(*)::bigint as n_docs, sum(n)::bigint as l from sizes),
  m as (select doc_id, 75 + (25 * n * n_docs) // l as m from sizes, stat),
  w as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)))::bigint as w from tf, stat group by term, n_docs),
  items as (select item_id, term, count(*) as times from (select item_id, {terms.replace(chr(92) * 2, chr(92))} as term from (select distinct item_id, text from benchmark where item_id is not null)) group by all),
  scores as (select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score from items join w using (term) join tf using (term) join m using (doc_id) group by all),
  ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from scores where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= {k}
"""


ORACLES: dict[str, str] = {
    "op11_ranked_search": _ranked_search_sql(),
    "op9_url_filter": _url_filter_sql(),
    "op6_chat": f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + 23)::bigint as formatted_chars
from rows group by conv_id
""",
    "op5_line_dedup": f"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
keyed as (
  select *, translate(trim(line, {_WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
hot as (
  select key, max(doc_id) as keeper from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
marked as (
  select k.*, h.key is not null and k.doc_id <> h.keeper as gone from keyed k left join hot h on k.key = h.key)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
""",
}
