"""Queries of text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.functions.vectors import cosine, dot
from graphloom.plans.base import Registry

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
c = F.col
r6 = lambda x, n: F.round(x, 6).alias(n)
J = lambda a: F.array_join(a, "|")


@query("o_s1_tokens", "select doc_id, len(t) as n, md5(array_to_string(t, '|')) as tokens from (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') as t from documents)")
def _(t):
    k = tx.tokens(c("text"))
    return t.documents.select("doc_id", F.size(k).cast("long").alias("n"), F.md5(J(k)).alias("tokens"))


@query("o_s2_name_tokens", "with n as (select p_partkey, replace(lower(p_name), ' ', '_') as x from part), s as (select *, list_filter(string_split(x, '_'), lambda y: y <> '') as p from n) select p_partkey, array_to_string(case when list_contains(p, x) then p else list_append(p, x) end, '|') as tokens from s")
def _(t):
    return t.part.select("p_partkey", J(tx.name_tokens(F.replace("p_name", F.lit(" "), F.lit("_")))).alias("tokens"))


@query("o_s3_identifier_tokens")
def _(t):
    return t.part.select("p_partkey", J(tx.identifier_tokens(F.concat(F.lit("getHTTPValue_"), F.initcap("p_type"), F.lit("2for")))).alias("tokens"))


# Counted by hand: class A, its f and struct B; h and struct B.
@query("o_s4_declarations", "select p_partkey, (case when p_size > 25 then 3 else 2 end)::bigint as n from part")
def _(t):
    code = F.concat(F.when(c("p_size") > 25, "class A { /* class Z */ int/*x*/f(int a) const; };").otherwise("// enum Q\n void g() {} int h();"), F.lit(" struct B {}; // "), "p_name")
    return t.part.select("p_partkey", tx.declaration_count(code).cast("long").alias("n"))


@query("o_s5_naming_consistency")
def _(t):
    body = F.concat(F.lit("int "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(" = get"), F.initcap(F.split_part("p_name", F.lit(" "), F.lit(1))), F.lit("(x, "), F.replace("p_type", F.lit(" "), F.lit("_")), F.lit(");"))
    return t.part.select("p_partkey", r6(tx.naming_consistency(body), "consistency"))


_COS = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: z[1]::double * z[2]::double))"
_NORM = "sqrt(list_sum(list_transform({0}.embedding, lambda x: x::double * x::double)))"


@query("o_s6_cosine", f"select e.vec_id, round({_COS} / ({_NORM.format('e')} * {_NORM.format('q')}), 6) as cosine from embeddings e, (select embedding from embeddings where vec_id = 0) q")
def _(t):
    q = t.embeddings.where("vec_id = 0").select(c("embedding").alias("q"), F.lit(1).alias("one"))
    return t.embeddings.withColumn("one", F.lit(1)).join(F.broadcast(q), "one").select("vec_id", r6(cosine(c("embedding"), c("q")), "cosine"))


@query("o_s7_dot", f"select e.vec_id, round({_COS}, 6) as dot from embeddings e, (select embedding from embeddings where vec_id = 1) q")
def _(t):
    q = t.embeddings.where("vec_id = 1").select(c("embedding").alias("q"), F.lit(1).alias("one"))
    return t.embeddings.withColumn("one", F.lit(1)).join(F.broadcast(q), "one").select("vec_id", r6(dot(c("embedding"), c("q")), "dot"))


@query("o_s9_signatures")
def _(t):
    return t.part.select("p_partkey", tx.normalize_signature_udf(F.concat(F.lit("f(const std::map<int, int>& m, int n = 3, void (*cb)(int a), "), "p_type", F.lit(" x)"))).alias("signature"))


@query("o_s10_base_name", "select distinct split_part(p_name || '(' || p_type, '(', 1) as name from part")
def _(t):
    return t.part.select(tx.base_name(F.concat("p_name", F.lit("("), "p_type")).alias("name")).distinct()


@query("o_s11_declaration_only", "select doc_id, trim(text) = '' or (trim(text) like '%;' and not contains(text, '{')) or (len(list_filter(string_split(trim(text), chr(10)), lambda x: trim(x) <> '' and not starts_with(trim(x), '//'))) <= 1 and not contains(text, '{')) as only from documents")
def _(t):
    from graphloom.operators.filters import is_declaration

    return t.documents.select("doc_id", is_declaration(c("text")).alias("only"))


@query("o_s12_node_ids", "select p_partkey, 'func:src/' || p_brand || ':' || p_name as rel, 'func:' || substr(md5('func:src/' || p_brand || ':' || p_name), 1, 8) as hashed, 'func:' || p_brand || ':' || p_name as smart from part")
def _(t):
    k = lambda s: tx.node_id(F.lit("func"), c("p_name"), F.concat(F.lit("src/"), "p_brand"), s)
    return t.part.select("p_partkey", k("relative").alias("rel"), k("hash").alias("hashed"), k("smart").alias("smart"))


@query("o_s13_paths", "select page_id, regexp_replace(regexp_extract(url, '[^/]*$'), '[.][^.]*$', '') as stem, regexp_replace(url, '/?[^/]*$', '') as parent, regexp_extract(url, '[^/]*$') as base from pages")
def _(t):
    return t.pages.select("page_id", tx.stem(c("url")).alias("stem"), tx.parent(c("url")).alias("parent"), F.substring_index("url", "/", -1).alias("base"))


@query("o_s14_path_of_id", "select p_partkey, 'a/' || p_brand as path from part")
def _(t):
    return t.part.select("p_partkey", tx.path_of_id(F.concat(F.lit("func:a/"), "p_brand", F.lit(":"), "p_name")).alias("path"))


@query("o_s15_outline", "select p_partkey, unnest([p_name, 'Thing']) as name, unnest([case when p_size > 20 then 'Function' else 'Variable' end, 'Struct']) as kind from part")
def _(t):
    o = F.concat("p_name", F.lit(" ("), F.when(c("p_size") > 20, "Function").otherwise("Variable"), F.lit(")\nno match\n  Thing (Struct)"))
    return t.part.select("p_partkey", F.inline(tx.outline(o)))


@query("o_s16_kinds", "select p_brand, string_agg(p_name, '|' order by p_name) filter (where p_size > 20) as functions, string_agg(p_name, '|' order by p_name) filter (where p_size <= 20) as variables from part group by 1")
def _(t):
    pick = lambda w, n: F.nullif(J(F.array_sort(F.collect_list(F.when(w, c("p_name"))))), F.lit("")).alias(n)
    return t.part.groupBy("p_brand").agg(pick(c("p_size") > 20, "functions"), pick(c("p_size") <= 20, "variables"))


@query("o_s17_clean", "select p_partkey, 'a & <' || p_name || '>' as text from part")
def _(t):
    return t.part.select("p_partkey", tx.unescape_udf(F.concat(F.lit(' "a &amp; &lt;'), "p_name", F.lit('&gt;\x01" '))).alias("text"))


@query("o_s18_strip_control", "select doc_id, md5(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')) as text from documents")
def _(t):
    return t.documents.select("doc_id", F.md5(tx.strip_control(c("text"))).alias("text"))


@query("o_s19_entities", "select p_partkey, upper(p_name) as name, 'CODE' as kind, upper(p_type) as type, 'DEFINE' as relation, 'd ' || replace(p_brand, '#', '_') as description from part union all select p_partkey, 'X', 'SEMANTIC', 'Y', 'USE', 'z' from part")
def _(t):
    rec = F.concat(F.lit("("), "p_name", F.lit("<|>code<|>"), "p_type", F.lit("<|>define<|>d "), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit(")## (x <|>semantic<|>y<|>use<|>z)##(too<|>short)##(a<|>other<|>b<|>c<|>d)<END>"))
    return t.part.select("p_partkey", F.inline(tx.entities(rec)))


@query("o_s20_relations", "select p_partkey, upper(p_name) as source, 'USE' as relationship, upper(p_type) as target from part")
def _(t):
    return t.part.select("p_partkey", F.inline(tx.relations(F.concat(F.lit("("), "p_name", F.lit("<|>use<|>"), "p_type", F.lit(")##(a<|>b)")))))


@query("o_s21_summary", "select p_partkey, case when p_size > 20 then p_type else '' end as type, case when p_size > 20 then p_name || ': more' else p_name end as description from part")
def _(t):
    s = tx.summary(F.when(c("p_size") > 20, F.concat("p_type", F.lit(": "), "p_name", F.lit(": more"))).otherwise(c("p_name")))
    return t.part.select("p_partkey", s.alias("s")).select("p_partkey", "s.type", "s.description")


@query("o_s22_code_blocks", "select p_partkey, p_name || chr(10) as last, 2 as n from part")
def _(t):
    x = F.concat(F.lit("text\n```cpp\na\n```\nmore\n```cpp\n"), "p_name", F.lit("\n```"))
    return t.part.select("p_partkey", tx.last_block(x, "cpp").alias("last"), F.size(tx.code_blocks(x)).alias("n"))


@query("o_s23_repair_json")
def _(t):
    return t.events.select("event_id", tx.repair_json_udf(F.replace("props", F.lit('"'), F.lit("'"))).alias("json"))


@query("o_s24_literal_blocks")
def _(t):
    return t.part.select("p_partkey", tx.literal_blocks_udf(F.concat(F.lit("code: |\n```cpp\nint "), "p_name", F.lit(";\n```\nnext: 1"))).alias("yaml"))


@query("o_s25_thoughts", "select p_partkey, p_name as content, case when p_size > 20 then p_type else '' end as reasoning from part")
def _(t):
    s = tx.split_thoughts(F.when(c("p_size") > 20, F.concat(F.lit("<think>"), "p_type", F.lit("</think>\n"), "p_name")).otherwise(c("p_name")))
    return t.part.select("p_partkey", s.alias("s")).select("p_partkey", "s.content", "s.reasoning")


RESPONSE = "case p_size % 4 when 0 then '<think>a</think><answer>' || p_type || '</answer>' when 1 then '<think>a</think>' when 2 then '<think>a</think>' || chr(10) || '<answer> x </answer>' else '<answer>' || p_type || '</answer><answer>' end"


def response():
    m = c("p_size") % 4
    return F.when(m == 0, F.concat(F.lit("<think>a</think><answer>"), "p_type", F.lit("</answer>"))).when(m == 1, "<think>a</think>").when(m == 2, "<think>a</think>\n<answer> x </answer>").otherwise(F.concat(F.lit("<answer>"), "p_type", F.lit("</answer><answer>")))


@query("o_s26_tag_reward", "select p_partkey, case p_size % 4 when 0 then 1.0 when 1 then 0.5 when 2 then 1.0 else 0.25 end::double as reward from part")
def _(t):
    return t.part.select("p_partkey", tx.tag_reward(response(), ["<think>", "</think>", "<answer>", "</answer>"]).alias("reward"))


@query("o_s27_format_reward", f"select p_partkey, case when regexp_full_match({RESPONSE}, '(?s)\\s*<think>.*?</think>\\s*<answer>.*?</answer>\\s*') then 1.0 else 0.0 end::double as reward from part")
def _(t):
    return t.part.select("p_partkey", tx.format_reward(response()).alias("reward"))


@query("o_s28_accuracy_reward", f"select p_partkey, case when trim(regexp_extract({RESPONSE}, '(?s)<answer>(.*?)</answer>', 1)) = p_type then 2.0 else 0.0 end::double as reward from part")
def _(t):
    return t.part.select("p_partkey", tx.accuracy_reward(response(), c("p_type")).alias("reward"))


@query("o_s29_json_block", "select event_id, json_extract(props, '$.k')::bigint as k from events")
def _(t):
    return t.events.select("event_id", tx.single_json_block(F.concat(F.lit("call\n```json\n"), "props", F.lit("\n```\n")), "k long")["k"].alias("k"))


@query("o_s30_final_answer", "select p_partkey, case when p_size > 10 then p_name end as answer from part")
def _(t):
    return t.part.select("p_partkey", tx.final_answer(F.when(c("p_size") > 10, F.concat(F.lit("so #### "), "p_name", F.lit(" "))).otherwise(c("p_name"))).alias("answer"))


@query("o_s31_word_count", "select doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+'))::int as n from documents")
def _(t):
    return t.documents.select("doc_id", tx.word_count(c("text")).alias("n"))


@query("o_s32_unit_text", "select doc_id, md5(source || chr(10) || lang || '/' || source || chr(10) || text) as text from documents")
def _(t):
    m = F.create_map(F.lit("Header 1"), "lang", F.lit("Header 2"), "source")
    return t.documents.select("doc_id", F.md5(F.concat_ws("\n", "source", F.concat_ws("/", F.map_values(m)), "text")).alias("text"))


@query("o_s33_numbered", "select p_brand, string_agg('<' || n::varchar || '>' || p_name || '</' || n::varchar || '>', '' order by n) as context from (select p_brand, p_name, row_number() over (partition by p_brand order by p_name, p_partkey) as n from part) group by 1")
def _(t):
    return t.part.groupBy("p_brand").agg(F.array_sort(F.collect_list("p_name")).alias("x")).select("p_brand", tx.numbered(c("x")).alias("context"))


@query("o_s34_chat_text", "select conv_id, md5(string_agg('<|' || role || '|>' || chr(10) || coalesce(text, '') || chr(10), '' order by turn)) as text from conversations group by 1")
def _(t):
    m = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content")))).alias("m"))
    return m.select("conv_id", F.md5(tx.chat_text(c("m"))).alias("text"))


@query("o_s35_with_end", "select p_partkey, p_name || ' </s>' as text from part")
def _(t):
    return t.part.select("p_partkey", tx.with_end(F.when(c("p_size") > 20, F.concat("p_name", F.lit("\n\n"))).otherwise(F.concat("p_name", F.lit(" </s>"))), "</s>").alias("text"))


@query("o_s36_with_reward", "select event_id, event_type || ' <reward>' || printf('%.2f', value) as text from events")
def _(t):
    return t.events.select("event_id", tx.with_reward(c("event_type"), c("value")).alias("text"))


@query("o_s37_comment_lines", "select p_partkey, case when p_size > 20 then 4 else 1 end as n from part")
def _(t):
    return t.part.select("p_partkey", tx.comment_lines(F.when(c("p_size") > 20, "int a; /* one\n two\n three */\n b; // c\n d").otherwise("x; /* y */\n z")).alias("n"))


CODE = "int f(int a) { // note\n  return a + 1 > 2 ? a : \"//\"; /* x */ }\n"


@query("o_s38_halstead")
def _(t):
    h = tx.halstead(F.concat(F.lit(CODE), "p_name"))
    return t.part.select("p_partkey", h.alias("h")).select("p_partkey", r6("h.volume", "volume"), r6("h.difficulty", "difficulty"), r6("h.effort", "effort"))


@query("o_s39_halstead_tokens", """with v as (select p_partkey, p_size * 10 as n, floor(pow(p_size * 10.0::double, 0.7::double)) as v from part), w as (select *, floor(v * 0.4::double) as n1, greatest(v - floor(v * 0.4::double), 1) as n2, case when v > 1 then n * log2(greatest(v, 2)) else 0 end as volume from v)
  select p_partkey, round(volume, 4) as volume, round(n1 / 2 * floor(n * 0.6::double) / n2, 4) as difficulty, round(volume * (n1 / 2 * floor(n * 0.6::double) / n2), 2) as effort from w""")
def _(t):
    v = t.part.select("p_partkey", *tx.halstead_of_tokens(c("p_size") * 10))
    return v.select("p_partkey", F.round("volume", 4).alias("volume"), F.round("difficulty", 4).alias("difficulty"), F.round("effort", 2).alias("effort"))


@query("o_s40_halstead_lines", "select p_partkey, p_size * 25.0::double as volume, round(p_size * 1.2::double, 4) as difficulty, round(p_size * 25.0::double * (p_size * 1.2::double), 4) as effort from part")
def _(t):
    v = t.part.select("p_partkey", *tx.halstead_of_lines(c("p_size")))
    return v.select("p_partkey", "volume", F.round("difficulty", 4).alias("difficulty"), F.round("effort", 4).alias("effort"))


@query("o_s41_strip_strings")
def _(t):
    return t.part.select("p_partkey", tx.strip_strings_udf(F.concat(F.lit(CODE), "p_name")).alias("code"))


@query("o_s42_complexity", "select p_partkey, case when p_size > 20 then 4 else 1 end as n from part")
def _(t):
    return t.part.select("p_partkey", tx.complexity(F.when(c("p_size") > 20, "if (a && b) { x = c ? 1 : 2; } // if").otherwise("return;")).alias("n"))


# A file a part: a function of p_size % 4 branches, a class with a method, and text that only looks like code. Counted by rule.
@query("o_s42_function_metrics", """select p_partkey, 'f' as name, 1::bigint as start_line, (p_size % 4 + 3)::bigint as end_line, (p_size % 4 + 3)::bigint as nloc, (2 * (p_size % 4) + 1)::bigint as complexity from part
  union all select p_partkey, 'm', (p_size % 4 + 5)::bigint, (p_size % 4 + 5)::bigint, 1, 2 from part""")
def _(t):
    from graphloom.operators.code_metrics import function_metrics

    branch = F.lit('  if (a > 1 && b) { s = "}"; } // }\n')
    code = F.concat(F.lit("int f(int a) {\n"), F.repeat(branch, c("p_size") % 4), F.lit("  return a; /* if */\n}\nclass K { // "), "p_name", F.lit("\n  int m() const { return x ? 1 : 2; }\n};\n"))
    return function_metrics(t.part.select(F.col("p_partkey").alias("id"), code.alias("code"))).withColumnRenamed("id", "p_partkey")


@query("o_s43_change", "select l_orderkey, l_linenumber, round(l_tax - l_discount, 6) as diff, round(case when l_discount <> 0 then 100 * (l_tax - l_discount) / abs(l_discount) else 0 end, 4) as percent, case when l_tax = l_discount then 'same' when l_tax < l_discount then 'better' else 'worse' end as status from lineitem")
def _(t):
    v = t.lineitem.select("l_orderkey", "l_linenumber", *tx.change(c("l_tax"), c("l_discount"), higher_is_better=False))
    return v.select("l_orderkey", "l_linenumber", r6("diff", "diff"), F.round("percent", 4).alias("percent"), "status")


@query("o_s52_glob", "select p_partkey from part where regexp_matches(p_name, '^.*[a-m]. [^a-p].*$')")
def _(t):
    from graphloom.operators.filters import glob_regex

    return t.part.where(c("p_name").rlike(glob_regex("*[a-m]? [!a-p]*"))).select("p_partkey")


@query("o_s53_shorten", "select doc_id, case when length(text) > 60 then substr(text, 1, 57) || '...' else text end as text from documents")
def _(t):
    return t.documents.select("doc_id", tx.shorten(c("text"), 60).alias("text"))


@query("o_s54_strip_repeated", "select p_partkey, p_name as text from part")
def _(t):
    return t.part.select("p_partkey", tx.strip_repeated(F.concat(F.lit("<pad><pad>"), "p_name", F.lit("</s></s>")), "<pad>", "</s>").alias("text"))
