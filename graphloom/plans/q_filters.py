"""Queries of filters and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import filters as op
from graphloom.operators.numbering import numbered
from graphloom.plans.base import CALLS, NODES, Registry

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

BODY = "select doc_id as id, source as name, text as body from documents"


@query("o_f1_nodes_by_type", f"select * from ({NODES}) where type = 'ECONOMY'")
def _(t):
    return op.where_equal(t.nodes, type="ECONOMY")


@query("o_f2_nodes_by_file", f"select * from ({NODES}) where file_path = 'brand/7.cc'")
def _(t):
    return op.nodes_by_file(t.nodes, r".\brand//7.cc")


@query("o_f3_nodes_by_name", f"select * from ({NODES}) where name = 'red widget' and type = 'ECONOMY'")
def _(t):
    return op.where_equal(t.nodes, name="red widget", type="ECONOMY")


@query("o_f4_nodes_by_glob", f"select * from ({NODES}) where regexp_matches(name, '^[rs].* .i.*$')")
def _(t):
    return op.nodes_by_glob(t.nodes, "[rs]* ?i*")


@query("o_f5_edges_by_type", f"select * from ({CALLS}) where type = 'A' and dst = 5")
def _(t):
    return op.where_equal(t.calls, type="A", src=None, dst=5)


@query("o_f6_edges_by_regex", f"select * from ({CALLS}) where regexp_matches(src::varchar, '^1.$') and regexp_matches(dst::varchar, '7') and type = 'N'")
def _(t):
    return op.edges_by_regex(t.calls, "^1.$", "7", ignore_case=True, type="N")


@query("o_f7_drop_self_loops", f"select * from ({CALLS}) where src <> dst")
def _(t):
    return op.drop_self_loops(t.calls)


def bodies(t):
    return t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("name"), F.col("text").alias("body"))


@query("o_f8_functions_with_body", f"""select id, length(body)::int as body_length from ({BODY}) where name like 'src1%' and not (trim(body) = ''
  or (trim(body) like '%;' and not contains(body, '{{')) or (len(list_filter(string_split(trim(body), chr(10)), lambda x: trim(x) <> '' and not starts_with(trim(x), '//'))) <= 1 and not contains(body, '{{')))""")
def _(t):
    return op.functions_with_body(bodies(t), "^src1").select("id", "body_length")


@query("o_f9_declarations", f"""select id from ({BODY}) where (trim(body) = ''
  or (trim(body) like '%;' and not contains(body, '{{')) or (len(list_filter(string_split(trim(body), chr(10)), lambda x: trim(x) <> '' and not starts_with(trim(x), '//'))) <= 1 and not contains(body, '{{')))""")
def _(t):
    return op.declarations(bodies(t)).select("id")


@query("o_f10_keyword_search", f"select * from ({NODES}) where type = 'STANDARD' and (contains(lower(name), 'red') or contains(id::varchar, 'red')) order by id limit 20")
def _(t):
    return op.keyword_search(t.nodes, "RED", ["id", "name"], 20, type="STANDARD")


MASK_NODES = "select o_orderkey as id, case when o_orderpriority = '5-LOW' then 'flow' else 'function' end as type, o_orderstatus as body from orders"
MASK_EDGES = "select distinct l_suppkey as src, l_orderkey as dst, case when l_returnflag = 'A' then 'contains' else 'depends_on' end as type from lineitem"


def masked(t):
    n = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderpriority") == "5-LOW", "flow").otherwise("function").alias("type"), F.col("o_orderstatus").alias("body"))
    e = t.lineitem.select(F.col("l_suppkey").alias("src"), F.col("l_orderkey").alias("dst"), F.when(F.col("l_returnflag") == "A", "contains").otherwise("depends_on").alias("type")).distinct()
    return op.mask_target(n, e, 3, "flow")


_FLOWS = f"flows as (select e.dst as id from ({MASK_EDGES}) e join ({MASK_NODES}) n on n.id = e.dst where e.src = 3 and e.type = 'contains' and n.type = 'flow')"


@query("o_f11_mask_target_nodes", f"with {_FLOWS} select id, type, case when id <> 3 then body end as body from ({MASK_NODES}) where id not in (select id from flows)")
def _(t):
    return masked(t)[0]


@query("o_f11_mask_target_edges", f"with {_FLOWS} select * from ({MASK_EDGES}) where src <> 3 and src not in (select id from flows) and dst not in (select id from flows)")
def _(t):
    return masked(t)[1]


@query("o_f12_both_ends", f"select * from ({CALLS}) where contains(src::varchar, '2') and contains(dst::varchar, '2')")
def _(t):
    return op.both_ends_contain(t.calls, "2")


@query("o_f13_attribute_filter", "select event_id, event_type from events where event_type = 'click' and user_id = 7")
def _(t):
    return op.where_equal(t.events, event_type="click", user_id=7, value=None).select("event_id", "event_type")


_REL = "select l_orderkey as id, l_linenumber as line, case when l_linestatus = 'O' then 'SEMANTIC' else 'CODE' end as source_kind, case l_returnflag when 'A' then 'USE' when 'N' then 'CONTAIN' else 'IMPLEMENT' end as relationship, case when l_quantity < 25 then 'CODE' else 'SEMANTIC' end as target_kind, 'T' || (l_suppkey % 13)::varchar as type from lineitem"
_TYPES = [f"T{i}" for i in range(10)]


@query("o_f14_valid_relations", f"select * from ({_REL}) where type in ({', '.join(repr(x) for x in _TYPES)}) and ((source_kind = 'SEMANTIC' and relationship = 'USE' and target_kind = 'CODE') or (source_kind = 'SEMANTIC' and relationship = 'CONTAIN' and target_kind = 'SEMANTIC') or (source_kind = 'CODE' and relationship = 'IMPLEMENT' and target_kind = 'SEMANTIC'))")
def _(t):
    r = t.lineitem.select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.when(F.col("l_linestatus") == "O", "SEMANTIC").otherwise("CODE").alias("source_kind"),
        F.when(F.col("l_returnflag") == "A", "USE").when(F.col("l_returnflag") == "N", "CONTAIN").otherwise("IMPLEMENT").alias("relationship"),
        F.when(F.col("l_quantity") < 25, "CODE").otherwise("SEMANTIC").alias("target_kind"), F.concat(F.lit("T"), F.col("l_suppkey") % 13).alias("type"),
    )
    return op.valid_relations(r, _TYPES)


@query("o_f15_valid_cases", "select event_id from events where event_type <> 'view' and event_type <> 'error'")
def _(t):
    e = t.events.withColumn("evaluation", F.when(F.col("event_type") != "view", F.col("value"))).withColumn("error", F.when(F.col("event_type") == "error", F.lit("x")))
    return op.valid_cases(e).select("event_id")


_ITEMS = "[p_type, ' N/A ', case when p_size < 25 then 'None' else p_brand end, null, '<NONE>', '  ']"


@query("o_f16_placeholders", f"select p_partkey, array_to_string(list_filter({_ITEMS}, lambda x: x is not null and lower(trim(x)) not in ('<none>', 'none', '(none)', 'n/a', 'null', '')), '|') as items from part")
def _(t):
    items = F.array("p_type", F.lit(" N/A "), F.when(F.col("p_size") < 25, "None").otherwise(F.col("p_brand")), F.lit(None).cast("string"), F.lit("<NONE>"), F.lit("  "))
    return t.part.select("p_partkey", F.array_join(op.drop_placeholders(items), "|").alias("items"))


_PATHS = "select page_id, regexp_replace(url, '^[a-z]*://[^/]*/', 'main/') as path from pages"


@query("o_f17_path_rules", f"select * from ({_PATHS}) where not list_contains(string_split(path, '/'), 'es') and (not starts_with(path, 'main/') or string_split(path, '/')[2] in ('en', 'fr'))")
def _(t):
    files = t.pages.select("page_id", F.regexp_replace("url", "^[a-z]*://[^/]*/", "main/").alias("path"))
    return op.path_rules(files, "es", "main", ["en", "fr"])


@query("o_f18_key_filter", "select vec_id, label from embeddings where vec_id in (select doc_id from labels)")
def _(t):
    return t.embeddings.join(t.labels.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi").select("vec_id", "label")


_LINES = "select l_orderkey, l_linenumber, l_suppkey as start_line, l_suppkey + l_quantity::bigint as end_line from lineitem"


@query("o_f19_longer_than", f"select * from ({_LINES}) where end_line - start_line + 1 > 3")
def _(t):
    return op.longer_than(t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("start_line"), (F.col("l_suppkey") + F.col("l_quantity").cast("long")).alias("end_line")), 3)


@query("o_f20_pending", "select o_orderkey from orders where o_orderstatus = 'O' and o_orderpriority <> '1-URGENT'")
def _(t):
    f = t.orders.select("o_orderkey", (F.col("o_orderstatus") == "O").alias("in_scope"), (F.col("o_orderpriority") == "1-URGENT").alias("done"))
    return op.pending_in_scope(f, ["o_orderkey"]).select("o_orderkey")


@query("o_f21_file_search", "select page_id, url from pages where not contains(url, '/de/') and regexp_matches(url, '[.]html$') and contains(lower(url), 'th') order by url, page_id limit 50")
def _(t):
    return t.pages.where(~F.col("url").contains("/de/") & F.col("url").rlike("[.]html$") & F.lower("url").contains("th")).orderBy("url", "page_id").limit(50).select("page_id", "url")


@query("o_f22_text_search", r"""select doc_id, pos::int as line_no, line from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents)
  where regexp_matches(line, '(?i)\b(?:THE OF)\b')""")
def _(t):
    return op.search_lines(t.documents, "THE OF", literal=True, ignore_case=True, whole_word=True, id_col="doc_id")


@query("o_f23_prompts_that_fit", "select conv_id, turn from conversations where length(text) < 498")
def _(t):
    return op.prompts_that_fit(t.conversations.withColumn("n", F.length("text")), "n", 500).select("conv_id", "turn")


@query("o_f24_degrees", f"with e as ({CALLS}) select id, (select count(*) from e where dst = id)::bigint as in_degree, (select count(*) from e where src = id)::bigint as out_degree, (select count(*) from e where dst = id)::bigint + (select count(*) from e where src = id)::bigint as degree from ({NODES})")
def _(t):
    return op.with_degrees(t.nodes.select("id"), t.calls)


@query("o_f25_rows_in_order", "select pos, l.vec_id, e.label from (select row_number() over (order by vec_id desc) as pos, vec_id from embeddings where label = 3) l join embeddings e on e.vec_id = l.vec_id")
def _(t):
    ids = numbered(t.embeddings.where("label = 3").select("vec_id"), [F.desc("vec_id")], "pos")
    return op.rows_in_order(ids, t.embeddings.select("vec_id", "label"), "vec_id")


@query("o_f26_rows_by_ids", "select vec_id, label from embeddings where vec_id in (select item_id from benchmark)")
def _(t):
    return t.embeddings.join(t.benchmark.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").select("vec_id", "label")


_ENC = "select d.doc_id, case when d.lang <> 'fr' then d.lang end as what, d.source as how, l.quality as embedding from documents d left join labels l on l.doc_id = d.doc_id"


def encoded(t):
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.when(F.col("lang") != "fr", F.col("lang")).alias("what"), F.col("source").alias("how"), F.col("quality").alias("embedding"))


@query("o_f27_needs_embedding", f"select doc_id from ({_ENC}) where what <> '' and how <> '' and embedding is null")
def _(t):
    return op.needs_embedding(encoded(t)).select("doc_id")


@query("o_f28_empty_what", f"select doc_id from ({_ENC}) where what is null")
def _(t):
    return encoded(t).where("what is null").select("doc_id")


@query("o_f29_active", "select d.doc_id from documents d left join labels l on l.doc_id = d.doc_id where coalesce(l.quality = 1, true)")
def _(t):
    return op.active(t.documents.join(t.labels, "doc_id", "left").withColumn("status", F.col("quality") == 1)).select("doc_id")


@query("o_f30_by_suffix", f"select id, name from ({NODES}) where name like '%bolt' and name <> ''")
def _(t):
    return t.nodes.where(F.col("name").endswith("bolt") & (F.col("name") != "")).select("id", "name")


@query("o_f31_replace_lines", "with l as (select doc_id, string_split(text, chr(10)) as x from documents) select doc_id, md5(array_to_string(list_concat(x[1:1], ['new', 'lines'], x[4:]), chr(10))) as text, md5(array_to_string(list_transform(x, lambda v, i: case when i > 2 and i < 5 then '' else v end), chr(10))) as blanked from l where len(x) >= 3")
def _(t):
    d = t.documents.where(F.size(F.split("text", "\n")) >= 3)
    return d.select("doc_id", F.md5(op.replace_lines(F.col("text"), 2, 3, F.lit("new\nlines"))).alias("text"), F.md5(op.blank_body(F.col("text"), 2, 5)).alias("blanked"))


_CASES = "select l_orderkey * 10 + l_linenumber as id, 'f' || (l_suppkey % 30)::varchar as file_path, l_suppkey as start_line, l_suppkey + l_quantity::bigint as end_line from lineitem"


def cases(t):
    return t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat(F.lit("f"), F.col("l_suppkey") % 30).alias("file_path"), F.col("l_suppkey").alias("start_line"), (F.col("l_suppkey") + F.col("l_quantity").cast("long")).alias("end_line"))


for _name, _type, _sql in (
    ("long", "run-96", f"select * from ({_CASES}) where end_line - start_line >= 20"),
    ("files", "run-168", f"select * from ({_CASES}) where file_path not in ('f3', 'f7', 'f11')"),
    ("sample", "run-10", f"select * from ({_CASES}) where end_line - start_line >= 20 order by md5(id::varchar || ':0'), id limit 10"),
    ("one", "demo", f"select * from ({_CASES}) order by id limit 1"),
):
    query(f"o_f32_case_subset_{_name}", _sql)(lambda t, _type=_type: op.case_subset(cases(t), _type, ["f3", "f7", "f11"]))
