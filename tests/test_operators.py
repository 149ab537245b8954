"""Operators on small hand-made inputs: cycles, loops, nulls, ties, empty tables; and those that SQL can't express."""

import math
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.functions import training as tr
from graphloom.functions.vectors import cosine
from graphloom.operators import aggregates as ag
from graphloom.operators import filters as fl
from graphloom.operators import graph as gr
from graphloom.operators.cycles import cycles
from graphloom.operators import joins as jn
from graphloom.operators import segment as sg
from graphloom.operators import sets as st
from graphloom.operators import windows as wn
from graphloom.plans import pipeline as pl
from graphloom.sources import files as io


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


CYCLIC = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 4), (4, 5), (1, 2), (7, 8)]


def test_bfs_cycles_and_depth(spark):
    e = edges(spark, CYCLIC)
    start = spark.createDataFrame([(1,), (1,)], "id long")
    assert rows(gr.reachable(e, start, 2)) == [(1, 0), (2, 1), (3, 2)]
    assert rows(gr.reachable(e, start, None)) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]
    assert rows(gr.reachable(e, start, None, "in")) == [(1, 0), (2, 2), (3, 1)]
    assert rows(gr.reachable(edges(spark, []), start, None)) == [(1, 0)]
    assert rows(gr.reachable(e, start.limit(0), None)) == []


def test_paths(spark):
    e = edges(spark, CYCLIC)
    assert rows(gr.simple_paths(e, 1, 5)) == [([1, 2, 3, 4, 5], 4)]
    assert rows(gr.simple_paths(e, 1, 3)) == []
    assert rows(cycles(e, 4)) == [([1, 2, 3],), ([4],)]
    assert rows(gr.shortest_path(edges(spark, [(1, 2), (1, 3), (2, 4), (3, 4)]), 1, 4)) == [([1, 2, 4],)]
    assert rows(gr.shortest_path(e, 5, 1)) == []
    tree = rows(gr.call_tree(e, 3, 1))
    assert tree == [([3, 1], 1, True), ([3, 4], 1, True), ([3], 0, False)]


def test_components_against_union_find(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(500 + i, 501 + i) for i in range(40)] + [(3, None)]
    nodes = spark.createDataFrame([(i,) for i in [*range(120), *range(500, 541)]], "id long")
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = dict(rows(gr.components(nodes, edges(spark, pairs))))
    assert got == {i: find(i) for i in got}


def test_levels_and_rounds(spark):
    nodes = spark.range(1, 9)
    e = edges(spark, [(1, 2), (1, 3), (2, 4), (3, 4), (5, 6), (6, 5), (6, 7)])
    assert rows(gr.levels(nodes, e)) == sorted([(1, 0), (2, 1), (3, 1), (4, 2), (8, 0), (5, None), (6, None), (7, None)], key=repr)
    calls = edges(spark, [(1, 1), (1, 2), (3, 4), (4, 3), (4, 2), (2, 99)])
    got = dict(rows(gr.rounds(spark.range(1, 5), calls)))
    assert got[2] == 0 and got[1] == 1 and got[3] < got[4]  # 3 calls one pending node, 4 as well: the smaller id first
    assert rows(gr.rounds(spark.range(0), calls)) == []


def test_visits(spark):
    e = edges(spark, [(1, 3), (1, 2), (2, 4), (3, 4), (4, 1)])
    assert [r.id for r in gr.order_of_visits(e, 1).orderBy("seq").collect()] == [1, 2, 4, 3]
    assert [r.id for r in gr.order_of_visits(e, 1, post=True).orderBy("seq").collect()] == [4, 2, 3, 1]


def test_hops_share_visited_per_hit(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (4, 1)])
    got = rows(gr.hops(e, spark.createDataFrame([(1,)], "id long"), 2))
    assert got == [(1, 2, 1, 1, "successor"), (1, 3, 1, 1, "predecessor"), (1, 4, 1, 1, "predecessor")]


def test_filters_with_nulls(spark):
    e = spark.createDataFrame([(1, 1), (None, None), (1, None), (1, 2)], "src long, dst long")
    assert rows(fl.drop_self_loops(e)) == [(1, 2), (1, None)]
    items = spark.createDataFrame([(["a", " None ", None, "N/A", "", "  ", "<none>", "null x"],), (None,)], "x array<string>")
    assert [r[0] for r in items.select(fl.drop_placeholders(F.col("x"))).collect()] == [["a", "null x"], None]
    assert rows(fl.active(spark.createDataFrame([(1, True), (2, None), (3, False)], "id long, status boolean")).select("id")) == [(1,), (2,)]
    t = spark.createDataFrame([("a\nb\nc",), (None,)], "t string")
    assert [r[0] for r in t.select(fl.replace_lines(F.col("t"), 2, -1, F.lit("x"))).collect()] == ["a\nx", None]


def test_globs(spark):
    names = spark.createDataFrame([("ab.c",), ("a.c",), ("[x]",), ("axc",)], "name string")
    pick = lambda p: [r[0] for r in names.where(F.col("name").rlike(fl.glob_regex(p))).collect()]
    assert pick("a?.c") == ["ab.c"] and pick("*.c") == ["ab.c", "a.c"] and pick("a[!b.]c") == ["axc"] and pick("[[]x]") == ["[x]"]


def test_joins(spark):
    with pytest.raises(Exception, match="no row for"):
        jn.checked_lookup(spark.range(3), spark.range(2), "id").collect()
    w = spark.createDataFrame([(1, "s", "f1"), (2, "s", "f9"), (3, "zz", "f1")], "id long, symbol string, file string")
    c = spark.createDataFrame([(10, "s", "f0", 1), (11, "s", "f1", 2)], "cid long, symbol string, file string, seq long")
    assert rows(jn.canonical(w, c)) == [(1, 11), (2, 10)]
    shifted = jn.cyclic_shift(spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 3, "c")], "b long, o long, y string"), "b", "o", "y")
    assert rows(shifted.select("y", "other")) == [("a", "b"), ("b", "a"), ("c", "c")]


def test_sets(spark):
    a = spark.createDataFrame([(None, 1, 2, "t", 1), (None, 1, 2, "t", 0), (7, 1, 2, "t", 3), (7, 9, 9, "u", 2)], "id long, src long, dst long, type string, seq long")
    assert rows(st.dedupe_edges(a).select("seq")) == [(0,), (2,)]
    x = spark.createDataFrame([(1,), (1,), (None,)], "v long")
    assert rows(st.difference(x, spark.createDataFrame([(None,)], "v long"))) == [(1,)]
    merged = st.merge_graphs([spark.createDataFrame([(1, "a")], "id long, label string"), spark.createDataFrame([(1, None, "b"), (2, "c", None)], "id long, label string, body string")])
    assert rows(merged.select("id", "label", "body")) == [(1, "a", "b"), (2, "c", None)]


def test_ratios_guard_zero(spark):
    d = spark.createDataFrame([(0, 0, 0), (2, 1, 4)], "c long, i long, r long")
    pick = lambda k: [round(x[0], 4) for x in d.select(ag.reuse_rate(F.col("c"), F.col("i"), F.col("r"), k)).collect()]
    assert pick("reference_count") == [0.0, 50.0] and pick("correct_plus_incorrect") == [0.0, 66.6667]
    golden = spark.createDataFrame([(2, 6, 6, 15)], "a long, b long, c long, d long")
    got = golden.select(ag.rate(F.col("a"), F.col("a") + F.col("b")), ag.rate(F.col("c"), F.col("c") + F.col("d"))).first()
    assert got[0] == 25.0 and round(got[1], 6) == 28.571429


def test_best_of_takes_the_first(spark):
    d = spark.createDataFrame([("p", 1, 2.0), ("p", 2, 2.0), ("p", 3, 1.0), ("p", 4, 1.0), ("q", 5, 0.0)], "g string, seq long, r double")
    assert rows(ag.preference_pairs(d, "g", "r", "seq")) == [("p", 1, 2.0, 3, 1.0), ("q", 5, 0.0, 5, 0.0)]


def test_group_of_one(spark):
    d = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 3.0)], "g string, r double")
    for method, want in (("mean", [0.0, -1.0, 1.0]), ("leave_one_out", [None, -2.0, 2.0])):
        assert [r.advantage for r in wn.group_advantage(d, ["g"], "r", method).orderBy("g", "r").collect()] == want
    assert [r.advantage for r in wn.group_advantage(d, ["g"], "r", "norm").orderBy("g", "r").collect()][0] is None


def test_returns_and_gae(spark):
    d = spark.createDataFrame([([1.0, 2.0, 3.0], [0.5, 0.5, 0.5]), ([], [])], "r array<double>, v array<double>")
    got = d.select(wn.discounted_returns(F.col("r"), 0.5).alias("x"), wn.gae(F.col("v"), F.col("r"), 1.0, 1.0).alias("g")).collect()
    assert got[0].x == [2.75, 3.5, 3.0] and got[0].g.returns == [6.0, 5.0, 3.0] and got[1].x == [] and got[1].g is None
    assert one(spark, wn.token_rewards(F.col("r"), F.array(F.lit(1.0), F.lit(2.0)), -1.0, 3.0), r=9.0) == [0.0, 3.0]


def test_small_chunks(spark):
    f = lambda c: spark.createDataFrame([(c,)], "c array<string>").select(wn.coalesce_small(F.col("c"), 5)).first()[0]
    assert f(["a", "bb", "cccc", "d", "e"]) == ["a\nbb", "cccc", "d\ne"] and f([]) == []


def test_round_robin_and_shards(spark):
    d = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "g string, v long")
    assert [r.v for r in wn.round_robin(d, "g", [F.col("v")], "g").orderBy("seq").collect()] == [1, 3, 2]
    got = [sorted(r.id for r in wn.strided_shard(spark.range(5), "id", k, 3).collect()) for k in range(3)]
    assert got == [[0, 3], [1, 4], [0, 2]]


def test_vectors(spark):
    d = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in d.select(cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_signatures(spark):
    cases = {
        "f(int a, const char *b = nullptr)": "f(int, const char *)", "g()": "g()", "h": "h", "k(std::map<int, int> m, void (*cb)(int a, int b))": "k(std::map<int, int>, void (*cb)(int a, int b))",
        "m(unsigned x[3], T)": "m(unsigned[3], T)", None: None,
    }
    d = spark.createDataFrame([(k,) for k in cases], "s string")
    assert [r[0] for r in d.select(tx.normalize_signature_udf("s")).collect()] == list(cases.values())


def test_records(spark):
    text = '("X"<|>CODE<|>class<|>define<|>d1)##("Y"<|>other<|>a<|>b<|>c)##(z<|>semantic<|>t<|>use<|>d2)##(short)<|END|>'
    got = one(spark, tx.entities(F.col("t")), t=text)
    assert [(r.name, r.kind, r.relation, r.description) for r in got] == [('"X"', "CODE", "DEFINE", "d1"), ("Z", "SEMANTIC", "USE", "d2")]
    assert one(spark, tx.summary(F.col("t")), t="KIND: a: b").asDict() == {"type": "KIND", "description": "a: b"}
    assert one(spark, tx.summary(F.col("t")), t="none").asDict() == {"type": "", "description": "none"}


def test_comments_and_code(spark):
    code = "a; // x\n/* b\nc */ d\ne /* f */\n\"//\""
    assert one(spark, tx.comment_lines(F.col("c")), c="a; // x\n/* b\nc */ d\ne /* f */\ng") == 4
    assert one(spark, tx.strip_strings_udf(F.col("c")), c=code) == "a; \n\n d\ne \n    "
    h = one(spark, tx.halstead(F.col("c")), c="a = b + 1;")
    assert h.volume == 6 * math.log2(6) and h.difficulty == 1.5
    assert one(spark, tx.halstead(F.col("c")), c="").effort == 0.0


def test_identifiers_and_declarations(spark):
    tokens = lambda x: one(spark, tx.identifier_tokens(F.col("c")), c=x)
    assert tokens("getHTTPValue_2for") == ["get", "http", "value"] and tokens("switch") == [] and tokens("my_enumClass") == ["my"]
    declared = lambda x: one(spark, tx.declaration_count(F.col("c")), c=x)
    assert tokens("ABc_xY9Z") == ["a", "bc", "x", "y", "z"] and tokens("HTTPServer") == ["http", "server"]
    assert declared("enum class Mode { A, B }; struct { int x; } s; class A : public B {};") == 2
    assert declared("int f(int a, int b) const override; x = g(1); void h(int (*p)(int)); call(2); return k(3);") == 2
    assert declared("") == 0 and declared("class") == 0
    assert declared("int/*x*/f(int a);") == 1 and declared("int f() { return 1; }") == 0 and declared("class A; // enum B\nvoid g() const;") == 2
    naming = lambda x: one(spark, tx.naming_consistency(F.col("c")), c=x)
    assert naming(None) == 1.0 and naming("int i") == 1.0 and naming("int fooBar = foo_baz + foo_baz;") == pytest.approx((1 / 3 + 1 / 3 + 1) / 3)
    h = one(spark, tx.halstead(F.col("c")), c="return new X(a, 12u); // b")
    assert h.volume == pytest.approx(8 * math.log2(8)) and h.difficulty == pytest.approx(2.5)


def test_resolve_at_every_level(spark):
    files = spark.createDataFrame([("main/audio/afe_wake_word.h",), ("main\\\\b.cc".replace("\\\\", "\\"),), ("x/ab",), ("x/b.cc.txt",)], "id string")
    wants = ["main/audio/afe_wake_word.h", "main\\audio\\afe_wake_word.h", "main/b.cc", "zz/afe_wake_word.h", "afe_wake", "q/b.cc", "ab", "none.h", "dir/", None]
    got = {r.want: r.id for r in gr.resolve(files, spark.createDataFrame([(w,) for w in wants], "want string")).collect()}
    whole = "main/audio/afe_wake_word.h"
    assert got == {whole: whole, "main\\audio\\afe_wake_word.h": whole, "main/b.cc": "main\\b.cc", "zz/afe_wake_word.h": whole, "afe_wake": whole, "q/b.cc": "main\\b.cc", "ab": "x/ab"}


def test_guided_search_by_a_queue(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(70)]
    edges = spark.createDataFrame([*pairs, (None, 3)], "src long, dst long")
    for depth, budget in ((3, 12), (2, 100), (0, 5), (4, 1)):
        level, done, want = [pairs[0][0]], [], set()
        for d in range(depth + 1):
            now = sorted(level)[: budget - len(done)]
            done += now
            want |= {(x, d, "answer" if x % 5 == 0 else "explore") for x in now}
            near = {b for x in now for p in pairs for a, b in (p, p[::-1]) if a == x} - set(done)
            if d < depth:
                want |= {(x, d + 1, "skip") for x in near if x % 4 == 3}
            level = [x for x in near if x % 4 != 3]
        got = gr.guided_search(edges, pairs[0][0], lambda x: x.where("id % 5 = 0"), lambda x: x.where("id % 4 <> 3"), depth, budget)
        assert {tuple(r) for r in got.collect()} == want


def test_losses(spark):
    x = one(spark, F.struct(tr.log_sigmoid(F.lit(-800.0)).alias("a"), tr.log_sigmoid(F.lit(800.0)).alias("b"), tr.log_sum_exp(F.array(F.lit(1000.0), F.lit(1000.0))).alias("c")), z=1)
    assert x.a == -800.0 and x.b == 0.0 and abs(x.c - 1000 - math.log(2)) < 1e-9
    logits = F.array(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0)), F.array(F.lit(5.0), F.lit(5.0)))
    lm = one(spark, tr.language_model_loss(logits, F.array(F.lit(-100), F.lit(0), F.lit(-100))), z=1)
    assert abs(lm - math.log(1 + math.exp(-1))) < 1e-9
    assert one(spark, tr.language_model_loss(logits, F.array(F.lit(1), F.lit(-100), F.lit(-100))), z=1) is None
    pr = one(spark, tr.process_reward_loss(logits, F.array(F.lit(0), F.lit(0), F.lit(-100))), z=1)
    assert pr.accuracy == 0.5
    assert one(spark, tr.adaptive_coefficient(1.0, F.col("k"), 1.0, 10, 1), k=[9.0, 1.0]) == 1.02


def test_sections_and_splits(spark):
    d = spark.createDataFrame([(1, "# A\nx\n### C\ny\n## B\nz"), (2, ""), (3, None)], "doc_id long, text string")
    assert rows(sg.sections(d).select("doc_id", "headers", "content")) == sorted([(1, "A", "# A\nx"), (1, "A/C", "### C\ny"), (1, "A/B", "## B\nz"), (2, "", "")], key=repr)
    text = " ".join(f"w{i}" for i in range(300))
    parts = sg.split_text(text, 50, 10)
    assert all(len(p) <= 50 for p in parts) and parts[0].startswith("w0") and parts[-1].endswith("w299")
    assert {w for p in parts for w in p.split()} == set(text.split())
    assert sg.split_text("x" * 120, 50, 0) == ["x" * 50, "x" * 50, "x" * 20] and sg.split_text("", 5, 1) == []


def test_yaml_cases():
    text = "benchmark:\n- query: 'complete f(a: b)'\n  n: 3\n  code: |\n    int f() {\n\n      x;\n    }\n- query: \"q\"\n  empty:\n# note\n"
    assert io.parse_cases(text) == [{"query": "complete f(a: b)", "n": "3", "code": "int f() {\n\n  x;\n}"}, {"query": "q", "empty": ""}]
    assert io.parse_cases("") == []


def test_files(spark, tmp_path):
    (tmp_path / "a/.hidden").mkdir(parents=True)
    for p, x in (("a/x.md", "one"), ("a/.hidden/y.md", "two"), ("z.txt", "three"), ("a/build.cc", "four")):
        (tmp_path / p).write_text(x)
    root = f"file://{tmp_path}"
    assert [tuple(r) for r in io.read_markdown(spark, root).select("source", "content").collect()] == [("a", "one")]
    files = io.list_files(spark, root)
    assert rows(io.without_names(files, ["a"]).select("name")) == [("z.txt",)]
    assert rows(io.within_depth(files, root, 0).select("name", "folder", "depth")) == [("z.txt", "", 0)]
    assert rows(io.without_names(files, ["bui"], anywhere=True).select("name")) == [("x.md",), ("z.txt",)]  # Spark lists no hidden folders


def test_results_of_both_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"metadata": {"test_type": "t"}, "results": [{"query": "q1"}, {"query": "q2"}]}')
    (tmp_path / "b.json").write_text(' [{"query": "q3"}]')
    got = rows(io.read_results(spark, f"file://{tmp_path}", "query: string").select("test_type", "result.query"))
    assert got == [("t", "q1"), ("t", "q2"), ("unknown", "q3")]


def test_tables_as_text():
    r = [{"a": "x_y", "b": 1}]
    assert io.markdown_table(r, ["a", "b"]) == "| a | b |\n|---|---|\n| x_y | 1 |"
    assert r"x\_y & 1 \\" in io.latex_table(r, ["a", "b"])


def test_steps(spark):
    steps = pl.Steps()
    steps.register("double")(lambda d, by=2, **_: d.select((F.col("id") * by).alias("id")))
    out = steps.run([{"name": "double", "input": "x", "output": "y"}, {"name": "double", "input": "y", "output": "z", "by": 5}], {"x": spark.range(2)})
    assert rows(out["z"]) == [(0,), (10,)]
    with pytest.raises(KeyError):
        steps.run([{"name": "none", "input": "x", "output": "y"}], {"x": spark.range(1)})


def test_tools(spark):
    tools = pl.Tools()
    tools.register("take", n=(int, True))(lambda d, n: d.limit(n))
    assert tools.call("take", spark.range(5), n=2).count() == 2
    for bad in ({}, {"n": "2"}, {"n": 1, "m": 2}):
        with pytest.raises(TypeError):
            tools.call("take", spark.range(5), **bad)


def test_pages_end_with_a_short_one(spark):
    calls = lambda page, size: [{"id": i, "title": "t"} for i in range(4)][(page - 1) * size : page * size]
    assert io.read_issues(spark, calls, 2).count() == 4 and io.read_issues(spark, calls, 3).count() == 4


def test_cached_map_works_on_misses_only(spark):
    seen = spark.sparkContext.accumulator(0)
    d = spark.createDataFrame([("a",), ("b",), ("b",)], "t string")
    cache = d.where("t = 'a'").select(F.md5("t").alias("key"), F.lit("old").alias("value"))

    def work(misses):
        seen.add(misses.count())
        return misses.withColumn("value", F.upper("t"))

    assert sorted(r.value for r in pl.cached_map(d, cache, "t", work).collect()) == ["B", "old"] and seen.value == 1


def test_without_llm():
    """The entry module and all other queries stand without the llm subpackage; nothing else imports it."""
    import ast
    import pathlib

    root = pathlib.Path(__file__).parent.parent
    for p in (root / "graphloom").rglob("*.py"):
        if "llm" not in p.parts:
            for node in ast.walk(ast.parse(p.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n for n in names), p


def test_property_graph(spark):
    from graphloom.model import SCHEMAS, PropertyGraph, with_defaults

    for ddl in SCHEMAS.values():
        assert spark.createDataFrame([], ddl).columns
    v = spark.createDataFrame([(1, "file"), (2, "function"), (3, "odd")], "id long, type string")
    e = spark.createDataFrame([(1, 2, "contains_function", 1), (1, 2, "function_incoming", 2), (2, 9, "nonsense", 3)], "src long, dst long, type string, seq long")
    g = PropertyGraph(v, e)
    assert rows(g.last_wins("seq").edges.select("src", "dst", "type")) == [(1, 2, "function_incoming"), (2, 9, "nonsense")]
    assert rows(g.invalid()) == [("edge type", "nonsense"), ("missing vertex", "9"), ("node type", "odd")]
    assert rows(g.components()) == [(1, 1), (2, 1), (3, 3)]
    assert g.subgraph(spark.range(3)).edges.count() == 2
    assert rows(with_defaults(v.withColumn("label", F.lit(None).cast("string")), {"label": "", "body": "-"}).select("label", "body").distinct()) == [("", "-")]


def test_calls_by_symbol_against_all_pairs(spark, monkeypatch):
    """Bundles of a few ids, repeated rows, nodes of several symbols, nulls; pairs of nodes of one symbol are not shuffled."""
    monkeypatch.setattr(jn, "BUNDLE", 3)
    calls = [(i % 40, "ab"[i % 2]) for i in range(60)] + [(1, "b"), (2, "c"), (None, "a"), (3, None), (4, "nowhere")]
    nodes = [(100 + i % 20, "a") for i in range(30)] + [(200 + i, "b") for i in range(10)] + [(100, "b"), (300, "c"), (300, "a"), (None, "b"), (301, None)]
    got = jn.calls_by_symbol(spark.createDataFrame(calls, "src long, symbol string"), spark.createDataFrame(nodes, "id long, symbol string"))
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == {(s, d) for s, x in calls for d, y in nodes if x is not None and x == y}


def test_calls_by_symbol_shuffles_no_pairs(spark):
    """3,000 callers and 3,000 nodes of one symbol: nine million edges, a few thousand rows in the exchanges."""
    side = lambda c: spark.range(3000).select(F.col("id").alias(c), F.lit("x").alias("symbol"))
    out = jn.calls_by_symbol(side("src"), side("id"))
    assert out.count() == 9_000_000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Repartition")  # unfolded after the last exchange


def test_canonical_against_all_candidates(spark):
    """As the scan orders them: same file, other file, none; then seq. One symbol with many rows is not paired."""
    import random

    r = random.Random(3)
    pick = lambda: r.choice(["f1", "f2", "f3", None])
    wanted = [(i, r.choice(["s", "t", "u", None]), pick()) for i in range(60)]
    cands = [(i, r.choice(["s", "t", None]), r.choice(["f1", "f2", "f8", None]), i * 7 % 41) for i in range(40)] + [(99, "u", None, 1)]
    order = lambda f, g: 2 if f is None or g is None else int(f != g)
    want = []
    for i, s, f in wanted:
        own = sorted((order(f, g), q, c) for c, x, g, q in cands if s is not None and x == s)
        want += [(i, own[0][2])] if own else []
    w, c = spark.createDataFrame(wanted, "id long, symbol string, file string"), spark.createDataFrame(cands, "cid long, symbol string, file string, seq long")
    assert sorted(tuple(r) for r in jn.canonical(w, c).collect()) == want
    big = jn.canonical(spark.range(20_000).select("id", F.lit("s").alias("symbol"), F.col("id").cast("string").alias("file")), spark.range(20_000).select(F.col("id").alias("cid"), F.lit("s").alias("symbol"), F.lit("f").alias("file"), F.col("id").alias("seq")))
    assert big.agg(F.count("*"), F.max("cid")).first() == (20_000, 0)  # 400 million pairs, were they made


def test_propagate_ends_after_its_rounds(spark, tmp_path):
    """A ring on which some nodes are further than 30 rounds away: o_g25_propagate goes as far as its SQL."""
    from graphloom.operators.graph import propagate

    chain = spark.range(12).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert propagate(chain, spark.range(1), lambda d: d, 5).agg(F.max("round"), F.count("*")).first() == (5, 6)
    assert propagate(chain, spark.range(1), lambda d: d).agg(F.max("round"), F.count("*")).first() == (12, 13)
    duckdb = pytest.importorskip("duckdb")
    from graphloom.plans import q_graph

    spark.range(100_000).select(F.col("id").alias("vec_id")).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(q_graph.ORACLES["o_g25_propagate"]).fetchall()
    got = [tuple(r) for r in q_graph.QUERIES["o_g25_propagate"](spark, str(tmp_path)).select("id", "round").collect()]
    assert sorted(got) == sorted(want)


def test_expressions_compute_a_value_once(spark):
    """What several places of an expression need is written once, and not within the lambdas that use it."""
    from graphloom.functions import training as tr

    times = lambda x, what: spark.range(1).select(F.lit("int a_b = f(x);").alias("c"), F.array(F.lit(1.0), F.lit(2.0)).alias("v")).select(x.alias("r"))._jdf.queryExecution().analyzed().toString().split("\n")[0].count(what)
    assert times(tx.halstead(F.col("c")), "regexp_extract_all(") == 1
    assert times(tx.naming_consistency(F.col("c")), "regexp_extract_all(") == 1
    assert times(tx.declaration_count(F.col("c")), "regexp_extract_all(") == 2  # words, and statements
    assert times(tr.distillation_loss(F.reverse(F.col("v")), F.col("v")), "array_max(") == 2
    assert times(tr.log_sum_exp(F.col("v")), "array_max(") == 1


def test_recursive_split_passes_pieces_on(spark, monkeypatch):
    """Texts come in batches of a few MB and pieces leave in runs, not a column of 10,000 texts at a time."""
    from graphloom.shared import BATCH, BATCH_BYTES

    texts = [(i, "word " * (i % 50) + "\n\n" + "x" * (i % 7)) for i in range(200)] + [(900, None), (901, "")]
    monkeypatch.setattr(sg, "PASSED", 100)
    spark.conf.unset(BATCH)
    out = sg.recursive_split(spark.createDataFrame(texts, "doc_id long, text string"), 50, 10)
    assert spark.conf.get(BATCH) == str(BATCH_BYTES) and "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == sorted((i, k, p) for i, t in texts for k, p in enumerate(sg.split_text(t or "", 50, 10)))
