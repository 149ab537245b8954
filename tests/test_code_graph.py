"""The builders of the code graph and the symbols around a range, on hand-made records."""

import random

from graphloom.operators import code_graph as cg


def record(**x):
    names = [f.split()[0] for f in ("file_path functions bodies global_variables global_var_analysis struct_analysis outgoing_calls incoming_calls class_members class_references referenced_files referencing_files").split()]
    return tuple(x.get(n) for n in names)


def seen(name, type, path):
    return ([(name, type)], (path, path))


def test_code_graph(spark):
    a = record(
        file_path="src/a.c", functions=["f(int x)", "decl"], bodies={"f(int x)": "{\n v = w + $z;\n}", "decl": "void decl();"}, global_variables=["v", "w", "vv"],
        global_var_analysis={"v": (("src/a.c",), [("src/b.c",), ("src/a.c",)]), "w": (("src/b.c",), []), "vv": (("src/a.c",), None)},
        struct_analysis={"S": ([("x",), ("y",)], [seen("v", "Variable", "src/a.c"), ([], ("src/a.c", None))])},
        outgoing_calls={"f(int x)": [("g", "src/b.c"), ("", "src/b.c")]}, incoming_calls={"f(int x)": [("h", "src/b.c")]},
        class_members={"C": [("m", "Method"), ("n", "Field")]}, class_references={"C": [seen("g", "Function", "src/b.c")]}, referenced_files=["src/b.c"], referencing_files=["src/c.c"],
    )
    g = cg.code_graph(spark.createDataFrame([a, record(file_path="src/b.c")], cg.FILE_ANALYSIS))
    assert sorted(map(tuple, g.vertices.select("id", "type").collect())) == sorted([
        ("file:src/a.c", "file"), ("file:src/b.c", "file"), ("struct:src/a.c:S", "struct"), ("field:src/a.c:x", "field"), ("field:src/a.c:y", "field"), ("var:src/a.c:v", "global_variable"),
        ("var:src/a.c:vv", "global_variable"), ("func:src/a.c:f(int)", "function"), ("func:src/a.c:decl", "function"), ("class:src/a.c:C", "class"), ("field:src/a.c:n", "field"),
    ])
    f = "func:src/a.c:f(int)"
    edges = [
        ("struct:src/a.c:S", "var:src/a.c:v", "class_and_instance"), ("file:src/a.c", "var:src/a.c:v", "contains_variable"), ("file:src/a.c", "var:src/a.c:vv", "contains_variable"),
        ("file:src/b.c", "var:src/a.c:v", "variable_references"), ("file:src/a.c", f, "contains_function"), ("file:src/a.c", "func:src/a.c:decl", "contains_function"),
        (f, "var:src/a.c:v", "function_uses_variable"), (f, "var:src/b.c:w", "function_uses_variable"), (f, "func:src/b.c:g", "function_calls"), ("func:src/b.c:h", f, "function_incoming"),
        ("class:src/a.c:C", "func:src/a.c:m", "class_contains_method"), ("class:src/a.c:C", "func:src/b.c:g", "class_and_instance"), ("file:src/a.c", "file:src/b.c", "file_references"),
        ("file:src/c.c", "file:src/a.c", "file_references"),
    ]
    assert sorted(map(tuple, g.edges.collect())) == sorted(edges)
    bare = cg.code_graph(spark.createDataFrame([a], cg.FILE_ANALYSIS), exclude_declarations=True)
    assert "func:src/a.c:decl" not in {r.id for r in bare.vertices.collect()} | {r.dst for r in bare.edges.collect()}


def test_folder_graph(spark):
    g = cg.folder_graph(spark.createDataFrame([("src", ["src/a.c", "src/b.c"], ["lib"]), ("empty", None, None)], cg.FOLDER_ANALYSIS))
    assert {tuple(r) for r in g.vertices.collect()} == {("folder:src", "folder", "src", "src"), ("folder:empty", "folder", "empty", "empty")}
    assert sorted(map(tuple, g.edges.collect())) == [("folder:src", "file:src/a.c", "folder_contains"), ("folder:src", "file:src/b.c", "folder_contains"), ("folder:src", "folder:lib", "file_references")]


def test_enclosing_symbols(spark):
    rng = random.Random(2)
    symbols = []
    for i in range(60):
        a = rng.randint(0, 300)
        symbols.append((rng.choice("fg"), i, rng.choice(["Function", "Variable", "Class"]), a, a + rng.choice([0, 1, 7, 40, 300]), rng.choice(["x.y + 1", "xzy", "ax.y"])))
    spans = [(rng.choice("fg"), i, s, s + rng.choice([0, 3]), "x.y") for i, s in enumerate(rng.randint(0, 400) for _ in range(60))]
    got = cg.enclosing_symbols(spark.createDataFrame(symbols, "file string, symbol int, kind string, first_line int, last_line int, text string"), spark.createDataFrame(spans, "file string, id int, start_line int, end_line int, wanted string"))
    want = sorted((i, s) for f, s, k, a, b, t in symbols for g, i, c, d, _ in spans if f == g and a <= c and b >= d and k != "Class" and t == "x.y + 1")
    assert want and sorted((r.id, r.symbol) for r in got.collect()) == want
