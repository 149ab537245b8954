"""Builders of the code graph from analysis records, and the look-up of symbols around a range of lines.

Records may come in several rows a file: results are unions. Nodes are one an id (the first by name and path);
edges are a multiset, and their ends needn't be nodes of the same records. Null lists and maps are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import node_id, normalize_signature_udf
from graphloom.model import PropertyGraph
from graphloom.operators.filters import is_declaration

_SYMBOL = "array<struct<symbol: array<struct<symbolName: string, type: string>>, uri: struct<fsPath: string, path: string>>>"
_CALL = "map<string, array<struct<name: string, file_path: string>>>"
#: A file's analysis. bodies: function bodies by the functions' names.
FILE_ANALYSIS = (
    "file_path string, functions array<string>, bodies map<string, string>, global_variables array<string>, "
    "global_var_analysis map<string, struct<definition: struct<file_path: string>, references: array<struct<file_path: string>>>>, "
    f"struct_analysis map<string, struct<fields: array<struct<name: string>>, references: {_SYMBOL}>>, outgoing_calls {_CALL}, incoming_calls {_CALL}, "
    f"class_members map<string, array<struct<name: string, type: string>>>, class_references map<string, {_SYMBOL}>, referenced_files array<string>, referencing_files array<string>"
)
FOLDER_ANALYSIS = "folder_path string, files_analyzed array<string>, referenced_folders array<string>"
PREFIXES = {"file": "file", "folder": "folder", "function": "func", "global_variable": "var", "struct": "struct", "class": "class", "field": "field"}


def _id(kind: str, name: Column | None, path: Column) -> Column:
    name = F.lit(None).cast("string") if name is None else normalize_signature_udf(name) if kind == "function" else name
    return node_id(F.lit(PREFIXES[kind]), name, path)


def _node(rows: DataFrame, kind: str, name: Column | None, path: Column) -> DataFrame:
    shown = F.substring_index(path, "/", -1) if name is None else name
    return rows.select(_id(kind, name, path).alias("id"), F.lit(kind).alias("type"), shown.alias("name"), path.alias("file_path"))


def _edge(rows: DataFrame, src: Column, dst: Column, type: str) -> DataFrame:
    return rows.select(src.alias("src"), dst.alias("dst"), F.lit(type).alias("type"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _graph(nodes: list[DataFrame], edges: list[DataFrame]) -> PropertyGraph:
    first = F.min(F.struct("name", "file_path", "type")).alias("x")
    return PropertyGraph(_union(nodes).groupBy("id").agg(first).select("id", "x.type", "x.name", "x.file_path"), _union(edges))


def code_graph(files: DataFrame, exclude_declarations: bool = False) -> PropertyGraph:
    """The graph of FILE_ANALYSIS rows: six kinds of nodes (folders come from folder_graph) and all kinds of edges that an analysis yields.

    A variable is a node of the file that defines it; a function's use of a variable points to that variable's own
    definition (B6). With exclude_declarations, functions without a body are no nodes and have no edges.
    References of structs and classes are class_and_instance edges; those without a symbol are left out.
    """
    c, path = F.col, F.col("file_path")
    file = _id("file", None, path)
    nodes, edges = [_node(files, "file", None, path)], []

    structs = files.select("file_path", F.explode("struct_analysis").alias("of", "a"))
    fields = structs.select("file_path", F.explode("a.fields").alias("f"))
    nodes += [_node(structs, "struct", c("of"), path), _node(fields, "field", c("f.name"), path)]

    def instances(rows: DataFrame, kind: str, place: str) -> DataFrame:
        """Edges to what a struct or class is referred to by; rows: file_path, of, r."""
        rows = rows.where(F.size("r.symbol") > 0).select("file_path", "of", c("r.symbol")[0]["symbolName"].alias("name"), F.lower(c("r.symbol")[0]["type"]).alias("t"), c(f"r.uri.{place}").alias("at"))
        t = F.when(c("t") == "variable", "global_variable").otherwise(c("t"))
        alias = F.coalesce(*(F.when(t == k, p) for k, p in PREFIXES.items()), t)
        name = F.when(t == "function", normalize_signature_udf(c("name"))).otherwise(c("name"))
        return _edge(rows, _id(kind, c("of"), path), node_id(alias, name, c("at")), "class_and_instance")

    edges.append(instances(structs.select("file_path", "of", F.explode("a.references").alias("r")), "struct", "fsPath"))

    variables = files.select("file_path", "global_var_analysis", F.explode("global_variables").alias("name")).withColumn("a", c("global_var_analysis")[c("name")])
    own = variables.where(c("a.definition.file_path") == path)
    var = _id("global_variable", c("name"), path)
    nodes.append(_node(own, "global_variable", c("name"), path))
    edges.append(_edge(own, file, var, "contains_variable"))
    refs = own.select("file_path", "name", F.explode("a.references").alias("r")).where((c("r.file_path") != "") & (c("r.file_path") != path))
    edges.append(_edge(refs, _id("file", None, c("r.file_path")), var, "variable_references"))

    functions = files.withColumn("name", F.explode("functions")).withColumn("body", c("bodies")[c("name")])
    if exclude_declarations:
        functions = functions.where(~is_declaration(c("body")))
    func = _id("function", c("name"), path)
    nodes.append(_node(functions, "function", c("name"), path))
    edges.append(_edge(functions, file, func, "contains_function"))
    uses = functions.where(c("body") != "").select("file_path", "name", "body", "global_var_analysis", F.explode("global_variables").alias("v"))
    uses = uses.where(F.rlike("body", F.concat(F.lit(r"(?U)\b\Q"), c("v"), F.lit(r"\E\b"))))
    defined = F.coalesce(c("global_var_analysis")[c("v")]["definition"]["file_path"], F.lit(""))
    edges.append(_edge(uses, func, _id("global_variable", c("v"), defined), "function_uses_variable"))
    for column, type in (("outgoing_calls", "function_calls"), ("incoming_calls", "function_incoming")):
        calls = functions.select("file_path", "name", F.explode(c(column)[c("name")]).alias("k")).where((c("k.name") != "") & (c("k.file_path") != ""))
        other = _id("function", c("k.name"), c("k.file_path"))
        edges.append(_edge(calls, func, other, type) if column == "outgoing_calls" else _edge(calls, other, func, type))

    classes = files.select("file_path", F.explode("class_members").alias("of", "members"))
    members = classes.select("file_path", "of", F.explode("members").alias("m"))
    nodes += [_node(classes, "class", c("of"), path), _node(members.where("m.type = 'Field'"), "field", c("m.name"), path)]
    methods = members.where("m.type = 'Method'")
    edges.append(_edge(methods, _id("class", c("of"), path), _id("function", c("m.name"), path), "class_contains_method"))
    edges.append(instances(files.select("file_path", F.explode("class_references").alias("of", "rs")).select("file_path", "of", F.explode("rs").alias("r")), "class", "path"))

    for column, forth in (("referenced_files", True), ("referencing_files", False)):
        others = files.select("file_path", F.explode(column).alias("o"))
        ends = (file, _id("file", None, c("o")))
        edges.append(_edge(others, *(ends if forth else ends[::-1]), "file_references"))
    return _graph(nodes, edges)


def folder_graph(folders: DataFrame) -> PropertyGraph:
    """Folders, the files that they contain, and the folders that they refer to, from FOLDER_ANALYSIS rows; files' nodes come from code_graph."""
    path = F.col("folder_path")
    folder = _id("folder", None, path)
    files = folders.select("folder_path", F.explode("files_analyzed").alias("o"))
    others = folders.select("folder_path", F.explode("referenced_folders").alias("o"))
    edges = [_edge(files, folder, _id("file", None, F.col("o")), "folder_contains"), _edge(others, folder, _id("folder", None, F.col("o")), "file_references")]
    return _graph([_node(folders, "folder", None, path)], edges)


def mentions(text: Column, name: Column) -> Column:
    """Whether text has name as a whole word (of A-Z, a-z, 0-9 and _), whatever characters name has."""
    edge = "[^a-zA-Z0-9_]"
    return F.rlike(text, F.concat(F.lit(rf"(^|{edge})\Q"), name, F.lit(rf"\E($|{edge})")))


def enclosing(symbols: DataFrame, spans: DataFrame) -> DataFrame:
    """All pairs of a symbol (file, first_line, last_line, ...) and a span (file, start_line, end_line, ...) within its lines, both ends included.

    Joined by equality: a symbol of 2^k lines or more (and fewer than 2^(k+1)) lies in three blocks of 2^k lines at
    most, and a span's start in one block of each size that occurs. The symbol tree is given flat, children's
    lines being within their parents'.
    """
    size = F.floor(F.log2((F.col("last_line") - F.col("first_line") + 1).cast("double"))).cast("int")
    sized = symbols.where("first_line <= last_line").withColumn("__level", size)
    levels = F.broadcast(sized.select("__level").distinct())  # at most 64 rows
    blocks = sized.withColumn("__block", F.explode(F.sequence(F.expr("shiftright(cast(first_line as bigint), __level)"), F.expr("shiftright(cast(last_line as bigint), __level)"))))
    probes = spans.crossJoin(levels).withColumn("__block", F.expr("shiftright(cast(start_line as bigint), __level)"))
    met = blocks.join(probes, ["file", "__level", "__block"])
    return met.where("first_line <= start_line and last_line >= end_line").drop("__level", "__block")


def enclosing_symbols(symbols: DataFrame, spans: DataFrame) -> DataFrame:
    """enclosing(), where the symbol is a variable, field, function or method whose text (hover or body) mentions the span's wanted name."""
    kinds = ("Field", "Variable", "Function", "Method")
    return enclosing(symbols.where(F.col("kind").isin(*kinds)), spans).where(mentions(F.col("text"), F.col("wanted")))
