"""Projections, filters and predicates over nodes (id, type, name, file_path, ...) and edges (src, dst, type)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that stand for "nothing" in evaluation lists (fixed values).
PLACEHOLDERS = ("<none>", "none", "(none)", "n/a", "null", "")
#: (kind of the source, relationship, kind of the target) that a document relation may have (fixed values).
RELATION_TRIPLES = (("SEMANTIC", "USE", "CODE"), ("SEMANTIC", "CONTAIN", "SEMANTIC"), ("CODE", "IMPLEMENT", "SEMANTIC"))


def normalize_path(path: Column) -> Column:
    """Backslashes to slashes, doubled slashes and a leading ./ removed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/{2,}", "/"), r"^\./", "")


def glob_regex(pattern: str) -> str:
    """A glob (*, ?, [set], [!set]) as an anchored regular expression."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            body = re.sub(r"([\\\[&~])", r"\\\1", pattern[i + 1 : end])
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def where_equal(df: DataFrame, **wanted) -> DataFrame:
    """Rows equal in all given columns; a None asks for nothing."""
    for c, v in wanted.items():
        if v is not None:
            df = df.where(F.col(c) == v)
    return df


def nodes_by_file(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where(normalize_path(F.col("file_path")) == normalize_path(F.lit(path)))


def nodes_by_glob(nodes: DataFrame, pattern: str, type: str | None = None) -> DataFrame:
    return where_equal(nodes.where(F.col("name").rlike(glob_regex(pattern))), type=type)


def edges_by_regex(edges: DataFrame, source: str | None = None, target: str | None = None, ignore_case: bool = False, type: str | None = None) -> DataFrame:
    """Unanchored search in both ends."""
    flag = "(?i)" if ignore_case else ""
    for c, p in (("src", source), ("dst", target)):
        if p is not None:
            edges = edges.where(F.col(c).cast("string").rlike(flag + p))
    return where_equal(edges, type=type)


def drop_self_loops(edges: DataFrame) -> DataFrame:
    """Edges whose ends differ; two null ends are equal."""
    return edges.where(~F.col("src").eqNullSafe(F.col("dst")))


def is_declaration(body: Column) -> Column:
    """Whether a function body is no more than a declaration."""
    t = F.trim(F.coalesce(body, F.lit("")))
    lines = F.filter(F.split(t, "\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("//"))
    return (t == "") | t.endswith(";") & ~t.contains("{") | (F.size(lines) <= 1) & ~t.contains("{")


def functions_with_body(functions: DataFrame, pattern: str | None = None) -> DataFrame:
    found = functions.where(F.col("body").isNotNull() & ~is_declaration(F.col("body")))
    if pattern:
        found = found.where(F.col("name").rlike(pattern))
    return found.withColumn("body_length", F.length("body"))


def declarations(functions: DataFrame) -> DataFrame:
    return functions.where(F.col("body").isNotNull() & is_declaration(F.col("body")))


def keyword_search(nodes: DataFrame, keyword: str, columns: list[str], limit: int, type: str | None = None, order: str = "id") -> DataFrame:
    """Case-insensitive substring in any column; the first by order."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.col(c).cast("string")).contains(keyword.lower())
    return where_equal(nodes.where(hit), type=type).orderBy(order).limit(limit)


def mask_target(nodes: DataFrame, edges: DataFrame, target, flow_type: str) -> tuple[DataFrame, DataFrame]:
    """Hide a node's solution: its contained flows go, as do its out-edges, and its body is null."""
    flows = edges.where((F.col("src") == F.lit(target)) & (F.col("type") == "contains")).select(F.col("dst").alias("id")).join(nodes.where(F.col("type") == flow_type).select("id"), "id", "left_semi")
    left = nodes.join(flows, "id", "left_anti").withColumn("body", F.when(F.col("id") != F.lit(target), F.col("body")))
    gone = lambda e, c: e.join(flows.withColumnRenamed("id", c), c, "left_anti")
    return left, gone(gone(edges, "src"), "dst").where(F.col("src") != F.lit(target)).select(*edges.columns)


def both_ends_contain(edges: DataFrame, text: str) -> DataFrame:
    return edges.where(F.col("src").cast("string").contains(text) & F.col("dst").cast("string").contains(text))


def valid_relations(relations: DataFrame, types: list[str], triples=RELATION_TRIPLES) -> DataFrame:
    """Rows (source_kind, relationship, target_kind, type) with an allowed type and an allowed triple."""
    spark = relations.sparkSession
    allowed = spark.createDataFrame(list(triples), "source_kind string, relationship string, target_kind string")  # a fixed few rows
    return relations.where(F.col("type").isin(*types)).join(F.broadcast(allowed), ["source_kind", "relationship", "target_kind"], "left_semi")


def valid_cases(cases: DataFrame, evaluation: str = "evaluation", error: str = "error") -> DataFrame:
    return cases.where(F.col(evaluation).isNotNull() & F.col(error).isNull())


def drop_placeholders(items: Column) -> Column:
    """An array without its placeholders, whatever their case and outer blanks."""
    return F.filter(items, lambda x: x.isNotNull() & ~F.lower(F.trim(x)).isin(*PLACEHOLDERS))


def path_rules(files: DataFrame, dropped: str, under: str, kept: list[str], column: str = "path") -> DataFrame:
    """Without files in a folder named dropped; directly under a given folder, only certain folders."""
    parts = F.split(F.col(column), "/")
    inside = F.col(column).startswith(under + "/")
    folder = F.element_at(parts, len(under.split("/")) + 1)
    return files.where(~F.array_contains(parts, dropped) & (~inside | folder.isin(*kept)))


def longer_than(functions: DataFrame, lines: int) -> DataFrame:
    return functions.where(F.col("end_line") - F.col("start_line") + 1 > lines)


def pending_in_scope(files: DataFrame, order: list[str]) -> DataFrame:
    return files.where(F.col("in_scope") & ~F.col("done")).orderBy(*order)


def search_lines(texts: DataFrame, pattern: str, literal: bool = False, ignore_case: bool = False, whole_word: bool = False, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, line_no, line): lines that match, line numbers from 1."""
    p = re.escape(pattern) if literal else pattern
    p = rf"\b(?:{p})\b" if whole_word else p
    lines = texts.select(id_col, F.posexplode(F.split(F.col(text_col), "\n")).alias("at", "line"))
    return lines.where(F.col("line").rlike(("(?i)" if ignore_case else "") + p)).select(id_col, (F.col("at") + 1).alias("line_no"), "line")


def prompts_that_fit(rows: DataFrame, length: str, max_length: int, reserve: int = 2) -> DataFrame:
    return rows.where(F.col(length) < max_length - reserve)


def with_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with in_degree, out_degree and degree."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select(F.col("dst"), F.lit(0), F.lit(1)))
    d = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return nodes.join(d, "id", "left").withColumn("in_degree", zero("in_degree")).withColumn("out_degree", zero("out_degree")).withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def rows_in_order(ids: DataFrame, rows: DataFrame, key: str = "id", position: str = "pos") -> DataFrame:
    """Rows of the listed ids, in the list's order."""
    return ids.join(rows, key).orderBy(position)


def needs_embedding(nodes: DataFrame) -> DataFrame:
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return nodes.where(filled("what") & filled("how") & F.col("embedding").isNull())


def active(rows: DataFrame, status: str = "status") -> DataFrame:
    """Status true or missing."""
    return rows.where(F.coalesce(F.col(status), F.lit(True)))


def replace_lines(text: Column, start: int, end: int, new: Column) -> Column:
    """Lines start to end (from 1, inclusive; -1: the last) replaced."""
    lines = F.split(text, "\n")
    last = F.size(lines) if end == -1 else F.lit(end)
    return F.array_join(F.concat(F.slice(lines, 1, start - 1), F.split(new, "\n"), F.slice(lines, last + 1, F.greatest(F.size(lines) - last, F.lit(0)))), "\n")


def blank_body(text: Column, start: int, end: int) -> Column:
    """Lines between start and end blanked, both kept."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x, i: F.when((i + 1 > start) & (i + 1 < end), F.lit("")).otherwise(x)), "\n")


def case_subset(cases: DataFrame, test_type: str, ignored: list[str], sample: int = 10, seed: int = 0) -> DataFrame:
    """The cases of a test type: by length (96), by file (168), a seeded sample (10), else one."""
    by_length = cases.where(F.col("end_line") - F.col("start_line") >= 20)
    if "96" in test_type:
        return by_length
    if "168" in test_type:
        return cases.where(~F.col("file_path").isin(*ignored))
    draw = F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed))))
    return by_length.orderBy(draw, "id").limit(sample) if "10" in test_type else cases.orderBy("id").limit(1)
