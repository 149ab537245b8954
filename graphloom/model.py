"""Schemas of the records that operators work on, as Spark DDL, and the property-graph wrapper.

Readers should declare these schemas and fill defaults once: absent, null and empty are told apart nowhere
else. Edges are a multiset by default; last_wins gives one edge per (src, dst), later rows over earlier.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMAS: dict[str, str] = {
    "document": "id string, content string, metadata map<string, string>",
    "text_unit": "id string, content string, metadata map<string, string>, path string, source string, document_id string, tokens int, ordinal int, embedding array<float>, score double",
    "entity": "id string, kind string, type string, name string, description string, embedding array<float>, score double",
    "code_node": "id string, type string, name string, file_path string, body string, metadata map<string, string>, encoding struct<what: string, how: string, embedding: array<float>>",
    "code_edge": "src string, dst string, type string, metadata map<string, string>",
    "layered_node": "id string, type string, label string, body string, involved_functions array<string>",
    "function_body": "id string, graph_node_id string, relative_path string, filepath string, symbolName string, functionBody string",
    "symbols": "filepath string, symbols array<string>, symbolKinds array<string>",
    "file_status": "path string, in_refactor_scope boolean, refactored boolean, dependencies int, header string",
    "benchmark_case": "query string, file_path string, start_line int, end_line int, ground_truth string, description string, outputs map<string, string>",
    "reference": "query string, functions array<string>, variables array<string>",
    "task": "id string, status boolean, prompt array<struct<role: string, content: string>>, workspace string, branch string, commits array<string>",
    "trajectory": "task_id string, id string, status boolean, prompt array<struct<role: string, content: string>>, info string",
    "rollout": "group_id bigint, sample_idx int, reward double, kl array<double>, values array<double>, rewards array<double>",
    "scored": "input string, output string, reward double, seq bigint",
    "pair": "prompt string, chosen string, chosen_reward double, rejected string, rejected_reward double",
    "vector": "id string, text string, vector array<float>",
    "action": "action_type string, action_name string, action_desc string",
    "quality": "source string, metrics map<string, double>, has_errors boolean, errors array<string>",
}
#: Allowed types of code nodes and edges (fixed values).
NODE_TYPES = ("file", "function", "global_variable", "folder", "struct", "class", "field")
EDGE_TYPES = ("file_references", "function_calls", "variable_references", "contains_function", "contains_variable", "folder_contains", "function_uses_variable", "function_incoming", "class_contains_method", "class_contains_variable", "struct_and_instance", "class_and_instance")


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """df with missing columns added and nulls filled."""
    for c, v in defaults.items():
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v))
    return df


@dataclass(frozen=True)
class PropertyGraph:
    """vertices (id, type, ...) and edges (src, dst, type, ...)."""

    vertices: DataFrame
    edges: DataFrame

    def last_wins(self, seq: str) -> PropertyGraph:
        """One edge per (src, dst): the last by seq."""
        from graphloom.operators.joins import last_per

        return PropertyGraph(self.vertices, last_per(self.edges, ["src", "dst"], seq))

    def invalid(self, nodes: tuple[str, ...] = NODE_TYPES, edges: tuple[str, ...] = EDGE_TYPES) -> DataFrame:
        """(what, value): types beyond the allowed ones, and ends of edges that are no vertices."""
        v = self.vertices.where(~F.col("type").isin(*nodes)).select(F.lit("node type").alias("what"), F.col("type").cast("string").alias("value"))
        e = self.edges.where(~F.col("type").isin(*edges)).select(F.lit("edge type"), F.col("type").cast("string"))
        ends = self.edges.select(F.col("src").alias("id")).union(self.edges.select("dst")).join(self.vertices.select("id"), "id", "left_anti")
        return v.union(e).union(ends.select(F.lit("missing vertex"), F.col("id").cast("string"))).distinct()

    def subgraph(self, ids: DataFrame) -> PropertyGraph:
        from graphloom.operators.sets import induced

        return PropertyGraph(self.vertices.join(ids.select("id"), "id", "left_semi"), induced(self.edges, ids))

    def reachable(self, starts: DataFrame, max_depth: int | None, direction: str = "out") -> DataFrame:
        from graphloom.operators.graph import reachable

        return reachable(self.edges, starts, max_depth, direction)

    def components(self) -> DataFrame:
        from graphloom.operators.graph import components

        return components(self.vertices, self.edges)
