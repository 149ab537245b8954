"""Readers and writers. Paths are Spark's: any store that Spark reads; listings are DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def list_files(spark: SparkSession, root: str, extensions: list[str] | None = None) -> DataFrame:
    """(path, name, length, modified) of all files below root, without their contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("modificationTime").alias("modified"), "length")
    files = files.withColumn("name", F.substring_index("path", "/", -1))
    if extensions:
        files = files.where(F.col("name").rlike(r"\.(" + "|".join(e.lstrip(".") for e in extensions) + ")$"))
    return files


def without_names(files: DataFrame, names: list[str], anywhere: bool = False) -> DataFrame:
    """Files none of whose path parts is one of names (anywhere: none of whose own name contains one)."""
    if anywhere:
        return files.where(~F.col("name").rlike("|".join(names))) if names else files
    return files.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, names)))) if names else files


def within_depth(files: DataFrame, root: str, most: int) -> DataFrame:
    """Files at most so many folders below root, with folder and depth."""
    relative = F.regexp_replace(F.col("path"), "^.*?" + root.rstrip("/").split("://")[-1] + "/", "")
    return files.withColumn("folder", F.regexp_replace(relative, "/?[^/]*$", "")).withColumn("depth", F.size(F.split(relative, "/")) - 1).where(F.col("depth") <= most)


def read_markdown(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """(id, path, source, content) of .md files, those in or named dot-something left out; source is the first folder below root."""
    d = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    relative = F.regexp_replace("path", "^.*?" + root.rstrip("/").split("://")[-1] + "/", "")
    d = d.withColumn("relative", relative).where(~F.exists(F.split("relative", "/"), lambda x: x.startswith(".")))
    return d.select(F.md5("relative").alias("id"), "path", F.split_part("relative", F.lit("/"), F.lit(1)).alias("source"), "content")


def read_jsonl(spark: SparkSession, path: str, schema: str, keep_corrupt: bool = False) -> DataFrame:
    """JSON lines; blank lines are skipped, corrupt ones dropped or kept in _corrupt_record."""
    d = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return d if keep_corrupt else d.where("_corrupt_record is null").drop("_corrupt_record")


def result_files(files: DataFrame, include: list[str], exclude: list[str], any_of: list[str]) -> DataFrame:
    """Files whose names contain all, none and one of the given texts, sorted."""
    for x in include:
        files = files.where(F.col("name").contains(x))
    for x in exclude:
        files = files.where(~F.col("name").contains(x))
    if any_of:
        hit = F.lit(False)
        for x in any_of:
            hit = hit | F.col("name").contains(x)
        files = files.where(hit)
    return files.orderBy("name")


def read_results(spark: SparkSession, path: str, result_schema: str) -> DataFrame:
    """(path, test_type, result) of files that hold an object {metadata, results} or a bare array of results."""
    d = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    obj = F.from_json("value", f"struct<metadata: struct<test_type: string>, results: array<struct<{result_schema}>>>")
    arr = F.from_json("value", f"array<struct<{result_schema}>>")
    bare = F.ltrim("value").startswith("[")
    d = d.select("path", F.when(~bare, obj["metadata"]["test_type"]).alias("test_type"), F.when(bare, arr).otherwise(obj["results"]).alias("results"))
    return d.select("path", F.coalesce("test_type", F.lit("unknown")).alias("test_type"), F.explode("results").alias("result"))


def graph_of_json(d: DataFrame, column: str, u: str = "u", v: str = "v") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of graphs as JSON {nodes: [{id, type, label, body}], edges: [{u, v, edge_type}]} (or source, target)."""
    g = d.select(F.from_json(column, f"struct<nodes: array<struct<id: string, type: string, label: string, body: string>>, edges: array<struct<{u}: string, {v}: string, edge_type: string>>>").alias("g"))
    nodes = g.select(F.inline("g.nodes"))
    edges = g.select(F.inline("g.edges")).select(F.col(u).alias("src"), F.col(v).alias("dst"), F.col("edge_type").alias("type"))
    return nodes, edges


def graph_to_json(nodes: DataFrame, edges: DataFrame, u: str = "u", v: str = "v") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges as JSON lines, one each: graphs of any size are written in parts."""
    e = edges.select(F.to_json(F.struct(F.col("src").alias(u), F.col("dst").alias(v), F.col("type").alias("edge_type"))).alias("value"))
    return nodes.select(F.to_json(F.struct(*nodes.columns)).alias("value")), e


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(id, data) and (src, dst, data) of GraphML files; data is an array of (key, value)."""
    data = "data array<struct<_key: string, _VALUE: string>>"
    x = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    nodes = x("node", f"_id string, {data}").select(F.col("_id").alias("id"), "data")
    return nodes, x("edge", f"_source string, _target string, {data}").select(F.col("_source").alias("src"), F.col("_target").alias("dst"), "data")


def _escaped(column: str) -> Column:
    out = F.col(column).cast("string")
    for c, x in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(c), F.lit(x))
    return out


def _write_xml(elements: list[tuple[int, DataFrame]], frame: list[tuple[int, str]], path: str, parts: int) -> None:
    """Elements (DataFrames with value) between fixed lines, by place, in so many well-formed documents: path/part=k holds one file."""
    spark = elements[0][1].sparkSession
    lines = None
    for at, df in elements:
        rows = df.select(F.pmod(F.xxhash64("value"), F.lit(parts)).cast("long").alias("part"), F.lit(at).alias("at"), "value")
        lines = rows if lines is None else lines.union(rows)
    fixed = F.explode(F.array(*(F.struct(F.lit(at).alias("at"), F.lit(x).alias("value")) for at, x in frame)))
    whole = lines.union(spark.range(parts).select("id", fixed.alias("x")).select("id", "x.at", "x.value")).repartition(parts, "part")
    whole.sortWithinPartitions("part", "at", "value").select("part", "value").write.partitionBy("part").text(path)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str, parts: int = 4) -> None:
    n = nodes.select(F.concat(F.lit('<node id="'), _escaped("id"), F.lit('"/>')).alias("value"))
    e = edges.select(F.concat(F.lit('<edge source="'), _escaped("src"), F.lit('" target="'), _escaped("dst"), F.lit('"/>')).alias("value"))
    _write_xml([(1, n), (2, e)], [(0, "<graphml><graph>"), (3, "</graph></graphml>")], path, parts)


def write_gexf(nodes: DataFrame, edges: DataFrame, path: str, parts: int = 4) -> None:
    n = nodes.select(F.concat(F.lit('<node id="'), _escaped("id"), F.lit('" label="'), _escaped("label"), F.lit('"/>')).alias("value"))
    e = edges.select(F.concat(F.lit('<edge id="'), F.md5(F.concat_ws(":", F.col("src").cast("string"), F.col("dst").cast("string"))), F.lit('" source="'), _escaped("src"), F.lit('" target="'), _escaped("dst"), F.lit('"/>')).alias("value"))
    _write_xml([(1, n), (3, e)], [(0, '<gexf version="1.3"><graph defaultedgetype="directed"><nodes>'), (2, "</nodes><edges>"), (4, "</edges></graph></gexf>")], path, parts)


def write_vectors(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows that have a vector, by graph and class."""
    rows.where(F.col("vector").isNotNull()).write.mode(mode).partitionBy("graph", "class_name").parquet(path)


def cache_misses(wanted: DataFrame, cache: DataFrame, text: str) -> DataFrame:
    """Rows whose md5 key isn't in the cache (key)."""
    return wanted.withColumn("key", F.md5(F.col(text))).join(cache.select("key"), "key", "left_anti")


def file_digests(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.md5("content").alias("md5"))


def answered(rows: DataFrame, answer: str = "answer") -> DataFrame:
    """Problems with a final answer behind ####, as chat messages with the answer as label."""
    from graphloom.functions.text import final_answer

    out = rows.withColumn("label", final_answer(F.col(answer))).where("label is not null and label <> ''")
    return out.withColumn("messages", F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content"))))


def markdown_table(rows: list[dict], columns: list[str]) -> str:
    """A few rows as a markdown table."""
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(str(r.get(c, "")) for c in columns) + " |" for r in rows])


def latex_table(rows: list[dict], columns: list[str]) -> str:
    esc = lambda x: "".join("\\" + ch if ch in "&%$#_{}" else ch for ch in str(x))
    body = [" & ".join(esc(r.get(c, "")) for c in columns) + r" \\" for r in rows]
    return "\n".join([r"\begin{tabular}{" + "l" * len(columns) + "}", " & ".join(map(esc, columns)) + r" \\ \hline", *body, r"\end{tabular}"])


def as_strings(row: Column) -> Column:
    """A struct as JSON, for attributes that have no other form."""
    return F.to_json(row)


class YamlSource(DataSource):
    """format("yaml_cases"): lists of flat `key: value` mappings, below a `benchmark:` key or bare, as (path, case map)."""

    @classmethod
    def name(cls):
        return "yaml_cases"

    def schema(self):
        return "path string, case map<string, string>"

    def reader(self, schema):
        return YamlReader(self.options)


class YamlReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("path", "").split(",") if p]

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        import pyarrow.fs as pafs

        fs, at = pafs.FileSystem.from_uri(partition.value)
        with fs.open_input_stream(at) as f:
            for case in parse_cases(f.readall().decode()):
                yield partition.value, case


def parse_cases(text: str) -> list[dict[str, str]]:
    """Cases of the YAML subset above: items begin with `- `, values are plain, quoted, or literal blocks (|)."""
    cases: list[dict[str, str]] = []
    block: tuple[str, int] | None = None
    for line in text.split("\n"):
        body = line.lstrip(" ")
        indent = len(line) - len(body)
        if block and (indent > block[1] or not body):
            cases[-1][block[0]] += ("\n" if cases[-1][block[0]] else "") + line[block[1] + 2 :]
            continue
        block = None
        if not body or body.startswith("#") or body.rstrip() == "benchmark:":
            continue
        if body.startswith("- "):
            cases.append({})
            body, indent = body[2:], indent + 2
        if ":" in body and cases:
            key, _, value = body.partition(":")
            value = value.strip()
            if value in ("|", "|-"):
                block, value = (key.strip(), indent), ""
            elif len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
                value = value[1:-1]
            cases[-1][key.strip()] = value
    for case in cases:
        for k, v in case.items():
            case[k] = v.rstrip("\n")
    return cases


class PagedSource(DataSource):
    """A paginated interface, page by page until one is short. fetch (a pickled function of page and size, in hex) is injected."""

    @classmethod
    def name(cls):
        return "paged"

    def schema(self):
        return "id long, title string, keys array<string>"

    def reader(self, schema):
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.fetch, self.size = bytes.fromhex(options["fetch"]), int(options.get("size", "100"))

    def partitions(self):
        return [InputPartition(0)]  # how many pages there are shows only on the way

    def read(self, partition):
        import pickle

        fetch, page = pickle.loads(self.fetch), 1  # noqa: S301  the caller's own function
        while True:
            rows = fetch(page, self.size)
            for r in rows:
                yield r.get("id"), r.get("title"), sorted(r)
            if len(rows) < self.size:
                return
            page += 1


def read_issues(spark: SparkSession, fetch, size: int = 100) -> DataFrame:
    """(id, title) of all issues that fetch(page, size) gives, without pull requests."""
    from pyspark import cloudpickle

    spark.dataSource.register(PagedSource)
    d = spark.read.format("paged").option("fetch", cloudpickle.dumps(fetch).hex()).option("size", str(size)).load()
    return d.where(~F.array_contains("keys", "pull_request")).select("id", "title")
