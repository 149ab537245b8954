"""Text segmentation: sections by markdown headers, recursive splits, small chunks merged."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.windows import coalesce_small
from graphloom.shared import small_batches, trim

SEPARATORS = ("\n\n", "\n", " ", "")
#: Characters of pieces that a task passes on at once.
PASSED = 1 << 20


def sections(docs: DataFrame, depth: int = 4, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ordinal, headers, content): sections at `#` to `####` lines outside fences, header lines kept; headers
    is the path of titles. Ordered by line within each document; documents are never brought together."""
    lines = docs.select(id, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    w = W.partitionBy(id).orderBy("pos")
    fence = F.sum(F.when(F.col("line").rlike("^\\s*```"), 1).otherwise(0)).over(w) % 2 == 1
    level = F.length(F.regexp_extract("line", rf"^(#{{1,{depth}}})\s", 1))
    lines = lines.withColumn("level", F.when(~fence, level).otherwise(0))
    lines = lines.withColumn("section", F.sum(F.when(F.col("level") > 0, 1).otherwise(0)).over(w))
    for k in range(1, depth + 1):  # the last title of level k since a higher header
        title = F.when(F.col("level") == k, F.concat(F.lit("="), F.regexp_replace("line", r"^#+\s+", ""))).when((F.col("level") > 0) & (F.col("level") < k), F.lit(""))
        lines = lines.withColumn(f"h{k}", F.last(title, ignorenulls=True).over(w))
    path = F.array_join(F.transform(F.filter(F.array(*(F.col(f"h{k}") for k in range(1, depth + 1))), lambda x: x.startswith("=")), lambda x: F.substring(x, 2, 1 << 20)), "/")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return lines.withColumn("headers", path).groupBy(id, F.col("section").alias("ordinal")).agg(F.max_by("headers", "pos").alias("headers"), joined.alias("content"))


def split_text(text: str, size: int, overlap: int, length=len, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most size, at the coarsest separator that helps, then the next; neighbours share up to overlap."""
    sep = next((s for s in separators if s == "" or s in text), "")
    rest = separators[separators.index(sep) + 1 :]
    parts = list(text) if sep == "" else text.split(sep)
    out: list[str] = []
    run: list[str] = []
    for p in parts:
        if length(p) > size and rest:
            if run:
                out.append(sep.join(run))
                run = []
            out += split_text(p, size, overlap, length, rest)
            continue
        if run and length(sep.join([*run, p])) > size:
            out.append(sep.join(run))
            while run and (length(sep.join(run)) > overlap or length(sep.join([*run, p])) > size):
                run.pop(0)
        run.append(p)
    if run:
        out.append(sep.join(run))
    return [x for x in out if x.strip()]


def recursive_split(docs: DataFrame, size: int = 600, overlap: int = 100, length=len, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ordinal, content); length is any function of a text, say a token count. Texts come and go in batches of a few MB."""

    small_batches(docs.sparkSession)
    rows = docs.select(id, F.col(text).alias("__text"))
    schema = T.StructType([rows.schema[0], T.StructField("ordinal", T.IntegerType()), T.StructField("content", T.StringType())])

    def split(batches):
        for batch in batches:
            at, ordinals, contents, held = [], [], [], 0
            for i, t in enumerate(batch.column(1)):
                pieces = split_text(t.as_py() or "", size, overlap, length)
                at += [i] * len(pieces)
                ordinals += range(len(pieces))
                contents += pieces
                held += sum(map(len, pieces))
                if held >= PASSED or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(ordinals, pa.int32()), pa.array(contents, pa.string())], names=schema.names)
                    at, ordinals, contents, held = [], [], [], 0
            trim()

    return rows.mapInArrow(split, schema)


def merge_small(chunks: DataFrame, least: int = 200, id: str = "doc_id") -> DataFrame:
    """(id, ordinal, content): chunks of a document merged while two neighbours together are shorter than least."""
    arr = chunks.groupBy(id).agg(F.array_sort(F.collect_list(F.struct("ordinal", "content"))).alias("c"))
    return arr.select(id, F.posexplode(coalesce_small(F.col("c.content"), least)).alias("ordinal", "content"))


def chunk(docs: DataFrame, size: int = 600, overlap: int = 100, least: int = 200) -> DataFrame:
    """(doc_id, ordinal, content) end to end: sections, splits, merges."""
    s = sections(docs)
    parts = recursive_split(s.withColumn("key", F.struct("doc_id", "ordinal")), size, overlap, id="key", text="content")
    flat = parts.select(F.col("key.doc_id").alias("doc_id"), F.struct(F.col("key.ordinal").alias("a"), F.col("ordinal").alias("b")).alias("ordinal"), "content")
    return merge_small(flat, least)
