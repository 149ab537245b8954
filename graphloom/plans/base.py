"""Registering queries with their SQL, and the tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def add(f: Callable[[Tables], DataFrame]):
            self.queries[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql:
                self.oracles[name] = sql
            return f

        return add


class Tables:
    """The parquet tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # Stand-ins for graphs, made of the given tables.
    @property
    def nodes(self) -> DataFrame:
        """Code-graph vertices: part rows."""
        return self.part.select(
            F.col("p_partkey").alias("id"), F.col("p_type").alias("type"), F.col("p_name").alias("name"), F.concat(F.lower(F.regexp_replace("p_brand", "#", "/")), F.lit(".cc")).alias("file_path")
        )

    @property
    def calls(self) -> DataFrame:
        """Typed edges with loops, cycles and hubs: lineitem's suppliers and parts."""
        return self.lineitem.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 97).alias("dst"), F.col("l_returnflag").alias("type")).distinct()

    @property
    def ring(self) -> DataFrame:
        """Sparse cyclic edges over vec_id."""
        v = self.embeddings.select("vec_id")
        n = v.count()
        e = lambda a, b: v.select(F.col("vec_id").alias("src"), ((F.col("vec_id") * a + b) % n).alias("dst"))
        return e(7, 1).union(e(13, 5)).distinct()

    @property
    def tree(self) -> DataFrame:
        """Acyclic containment over vec_id: child to parent is vec_id div 3, level by vec_id."""
        v = self.embeddings.select("vec_id")
        return v.where("vec_id > 0").select((F.col("vec_id") / 3).cast("long").alias("src"), F.col("vec_id").alias("dst"))


#: The same in SQL.
NODES = "select p_partkey as id, p_type as type, p_name as name, lower(replace(p_brand, '#', '/')) || '.cc' as file_path from part"
CALLS = "select distinct l_suppkey as src, l_partkey % 97 as dst, l_returnflag as type from lineitem"
RING = "select distinct src, dst from (select vec_id as src, (vec_id * 7 + 1) % (select count(*) from embeddings) as dst from embeddings union all select vec_id, (vec_id * 13 + 5) % (select count(*) from embeddings) from embeddings)"
TREE = "select vec_id // 3 as src, vec_id as dst from embeddings where vec_id > 0"
