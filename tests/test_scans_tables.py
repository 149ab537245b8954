"""Returns by a scan across partitions, and upserts that persist."""

import glob
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators.scans import trajectory_returns
from graphloom.sources.keyed_table import KeyedTable


def brute(rows, gamma, lam, with_value):
    by, out = {}, {}
    for k, s, r, v in rows:
        by.setdefault(k, []).append((s, r or 0.0, (v or 0.0) if with_value else 0.0))
    for k, steps in by.items():
        a = nxt = 0.0
        for s, r, v in sorted(steps, reverse=True):
            a = r + gamma * nxt - v + gamma * lam * a
            nxt = v
            out[k, s] = (a, a + v)
    return out


@pytest.mark.parametrize("with_value", [False, True])
def test_returns_over_partitions(spark, with_value):
    rng = random.Random(4)
    rows = [(k, s, rng.choice([None, rng.uniform(-1, 2)]), rng.choice([None, rng.uniform(0, 3)])) for k, n in ((1, 700), (2, 1), (None, 40), (3, 5), (4, 300)) for s in range(n)]
    table = spark.createDataFrame(rows, "k long, s long, r double, v double").repartition(5)
    gamma, lam = 0.97, 0.8 if with_value else 1.0
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = trajectory_returns(table, "k", "s", "r", gamma, "v" if with_value else None, lam)
        parts = out.groupBy(F.spark_partition_id()).agg(F.countDistinct(F.coalesce("k", F.lit(-1))), F.count_if(F.col("k") == 1).alias("n")).collect()
        assert sum(p.n > 0 for p in parts) > 3, "one long trajectory lies in several tasks"
        got = {(r.k, r.s): (r.advantage, r["return"]) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    want = brute(rows, gamma, lam, with_value)
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in want)
    assert trajectory_returns(table.limit(0), "k", "s", "r", 0.9).count() == 0


def digests(path):
    return {p.split("/rows/")[1]: hashlib.md5(open(p, "rb").read()).hexdigest() for p in glob.glob(f"{path}/rows/*/*.parquet")}


def test_upserts(spark, tmp_path, monkeypatch):
    t = KeyedTable(spark, f"file://{tmp_path}/t", "k", "at", buckets=16)
    assert t.rows() is None
    rows = lambda values, at: spark.createDataFrame([(k, at, f"{k}@{at}") for k in values], "k long, at long, x string")
    t.upsert(rows([*range(50), None], 1))
    first = digests(tmp_path / "t")
    t.upsert(rows([3, 4, 3], 5))
    second = digests(tmp_path / "t")
    assert len(t.touched) <= 2 and {p for p in first if first[p] == second.get(p)} == {p for p in first if int(p.split("=")[1].split("/")[0]) not in t.touched}
    now = lambda: {r.k: r.x for r in t.rows().collect()}
    want = {k: f"{k}@1" for k in (*range(50), None)} | {3: "3@5", 4: "4@5"}
    assert now() == want
    t.upsert(rows([3, 4], 5))
    t.upsert(rows([3, None], 2))  # older than what is there, and newer
    assert now() == want | {None: "None@2"}
    # Lost after the log was written, with one bucket gone already: the next one finishes it.
    apply, calls = KeyedTable._apply, []
    monkeypatch.setattr(KeyedTable, "_apply", lambda self, n: calls.append(n))
    t.upsert(rows([7], 9))
    monkeypatch.setattr(KeyedTable, "_apply", apply)
    assert now()[7] == "7@1" and calls == [4]
    again = KeyedTable(spark, f"file://{tmp_path}/t", "k", "at", buckets=16)
    again.upsert(rows([8], 9))
    assert now() == want | {None: "None@2", 7: "7@9", 8: "8@9"} and t.rows().count() == 51
