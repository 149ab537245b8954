"""Bounded joins and searches on vectors against all pairs and whole scans."""

import random

import numpy as np
import pytest

from graphloom.operators import vector_join as vj
from graphloom.operators.retrieval import scored, top_k
from graphloom.sources.pivot_table import PivotTable

SCHEMA = "block string, id long, vector array<double>, cell_name string"


def clustered(n, centres=40, d=24, seed=5):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, d))
    middle /= np.linalg.norm(middle, axis=1)[:, None]
    x = middle[rng.integers(0, centres, n)] + 0.03 * rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1)[:, None]


def all_pairs(rows, least):
    out = []
    for i, (b, p, u, _) in enumerate(rows):
        for c, q, v, _ in rows[i + 1 :]:
            if b is not None and b == c and p != q and None not in (p, q, u, v) and len(u) == len(v) > 0 and all(x is not None and np.isfinite(x) for x in (*u, *v)):
                s = 0.0
                for x, y in zip(u, v):
                    s += x * y
                if s >= least:
                    out += [(p, q, s), (q, p, s)]
    return sorted(out)


def test_similar_pairs_by_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vj, "BUCKET_BYTES", 24 * 8 * 12)  # many buckets and tiles
    monkeypatch.setattr(vj, "TILE", 3)
    rng, x = random.Random(3), clustered(240, 12)
    rows = [(rng.choice(["p", "p", "q", None]), i, (x[i] * rng.choice([0.5, 1, 3])).tolist(), "c") for i in range(240)]
    rows += [("p", 7, x[3].tolist(), None), ("p", 500, rows[4][2], "c"), ("p", 500, rows[4][2], "c"), ("p", None, x[1].tolist(), "c"), ("p", 501, None, "c"), ("p", 502, [], "c")]
    rows += [("p", 503, [float("nan")] * 24, "c"), ("p", 504, [float("inf")] + [0.0] * 23, "c"), ("p", 505, [None] * 24, "c"), ("p", 506, [1.0, 2.0], "c"), ("p", 507, [1.0, 0.5], "c"), ("p", 508, [0.0] * 24, "c")]
    for least in (0.8, -0.4):
        got = vj.similar_pairs(spark.createDataFrame(rows, SCHEMA), least, pivots=9)
        assert sorted(map(tuple, got.collect())) == all_pairs(rows, least)
    assert not vj.similar_pairs(spark.createDataFrame([], SCHEMA), 0.5).collect()


def test_names_as_ids_and_blocks_of_any_kind(spark):
    d = spark.createDataFrame([(1, "a", [1.0, 0.0]), (1, "b", [0.9, 0.1]), (2, "c", [1.0, 0.0])], "block int, id string, vector array<float>")
    assert sorted((r.src, r.dst) for r in vj.similar_pairs(d, 0.5).collect()) == [("a", "b"), ("b", "a")]


def test_few_pairs_are_candidates(spark, monkeypatch):
    """Of the given vectors, random ones, under a tenth are multiplied whole; of clustered ones most pairs of buckets never meet."""
    given = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    n = vj.similar_pairs(given, 0.3, "label", "vec_id", "embedding", counts=True).agg({"pairs": "sum", "candidates": "sum", "found": "sum"}).first().asDict()
    assert n["sum(pairs)"] > 10_000 and 0 < n["sum(found)"] <= n["sum(candidates)"] < n["sum(pairs)"] / 10
    monkeypatch.setattr(vj, "BUCKET_BYTES", 24 * 8 * 50)
    x = clustered(1500)
    close = int((np.triu(x @ x.T, 1) >= 0.9).sum())
    d = spark.createDataFrame([("p", i, v.tolist(), "c") for i, v in enumerate(x)], SCHEMA)
    n = vj.similar_pairs(d, 0.9, pivots=40, counts=True).agg({"pairs": "sum", "found": "sum"}).first().asDict()
    assert n["sum(found)"] == close and n["sum(pairs)"] < 1500 * 1499 / 2 / 8


def test_a_crowded_block_is_split(spark, monkeypatch):
    """One vector in most rows: its pivot's rows lie in many buckets of like size."""
    monkeypatch.setattr(vj, "BUCKET_BYTES", 2 * 8 * 20)
    d = spark.createDataFrame([("p", i, [1.0, 0.0] if i % 4 else [0.0, 1.0], "c") for i in range(400)], SCHEMA)
    n = vj.similar_pairs(d, 0.5, pivots=2, counts=True).collect()
    assert sum(r.found for r in n) == 300 * 299 // 2 + 100 * 99 // 2
    assert max(r.pairs for r in n) < 60 * 60


@pytest.mark.parametrize("least", [None, 0.5])
def test_search_skips_cells(spark, tmp_path, least):
    x = clustered(2000)
    rows = [("p", i, v.tolist(), "c") for i, v in enumerate(x)] + [("p", 3000 + i, x[5].tolist(), "c") for i in range(4)]
    rows += [("p", 4000, None, "c"), ("p", 4001, [0.0] * 24, "c"), ("p", 4002, [1.0], "c"), ("p", 4003, [None] * 24, "c")]
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"file://{tmp_path}/d")
    d = spark.read.parquet(f"file://{tmp_path}/d")
    PivotTable(spark, f"file://{tmp_path}/t").write(d, cells=40)
    held = PivotTable(spark, f"file://{tmp_path}/t")  # opened again
    cells = spark.read.parquet(f"file://{tmp_path}/t/cells").count()
    for query in (x[5].tolist(), (x[77] * 4).tolist(), (-x[9]).tolist()):
        for k in (7, 2500):
            want = top_k(scored(d, query), k, least).select("id", "score", "cell_name").collect()
            assert held.top_k(query, k, least).select("id", "score", "cell_name").collect() == want
            if k == 7 and query == x[5].tolist():
                assert len(held.read) <= 4 < cells, held.read
    for query in ([0.0] * 24, [1.0, 2.0]):
        assert held.top_k(query, 5).select("id", "score").collect() == top_k(scored(d, query), 5).select("id", "score").collect()


def test_search_of_an_empty_table(spark, tmp_path):
    held = PivotTable(spark, f"file://{tmp_path}/e").write(spark.createDataFrame([], SCHEMA))
    assert held.top_k([1.0, 0.0], 3).collect() == [] and held.read == []
