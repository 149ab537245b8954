"""The stored BM25 index against a scan with the same formula."""

import math
import random
import re

from graphloom.sources import lexical_index as li

WORD = re.compile(r"\w+")


def ranked(corpus, queries, k):
    docs = {d: WORD.findall((t or "").lower()) for d, t in corpus if d is not None}
    mean, full = sum(map(len, docs.values())) / len(docs), sum(1 for w in docs.values() if w)
    df = {}
    for w in docs.values():
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for q, text in queries:
        found = []
        for d, w in docs.items():
            if set(w) & set(WORD.findall((text or "").lower())):
                s = sum(math.log((full - df[t] + 0.5) / (df[t] + 0.5) + 1) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / mean)) for t in WORD.findall(text.lower()) if t in df)
                found.append((-round(s, 9), -d))
        out += [(q, -d, r) for r, (_, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def corpus_of(n, seed=4):
    """Common words everywhere, names in a few documents."""
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.7)) % 3000}" for _ in range(60_000)]
    return [(i, " ".join(r.choices(words, k=r.randint(1, 60)) + [f"Name{i % 97}"] * (i % 5 == 0))) for i in range(n)]


def test_search_reads_blocks_that_can_matter(spark, tmp_path):
    corpus = corpus_of(1500) + [(5000, None), (5001, ""), (5002, "w1 " * 3000), (None, "name5 name5"), (5003, "name5"), (5004, "name5")]
    queries = [(1, "name5 w1"), (2, "NAME10 name10 name15"), (3, "w1 w2 w3"), (4, "unknown"), (5, None), (6, "name0"), (6, "w7")]
    d = spark.createDataFrame(corpus, "doc_id long, text string").repartition(4)
    held = li.LexicalIndex(spark, f"file://{tmp_path}/i").write(d)
    q = spark.createDataFrame(queries, "query_id long, text string")
    want = ranked(corpus, [(1, queries[0][1]), (2, queries[1][1]), (3, queries[2][1]), (6, "name0 w7")], 5)
    assert sorted((r.query_id, r.doc_id, r.rank) for r in held.search(q, 5).collect()) == want
    wanted, bounds, _ = held.plan(q, 5)
    read, shared = ({r.query_id: r["count"] for r in t.groupBy("query_id").count().collect()} for t in (wanted, bounds))
    assert read[1] < shared[1] / 2 and shared[1] > 40  # w1 is in all blocks, name5 in few; none of the others can hold one of the best
    assert all(read[q] <= shared[q] for q in shared)


def test_empty_index_and_no_queries(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string")
    ask = spark.createDataFrame([(1, "b")], "query_id long, text string")
    assert li.LexicalIndex(spark, f"file://{tmp_path}/n").write(none).search(ask, 3).collect() == []
    held = li.LexicalIndex(spark, f"file://{tmp_path}/s").write(some)
    assert held.search(ask.limit(0), 3).collect() == []
    assert [(r.doc_id, r.rank) for r in held.search(ask, 1 << 20).orderBy("rank").collect()] == [(2, 1), (1, 2)]


def test_parts_of_queries_and_slices_of_sums(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(li, "PART_TERMS", 4)
    corpus = corpus_of(300, seed=9)
    queries = [(f"q{i}", f"name{i} w{i} w1") for i in range(12)] + [(None, "w1")]
    held = li.LexicalIndex(spark, f"file://{tmp_path}/i").write(spark.createDataFrame(corpus, "doc_id long, text string"))
    q = spark.createDataFrame(queries, "query_id string, text string")
    assert len(held.plan(q, 4)[2]) > 3
    assert sorted((r.query_id, r.doc_id, r.rank) for r in held.search(q, 4).collect()) == ranked(corpus, queries[:-1], 4)
    assert sorted((r.query_id, r.doc_id) for r in held.scores(q).collect()) == sorted(x[:2] for x in ranked(corpus, queries[:-1], 1000))


def test_ranges_and_best_against_loops():
    """_ranges and _best, on which a block's sums rest, against loops."""
    import numpy as np

    r = random.Random(3)
    begin, n = np.array([r.randint(0, 50) for _ in range(40)]), np.array([r.randint(0, 6) for _ in range(40)])
    assert li._ranges(begin, n).tolist() == [b + i for b, m in zip(begin.tolist(), n.tolist()) for i in range(m)]
    query, score, ids = (np.array([r.randint(0, m) for _ in range(500)]) for m in (9, 5, 10**6))
    want = sorted(sorted((i for i in range(500) if query[i] == q), key=lambda i: (-score[i], -ids[i]))[:7] for q in range(10))
    got = li._best(query, score.astype(float), ids, 7).tolist()
    assert sorted([i for i in got if query[i] == q] for q in range(10)) == want


def test_a_task_holds_a_bounded_number_of_scores(spark, tmp_path, monkeypatch):
    """What runs of blocks give is passed on as it comes (all scores) or cut to the best so far (a search), never gathered by batch."""
    import numpy as np

    runs, largest = [], []
    block = lambda i: (np.arange(4), np.full(4, i), np.full(4, float(i % 7)))
    monkeypatch.setattr(li, "HELD", 64)
    for q, _, _ in li._gathered(map(block, range(1000)), None, None):
        runs.append(len(q))
    assert sum(runs) == 4000 and max(runs) <= 68

    def best(q, i, v):
        largest.append(len(q))
        return li._best(q, v, i, 3)

    ((q, i, v),) = li._gathered(map(block, range(1000)), 3, best)
    assert max(largest) <= 12 + 68
    assert sorted(zip(q.tolist(), v.tolist(), i.tolist())) == sorted((x, 6.0, n) for x in range(4) for n in (986, 993, 979))
    monkeypatch.undo()
    corpus, queries = corpus_of(400, 9), [(i, f"w{i} w1 name{i}") for i in range(30)]
    held = li.LexicalIndex(spark, f"file://{tmp_path}/g").write(spark.createDataFrame(corpus, "doc_id long, text string").repartition(3))
    found = held.search(spark.createDataFrame(queries, "query_id long, text string"), 4).collect()
    assert sorted((r.query_id, r.doc_id, r.rank) for r in found) == ranked(corpus, queries, 4)
    from graphloom.operators.retrieval import bm25

    again = bm25(spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(corpus, "doc_id long, text string"), 4)
    assert sorted((r.query_id, r.doc_id, r.rank) for r in again.collect()) == ranked(corpus, queries, 4)


def test_row_groups_of_few_blocks(spark, tmp_path, monkeypatch):
    """Spark's reader unpacks a row group's blocks at once (up to 4096), so a file of many has many groups; an empty one has none."""
    import glob

    import pyarrow.parquet as pq

    monkeypatch.setattr(li, "GROUP_BLOCKS", 3)
    d = spark.createDataFrame(corpus_of(32 * 40), "doc_id long, text string").coalesce(1)
    held = li.LexicalIndex(spark, f"file://{tmp_path}/i").write(d)
    for what in ("postings", "bounds"):
        files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{tmp_path}/i/{what}/*.parquet")]
        assert sum(m.num_rows for m in files) == 40
        assert max(m.row_group(g).num_rows for m in files for g in range(m.num_row_groups)) == 3
    assert held.search(spark.createDataFrame([(1, "w1")], "query_id long, text string"), 5).count() == 5
