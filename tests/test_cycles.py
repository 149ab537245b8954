"""Components, cycles and paths against brute force on random graphs."""

import random

import pytest

from graphloom.operators import cycles as C
from graphloom.operators import graph as G


def graph(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def nodes_of(spark, n):
    return spark.range(n).select("id")


def reach(pairs, n):
    to = [{i} for i in range(n)]
    for _ in range(n):
        for a, b in pairs:
            to[a] |= to[b]
    return to


def brute_cycles(pairs, n, most):
    after, out = {}, set()
    for a, b in pairs:
        after.setdefault(a, set()).add(b)

    def grow(path):
        for b in after.get(path[-1], ()):
            if b == path[0]:
                out.add(tuple(path))
            elif b > path[0] and b not in path and len(path) < most:
                grow([*path, b])

    for i in range(n):
        grow([i])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_components_and_cycles(spark, seed):
    rng, n = random.Random(seed), 14
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range((12, 20, 30)[seed])] + [(3, 3), (5, 6), (5, 6)]
    to = reach(pairs, n)
    got = dict(map(tuple, C.strong_components(nodes_of(spark, n), graph(spark, pairs + [(None, 2), (2, None)])).collect()))
    assert got == {v: min(u for u in range(n) if u in to[v] and v in to[u]) for v in range(n)}
    found = [tuple(r.cycle) for r in C.cycles(graph(spark, pairs), 5).collect()]
    assert len(found) == len(set(found)) and set(found) == brute_cycles(set(pairs), n, 5)


def test_no_path_grows_without_a_cycle(spark, monkeypatch):
    n = 60
    pairs = [(a, b) for a in range(n) for b in range(a + 1, min(n, a + 8))]  # some 10^15 paths
    assert C.inner_edges(graph(spark, pairs)).isEmpty()
    assert C.cycles(graph(spark, pairs), 50).count() == 0
    assert C.strong_components(nodes_of(spark, 3), graph(spark, [])).where("id = component").count() == 3


def test_short_cycles_need_no_components(spark, monkeypatch):
    n = 3000
    pairs = [(i, (a * i + b) % n) for i in range(n) for a, b in ((7, 1), (13, 5))]  # two permutations: all is one component or few
    monkeypatch.setattr(C, "strong_components", None)
    for most in range(1, 7):
        found = [tuple(r.cycle) for r in C.cycles(graph(spark, pairs), most).collect()]
        assert len(found) == len(set(found)) and set(found) == brute_cycles(set(pairs), n, most)


@pytest.mark.parametrize("paths", [0, 1000])
def test_cycles_of_every_length(spark, monkeypatch, paths):
    rng, n = random.Random(4), 9
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(26)] + [(None, 2), (2, None), (1, 1), (1, 1)]
    monkeypatch.setattr(C, "PATHS", paths)
    want = brute_cycles({p for p in pairs if None not in p}, n, n)
    found = [tuple(r.cycle) for r in C.cycles(graph(spark, pairs), n + 3).collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert C.cycles(graph(spark, []), 5).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_explicit_cycle(spark, seed):
    rng, n = random.Random(seed), 40
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(45)] + [(30, 31), (31, 32), (32, 30), (32, 33)]
    edges = graph(spark, pairs)
    rest = G.levels(nodes_of(spark, n), edges).where("level is null")
    left = {r.id for r in rest.collect()}
    rows = C.explicit_cycles(rest, edges).collect()
    cycles = {}
    for r in rows:
        cycles.setdefault(r.cycle, []).append((r.position, r.id))
    assert cycles
    for name, row in cycles.items():
        row = sorted(row)
        assert [p for p, _ in row] == list(range(len(row)))
        ids = [i for _, i in row]
        assert ids[0] == name == min(ids) and len(set(ids)) == len(ids) and set(ids) <= left
        assert all((a, b) in set(pairs) for a, b in zip(ids, [*ids[1:], ids[0]]))
    before = {v: min(a for a, b in pairs if b == v and a in left) for v in left}
    behind = set()
    for v in left:  # each leftover node leads back to a cycle that is reported
        for _ in range(n):
            v = before[v]
        behind.add(v)
    assert behind <= {r.id for r in rows}
    assert C.explicit_cycles(rest.limit(0), edges).count() == 0


def test_paths_grow_only_where_they_can_end(spark):
    rng, n = random.Random(9), 10
    pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(18)} | {(0, 1), (1, 8), (8, 9)}
    pairs = {(a, b) for a, b in pairs if a != 9}
    want = set()

    def grow(path):
        onward = [b for a, b in pairs if a == path[-1]]
        if not onward:
            want.add(tuple(path))
        for b in onward:
            if b not in path and len(path) <= 5:
                grow([*path, b])

    grow([0])
    got = G.simple_paths(graph(spark, sorted(pairs)), 0, 5)
    assert {(tuple(r.path), r.depth) for r in got.collect()} == {(p, len(p) - 1) for p in want}
    trap = [(0, 1)] + [(a, b) for a in range(1, 12) for b in range(1, 12) if a != b] + [(0, 20)]
    assert [tuple(r.path) for r in G.simple_paths(graph(spark, trap), 0, 9).collect()] == [(0, 20)]


def test_shortest_path_by_parents(spark):
    rng, n = random.Random(2), 30
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(60)]
    far = {0: 0}
    for d in range(n):
        far.update({b: d + 1 for a, b in pairs if far.get(a) == d and b not in far})
    for target in range(n):
        got = [r.path for r in G.shortest_path(graph(spark, pairs), 0, target).collect()]
        assert len(got) == (target in far)
        if got:
            assert got[0][0] == 0 and got[0][-1] == target and len(got[0]) == far[target] + 1
            assert all(x in pairs for x in zip(got[0], got[0][1:]))
        if target > 12:
            break
