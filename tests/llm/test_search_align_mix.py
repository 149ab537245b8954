"""Ranked search, tokenizer alignment and mixing against brute force, on hand-made inputs."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest

from graphloom.llm import queries as Q

DOCS = "doc_id long, text string, source string, lang string, term string, size int, row int, a int"


def frame(spark, rows):
    """(doc_id, text, source) with further columns of names that the operators use themselves."""
    return spark.createDataFrame([(*r, "en", "t", 3, 4, 5) for r in rows], DOCS).repartition(3)


def prose(rng, words, n):
    return " ".join(rng.choice(words) + rng.choice(["", ",", ".\n", "!", " -"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeéßж1") for _ in range(rng.randint(1, 4))) for _ in range(120)] + ["The", "of"] * 20
    out = [(i, prose(rng, words, rng.randint(1, 80)), rng.choice(["s1", "s2", "É", None])) for i in range(150)]
    out += [(200 + i, out[7][1], "hot") for i in range(40)]  # copies: equal scores
    out += [(300, None, "s1"), (301, "", None), (302, "-- \n ...", "s2"), (303, prose(rng, words, 20_000), "long"), (304, out[3][1], "s1"), (304, out[3][1], "s1"), (None, out[2][1], "s1"), (None, "of of", None)]
    return out


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(rows, items, k):
    docs = [(d, Counter(t)) for d, text, *_ in rows if d is not None and (t := terms(text))]
    n, length = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in docs:
            m = 75 + 25 * sum(c.values()) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                found.append((-s, d))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard,block,restricted", [(1 << 20, 200_000, True), (200, 30, True), (500, 200_000, False)])
def test_ranked_search(spark, rows, shard, block, restricted):
    from graphloom.llm import lexical as L

    rng = random.Random(3)
    items = [(i, " ".join(rng.sample(terms(rows[rng.randrange(150)][1]), 1) + rng.choices(["the", "of", "nowhere"], k=i % 4))) for i in range(12)]
    items += [(20, rows[7][1]), (21, None), (22, "..."), (23, "of of OF the"), (24, rows[303 - 300 + 150 + 40][1])]
    table = spark.createDataFrame([*items, items[1], (None, "of")], "item_id long, text string")
    vocabulary = L.item_terms(table).select("term").distinct() if restricted else None
    report = []
    got = L.search(L.build_index(frame(spark, rows), vocabulary, shard), table, k=6, block=block, report=report)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute_search(rows, items, 6)
    if shard == 200:
        opened = {t: sum(n for _, k, n in report if k == t) for t in (1, 2, 3)}
        assert opened[3] < opened[1], "no item was proved before the last tier"


def test_ranked_search_of_nothing(spark, rows):
    from graphloom.llm.lexical import ranked_search

    items = spark.createDataFrame([(1, "of")], "item_id long, text string")
    assert ranked_search(frame(spark, rows).limit(0), items).count() == 0
    assert ranked_search(frame(spark, rows), items.limit(0)).count() == 0
    assert ranked_search(frame(spark, [(1, None, None)]), items).count() == 0


def test_lower_tiers_are_not_read_by_the_first_pass(spark, rows):
    from graphloom.llm import lexical as L

    index = L.build_index(frame(spark, rows))
    plan = index.shards.select("shard", "doc_ids", "terms", "docs0").mapInArrow(lambda b: b, "shard long, doc_ids array<long>, terms array<string>, docs0 array<int>")
    assert "docs1" not in plan._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


@pytest.fixture(scope="module")
def two():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(Q.tokenizer_file())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=Q.tokenizer_file("piece_bpe_32k.model"))


def spans(ids, size):
    out, at = [], 0
    for i in ids:
        out.append((at, at + size(i), i))
        at += size(i)
    return out


def brute_alignment(texts, two):
    """Rows as the operator's, by comparing spans one by one."""
    from graphloom.llm.alignment import byte_level_alphabet

    a, b = two
    letters = byte_level_alphabet()
    a_bytes = lambda i: bytes(letters[c] for c in a.id_to_token(i))
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    seen, count = [], Counter()
    for text in texts:
        x, y, raw = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), b" " + text.encode()) if text else ([], [], b" ")
        if b"".join(map(a_bytes, x)) != raw or b"".join(map(b_bytes, y)) != raw:
            seen.append(None)
            continue
        x, y = spans(x, lambda i: len(a_bytes(i))), spans(y, lambda i: len(b_bytes(i)))
        found, first = [], 0
        for s, e, i in x:
            while y[first][1] <= s:
                first += 1
            k = first
            while k < len(y) and y[k][0] < e:
                found.append((i, y[k][2]))
                k += 1
        count.update(found)
        seen.append((x, y, found))
    top = defaultdict(int)
    for (_, i), n in count.items():
        top[i] = max(top[i], n)
    out = []
    for row in seen:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        x, y, found = row
        ends = sorted({e for _, e, _ in x} & {e for _, e, _ in y})
        group = lambda side: [",".join(str(i) for s, _, i in side if lo <= s < hi) for lo, hi in zip([0, *ends], ends)]
        said = ";".join(f"{p}|{q}" for p, q in zip(group(x), group(y)))
        out.append((len(x), len(y), len(ends), len(found), sum(count[p] == top[p[1]] for p in found), sum(count[p] for p in found), hashlib.sha256(said.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("sent", [2_000_000, 40, 0])
def test_alignment(spark, two, sent, monkeypatch):
    from graphloom.llm import alignment as A

    monkeypatch.setattr(A, "RUN", 400)
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdeéßжz19") for _ in range(rng.randint(1, 9))) for _ in range(80)]
    texts = [prose(rng, words, rng.randint(1, 25)) for _ in range(40)]
    texts += [None, "", " ", "a ", "  a  b   c ", "x<|endoftext|> </s> <s> [INST]", "odd ▁ blank", "ﬁ é 　", "日本語 \U0001f600\n\n\tx\r", texts[3], texts[3], "\x00a", "e" * 3000]
    table = frame(spark, [(i if i != 7 else None, t, None) for i, t in enumerate(texts)])
    got = A.align_tokenizers(table, Q.tokenizer_file(), Q.tokenizer_file("piece_bpe_32k.model"), sent)
    assert got.columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(i if i != 7 else None, *w) for i, w in enumerate(brute_alignment(texts, two))]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert want[46][1:] == (0, 0, 0, 0, 0, 0, "") and want[45][1] > 0
    assert A.align_tokenizers(table.limit(0), Q.tokenizer_file(), Q.tokenizer_file("piece_bpe_32k.model")).count() == 0


def test_chunks_as_the_library(two):
    from graphloom.llm.alignment import Sides

    rng = random.Random(5)
    both = Sides(Q.tokenizer_file(), Q.tokenizer_file("piece_bpe_32k.model"))
    texts = ["".join(rng.choice("ab  ,\n\té日<s>") for _ in range(rng.randint(1, 40))) for _ in range(400)]
    assert [np.frombuffer(x, "<i4").tolist() for x in both.b_ids(texts)] == two[1].encode(texts)


def brute_targets(sizes, weights, share, most):
    """Shares by weight; what is above a bound is shared again until none is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, fixed, excess = dict.fromkeys(names, 0.0), set(), share * sum(sizes.values())
    while excess > 1e-9 and len(fixed) < len(names):
        open_ = [s for s in names if s not in fixed]
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += excess * weight[s] / total
        excess = 0.0
        for s in open_:
            if target[s] > most * sizes[s]:
                excess += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                fixed.add(s)
    return target


def test_mixing(spark, rows, monkeypatch):
    from graphloom.llm import mixing as M

    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    target = brute_targets(sizes, (5, 2, 1), 1.5, 2)
    seen = []
    for bucket, sent in ((512, 500_000), (2, 500_000), (2, 0), (2, 0)):
        monkeypatch.setattr(M, "BUCKET", bucket)
        monkeypatch.setattr(M, "MOST_SENT", sent)
        got = [tuple(r) for r in M.mix_sources(frame(spark, rows)).collect()]
        seen.append(sorted(got, key=str))
        assert sorted((str(r[0]), r[1], r[2], r[3]) for r in got) == sorted((str(d), size(t), sizes[s], pytest.approx(target[s])) for d, t, s in rows)
        assert all(0 <= r[4] <= 2 * r[1] and r[4] == r[1] * r[5] for r in got)
        taken = defaultdict(int)
        for _, _, whole, _, words, _ in got:
            taken[whole] += words
        assert len(set(sizes.values())) == len(sizes)  # a source is known by its size here
        for s in sizes:
            largest = max(size(t) for _, t, of in rows if of == s)
            few = len({size(t) for _, t, of in rows if of == s}) < 5  # documents of one size or one alone: half of one may be missed
            assert abs(taken[sizes[s]] - target[s]) <= (largest / 2 if few else 1), (s, taken[sizes[s]], target[s])
    assert seen[1] == seen[3] == seen[2]
    assert M.mix_sources(frame(spark, rows).limit(0)).count() == 0
    assert [(r.size, r.taken, r.target) for r in M.mix_sources(frame(spark, [(1, None, None), (2, "", "x")])).collect()] == [(0, 0, 0.0)] * 2


def test_nearest_sum_is_the_best():
    from graphloom.llm.mixing import fit_budget, nearest_sum

    rng = random.Random(6)
    for _ in range(300):
        sizes = rng.sample(range(1, 30), rng.randint(1, 4))
        counts = [rng.randint(0, 3) for _ in sizes]
        budget = rng.randint(0, 60)
        take = nearest_sum(sizes, counts, budget)
        assert all(take.get(s, 0) <= c for s, c in zip(sizes, counts))
        best = min((abs(sum(map(int.__mul__, sizes, x)) - budget), sum(map(int.__mul__, sizes, x))) for x in product(*(range(c + 1) for c in counts)))
        found = sum(s * n for s, n in take.items())
        assert (abs(found - budget), found) == best
    sizes, counts = np.arange(1, 4000), np.full(3999, 50)
    whole = int((sizes * counts).sum())
    for part, window in product((0.1, 0.5, 0.937), (1 << 14, 5000, 16)):
        take = fit_budget(sizes, counts, whole * part, window)
        assert (take <= counts).all() and (take >= 0).all() and abs(int((sizes * take).sum()) - whole * part) <= 1
        assert abs(take / counts - part).max() <= 1  # no length is left out or used up
        assert np.abs(take[500:] - counts[500:] * part).max() <= 2
    assert fit_budget(np.array([7]), np.array([2]), 9.0).tolist() == [1]
    assert nearest_sum([3], [2], -5) == {}
    assert not any(nearest_sum([10], [1], b) for b in range(5)) and nearest_sum([10], [1], 6) == {10: 1}
