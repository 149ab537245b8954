"""Every overlap that the operator accepts has a seed."""

import itertools
import random

import pytest

from graphloom.llm import decontaminate as D
from graphloom.llm.decontaminate import Index, word_hashes


@pytest.mark.parametrize("n", [*range(1, 16), 20])
def test_every_accepted_overlap_is_found(n):
    words = [f"w{i}" for i in range(n)]
    index = Index([(7, " ".join(words))])
    for gone in itertools.combinations(range(n), n // 5):
        if n < 13 or not {0, n - 1} & set(gone):  # at an end of 13 words or more, the stretch is a shorter one
            text = ["before", *("other" if i in gone else w for i, w in enumerate(words)), "after"]
            assert [(i, m) for i, _, _, m, _ in index.overlaps(word_hashes(" ".join(text)))] == [(7, n)]


def brute(words, item):
    """Whether any alignment has a stretch of MIN_WORDS words (short items: the whole) of which 80 % are equal."""
    least = min(D.MIN_WORDS, len(item))
    for shift in range(-len(item) + least, len(words) - least + 1):
        begin, end = max(0, -shift), min(len(item), len(words) - shift)
        same = [0]
        for i in range(begin, end):
            same.append(same[-1] + (words[i + shift] == item[i]))
        if any(5 * (same[j] - same[i]) >= 4 * (j - i) for i in range(len(same)) for j in range(i + least, len(same))):
            return True
    return False


@pytest.mark.parametrize("block_words", [1 << 19, 40])
def test_recall_at_the_edge_is_whole(spark, monkeypatch, block_words):
    """Substitutions at and just beyond a fifth of the words, at any place, of items of any length."""
    monkeypatch.setattr(D, "BLOCK_WORDS", block_words)
    monkeypatch.setattr(D, "HELD", 1)
    monkeypatch.setattr(D, "CHUNK_WORDS", 500)
    rng = random.Random(12)
    items = [(k, [f"b{rng.randrange(400)}" for _ in range(rng.choice([1, 3, 6, 9, 12, 13, 14, 16, 19, 22, 27, 40]))]) for k in range(40)]
    docs = []
    for i in range(500):
        k, item = rng.choice(items)
        n = len(item) if len(item) <= D.MIN_WORDS else rng.randint(D.MIN_WORDS, len(item))
        begin = rng.randrange(len(item) - n + 1)
        part = item[begin : begin + n]
        for j in rng.sample(range(n), min(n, n // 5 + rng.randint(0, 1))):
            part[j] = "other"
        docs.append((i, [f"d{rng.randrange(300)}" for _ in range(rng.randint(0, 30))] + part + [f"d{rng.randrange(300)}" for _ in range(rng.randint(0, 30))]))
    want = {(i, k) for i, words in docs for k, item in items if brute(words, item)}
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").repartition(3)
    assert {(r.doc_id, r.item_id) for r in D.benchmark_overlaps(table, bench).collect()} == want
    assert {r.doc_id for r in D.clean_documents(table, bench).collect()} == {i for i, _ in docs} - {i for i, _ in want}
    assert 100 < len(want) < 600
