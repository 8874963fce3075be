import math
import random
import re
from collections import Counter

import pytest

from gatewise.llm import ranked

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def _brute(docs, items, k):
    bags = [(i, Counter(_words(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item_id, text in set(items):
        found = []
        for i, b in bags:
            if not b:
                continue
            m = 25 + (75 * sum(b.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m)) for t in _words(text) if b[t])
            if s > 0:
                found.append((-s, i is None, i if i is not None else 0))
        out += [(item_id, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def _run(spark, docs, items, k=10):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in ranked.search(d, i, k).collect()), key=str)


def _corpus(n=400, seed=3):
    rnd = random.Random(seed)
    words = ["a", "B", "b", "été", "Été", "x1", "1", "漢字", "the", "THE", "Zz", "q", "r", "s", "I_d", "o'k"]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 30)))) for i in range(n)]
    docs += [(n + j, "the zz B") for j in range(60)]  # one class, more members than k
    docs += [(5000 - j, "b\tZZ--The!") for j in range(60)]  # the same bag in other words
    docs += [(7, "the zz B"), (7, "the zz B"), (None, "the zz b"), (None, "q q q"), (900, None), (901, ""), (902, " -- "), (903, "the " * 20_000 + "q")]
    items = [(0, "the ZZ b"), (1, "q r s the the"), (2, "nowhere"), (3, None), (4, ""), (5, "été 漢字"), (5, "x1 1"), (0, "the ZZ b"), (None, "a"), (6, "i d o k")]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = _corpus()
    for k in (1, 10):
        assert _run(spark, docs, items, k) == _brute(docs, items, k)


@pytest.mark.parametrize("few", [1000, 0])
def test_many_blocks_and_shards(spark, monkeypatch, few):
    monkeypatch.setattr(ranked, "BLOCK_TERMS", 3)
    monkeypatch.setattr(ranked, "FEW_BLOCKS", few)
    monkeypatch.setattr(ranked, "SHARD_ROWS", 7)
    docs, items = _corpus(120)
    assert _run(spark, docs, items) == _brute(docs, items, 10)


def test_words_that_pass_the_bitmap_by_chance(spark, monkeypatch):
    docs, items = _corpus(120)
    monkeypatch.setattr(ranked, "vocabulary_bitmap", lambda asked: b"\xff" * (ranked.BITS // 8))
    assert _run(spark, docs, items) == _brute(docs, items, 10)


def test_bitmap_has_every_term(spark):
    items = spark.createDataFrame([(i, f"w{i} v{i * 7}") for i in range(3000)], "item_id long, text string")
    bitmap = ranked.vocabulary_bitmap(ranked.item_terms(items))
    kept = ranked.Kept(bitmap)
    assert all(kept[f"w{i}".encode()] and kept[f"v{i * 7}".encode()] for i in range(3000))
    assert sum(kept[f"n{i}".encode()] for i in range(10_000)) < 50


def test_empty_tables_and_clashing_columns(spark):
    docs, items = _corpus(20)
    assert _run(spark, [], items) == [] and _run(spark, docs, []) == [] and _run(spark, [(1, None)], items) == []
    d = spark.createDataFrame([(1, "a b", "x", 1)], "doc_id long, text string, bag string, n int")
    i = spark.createDataFrame([(1, "a", "x", 1)], "item_id long, text string, item string, term int")
    assert ranked.search(d, i).count() == 1
