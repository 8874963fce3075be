"""Repeated passages around very common words, against brute force."""

import random
from collections import defaultdict

from gatewise.llm import suffix_dedup
from gatewise.llm.hashing import WordHashes, gram_hashes


def covered(spark, texts, gram, window):
    least = gram + window - 1
    words = {d: t.split() for d, t in enumerate(texts)}
    got, want, holders = defaultdict(set), defaultdict(set), defaultdict(set)
    for r in suffix_dedup.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), gram, window).collect():
        assert r.other_doc != r.doc_id and r.n_words >= least
        assert not got[r.doc_id] & set(range(r.start_word, r.end_word))
        got[r.doc_id].update(range(r.start_word, r.end_word))
    passages = {d: [tuple(w[i : i + least]) for i in range(len(w) - least + 1)] for d, w in words.items()}
    for d, p in passages.items():
        for x in p:
            holders[x].add(d)
    for d, p in passages.items():
        for i, x in enumerate(p):
            if len(holders[x]) > 1:
                want[d].update(range(i, i + least))
    return got, want


def small_grams(n, many=1):
    """Grams of n words with so small hashes that they are the places of nearly every passage that holds them."""
    cache = WordHashes()
    return sorted((f"common{i}" + " words" * (n - 1) for i in range(5000)), key=lambda t: gram_hashes(cache.array(t.encode().split()), n)[0])[:many]


def test_words_before_a_common_gram(spark):
    # two documents each share three words before a sentence that all hold; what follows differs
    (common,) = small_grams(3)
    texts = [f"a{i // 2} b{i // 2} c{i // 2} {common} r{i} s{i} t{i}" for i in range(40_000)]
    got, want = covered(spark, texts, 3, 4)
    assert got == want and len(want) == 40_000


def test_partner_behind_nearer_ones(spark):
    # A and B share two words before and three after; the Cs share more of what follows, the Ds more of what precedes
    texts = []
    for k, common in enumerate(small_grams(5, 30)):
        x, y = [f"x{k}n{i}" for i in range(3)], " ".join(f"y{k}n{i}" for i in range(3))
        texts.append(f"u{k}a {x[2]} {x[1]} {x[0]} {common} {y} y{k}n3 v{k}a")
        texts.append(f"u{k}b w{k}b {x[1]} {x[0]} {common} {y} z{k}b v{k}b")
        for c in range(8):
            texts.append(f"u{k}c{c} w{k}c{c} q{k}c{c} {common} {y} y{k}n3 v{k}c{c}")
            texts.append(f"u{k}d{c} {x[2]} {x[1]} {x[0]} {common} r{k}d{c} s{k}d{c} v{k}d{c}")
    got, want = covered(spark, texts, 5, 6)
    assert got == want and len(want) == 60


def test_texts_under_one_doc_id_are_apart(spark):
    w = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(w[:100])), (1, " ".join(w[100:])), (1, " ".join(w[100:])), (2, " ".join(w[140:] + ["end"])), (3, " ".join(["start"] + w[:60])), (4, " ".join(w[20:69])), (None, " ".join(w)), (5, None)]
    got = sorted(map(tuple, suffix_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(1, 0, 60, 60, 3), (1, 40, 100, 60, 2), (2, 0, 60, 60, 1), (3, 1, 61, 60, 1)]


def row(doc, tail, at=0):
    return suffix_dedup.Row(b"g ", tail.encode(), b"", doc, 0, at, 0, 4, 4, -1, -1, -1, None)


def test_neighbours_across_partitions():
    # partitions of every size, some of one document only, give what one partition gives
    rng = random.Random(4)
    for _ in range(300):
        rows = sorted({row(rng.choice((1, 1, 1, 2, 3)), "".join(rng.choice("ab") + " " for _ in range(3)), at) for at in range(rng.randrange(1, 14))}, key=lambda r: (r.tail, r.doc_id, r.at))
        want = {o.row._replace(tail_reach=o.best) for o in suffix_dedup.compared(rows, 4, 0)}
        cuts = sorted(rng.choices(range(len(rows) + 1), k=rng.randrange(4)))
        borders, outs = {}, {}
        for p, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
            if a < b:
                borders[p] = suffix_dedup.Border()
                outs[p] = list(suffix_dedup.compared(borders[p].passing(rows[a:b]), 4, 0))
        over = suffix_dedup.beyond(borders)
        assert {suffix_dedup.ended(o, over[p], 4, 0) for p, found in outs.items() for o in found} == want
        for r in want:  # the longest shared tail of any other document
            assert r.tail_reach == max((suffix_dedup.shared_words(r.tail, q.tail) for q in rows if q.doc_id != r.doc_id), default=-1)
