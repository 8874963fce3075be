import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from gatewise.llm import alignment as al
from gatewise.llm.bpe import vocabulary_path


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece

    a = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    sign = al.byte_signs()
    a_bytes = {i: bytes(sign.get(c, 63) for c in t) for t, i in a.get_vocab().items()}
    b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(len(b))]
    return a, b, a_bytes, b_bytes


def _brute(libraries, docs):
    """The contract, read literally: whole texts, offsets, all pairs of links that end together."""
    a, b, a_bytes, b_bytes = libraries
    rows, counts = [], Counter()
    for doc_id, text in docs:
        want = (" " + (text or "")).encode()
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        if not text or b"".join(a_bytes[i] for i in x) != want or b"".join(b_bytes[i] for i in y) != want:
            rows.append((doc_id, 0, 0, 0, [], ""))
            continue

        def ends(ids, table):
            at, out = 0, []
            for i in ids:
                at += len(table[i])
                out.append(at)
            return out

        xe, ye = ends(x, a_bytes), ends(y, b_bytes)
        cuts = sorted(set(xe) & set(ye))
        groups = []
        for lo, hi in zip([0, *cuts], cuts, strict=False):
            groups.append(",".join(str(i) for i, e in zip(x, xe, strict=True) if lo < e <= hi) + "|" + ",".join(str(i) for i, e in zip(y, ye, strict=True) if lo < e <= hi))
        at = dict(zip(ye, y, strict=True))
        links = [(i, at[e]) for i, e in zip(x, xe, strict=True) if e in at]
        counts.update(links)
        rows.append((doc_id, len(x), len(y), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = defaultdict(int)
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    out = [(d, na, nb, ng, len(li), sum(counts[p] == top[p[1]] for p in li), sum(counts[p] for p in li), h) for d, na, nb, ng, li, h in rows]
    return sorted(out, key=str)


TEXTS = [
    None,
    "",
    " ",
    "   ",
    "a",
    " a  b ",
    "Hello world, it's 2024!",
    "tabs\tand\n\nlines \n  mixed spaces \x1c x",
    "<|endoftext|> and </s> <s> <unk> <0x41>",
    "blank ▁ sign", "▁",
    "漢字かな交じり文と한국어 и кириллица",
    "emoji 😀👩‍👩‍👧 é ﬁ ㍍ ① ​",
    "x" * 300,
    "supercalifragilistic " * 20,
    "\x00 null and \x7f",
    "1234567890 " * 7 + "\r\n",
    "a \n b  \n  c\n",
]


def _texts(n, seed=5):
    rnd = random.Random(seed)
    signs = ["a", "b", "The", "ing", " ", "  ", "\n", "\t", ".", ",", "'s", "é", "ß", "漢", "😀", "1", "23", "-", " ", "_", "tion"]
    return ["".join(rnd.choices(signs, k=rnd.randint(1, 60))) for _ in range(n)]


def _run(spark, docs, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted((tuple(r) for r in al.alignment_report(d, **how).collect()), key=str)


def test_equals_brute_force(spark, libraries):
    docs = [(i, t) for i, t in enumerate(TEXTS + _texts(300))] + [(3, "a"), (3, "a"), (None, "a b"), (None, None)]
    assert _run(spark, docs) == _brute(libraries, docs)


def test_long_texts_in_ranges(spark, libraries):
    rnd = random.Random(1)
    texts = ["".join(rnd.choices(_texts(40), k=120)) for _ in range(6)] + ["y" * 4000, "word\n" * 900, "a▁b " * 500, "z " * 3000]
    docs = list(enumerate(TEXTS + texts))
    assert _run(spark, docs, long=50, size=37) == _brute(libraries, docs)
    assert _run(spark, docs, long=0, size=400) == _brute(libraries, docs)


def _same(x, y):
    return x[:4] == y[:4] and x.links.tolist() == y.links.tolist()


def test_ranges_hang_over(libraries):
    """A cuts at line ends, B at blanks: heads and tails are open, and composition closes them."""
    both = al.pair()
    text = "one two\nthree four\nfive six\n" * 30
    parts = []
    for _, a_at, a, b_at, b in al.ranges(text, 25):
        parts.append(al.fragment(both.tokens_a(a, a_at), both.tokens_b(b, b_at)))
    assert any(len(p.tail[0][0]) or len(p.tail[1][0]) for p in parts)
    want = both.closed(text)
    for order in ("left", "right", "tree"):
        now = list(parts)
        while len(now) > 1:
            if order == "left":
                now = [al.compose(now[0], now[1]), *now[2:]]
            elif order == "right":
                now = [*now[:-2], al.compose(now[-2], now[-1])]
            else:
                now = [al.compose(now[i], now[i + 1]) if i + 1 < len(now) else now[i] for i in range(0, len(now), 2)]
        assert _same(al.whole(now[0]), want)


def test_composition_of_arbitrary_token_streams():
    rnd = random.Random(2)
    for _ in range(300):
        n = rnd.randint(1, 40)
        ends = [sorted(rnd.sample(range(1, n + 1), rnd.randint(0, n - 1)) + [n + 1]) for _ in range(2)]
        ends = [np.array(e, np.int64) for e in ends]
        ids = [np.arange(len(e)) for e in ends]
        want = al.whole(al.fragment((ids[0], ends[0]), (ids[1], ends[1])))
        cuts = [sorted(rnd.choices(range(n + 2), k=3)) for _ in range(2)]
        parts = []
        for k in range(4):
            both = []
            for side in range(2):
                lo, hi = ([-1, *cuts[side]][k] if k else -1), ([*cuts[side], n + 1][k])
                keep = (ends[side] > lo) & (ends[side] <= hi)
                both.append((ids[side][keep], ends[side][keep]))
            parts.append(al.fragment(*both))
        left = al.compose(al.compose(al.compose(parts[0], parts[1]), parts[2]), parts[3])
        right = al.compose(parts[0], al.compose(parts[1], al.compose(parts[2], parts[3])))
        assert _same(al.whole(left), want) and _same(al.whole(right), want)


def test_empty_table_and_clashing_columns(spark):
    assert _run(spark, []) == []
    d = spark.createDataFrame([(1, "a b", 2, "p")], "doc_id long, text string, row int, pairs string")
    assert al.alignment_report(d).count() == 1


def test_counts_beyond_the_broadcast_bound(spark, libraries, monkeypatch):
    monkeypatch.setattr(al, "MOST_BROADCAST", 0)
    docs = list(enumerate(TEXTS + _texts(60)))
    assert _run(spark, docs) == _brute(libraries, docs)
