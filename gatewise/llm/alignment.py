"""Alignment of two tokenizers' tokens over the same bytes, and statistics of linked ids.

Tokens of A (byte-level BPE) and B (pieces with byte fallback) are laid over
the bytes of space + text.  Offsets where both end cut the bytes into groups;
the last A and the last B token of a group are linked.

A stretch of tokens is a ``Fragment``: an open head up to its first common
end, closed groups, an open tail.  ``compose`` joins two neighbours by merging
the left one's open end with the right one's head.  It is associative, so a
document may be cut anywhere where its tokenizer cannot merge across.  A text
is one fragment, but a very long one is dealt as byte ranges to many tasks.
Each tokenizer has its own cuts (A at any white space, B at blanks), so tokens
hang over on either side; the fragments are composed by a tree of Spark
groupings.

Where texts are cut follows from the tokenizers: A's pattern never matches a
sign and a following white space in one token, and B has no piece with a blank
behind another sign (checked when it is loaded).
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from functools import cache
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatewise.llm.batches import bound_batches
from gatewise.llm.bpe import UNUSUAL, encoder, vocabulary_path
from gatewise.llm.store import MOST_BROADCAST, hot_join
from gatewise.operators.common import materialize

LONG = 48 * 1024  # characters; longer texts are dealt in ranges
RANGE = 16 * 1024
FAN = 8
BLANK = "▁"

_CUT_A = re.compile(r"(?<=\S)[ \n\t\r]")
_CUT_B = re.compile(r"(?<=[^ ]) ")

Tokens = tuple[np.ndarray, np.ndarray]  # ids and the byte offsets where they end


# ---- the monoid ----------------------------------------------------------------------------


class Closed(NamedTuple):
    """Groups with both ends known: counts, their text form, their links (A id * 2^32 + B id)."""

    n_a: int
    n_b: int
    n_groups: int
    text: str
    links: np.ndarray


class Fragment(NamedTuple):
    """``cut``: there is a common end.  Without one all tokens are in the head."""

    head: tuple[Tokens, Tokens]
    closed: Closed
    tail: tuple[Tokens, Tokens]
    cut: bool


NO_IDS = np.empty(0, np.int64)
NOTHING: Tokens = (NO_IDS, NO_IDS)
OPEN = (NOTHING, NOTHING)
NONE_CLOSED = Closed(0, 0, 0, "", NO_IDS)


def _plus(x: Tokens, y: Tokens) -> Tokens:
    return np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]])


def _part(x: Tokens, start: int, end: int | None) -> Tokens:
    return x[0][start:end], x[1][start:end]


def _join(*parts: Closed) -> Closed:
    parts = tuple(p for p in parts if p.n_groups)
    if len(parts) == 1:
        return parts[0]
    return Closed(sum(p.n_a for p in parts), sum(p.n_b for p in parts), sum(p.n_groups for p in parts), ";".join(p.text for p in parts), np.concatenate([NO_IDS, *(p.links for p in parts)]))


def common_ends(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Places of the A and of the B tokens that end where the other side ends too."""
    if not len(a[1]) or not len(b[1]):
        return NO_IDS, NO_IDS
    base = min(a[1][0], b[1][0])
    both = np.zeros(max(a[1][-1], b[1][-1]) - base + 1, np.int8)
    both[a[1] - base] += 1
    both[b[1] - base] += 1
    return np.flatnonzero(both[a[1] - base] == 2), np.flatnonzero(both[b[1] - base] == 2)


@cache
def _written(n: int) -> np.ndarray:
    """Text of each id behind a comma, a semicolon and a bar."""
    return np.array([f"{sign}{i}" for sign in ",;|" for i in range(n)], dtype=object)


def close(a: Tokens, b: Tokens) -> Closed:
    """Of tokens whose last ones end together: every group, written in order."""
    last_a, last_b = common_ends(a, b)
    if not len(last_a):
        return NONE_CLOSED
    n = int(max(a[0].max(), b[0].max())) + 1
    n = 1 << n.bit_length()
    first_a, first_b = np.append(0, last_a[:-1] + 1), np.append(0, last_b[:-1] + 1)
    sizes_a, sizes_b = last_a + 1 - first_a, last_b + 1 - first_b
    out = np.empty(len(a[0]) + len(b[0]), np.int64)
    sign_a, sign_b = a[0].copy(), b[0].copy()
    sign_a[first_a] += n
    sign_b[first_b] += 2 * n
    out[np.arange(len(a[0])) + np.repeat(first_b, sizes_a)] = sign_a  # behind the B tokens of earlier groups
    out[np.arange(len(b[0])) + np.repeat(last_a + 1, sizes_b)] = sign_b  # behind the A tokens up to this group
    return Closed(len(a[0]), len(b[0]), len(last_a), "".join(_written(n)[out].tolist())[1:], a[0][last_a] << 32 | b[0][last_b])


def fragment(a: Tokens, b: Tokens) -> Fragment:
    """Of the tokens of one byte range; offsets are those in the whole document."""
    last_a, last_b = common_ends(a, b)
    if not len(last_a):
        return Fragment((a, b), NONE_CLOSED, OPEN, False)
    x, y, i, j = last_a[0] + 1, last_b[0] + 1, last_a[-1] + 1, last_b[-1] + 1
    return Fragment((_part(a, 0, x), _part(b, 0, y)), close(_part(a, x, i), _part(b, y, j)), (_part(a, i, None), _part(b, j, None)), True)


def compose(x: Fragment, y: Fragment) -> Fragment:
    """``x`` followed by ``y``; associative, with ``fragment(NOTHING, NOTHING)`` as its one."""
    left = x.tail if x.cut else x.head
    seam = fragment(_plus(left[0], y.head[0]), _plus(left[1], y.head[1]))
    if not seam.cut:
        return Fragment(x.head, x.closed, seam.head, True) if x.cut else seam
    tail = y.tail if y.cut else seam.tail
    if x.cut:
        return Fragment(x.head, _join(x.closed, close(*seam.head), seam.closed, y.closed), tail, True)
    return Fragment(seam.head, _join(seam.closed, y.closed), tail, True)


def whole(f: Fragment) -> Closed | None:
    """All groups of a whole document; None if tokens are left over."""
    left = f.tail if f.cut else f.head
    if len(left[0][0]) or len(left[1][0]):
        return None
    return _join(close(*f.head), f.closed) if f.cut else NONE_CLOSED


# ---- the tokenizers --------------------------------------------------------------------------


def byte_signs() -> dict[str, int]:
    """Sign of a byte-level vocabulary -> byte: printable bytes stand for themselves, the rest count up from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """Both tokenizers, and the bytes of their entries."""

    def __init__(self, a_path: str | None = None, b_path: str | None = None):
        import sentencepiece
        from tokenizers import Tokenizer

        self.fast = encoder(a_path).fast
        self.exact = Tokenizer.from_file(a_path or vocabulary_path("byte_bpe_50k.json"))
        self.exact.encode_special_tokens = True  # their strings are plain text
        sign = byte_signs()
        special = {t.content for t in self.exact.get_added_tokens_decoder().values()}
        entries = [b""] * self.exact.get_vocab_size()
        for t, i in self.exact.get_vocab().items():
            entries[i] = t.encode() if t in special else bytes(sign[c] for c in t)
        self.a_bytes = entries, np.array([len(e) for e in entries])
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path or vocabulary_path("piece_bpe_32k.model"))
        pieces = [self.b.id_to_piece(i) for i in range(len(self.b))]
        if any(BLANK in p.lstrip(BLANK) for p in pieces):
            raise ValueError("the piece model has pieces with a blank behind another sign; texts cannot be cut at blanks")
        entries = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.b_bytes = entries, np.array([len(e) for e in entries])
        self.lead = self.b.encode("x")

    def _tokens(self, ids, table, base: int, text: str) -> Tokens | None:
        entries, sizes = table
        if b"".join(map(entries.__getitem__, ids)) != text.encode():
            return None
        ids = np.array(ids, np.int64)
        return ids, np.cumsum(sizes[ids]) + base

    def tokens_a(self, text: str, base: int = 0) -> Tokens | None:
        """Of a range that starts at a cut; None if its bytes do not come back."""
        if UNUSUAL.search(text):
            ids = self.exact.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode(text, disallowed_special=())
        return self._tokens(ids, self.a_bytes, base, text)

    def tokens_b(self, text: str, base: int = 0) -> Tokens | None:
        """The same for B: a range starts with a blank, here behind a sign that is a piece of its own."""
        ids = self.b.encode("x" + text)
        n = len(self.lead)
        return self._tokens(ids[n:], self.b_bytes, base, text) if ids[:n] == self.lead else None

    def closed(self, text: str) -> Closed | None:
        """Of space + ``text`` in one piece."""
        a = self.tokens_a(" " + text)
        b = None if a is None else self._tokens(self.b.encode(text), self.b_bytes, 0, " " + text)
        return None if b is None else whole(fragment(a, b))

    def document(self, text: str | None) -> tuple[int, int, int, str, np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups, digest, links, how often each) of a text in one piece."""
        return closed_row(self.closed(text) if text else None)


def closed_row(c: Closed | None) -> tuple[int, int, int, str, np.ndarray, np.ndarray]:
    if c is None or not c.n_groups:
        return 0, 0, 0, "", NO_IDS, NO_IDS
    return c.n_a, c.n_b, c.n_groups, hashlib.sha256(c.text.encode()).hexdigest(), *np.unique(c.links, return_counts=True)


@cache
def pair(a_path: str | None = None, b_path: str | None = None) -> Pair:
    """One pair per worker process."""
    return Pair(a_path, b_path)


def ranges(text: str, size: int) -> Iterator[tuple[int, int, str, int, str]]:
    """(number, A's byte offset, A's text, B's byte offset, B's text) of space + text, about ``size`` characters each."""
    row = " " + text
    cuts: list[list[int]] = [[0], [0]]
    for at in range(size, len(row), size):
        for own, rule in zip(cuts, (_CUT_A, _CUT_B), strict=True):
            found = rule.search(row, max(at, own[-1]))
            own.append(found.start() if found else len(row))
    base = [0, 0]
    for k, (a, b) in enumerate(zip(pairwise([*cuts[0], len(row)]), pairwise([*cuts[1], len(row)]), strict=True)):
        parts = row[slice(*a)], row[slice(*b)]
        yield k, base[0], parts[0], base[1], parts[1]
        base = [n + len(p.encode()) for n, p in zip(base, parts, strict=True)]


# ---- Spark -----------------------------------------------------------------------------------

ROW = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<long>"


def _rows(ids: list, doc_ids: list, found: list[tuple]) -> pa.RecordBatch:
    def lists(j: int) -> pa.Array:
        ends = np.cumsum([0, *(len(f[j]) for f in found)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([NO_IDS, *(f[j] for f in found)])))

    counts = [pa.array([f[j] for f in found], pa.int64()) for j in range(3)]
    columns = [pa.array(ids, pa.int64()), pa.array(doc_ids, pa.int64()), *counts, pa.array([f[3] for f in found], pa.string()), lists(4), lists(5)]
    return pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"])


def _in_ranges(rows: DataFrame, a_path: str | None, b_path: str | None, size: int) -> DataFrame:
    """Very long texts: ranges dealt over the tasks, fragments composed by a tree of groupings."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, doc_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield pa.RecordBatch.from_pylist([{"row": row, "doc_id": doc_id, "k": k, "a_at": x, "a": a, "b_at": y, "b": c} for k, x, a, y, c in ranges(text, size)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(a_path, b_path)
        for b in batches:
            out = []
            for r in b.to_pylist():
                a, c = both.tokens_a(r["a"], r["a_at"]), both.tokens_b(r["b"], r["b_at"])
                out.append(pickle.dumps(None if a is None or c is None or BLANK in r["b"] else fragment(a, c), protocol=4))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("k"), pa.array(out, pa.binary())], ["row", "doc_id", "k", "f"])

    def reduce(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        total = fragment(NOTHING, NOTHING)
        for data in table.column("f").to_pylist():
            f = pickle.loads(data)
            total = None if total is None or f is None else compose(total, f)
        return pa.table({"row": table.column("row").slice(0, 1), "doc_id": table.column("doc_id").slice(0, 1), "k": pa.compute.divide(table.column("k").slice(0, 1), FAN), "f": pa.array([pickle.dumps(total, protocol=4)], pa.binary())})

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for data in b.column("f").to_pylist():
                f = pickle.loads(data)
                found.append(closed_row(None if f is None else whole(f)))
            yield _rows(b.column("row").to_pylist(), b.column("doc_id").to_pylist(), found)

    shape = "row long, doc_id long, k long, f binary"
    dealt = rows.mapInArrow(deal, "row long, doc_id long, k long, a_at long, a string, b_at long, b string").repartition("row", "k")
    now = materialize(dealt.mapInArrow(encode, shape), "fragments")
    most = now.agg(F.max("k")).first()[0] or 0
    while most:
        now = now.groupBy("row", F.expr(f"k div {FAN}").alias("part")).applyInArrow(reduce, shape)
        most //= FAN
    return now.select("row", "doc_id", "f").mapInArrow(finish, ROW)


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, long: int = LONG, size: int = RANGE) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, groups_sha256, pairs, times) of each row of ``docs``, written once.

    ``pairs`` are the distinct links (A id * 2^32 + B id), ``times`` how often
    each stands in the text.  Texts longer than ``long`` characters are dealt in ranges.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(a_path, b_path)
        for b in batches:
            ids, doc_ids, texts = (c.to_pylist() for c in b.columns)
            yield _rows(ids, doc_ids, [both.document(t) for t in texts])

    size_of = F.coalesce(F.length("text"), F.lit(0))
    short = rows.where(size_of <= long).mapInArrow(run, ROW)
    return materialize(short.unionAll(_in_ranges(rows.where(size_of > long), a_path, b_path, size)), "aligned")


def alignment_report(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, long: int = LONG, size: int = RANGE) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A pair's count is how many links of the whole table hold it; ``n_best`` are
    a row's links whose count is the highest of their B id, ``count_sum`` the
    sum of the counts over its links.  A text that is null, empty, or that a
    tokenizer does not give back byte for byte has zeros and an empty digest.
    Rows that repeat, also with a null doc_id, are rows of their own; other
    columns are ignored; an empty table gives an empty result.
    """
    found = aligned(docs, a_path, b_path, long, size)
    links = F.arrays_zip("pairs", "times")
    each = found.select(F.explode(links).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    counts = each.groupBy("pair").agg(F.sum("n").alias("c"))
    most = F.max("c").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit(2**32 - 1))))
    counts = counts.select("pair", "c", (F.col("c") == most).alias("best"))
    keys = ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
    rows = found.select(*keys, F.explode_outer(links).alias("x")).select(*keys, F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    told = hot_join(rows, counts, "pair", few=MOST_BROADCAST)
    sums = told.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("best"), F.col("n"))), F.lit(0)).alias("n_best"), F.coalesce(F.sum(F.col("n") * F.col("c")), F.lit(0)).alias("count_sum"))
    return sums.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
