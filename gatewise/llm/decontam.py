"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item is short and a document long, so their Jaccard similarity says
nothing; what counts is which share of the item's shingles the document holds.
An item with q shingles that is contained to the share t misses at most
``q - ceil(t q)`` of them, so of any ``q - ceil(t q) + 1`` shingles at least
one is in the document.  The item's sketch is that many of its shingles, those
of smallest hash (bottom-k MinHash), sized by the largest item of its size
partition.  A document is looked up only in the partitions whose items it is
long enough to hold: one sorted search of its shingle hashes.  Every hit is
then verified on the shingles themselves, as words.  No contained item is
missed and none is reported by a hash alone.

Items are read in blocks of bounded size, one scan of the documents a block.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from gatewise.llm.batches import bound_batches
from gatewise.llm.hashing import U64, WordHashes, gram_hashes, mix, multipliers

N = 5
SHARE = (8, 10)  # containment from which an item counts as leaked
BLOCK_CHARS = 32_000_000  # characters of items that one scan looks for
WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    """Words without case and punctuation."""
    return WORD.findall(text.lower())


def shingles_of(words: list[str], n: int) -> set[tuple[str, ...]]:
    """Distinct n-word shingles; fewer words give the whole sequence as one."""
    if not words:
        return set()
    n = min(n, len(words))
    return set(zip(*(words[i:] for i in range(n)), strict=False))


class _Index:
    """Sketches of one block of items, by size partition."""

    def __init__(self, items: list[tuple[int | None, str]], n: int, share: tuple[int, int]):
        self.n, (num, den) = n, share
        need = lambda q: -(-num * q // den)
        cache = WordHashes()
        self.items, parts = [], {}
        for item_id, text in items:
            words = words_of(text)
            shingles = shingles_of(words, n)
            if shingles:
                gram = min(n, len(words))
                h = np.unique(gram_hashes(cache.array([w.encode("utf-8", "replace") for w in words]), gram))
                # partition: n-gram length, then powers of two of the item's size
                parts.setdefault((gram, len(h).bit_length()), []).append((len(self.items), h))
                self.items.append((item_id, gram, shingles, need(len(shingles))))
        self.grams = sorted({g for g, _ in parts})
        self.levels: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {g: [] for g in self.grams}
        for (gram, _), members in sorted(parts.items()):
            largest = max(len(h) for _, h in members)
            k = largest - need(largest) + 1
            rows = [(v, i) for i, h in members for v in h[np.argsort(mix(h))[:k]].tolist()]
            below = self.levels[gram][-1] if self.levels[gram] else (0, np.empty(0, U64), np.empty(0, np.int64))
            hashes = np.concatenate([below[1], np.array([v for v, _ in rows], dtype=U64)])
            owners = np.concatenate([below[2], np.array([i for _, i in rows], dtype=np.int64)])
            order = np.argsort(hashes, kind="stable")
            self.levels[gram].append((min(need(len(h)) for _, h in members), hashes[order], owners[order]))

    def search(self, words: list[str], hashed: np.ndarray) -> list[tuple[int | None, int, int]]:
        """(item, its shingles, shared shingles) of the items that the words contain."""
        found = []
        for gram in self.grams:
            grams = gram_hashes(hashed, gram)
            sketch = None
            for least, hashes, owners in self.levels[gram]:  # partitions the text is long enough for
                if len(grams) >= least:
                    sketch = hashes, owners
            if sketch is None or not len(grams):
                continue
            hashes, owners = sketch
            at = np.searchsorted(hashes, grams)
            at[at == len(hashes)] = 0
            hit = np.unique(grams[hashes[at] == grams])
            if not len(hit):
                continue
            lo, hi = np.searchsorted(hashes, hit, "left"), np.searchsorted(hashes, hit, "right")
            candidates = {int(o) for a, e in zip(lo, hi, strict=True) for o in owners[a:e]}
            own = shingles_of(words, gram)
            for c in sorted(candidates):
                item_id, _, shingles, need = self.items[c]
                shared = len(shingles & own)
                if shared >= need:
                    found.append((item_id, len(shingles), shared))
        return found


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(chars // BLOCK_CHARS) + 1
    rows = items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    for i in range(n):
        yield [(r[0], r[1]) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()]


def contained_items(docs: DataFrame, items: DataFrame, n: int = N, share: tuple[int, int] = SHARE) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment) of every leak.

    ``docs`` (doc_id, text), ``items`` (item_id, text); other columns are
    ignored.  Null and empty texts hold and match nothing; an item of fewer
    than n words is one shingle of its own length.  Repeated rows on either
    side give a row each; null ids stay null.
    """
    bound_batches(docs.sparkSession)
    out = None
    for block in _blocks(items):
        found = _search(docs, block, n, share)
        out = found if out is None else out.unionAll(found)
    return out


def _search(docs: DataFrame, items: list[tuple[int | None, str]], n: int, share: tuple[int, int]) -> DataFrame:
    index = _Index(items, n, share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(text) if text else []
                hashed = cache.array([w.encode("utf-8", "replace") for w in words])
                rows += [(doc, i, q, s, s / q) for i, q, s in index.search(words, hashed)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)], list(_NAMES))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, item_id long, n_item_shingles long, n_shared long, containment double")


_NAMES = ("doc_id", "item_id", "n_item_shingles", "n_shared", "containment")
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = N, share: tuple[int, int] = SHARE) -> DataFrame:
    """``docs`` without the rows whose text contains an item; all columns.

    Decided row by row: of several texts under one doc_id only those that hold
    an item go, also where the id is null.  Null and empty texts stay; without
    items all rows stay.
    """
    bound_batches(docs.sparkSession)
    for block in _blocks(items):
        docs = docs.where(~_holds(_Index(block, n, share))(F.coalesce(F.col("text"), F.lit(""))))
    return docs


def _holds(index: _Index) -> Callable[[Column], Column]:
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache = WordHashes()
        for part in parts:
            out = []
            for text in part:
                words = words_of(text)
                out.append(bool(words) and bool(index.search(words, cache.array([w.encode("utf-8", "replace") for w in words]))))
            yield pd.Series(out, dtype="bool")

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return pandas_udf(run, "boolean")
