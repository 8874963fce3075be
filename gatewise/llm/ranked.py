"""Ranked lexical search with whole-number scores, by bag deduplication.

A query item sees of a document only the item vocabulary: how often each of its
terms stands there, and the length figure m.  ``search`` restricts every document to
that bag, groups documents by the hash of (bag, m) and verifies the bags
themselves (Spark compares whole group keys), scores each class once, and
expands the winning classes to their members by ascending doc_id.

* The vocabulary goes to the tasks as one bitmap of 2^23 bits, whatever its
  size.  A word that passes by chance only makes a class finer; scores compare
  whole words.
* Of a class only its ``k`` first members can be in a top k, and the k first
  classes by (score, smallest doc_id) hold the k best documents, so neither a
  class nor a tie is ever gathered whole.
* Classes are packed into shards, items into blocks of bounded size; each
  (shard, block) pair is scored on its own.  Few blocks are broadcast, many
  are joined by shuffle.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewise.llm.batches import bound_batches
from gatewise.operators.common import materialize

BITS = 2**23
BUCKET = 32768  # bits in a bucket of Spark's bitmap functions
BLOCK_TERMS = 65_536
FEW_BLOCKS = 16
SHARD_ROWS, SHARD_BYTES = 1000, 4 * 1024 * 1024
CACHE = 200_000
NO_ID = 2**63 - 1  # rows without a doc_id stand behind all others

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode().translate(_LETTERS).split()


def bit(term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term) & (BITS - 1)


def encoded(bag: list[tuple[bytes, int]]) -> bytes:
    """Terms in order, a line feed, their counts; equal bags have equal bytes."""
    bag.sort()
    return b" ".join(t for t, _ in bag) + b"\n" + b" ".join(b"%d" % n for _, n in bag)


def decoded(bag: bytes) -> tuple[list[bytes], list[bytes]]:
    words, counts = bag.split(b"\n")
    return words.split(), counts.split()


class Kept(dict):
    """word -> whether its bit is set; bounded."""

    def __init__(self, bitmap: bytes):
        super().__init__()
        self.bitmap = bitmap

    def __missing__(self, word: bytes) -> bool:
        if len(self) >= CACHE:
            self.clear()
        at = bit(word)
        value = self[word] = bool(self.bitmap[at >> 3] >> (at & 7) & 1)
        return value


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term, n, bit): the terms of each distinct (item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, item_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                counts = Counter(terms(text))
                if counts:
                    size = len(counts)
                    columns = [pa.array([item] * size, pa.string()), pa.array([item_id] * size, pa.int64()), pa.array([t.decode() for t in counts]), pa.array(list(counts.values()), pa.int64()), pa.array([bit(t) for t in counts], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["item", "item_id", "term", "n", "bit"])

    item = F.concat_ws(":", F.coalesce(F.col("item_id").cast("string"), F.lit("-")), F.sha2(F.coalesce("text", F.lit("")), 256))
    rows = items.select(item.alias("item"), F.col("item_id").cast("long").alias("item_id"), "text").dropDuplicates(["item"])
    return rows.mapInArrow(run, "item string, item_id long, term string, n long, bit long")


def vocabulary_bitmap(asked: DataFrame) -> bytes:
    """One bit per term hash: at most 256 buckets of 4 kB, however many terms there are."""
    place = F.col("bit") + 1
    found = asked.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    whole = bytearray(BITS // 8)
    for r in found:
        at = (r["bucket"] - 1) * BUCKET // 8
        whole[at : at + len(r["bits"])] = r["bits"]
    return bytes(whole)


def bags(docs: DataFrame, bitmap: bytes) -> DataFrame:
    """(id, n, h, bag): each document's length in terms and its bag over the item vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Kept(shared.value)
        for b in batches:
            sizes, out = [], []
            for text in b.column(1).to_pylist():
                words = terms(text)
                sizes.append(len(words))
                out.append(encoded([(t, n) for t, n in Counter(words).items() if kept[t]]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], ["id", "n", "bag"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text")
    return rows.mapInArrow(run, "id long, n long, bag binary").withColumn("h", F.xxhash64("bag"))


def document_frequencies(found: DataFrame) -> DataFrame:
    """(term, df): counted in each batch, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: Counter = Counter()
            for bag in b.column(0).to_pylist():
                counts.update(decoded(bag)[0])
            yield pa.RecordBatch.from_arrays([pa.array([t.decode() for t in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "c"])

    return found.select("bag").mapInArrow(run, "term string, c long").groupBy("term").agg(F.sum("c").alias("df"))


def classes(found: DataFrame, m: Column, k: int) -> DataFrame:
    """(bag, m, ids): one row per class of equal (bag, m), with its first ``k`` members.

    Sorted and shuffled by the hash first; only equal hashes compare bags.  At
    most ``k`` rows of a class leave a task, so a class of a third of all rows
    is no larger group than another.
    """
    rows = found.where("length(bag) > 1").select("h", m.alias("m"), "bag", "id")
    first = Window.partitionBy("h", "m", "bag").orderBy("id")
    return rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k).groupBy("h", "m", "bag").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("bag", "m", "ids")


def shards(found: DataFrame) -> DataFrame:
    """(data): classes packed into rows of at most SHARD_ROWS classes and about SHARD_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.cumsum(pa.compute.binary_length(b.column(0)).to_numpy(zero_copy_only=False)) if len(b) else np.empty(0)
            at = 0
            while at < len(b):
                base = sizes[at - 1] if at else 0
                end = max(at + 1, min(at + SHARD_ROWS, int(np.searchsorted(sizes, base + SHARD_BYTES))))
                part = b.slice(at, end - at)
                data = pickle.dumps(tuple(part.column(i).to_pylist() for i in range(3)), protocol=4)
                yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["data"])
                at = end

    return found.mapInArrow(run, "data binary")


def item_blocks(asked: DataFrame, df: DataFrame, n_docs: int, n_blocks: int) -> DataFrame:
    """(block, items): terms with their weights, packed; an item stands in one block."""
    weight = F.floor(F.lit(1000) * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    rows = asked.join(df, "term").select(F.pmod(F.xxhash64("item"), F.lit(n_blocks)).cast("int").alias("block"), "item", "item_id", "term", (weight * F.col("n")).alias("w"))

    def pack(table: pa.Table) -> pa.Table:
        vocabulary: dict[bytes, int] = {}
        found: dict[str, tuple] = {}
        for item, item_id, term, w in zip(*(table.column(c).to_pylist() for c in ("item", "item_id", "term", "w")), strict=True):
            _, places, weights = found.setdefault(item, (item_id, [], []))
            places.append(vocabulary.setdefault(term.encode(), len(vocabulary)))
            weights.append(w)
        return pa.table({"block": table.column("block").slice(0, 1), "items": pa.array([pickle.dumps((vocabulary, found), protocol=4)], pa.binary())})

    return rows.groupBy("block").applyInArrow(pack, "block int, items binary")


def score(data: bytes, block: tuple[dict[bytes, int], dict[str, tuple]], k: int) -> Iterator[tuple[str, int | None, int, int]]:
    """(item, item_id, id, score) of each item's ``k`` best documents in one shard."""
    vocabulary, items = block
    all_bags, ms, ids = pickle.loads(data)
    owner, place, tf = [], [], []
    for c, bag in enumerate(all_bags):
        for word, n in zip(*decoded(bag), strict=True):
            at = vocabulary.get(word)
            if at is not None:
                owner.append(c)
                place.append(at)
                tf.append(int(n))
    owner, place, tf = np.array(owner, np.int64), np.array(place, np.int64), np.array(tf, np.int64)
    m = np.array(ms, np.int64)[owner]
    part = (1_000_000_000 * tf) // (1000 * tf + 8 * m)
    order = np.argsort(place, kind="stable")
    owner, part = owner[order], part[order]
    start = np.searchsorted(place[order], np.arange(len(vocabulary) + 1))
    least = np.array([i[0] for i in ids], np.int64)
    for item, (item_id, places, weights) in items.items():
        total = np.zeros(len(ms), np.int64)
        for at, w in zip(places, weights, strict=True):
            rows = slice(start[at], start[at + 1])
            total[owner[rows]] += w * part[rows]  # a class holds a term once
        able = np.flatnonzero(total > 0)
        if len(able) > k:
            able = able[total[able] >= np.partition(total[able], -k)[-k]]
        able = able[np.lexsort((least[able], -total[able]))][:k]
        members = sorted((-int(total[c]), i) for c in able for i in ids[c][:k])[:k]
        yield from ((item, item_id, i, -s) for s, i in members)


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best ``docs`` with a score above 0.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are
    ignored.  Null and empty texts have no term.  Every row of ``docs`` is a
    document of its own, also where ids or texts repeat; a null doc_id stands
    behind all ids.  Rows of ``items`` that repeat both id and text count once;
    one id with several texts is ranked for each.  Ties go to the smaller
    doc_id.  Without documents, items or common terms the result is empty.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    asked = materialize(item_terms(items), "item-terms")
    found = materialize(bags(docs, vocabulary_bitmap(asked)), "bags")
    n_docs, n_terms = found.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_blocks = -(-max(asked.count(), 1) // BLOCK_TERMS)
    m = F.expr(f"25L + ((75L * n * {n_docs}L) div {max(n_terms, 1)}L)")
    blocks = item_blocks(asked, document_frequencies(found), n_docs, n_blocks)
    packed = shards(classes(found, m, k))
    if n_blocks <= FEW_BLOCKS:  # at most FEW_BLOCKS * BLOCK_TERMS terms with their weights
        pairs = packed.select("data", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block")).join(F.broadcast(blocks), "block")
    else:
        spreads = F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt")
        dealt = packed.select("data", F.pmod(F.crc32("data"), F.lit(16)).cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
        pairs = dealt.join(blocks.select("block", "items", spreads), ["block", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, block = None, None
        for b in batches:
            for data, number, packed_items in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if number != last:
                    last, block = number, pickle.loads(packed_items)
                rows = list(score(data, block, k))
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["item", "item_id", "id", "score"])

    scored = pairs.select("data", "block", "items").mapInArrow(run, "item string, item_id long, id long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "id")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("item_id", "rank", F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "score")
