"""Repeated passages: a sparse suffix array over minimiser positions.

A passage of ``K + W - 1`` words holds W starts of K words; its *place* is the
start with the smallest hash (the first of equals).  The same words have the
same place wherever they stand, so two documents that share a passage share
the K words at its place, at the same distance from its start.

1. Retain the suffixes at places whose K words occur in two documents or more
   (a count over all places; hashes only choose what moves on).
2. Bring each retained place its words: the K words, the *tail* behind them
   and the *head* before them (nearest word first), as far as passages of this
   place reach.
3. Sort by (K words, tail) and compare each row with the nearest row of
   another document on either side, then extend the match to the left; sort by
   (K words, head) and do the same, extending to the right.  Rows are
   range-partitioned on the whole key with the row's own identity behind it, so
   a place that a third of all documents hold is many tasks; rows at the
   borders of partitions meet their neighbours in a second step.
4. The neighbours have the longest tail and the longest head that any other
   document shares, hence a bound on what can match.  Passages inside the bound
   that no neighbour shares as a whole (one partner has the tail, another the
   head) are grouped by their words, which settles them exactly.
5. Matches overlap, and so do those of neighbouring places; they are merged
   per text.

Matches are settled by words; no hash stands for a text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewise.llm.batches import bound_batches
from gatewise.llm.hashing import U64, WordHashes, ascii_words, gram_hashes
from gatewise.llm.store import hold, hot_join, shared_path, small

GRAM = 25
WINDOW = 26  # GRAM + WINDOW - 1 = 50 words
PLACES_PER_TASK = 50_000
ROWS_PER_BATCH = 2_000
WORDS_AT_ONCE = 16_384  # of short texts, so that their arrays stay in a core's cache


class Row(NamedTuple):
    """A retained suffix: K words, tail, head (every word followed by a space) and where it stands."""

    gram: bytes
    tail: bytes
    head: bytes
    doc_id: int
    copy: int
    at: int
    before: int
    count: int
    lo: int  # first and last distance to the start of a shared passage (lo > hi: none)
    hi: int
    tail_reach: int  # most words of the tail, and of the head, that another document shares
    head_reach: int
    other: int | None


class Out(NamedTuple):
    """A compared row."""

    row: Row
    edge: int  # 1: no row of another document before it in its partition, 2: none behind it, 3: both
    best: int  # longest part shared along the sort
    copies: int  # neighbours on either side that have all its words


ROW = "gram binary, tail binary, head binary, doc_id long, copy long, at int, before int, count int, lo int, hi int, tail_reach int, head_reach int, other long"
IDENTITY = ("doc_id", "copy", "at")
REACHES = ("tail_reach", "head_reach")


def kept_places(words: np.ndarray, ends: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places in joined texts that end at ``ends``, the hashes of their K words, each place's first passage and number of passages."""
    g = gram_hashes(words, gram)
    if len(g) < window:
        none = np.empty(0, dtype=np.int64)
        return none, np.empty(0, dtype=U64), none, none
    starts = np.arange(len(g) - window + 1)
    stops = np.repeat(ends, np.diff(ends, prepend=0))[: len(starts)]
    inside = starts + gram + window - 1 <= stops  # passages of one text
    at = (np.lib.stride_tricks.sliding_window_view(g, window).argmin(axis=1) + starts)[inside]
    new = np.flatnonzero(np.diff(at, prepend=-1))
    return at[new], g[at[new]], starts[inside][new], np.diff(new, append=len(at))


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("copy"), text.alias("body")).where("doc_id is not null and body is not null")


def places(docs: DataFrame, gram: int, window: int) -> DataFrame:
    """(hash, doc_id, copy, at, before, count) of every place; ``copy`` tells texts of one doc_id apart."""

    def placed(texts: list[np.ndarray], b: pa.RecordBatch) -> pa.RecordBatch:
        ends = np.cumsum([len(t) for t in texts])
        at, g, first, count = kept_places(np.concatenate(texts), ends, gram, window)
        text = np.searchsorted(ends, at, side="right")
        own = [b.column(i).take(pa.array(text)) for i in range(2)]
        where = [pa.array(v.astype(np.int32)) for v in (at - np.append(0, ends)[text], at - first, count)]
        return pa.RecordBatch.from_arrays([pa.array(g.astype(np.int64)), *own, *where], ["hash", "doc_id", "copy", "at", "before", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batches:
            texts, size = [], 0
            for i, body in enumerate(b.column(2).to_pylist()):
                texts.append(cache.array(ascii_words(body)))
                size += len(texts[-1])
                if size >= WORDS_AT_ONCE or i + 1 == b.num_rows:
                    yield placed(texts, b.slice(i + 1 - len(texts), len(texts)))
                    texts, size = [], 0

    return _texts(docs).mapInArrow(run, "hash long, doc_id long, copy long, at int, before int, count int")


def shared_places(kept: DataFrame) -> DataFrame:
    """Places whose hash stands in two documents or more, one row per text: (doc_id, copy, w)."""
    shared = hold(kept.groupBy("hash").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("hash", "n"))
    # places of very common words (at most one hash in PLACES_PER_TASK of all) never meet in one task
    common = small(shared.where(F.col("n") > PLACES_PER_TASK).select("hash"))
    rare = kept.join(common, "hash", "left_anti").join(shared.where(F.col("n") <= PLACES_PER_TASK).select("hash"), "hash")
    wanted = kept.join(common, "hash").unionByName(rare)
    return wanted.groupBy("doc_id", "copy").agg(F.collect_set(F.struct("at", "before", "count")).alias("w"))  # at most the places of one text


def _batch(rows: list[Row]) -> list[pa.Array]:
    kinds = [pa.binary()] * 3 + [pa.int64()] * 2 + [pa.int32()] * 7 + [pa.int64()]
    return [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)]


def suffixes(docs: DataFrame, wanted: DataFrame, gram: int, window: int) -> DataFrame:
    """The rows (``Row``) of the wanted places, with their words."""
    least = gram + window - 1

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, copy, body, *w in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                words = ascii_words(body)
                ahead, back = b" ".join(words) + b" ", b" ".join(words[::-1]) + b" "
                off = np.append(0, np.cumsum([len(x) + 1 for x in words]))
                for k in range(0, len(w[0]), ROWS_PER_BATCH):
                    at, before, count = (np.array(v[k : k + ROWS_PER_BATCH], dtype=np.int32) for v in w)
                    bounds = zip(*(off[i].tolist() for i in (at - before, at, at + gram, at - before + count - 1 + least)), strict=True)
                    cut = [(ahead[p:q], ahead[q:stop], back[off[-1] - p : off[-1] - start]) for start, p, q, stop in bounds]
                    own = [pa.array(np.full(len(at), v, dtype=np.int64)) for v in (doc, copy)]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.binary()) for c in zip(*cut, strict=True)), *own, *map(pa.array, (at, before, count))], list(Row._fields[:8]))

    rows = _texts(docs).join(wanted, ["doc_id", "copy"]).select("doc_id", "copy", "body", F.col("w.at").alias("at"), F.col("w.before").alias("before"), F.col("w.count").alias("count"))
    none = {"lo": window, "hi": -1, "tail_reach": -1, "head_reach": -1, "other": None}
    rows = rows.mapInArrow(found, ", ".join(ROW.split(", ")[:8]))
    return rows.select("*", *(F.lit(v).cast("long" if c == "other" else "int").alias(c) for c, v in none.items()))


def shared_words(a: bytes, b: bytes) -> int:
    """Number of whole words that two texts have in common from their starts."""
    if a == b:
        return a.count(b" ")
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return a.count(b" ", 0, lo)


def met(row: Row, partner: Row | None, window: int) -> tuple[Row, int, int]:
    """``row`` with the passages that ``partner`` shares, and the shared tail and head in words."""
    if partner is None or partner.gram != row.gram or partner.doc_id == row.doc_id:
        return row, -1, -1
    tail, head = shared_words(row.tail, partner.tail), shared_words(row.head, partner.head)
    lo = max(window - 1 - tail, 0)
    if lo <= head:
        other = partner.doc_id if row.other is None else min(row.other, partner.doc_id)
        row = row._replace(lo=min(row.lo, lo), hi=max(row.hi, head), other=other)
    return row, tail, head


def compared(rows: Iterable[Row], window: int, along: int) -> Iterator[Out]:
    """Sorted rows, each compared with the nearest row of another document on either side.

    Rows wait for the next row of another document, so only repeats of one
    document in one place are held.  A row that stands twice counts once.
    """
    last = other = None
    waiting: list[Out] = []
    for row in rows:
        if last is not None:
            if (row.doc_id, row.copy, row.at) == (last.doc_id, last.copy, last.at):
                continue
            if row.doc_id != last.doc_id:
                for o in waiting:
                    now, *ext = met(o.row, row, window)
                    yield Out(now, o.edge, max(o.best, ext[along]), o.copies + (o.row[:3] == row[:3]))
                waiting, other = [], last
        now, *ext = met(row, other, window)
        waiting.append(Out(now, 1 if other is None else 0, ext[along], int(other is not None and other[:3] == row[:3])))
        last = row
    for o in waiting:
        yield o._replace(edge=o.edge | 2)


class Border:
    """First and last rows of a partition, each with the nearest row of another document inside it."""

    def __init__(self) -> None:
        self.first = self.second = self.last = self.other = None

    def passing(self, rows: Iterable[Row]) -> Iterator[Row]:
        for row in rows:
            if self.first is None:
                self.first = row
            elif self.second is None and row.doc_id != self.first.doc_id:
                self.second = row
            if self.last is not None and row.doc_id != self.last.doc_id:
                self.other = self.last
            self.last = row
            yield row


def beyond(borders: dict[int, Border]) -> dict[int, tuple[tuple[Row | None, ...], tuple[Row | None, ...]]]:
    """Per partition, the nearest two rows of different documents before it and behind it."""
    before, behind = {}, {}
    near = alt = None
    for p in sorted(borders):
        before[p] = (near, alt)
        b = borders[p]
        alt = b.other if b.other is not None else near if near is not None and near.doc_id != b.last.doc_id else alt
        near = b.last
    near = alt = None
    for p in sorted(borders, reverse=True):
        behind[p] = (near, alt)
        b = borders[p]
        alt = b.second if b.second is not None else near if near is not None and near.doc_id != b.first.doc_id else alt
        near = b.first
    return {p: (before[p], behind[p]) for p in borders}


def ended(o: Out, over: tuple[tuple[Row | None, ...], tuple[Row | None, ...]], window: int, along: int) -> Row:
    """The row of ``o``, compared with the rows beyond its partition where it has no neighbour inside."""
    row, best = o.row, o.best
    for side in (0, 1):
        if o.edge >> side & 1:
            partner = next((q for q in over[side] if q is not None and q.doc_id != row.doc_id), None)
            row, *ext = met(row, partner, window)
            best = max(best, ext[along])
    return row._replace(**{REACHES[along]: best})


def _rows(batch: pa.RecordBatch) -> Iterator[Row]:
    return map(Row._make, zip(*(batch.column(i).to_pylist() for i in range(len(Row._fields))), strict=True))


def neighbours(rows: DataFrame, order: list[str], window: int, along: int) -> DataFrame:
    """``rows`` sorted by ``order``, each compared with its neighbours; ``along`` is 0 for tails, 1 for heads.

    ``copies`` is 2 for rows between two rows of other documents with all their words.

    Compared rows are written once; the few at partition borders are compared
    again with the rows beyond (four rows per partition pass through the driver).
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(*order, *IDENTITY).sortWithinPartitions(*order, *IDENTITY)
    dealt = dealt.select(*Row._fields, F.spark_partition_id().alias("part"))
    extra = f"{ROW}, part int, edge int, best int, copies int, mark int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, border, out = [0], Border(), []

        def read() -> Iterator[Row]:
            for b in batches:
                if b.num_rows:
                    part[0] = b.column(len(Row._fields))[0].as_py()
                    yield from _rows(b)

        def flush(rows_: list[Row], edge: list[int], best: list[int], copies: list[int], mark: list[int]) -> pa.RecordBatch:
            more = [[part[0]] * len(rows_), edge, best, copies, mark]
            return pa.RecordBatch.from_arrays([*_batch(rows_), *(pa.array(m, pa.int32()) for m in more)], [*Row._fields, "part", "edge", "best", "copies", "mark"])

        for o in compared(border.passing(read()), window, along):
            out.append(o)
            if len(out) == ROWS_PER_BATCH:
                yield flush([o.row for o in out], [o.edge for o in out], [o.best for o in out], [o.copies for o in out], [0] * len(out))
                out = []
        yield flush([o.row for o in out], [o.edge for o in out], [o.best for o in out], [o.copies for o in out], [0] * len(out))
        ends = [(i, r) for i, r in enumerate((border.first, border.second, border.last, border.other), 1) if r is not None]
        yield flush([r for _, r in ends], *([[0] * len(ends)] * 3), [i for i, _ in ends])

    path = shared_path(spark, "suffixes")
    dealt.mapInArrow(run, extra).write.option("compression", "zstd").parquet(path)
    done = spark.read.parquet(path)
    borders: dict[int, Border] = {}
    for r in done.where("mark > 0").collect():
        setattr(borders.setdefault(r.part, Border()), ("first", "second", "last", "other")[r.mark - 1], Row(*(bytes(r[c]) if c in ("gram", "tail", "head") else r[c] for c in Row._fields)))
    over = beyond(borders)

    reach = REACHES[along]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(Row._fields)
        for b in batches:
            rest = zip(_rows(b), *(b.column(i).to_pylist() for i in range(n, n + 3)), strict=True)
            rows_ = [ended(Out(row, edge, best, 0), over[part], window, along) for row, part, edge, best in rest]
            yield pa.RecordBatch.from_arrays(_batch(rows_), list(Row._fields))

    inner = done.where("mark = 0 and edge = 0").withColumn(reach, F.col("best")).select(*Row._fields, "copies")
    return inner.unionByName(done.where("mark = 0 and edge > 0").drop("copies", "mark").mapInArrow(finish, ROW).withColumn("copies", F.lit(0)))


def _keyed(rows: DataFrame, window: int) -> DataFrame:
    """``rows`` with the words of the passage that starts ``l`` words before the place, as ``key``."""

    def words(c: str, n: Column) -> Column:
        return F.call_function("substring_index", F.col(c).cast("string"), F.lit(" "), n)

    return rows.withColumn("key", F.concat_ws("\n", F.col("l").cast("string"), F.col("gram").cast("string"), words("head", F.col("l")), words("tail", F.lit(window - 1) - F.col("l"))))


def unsettled(rows: DataFrame, window: int) -> DataFrame:
    """(doc_id, copy, at, lo, hi, other) of shared passages that no neighbour shares as a whole.

    The reaches of a row bound its matches: distances from ``window - 1 - tail_reach`` to
    ``head_reach``, less those between the ones found.
    """
    inside = F.sequence(F.greatest(F.lit(window - 1) - F.col("tail_reach"), F.lit(0)), F.col("head_reach"))
    open_ = rows.where(F.col("tail_reach") + F.col("head_reach") >= window - 1).withColumn("ls", F.filter(inside, lambda x: (x < F.col("lo")) | (x > F.col("hi"))))
    open_ = open_.where(F.size("ls") > 0)
    asked = hold(_keyed(open_.select("gram", "tail", "head", *IDENTITY, F.explode("ls").alias("l")), window).select("gram", *IDENTITY, "l", "key"))
    grams = asked.groupBy("gram").agg(F.collect_set("l").alias("asked"))  # at most ``window`` numbers
    holders = hot_join(rows.select("gram", "tail", "head", "doc_id", "before", "count"), grams, "gram").where("asked is not null")
    able = F.filter("asked", lambda x: (x <= F.col("before")) & (x > F.col("before") - F.col("count")))
    each = _keyed(holders.select("gram", "tail", "head", "doc_id", F.explode(able).alias("l")), window)
    shared = each.groupBy("key").agg(F.min("doc_id").alias("least_doc"), F.max("doc_id").alias("most_doc")).where("least_doc < most_doc")
    hits = hot_join(asked.drop("gram"), shared, "key").where("least_doc is not null")
    return hits.select(*IDENTITY, F.col("l").alias("lo"), F.col("l").alias("hi"), F.when(F.col("least_doc") != F.col("doc_id"), F.col("least_doc")).otherwise(F.col("most_doc")).alias("other"))


def repeated_passages(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, other_doc) of every repeated passage.

    A passage has at least ``gram + window - 1`` words (lower-cased, split on
    white space) that also stand, word for word, in a document with another
    doc_id; ``other_doc`` is one of them.  Rows with a null doc_id or text take
    no part; rows that repeat doc_id and text count once; different texts under
    one doc_id have passages of their own, and none is a repeat of the other;
    other columns are ignored.  No passage gives an empty result.
    """
    bound_batches(docs.sparkSession)
    least = gram + window - 1
    kept = hold(places(docs, gram, window))
    rows = suffixes(docs, shared_places(kept), gram, window)
    rows = neighbours(rows, ["gram", "tail", "head"], window, 0)
    # a row between copies is shared as a whole; the first and last copy (smallest and largest doc_id) stand for it from here on
    between = rows.where("copies = 2")
    rows = neighbours(rows.where("copies < 2").drop("copies"), ["gram", "head", "tail"], window, 1)
    settled = [r.where("lo <= hi").select(*IDENTITY, "lo", "hi", "other") for r in (between, rows)]
    spans = settled[0].unionByName(settled[1]).unionByName(unsettled(rows, window))
    spans = spans.select("doc_id", "copy", (F.col("at") - F.col("hi")).cast("long").alias("start"), (F.col("at") - F.col("lo") + least).cast("long").alias("stop"), "other")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                now = None
                for s in sorted(spans, key=lambda s: (s["start"], s["stop"])):
                    if now and s["start"] <= now[2]:
                        now[2], now[3] = max(now[2], s["stop"]), min(now[3], s["other"])
                    else:
                        now = [doc, s["start"], s["stop"], s["other"]]
                        out.append(now)
            yield pa.RecordBatch.from_arrays([pa.array([f(r) for r in out], pa.int64()) for f in (lambda r: r[0], lambda r: r[1], lambda r: r[2], lambda r: r[2] - r[1], lambda r: r[3])], ["doc_id", "start_word", "end_word", "n_words", "other_doc"])

    per_text = spans.groupBy("doc_id", "copy").agg(F.collect_set(F.struct("start", "stop", "other")).alias("spans")).drop("copy")  # at most the places of one text
    return per_text.mapInArrow(merge, "doc_id long, start_word long, end_word long, n_words long, other_doc long")
