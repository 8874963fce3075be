"""Exact top-k inner products: ball trees per shard, branch and bound.

Vectors are dealt to shards around pivots (a bounded sample), large ones
split, so that near vectors share a shard of bounded size.  Each shard keeps a
ball tree: nodes with centre and radius, leaves of a few dozen vectors.  For a
query q a node's scores are at most ``q . centre + |q| radius``; nodes are
visited in the order of that bound and skipped once it is below the current
kth score of every query still interested.

The kth score is shared: a query first searches its own shard, where near
vectors are, and takes that bound along to every other shard; inside a task it
rises from shard to shard.  Queries are read in blocks of bounded size and
each block scans the index once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewise.llm.store import hold

PIVOTS = 64
SHARD_ROWS = 8192
LEAF_ROWS = 64
QUERY_BLOCK = 4096


class BallTree:
    """Nodes by index: centre, radius, row range; children are 2i + 1 and 2i + 2."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.order = np.arange(len(ids))
        self.nodes: dict[int, tuple[np.ndarray, float, int, int]] = {}
        self._split(vectors, 0, 0, len(ids))
        self.ids, self.vectors = ids[self.order], vectors[self.order]

    def _split(self, v: np.ndarray, node: int, lo: int, hi: int) -> None:
        own = v[self.order[lo:hi]]
        centre = own.mean(axis=0)
        apart = np.sqrt(((own - centre) ** 2).sum(axis=1))
        self.nodes[node] = (centre, float(apart.max(initial=0.0)), lo, hi)
        if hi - lo <= LEAF_ROWS:
            return
        far = own[apart.argmax()]  # split along the line of two far vectors
        other = own[((own - far) ** 2).sum(axis=1).argmax()]
        rank = np.argsort(own @ (other - far), kind="stable")
        self.order[lo:hi] = self.order[lo:hi][rank]
        mid = (lo + hi) // 2
        self._split(v, 2 * node + 1, lo, mid)
        self._split(v, 2 * node + 2, mid, hi)


class Best:
    """The k best scores of each query so far (ties to the smaller id)."""

    def __init__(self, query_ids: np.ndarray, floor: np.ndarray, k: int):
        self.query_ids, self.floor, self.k = query_ids, floor, k
        self.scores = np.full((len(query_ids), k), -np.inf)
        self.ids = np.full((len(query_ids), k), np.iinfo(np.int64).max)

    def kth(self) -> np.ndarray:
        return np.maximum(self.floor, self.scores[:, -1])

    def offer(self, which: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """``scores`` of the queries ``which`` for the vectors ``ids``."""
        scores = np.where(ids[None, :] == self.query_ids[which][:, None], -np.inf, scores)
        better = (scores >= self.kth()[which][:, None]).any(axis=1)
        which, scores = which[better], scores[better]
        if not len(which):
            return
        s = np.concatenate([self.scores[which], scores], axis=1)
        i = np.concatenate([self.ids[which], np.broadcast_to(ids, scores.shape)], axis=1)
        top = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.scores[which], self.ids[which] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)


def search(tree: BallTree, queries: np.ndarray, norms: np.ndarray, best: Best) -> int:
    """Branch and bound over one shard; returns the leaf rows that were scored."""

    def bound(node: int) -> np.ndarray:
        centre, radius, _, _ = tree.nodes[node]
        b = queries @ centre + norms * radius
        return b + 1e-9 * np.abs(b) + 1e-3  # the bound is in floating point, scores are whole

    first = bound(0)
    todo, scored = [(-first.max(initial=-np.inf), 0, first)], 0
    while todo:
        _, node, b = heapq.heappop(todo)
        which = np.flatnonzero(b >= best.kth())
        if not len(which):
            continue
        _, _, lo, hi = tree.nodes[node]
        if 2 * node + 1 in tree.nodes:
            for child in (2 * node + 1, 2 * node + 2):
                b = bound(child)
                if (b >= best.kth()).any():
                    heapq.heappush(todo, (-float(b.max()), child, b))
        else:
            scored += len(which) * (hi - lo)
            best.offer(which, tree.ids[lo:hi], queries[which] @ tree.vectors[lo:hi].T)
    return scored


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of whole, finite vectors; the others take no part."""
    x = F.col(vec_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~F.coalesce(F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(False))
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("double")).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, padded with zeros to ``dim``."""
    lens = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy()
    if (lens == dim).all():
        return flat.reshape(len(lens), dim).astype(np.float64)
    out = np.zeros((len(lens), dim))
    out[np.repeat(np.arange(len(lens)), lens), np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows but itself.

    ``is_query`` is a condition on ``vec_id``.  Shorter vectors are padded with
    zeros; rows with null ids, null vectors or null or non-finite components
    take no part; repeated rows of one id and vector count once.  Scores are
    exact below 2^53.  An empty table gives an empty result.
    """
    rows = hold(quantised(vectors, id_col, vec_col, scale))
    dim = int(rows.agg(F.max(F.size("v"))).first()[0] or 0)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).toArrow()
    if not len(sample):
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
    pivots = _matrix(sample.column("v").combine_chunks(), dim)
    pivots = pivots / np.maximum(np.sqrt((pivots**2).sum(axis=1, keepdims=True)), 1e-9)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column(1), dim)
            pivot = (m @ pivots.T).argmax(axis=1) if len(m) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pivot.astype(np.int32)), pa.array([r.tobytes() for r in m], pa.binary())], ["vec_id", "pivot", "v"])

    dealt = hold(rows.mapInArrow(nearest, "vec_id long, pivot int, v binary"))
    parts = {r[0]: -(-r[1] // SHARD_ROWS) for r in dealt.groupBy("pivot").count().collect()}  # at most PIVOTS rows
    split = F.element_at(F.create_map(*(F.lit(x) for kv in parts.items() for x in kv)), F.col("pivot"))
    sharded = dealt.select("vec_id", "v", (F.col("pivot").cast("long") * 2**40 + F.pmod(F.xxhash64("vec_id"), split)).alias("shard"), is_query.alias("is_query"))

    def home(table: pa.Table) -> pa.Table:
        """One row with the shard's vectors, and one per query with its kth score at home."""
        ids = table.column("vec_id").to_numpy()
        m = np.frombuffer(b"".join(table.column("v").to_pylist()), dtype=np.float64).reshape(len(ids), dim)
        asks = table.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
        _, once = np.unique(np.concatenate([ids[:, None], m.view(np.int64)], axis=1), axis=0, return_index=True)
        once = np.sort(once)
        ids, m, asks = ids[once], m[once], asks[once]
        by_id = np.argsort(ids, kind="stable")
        ids, m, asks = ids[by_id], m[by_id], asks[by_id]
        tree = BallTree(ids, m)
        q, qi = m[asks], ids[asks]
        best = Best(qi, np.full(len(qi), -np.inf), k)
        if len(qi):
            search(tree, q, np.sqrt((q**2).sum(axis=1)), best)
        kth = best.kth()
        return pa.table(
            {"query_id": [None, *qi.tolist()], "kth": [None, *(float(x) if np.isfinite(x) else None for x in kth)], "ids": [ids.tobytes(), *[None] * len(qi)], "v": [m.tobytes(), *(r.tobytes() for r in q)]},
            schema=pa.schema([("query_id", pa.int64()), ("kth", pa.float64()), ("ids", pa.binary()), ("v", pa.binary())]),
        )

    index = hold(sharded.groupBy("shard").applyInArrow(home, "query_id long, kth double, ids binary, v binary"))
    shards = index.where("ids is not null").select("ids", "v")
    asked = index.where("ids is null").select("query_id", "kth", "v")
    blocks = -(-asked.count() // QUERY_BLOCK)
    found = None
    for i in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).collect()
        if part:
            got = _scan(shards, part, dim, k)
            found = got if found is None else found.unionAll(got)
    if found is None:
        return rows.where(F.lit(False)).select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def _scan(shards: DataFrame, part: list, dim: int, k: int) -> DataFrame:
    """One block of queries against every shard; a task keeps each query's best k."""
    query_ids = np.array([r[0] for r in part], dtype=np.int64)
    floor = np.array([-np.inf if r[1] is None else r[1] for r in part])
    queries = np.frombuffer(b"".join(bytes(r[2]) for r in part), dtype=np.float64).reshape(len(part), dim)
    norms = np.sqrt((queries**2).sum(axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(query_ids, floor, k)
        for b in batches:
            for ids, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(ids, dtype=np.int64)
                search(BallTree(ids, np.frombuffer(v, dtype=np.float64).reshape(len(ids), dim)), queries, norms, best)
        have = np.isfinite(best.scores) & (best.scores >= floor[:, None])
        owner = np.broadcast_to(query_ids[:, None], have.shape)
        yield pa.RecordBatch.from_arrays([owner[have], best.ids[have], best.scores[have].astype(np.int64)], ["query_id", "vec_id", "score"])

    return shards.mapInArrow(run, "query_id long, vec_id long, score long")
