"""Ordered walks with jumps, by composition of chunk maps.

Some rules decide about a row from their own earlier decisions: a throttle
admits a request 60 s after the last one it admitted; shadowing stops for 300 s
after the third failure in a row.  Both are walks over a key's rows in time
order.  The walker stands before a row in one of a few lanes; the row sends it
to the next row, maybe in another lane, or has it skip to the first row at or
after some time, in lane 0.  Rows that it skips are not visited.

What a chunk of rows (a key and a span of time) does to the walker is a map
from where it comes in (a lane at the first row, or a time to skip to) to where
it goes out.  A time can only reach ``memory`` microseconds into a chunk, so
the map has a line per lane and per row of that span.  Maps compose, so

1. each chunk's map is computed on its own,
2. maps of ``FAN`` neighbours are composed, level by level, until a key has one,
3. going down again every chunk learns where the walker comes in,
4. one pass over the rows marks those it visits.

No task holds more of a key than one chunk's rows or ``FAN`` maps, however long
the key's history or an outage lasts.  Times are whole microseconds.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatewise.operators.common import materialize

FAN = 32
CHUNK_ROWS = 50_000
NEVER = np.iinfo(np.int64).min  # no time to skip to: come in at the first row

#: (times, gaps to the key's previous row or None, marks, lane) -> (next lane, time to skip to or NEVER) per row.
Rule = Callable[[np.ndarray, np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]]


class State(NamedTuple):
    lane: int
    until: int


START = State(0, NEVER)


class ChunkMap(NamedTuple):
    """``lanes``: exit per lane at the first row; ``times``/``exits``: exit when the
    walker skips to the first of these rows at or after its time; ``short``: there are no other rows."""

    lanes: list[State]
    times: np.ndarray
    exits: list[State]
    short: bool

    def __call__(self, at: State) -> State:
        if at.until == NEVER:
            return self.lanes[at.lane]
        i = int(np.searchsorted(self.times, at.until, "left"))
        if i < len(self.exits):
            return self.exits[i]
        if not self.short:
            raise ValueError("a rule skips further than its memory")
        return at


def chunk_map(t: np.ndarray, gaps: np.ndarray, marks: np.ndarray, rule: Rule, lanes: int, reach: int) -> ChunkMap:
    """The map of one chunk's rows; ``reach``: last time that a walker from before can skip to."""
    steps = [_steps(t, gaps, marks, rule, f) for f in range(lanes)]
    out: list[list[State]] = [[START] * len(t) for _ in range(lanes)]
    for i in range(len(t) - 1, -1, -1):
        for f, (lane, until, to) in enumerate(steps):
            if to[i] < len(t):
                out[f][i] = out[lane[i]][to[i]]
            else:
                out[f][i] = State(lane[i], until[i])
    n = min(int(np.searchsorted(t, reach, "left")) + 1, len(t))
    return ChunkMap([out[f][0] for f in range(lanes)], t[:n], out[0][:n], n == len(t))


def _steps(t: np.ndarray, gaps: np.ndarray, marks: np.ndarray, rule: Rule, lane: int) -> tuple[list[int], list[int], list[int]]:
    after, until = rule(t, gaps, marks, lane)
    jumps = until != NEVER
    to = np.where(jumps, np.maximum(np.searchsorted(t, until, "left"), np.arange(len(t)) + 1), np.arange(len(t)) + 1)
    return np.where(jumps, 0, after).tolist(), until.tolist(), to.tolist()


def compose(a: ChunkMap, b: ChunkMap) -> ChunkMap:
    """``a`` and then ``b``; associative."""
    times, exits = a.times, [b(x) for x in a.exits]
    if a.short:  # a time may lie behind all of a's rows
        times, exits = np.concatenate([times, b.times]), exits + b.exits
    return ChunkMap([b(x) for x in a.lanes], times, exits, a.short and b.short)


def marked(t: np.ndarray, gaps: np.ndarray, marks: np.ndarray, rule: Rule, lanes: int, at: State) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per row: visited, lane behind it, whether it made the walker skip, time the walker waits for (0: none)."""
    steps = [_steps(t, gaps, marks, rule, f) for f in range(lanes)]
    n = len(t)
    visited, jumped, behind, waits = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
    i, lane, until = (0, at.lane, 0) if at.until == NEVER else (int(np.searchsorted(t, at.until, "left")), 0, at.until)
    waits[:i] = until
    while i < n:
        after, to_time, to = (x[i] for x in steps[lane])
        visited[i], behind[i], jumped[i] = True, after, to_time != NEVER
        if to_time != NEVER:
            waits[i + 1 : to] = to_time
        i, lane = to, after
    return visited, behind, jumped, waits


def step_state(t: np.ndarray, visited: np.ndarray, lane: np.ndarray, jumped: np.ndarray, waits: np.ndarray, at: State, rule: Rule, gaps: np.ndarray, marks: np.ndarray) -> State:
    """Where the walker stands behind rows that ``marked`` has gone through."""
    seen = np.flatnonzero(visited)
    if not len(seen):
        return at
    last = int(seen[-1])
    if not jumped[last]:
        return State(int(lane[last]), NEVER)
    before = at.lane if last == 0 and at.until == NEVER else int(lane[last - 1]) if last and visited[last - 1] else 0
    return State(0, int(rule(t[last : last + 1], gaps[last : last + 1], marks[last : last + 1], before)[1][0]))


def _runs(pdf: pd.DataFrame, cols: list[str]) -> list[tuple[int, int]]:
    """(start, end) of the rows of a sorted frame that agree in ``cols``."""
    if not len(pdf):
        return []
    new = np.zeros(len(pdf), bool)
    new[0] = True
    for c in cols:
        v = pdf[c].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    at = np.flatnonzero(new)
    return list(zip(at.tolist(), [*at[1:].tolist(), len(pdf)], strict=True))


def walk(rows: DataFrame, key: str, ts_col: str, id_col: str, mark: str, rule: Rule, lanes: int, memory_s: float, chunk_rows: int = CHUNK_ROWS, bucket_s: int = 60) -> DataFrame:
    """(id_col, visited, lane, jumped, waits_us) of every row of ``rows``.

    Rows are ordered by (ts, id) within a key.  ``mark`` names a boolean column
    that the rule sees.  Rows with a null time are not visited and wait for
    nothing; a null key is a key.  An empty table gives an empty result.

    A chunk is as many time buckets of a key as hold about ``chunk_rows`` rows;
    one pandas group takes several small chunks or one large one.
    """
    id_type = rows.schema[id_col].dataType.simpleString()
    us = F.unix_micros(F.col(ts_col).cast("timestamp"))
    step = int(bucket_s * 1_000_000)
    memory = int(memory_s * 1_000_000)
    k = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("null"))
    base = rows.where(F.col(ts_col).isNotNull()).select(k.alias("k"), us.alias("t"), F.col(id_col).alias("id"), F.coalesce(F.col(mark), F.lit(False)).alias("m"))
    base = materialize(base.withColumn("u", F.floor(F.col("t") / step).cast("long")), "walk")
    groups = base.count() // chunk_rows + 1
    # chunks are made on one row per key and bucket
    sizes = base.groupBy("k", "u").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("last_t"))
    order = Window.partitionBy("k").orderBy("u")
    cut = sizes.withColumn("c", F.floor((F.sum("n").over(order) - F.col("n")) / chunk_rows).cast("long")).withColumn("prev_t", F.lag("last_t").over(order))
    inside = Window.partitionBy("k", "c").orderBy("u")
    buckets = materialize(cut.select("k", "u", "c", F.first("u").over(inside).alias("first_u"), F.first("prev_t").over(inside).alias("before_t")), "walk-chunks")

    def sorted_runs(pdf: pd.DataFrame) -> Iterator[tuple]:
        pdf = pdf.sort_values(["k", "c", "t", "id"], kind="mergesort")
        for i, j in _runs(pdf, ["k", "c"]):
            part = pdf.iloc[i:j]
            t = part["t"].to_numpy(np.int64)
            before = part["before_t"].iloc[0]
            gaps = np.diff(t, prepend=NEVER // 2 if pd.isna(before) else np.int64(before))
            yield part, t, gaps, part["m"].to_numpy(bool)

    def to_map(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part, t, gaps, marks in sorted_runs(pdf):
            found = chunk_map(t, gaps, marks, rule, lanes, int(part["first_u"].iloc[0]) * step + memory)
            out.append((part["k"].iloc[0], int(part["c"].iloc[0]), pickle.dumps(found)))
        return pd.DataFrame(out, columns=["k", "c", "f"])

    def to_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k", "c"]).reset_index(drop=True)
        pdf["b"] = pdf["c"] // FAN
        out = []
        for i, j in _runs(pdf, ["k", "b"]):
            out.append((pdf["k"][i], int(pdf["b"][i]), pickle.dumps(reduce(compose, [pickle.loads(f) for f in pdf["f"][i:j]]))))
        return pd.DataFrame(out, columns=["k", "c", "f"])

    def entries(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k", "c"]).reset_index(drop=True)
        out = []
        for i, j in _runs(pdf, ["k", "b"]):
            at = State(int(pdf["lane"][i]), int(pdf["until"][i]))
            for n in range(i, j):
                out.append((pdf["k"][n], int(pdf["c"][n]), *at))
                at = pickle.loads(pdf["f"][n])(at)
        return pd.DataFrame(out, columns=["k", "c", "lane", "until"])

    def to_rows(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part, t, gaps, marks in sorted_runs(pdf):
            visited, lane, jumped, waits = marked(t, gaps, marks, rule, lanes, State(int(part["lane"].iloc[0]), int(part["until"].iloc[0])))
            out.append(pd.DataFrame({id_col: part["id"].to_numpy(), "visited": visited, "lane": lane, "jumped": jumped, "waits_us": waits}))
        return pd.concat(out)

    def dealt(df: DataFrame, *keys: str) -> DataFrame:
        return df.withColumn("g", F.pmod(F.xxhash64(*keys), F.lit(groups)))

    shape, at = "k string, c long, f binary", "k string, c long, lane long, until long"
    block = F.floor(F.col("c") / FAN)
    known = base.join(buckets, ["k", "u"])
    levels = [materialize(dealt(known, "k", "c").groupBy("g").applyInPandas(to_map, shape), "walk-maps")]
    while (levels[-1].groupBy("k").count().agg(F.max("count")).first()[0] or 0) > FAN:
        levels.append(materialize(dealt(levels[-1].withColumn("b", block), "k", "b").groupBy("g").applyInPandas(to_block, shape), "walk-maps"))
    top = levels.pop().withColumn("b", F.lit(0)).withColumn("lane", F.lit(START.lane)).withColumn("until", F.lit(START.until))
    come = dealt(top, "k").groupBy("g").applyInPandas(entries, at)
    while levels:
        come = levels.pop().withColumn("b", block).join(come.select("k", F.col("c").alias("b"), "lane", "until"), ["k", "b"])
        come = dealt(come, "k", "b").groupBy("g").applyInPandas(entries, at)
    out = f"{id_col} {id_type}, visited boolean, lane long, jumped boolean, waits_us long"
    done = dealt(known.join(come, ["k", "c"]), "k", "c").groupBy("g").applyInPandas(to_rows, out)
    untimed = rows.where(F.col(ts_col).isNull()).select(id_col, F.lit(False).alias("visited"), F.lit(0).cast("long").alias("lane"), F.lit(False).alias("jumped"), F.lit(0).cast("long").alias("waits_us"))
    return done.unionByName(untimed)


# ---- rules -----------------------------------------------------------------------------------


def spacing_rule(window_s: float) -> Rule:
    """Visit a row, then skip to the first one ``window_s`` later."""
    window = int(window_s * 1_000_000)

    def rule(t, gaps, marks, lane):
        return np.zeros(len(t), np.int64), t + window

    return rule


def failure_rule(threshold: int, window_s: float, pause_s: float) -> Rule:
    """Lane: failures so far, each within ``window_s`` of the one before; at ``threshold`` skip ``pause_s``.

    ``marks`` are successes.  In a lane above 0 the row before is the last
    failure, since a success in between would have led back to lane 0.
    """
    window, pause = int(window_s * 1_000_000), int(pause_s * 1_000_000)

    def rule(t, gaps, marks, lane):
        fails = np.where(gaps <= window, lane, 0) + 1
        trips = ~marks & (fails >= threshold)
        return np.where(marks | trips, 0, fails), np.where(trips, t + pause, NEVER)

    return rule
