"""Chunk maps against the sequential rule: long outages, hot keys, ties, gaps, many levels."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gatewise.operators import folds, walks
from gatewise.operators.canary import shadow_auto_disable
from gatewise.operators.spacing import greedy_spacing

SEC = 1_000_000


def _sequential(t, marks, rule, lanes=3):
    """Row by row, from the rule itself."""
    gaps = np.diff(t, prepend=walks.NEVER // 2)
    seen, lane, until = [], 0, walks.NEVER
    for i in range(len(t)):
        if until != walks.NEVER and t[i] < until:
            seen.append(False)
            continue
        seen.append(True)
        after, to = rule(t[i : i + 1], gaps[i : i + 1], marks[i : i + 1], lane)
        lane, until = (0, int(to[0])) if to[0] != walks.NEVER else (int(after[0]), walks.NEVER)
    return seen


def test_composed_maps_equal_the_rule():
    rnd = random.Random(4)
    for trial in range(200):
        n = rnd.randint(1, 60)
        t = np.cumsum([rnd.choice([0, 1, 5, 40, 200, 400, 2000]) for _ in range(n)]).astype(np.int64) * SEC
        marks = np.array([rnd.random() < rnd.choice([0.0, 0.3, 0.9]) for _ in range(n)])
        rule, lanes, memory = (walks.failure_rule(3, 300, 300), 3, 300 * SEC) if trial % 2 else (walks.spacing_rule(60), 1, 60 * SEC)
        gaps = np.diff(t, prepend=walks.NEVER // 2)
        step = rnd.choice([30, 100, 1000]) * SEC
        cuts = [0, *(np.flatnonzero(np.diff(t // step)) + 1).tolist(), n]
        parts = [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        maps = [walks.chunk_map(t[p], gaps[p], marks[p], rule, lanes, int(t[p][0]) // step * step + memory) for p in parts]
        at, seen = walks.START, []
        for p, m in zip(parts, maps, strict=True):
            seen += walks.marked(t[p], gaps[p], marks[p], rule, lanes, at)[0].tolist()
            at = m(at)
        assert seen == _sequential(t, marks, rule)
        left = maps[0]
        for m in maps[1:]:
            left = walks.compose(left, m)
        right = maps[-1]
        for m in maps[-2::-1]:
            right = walks.compose(m, right)
        assert left(walks.START) == right(walks.START) == at


@pytest.mark.parametrize("kind", ["outage", "mixed"])
def test_shadow_rule_on_one_hot_key(spark, monkeypatch, kind):
    """All rows under one key and no success for the whole time: many chunks, three levels, equal to the fold."""
    monkeypatch.setattr(walks, "FAN", 3)
    n = 3000
    rnd = random.Random(8)
    gaps = [rnd.choice([1, 2, 7, 30, 299, 301]) for _ in range(n)]
    rows = [(i, int(x), kind == "mixed" and rnd.random() < 0.4) for i, x in enumerate(np.cumsum(gaps))]
    df = spark.createDataFrame(rows, "id long, s long, success boolean").select(F.lit("r").alias("k"), "id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "success")
    got = shadow_auto_disable(df, "k", "ts", "id", chunk_rows=100).toPandas().sort_values("id")
    pdf = pd.DataFrame(rows, columns=["id", "s", "success"])
    pdf["ts"] = pd.to_datetime(pdf["s"], unit="s")
    want = folds.shadow_disable_fold(pdf)
    assert want["tripped"].sum() > 50
    for c in ("skipped", "tripped", "fail_count"):
        assert got[c].tolist() == want[c].tolist()


def test_one_hot_key_in_many_chunks(spark):
    n = 4000
    df = spark.range(n).select(F.lit("r").alias("k"), "id", F.timestamp_seconds(F.col("id") * 10).alias("ts"), F.lit(True).alias("m"))
    found = walks.walk(df, "k", "ts", "id", "m", walks.spacing_rule(60), 1, 60, chunk_rows=200)
    assert found.where("visited").count() == -(-n // 6) and found.count() == n


def test_throttle_ids_ties_nulls_and_retry(spark):
    rows = [("a", 0.0, "x1"), ("a", 0.0, "x2"), ("a", 59.5, "x3"), ("a", 60.0, "x4"), (None, 1.0, "n1"), (None, 30.0, "n2"), ("a", None, "t0")]
    df = spark.createDataFrame(rows, "k string, s double, id string").select("k", "id", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("ts"))
    got = {r["id"]: (r["admitted"], r["retry_after"]) for r in greedy_spacing(df, "k", "ts", "id", 60.0).collect()}
    assert got == {"x1": (True, None), "x2": (False, 60), "x3": (False, 1), "x4": (True, None), "n1": (True, None), "n2": (False, 31), "t0": (False, None)}
    assert greedy_spacing(df.limit(0), "k", "ts", "id", 60.0).collect() == []
