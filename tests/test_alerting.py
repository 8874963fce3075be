"""Alert runs against an evaluation of every tick."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gatewise.operators import alerting as AL

T0 = datetime(2024, 1, 1)


def _at(s):
    return T0 + timedelta(seconds=s)


def _brute(met, first, until, wait):
    """met(tick) -> bool; ticks are minutes after T0."""
    runs, start = [], None
    for t in range(first, until + 2):
        now = t <= until and met(t)
        if now and start is None:
            start = t
        if not now and start is not None:
            last = t - 1
            fired, still = start + wait <= last, last >= until
            state = ("firing" if fired else "pending") if still else ("resolved" if fired else "dropped")
            runs.append((_at(start * 60), _at((start + wait) * 60) if fired else None, None if still else _at((last + 1) * 60), state))
            start = None
    return sorted(runs, key=str)


def _until(seconds):
    return max(-(-s // 60) for s in seconds)


def test_code_rules_equal_tick_by_tick_evaluation(spark):
    rng = random.Random(11)
    rows = []
    for r in AL.CODE_RULES:
        at = 0
        for _ in range(12):  # bursts and silences
            at += rng.choice([60, 240, 900])
            rows += [(r.code, at + rng.randrange(120)) for _ in range(rng.choice([1, 4, 8, 60]))]
    rows += [("OTHER", 20_000), (None, 5)]
    df = spark.createDataFrame([(c, _at(s)) for c, s in rows] + [("INTERNAL_ERROR", None)], "code string, ts timestamp_ntz")
    until = _until([s for _, s in rows])
    got = {}
    for x in AL.code_alerts(df, "code", "ts").collect():
        got.setdefault((x.code, x.severity), []).append((x.pending_at, x.firing_at, x.resolved_at, x.state))
    want, states = {}, set()
    for r in AL.CODE_RULES:
        mine = [s for c, s in rows if c == r.code]
        runs = _brute(lambda t: sum(t * 60 - r.window_s <= s < t * 60 for s in mine) > r.over, 0, until, -(-r.for_s // 60))
        states |= {x[3] for x in runs}
        if runs:
            want[(r.code, r.severity)] = runs
    assert {k: sorted(v, key=str) for k, v in got.items()} == want
    assert "resolved" in states and "dropped" in states


def test_gauges_go_stale_and_open_runs_stay_open(spark):
    rng = random.Random(12)
    rows, at = [], 0
    for i in range(120):
        at += rng.choice([1, 30, 60, 150, 299, 300, 301, 700])
        rows += [("a" if i % 9 else "b", at, 2 * i + k, rng.choice([0, 1, 1, 1])) for k in range(rng.choice([1, 2]))]
    rows += [("c", at - 200 + 60 * k, 1000 + k, 1) for k in range(4)]
    df = spark.createDataFrame([(k, _at(s), i, v) for k, s, i, v in rows], "k string, ts timestamp_ntz, id long, v int")
    until = _until([s for _, s, _, _ in rows])
    runs = AL.alert_runs(AL.gauge_ticks(df, ["k"], "ts", "id", "v"), ["k"], F.col("value") == 1, 180, AL.last_tick(df, "ts"))
    got = {}
    for x in runs.collect():
        got.setdefault(x.k, []).append((x.pending_at, x.firing_at, x.resolved_at, x.state))
    for k in "abc":
        mine = [(s, i, v) for kk, s, i, v in rows if kk == k]

        def met(t):
            seen = [x for x in mine if x[0] <= t * 60]
            return bool(seen) and max(seen)[0] + 300 > t * 60 and max(seen)[2] == 1

        assert sorted(got.get(k, []), key=str) == _brute(met, 0, until, 3)
    assert any(x[3] in ("firing", "pending") for x in got["c"])


def test_no_samples_no_alerts(spark):
    none = spark.createDataFrame([], "code string, ts timestamp_ntz")
    assert AL.code_alerts(none, "code", "ts").collect() == []
