"""The provider breaker against its stored state, call by call."""

import random
from datetime import datetime, timedelta

import pytest

from gatewise.operators.providers import provider_breaker


def _replay(calls, threshold, cooldown):
    state, failures, opened, out = "closed", 0, None, []
    for t, ok in calls:
        seen = "half_open" if state == "open" and t - opened >= cooldown else state
        if ok:
            state, failures = "closed", 0
        else:
            failures += 1
            if failures >= threshold:
                state, opened = "open", t
        move = "opened" if (seen, state) == ("closed", "open") else "closed" if seen != "closed" and ok else "probe_failed" if seen == "half_open" and not ok else None
        out.append((seen, failures, state, move))
    return out


@pytest.mark.parametrize(("threshold", "chunk_s"), [(1, 60), (3, 20), (3, 3600)])
def test_equals_the_stored_state(spark, threshold, chunk_s):
    rng = random.Random(threshold * 100 + chunk_s)
    t0, keys, rows, n = datetime(2024, 1, 1), {}, [], 0
    for key, many in (("hot", 400), ("b", 40), (None, 20)):
        at, calls = 0, []
        for _ in range(many):
            at += rng.choice([0, 1, 5, 29, 30, 31, 200])
            calls.append((at, rng.random() < 0.4))
        keys[key] = calls
        for t, ok in calls:
            rows.append((key, t0 + timedelta(seconds=t), n, ok))
            n += 1
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, event_id long, success boolean")
    got = {}
    for r in sorted(provider_breaker(df, ["k"], threshold=threshold, cooldown_s=30.0, chunk_s=chunk_s).collect(), key=lambda r: r.event_id):
        got.setdefault(r.k, []).append((r.seen, r.failures, r.state, r.transition))
    assert got == {k: _replay(c, threshold, 30) for k, c in keys.items()}


def test_no_calls(spark):
    assert provider_breaker(spark.createDataFrame([], "k string, ts timestamp_ntz, event_id long, success boolean"), ["k"]).collect() == []
