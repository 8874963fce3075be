"""Throttle and allow: usage that passes is usage that counts (against the rule, request by request)."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gatewise.operators import quota as Q
from gatewise.operators import walks

DAY = 86400


def _sequential(rows, daily, monthly, usd, policy):
    out, state = {}, {}
    for key, s, i, tok, cents in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        st = state.setdefault(key, {"day": None, "month": None, "d": 0, "m": 0, "c": 0, "last": None})
        day = s // DAY
        month = 0 if s < 31 * DAY else 1
        if st["day"] != day:
            st["day"], st["d"] = day, 0
        if st["month"] != month:
            st["month"], st["m"], st["c"] = month, 0, 0
        ex = st["d"] >= daily or st["m"] >= monthly or st["c"] >= usd * 100
        ok, retry = True, None
        if ex and policy == "throttle":
            ok = st["last"] is None or s - st["last"] >= 60
            if ok:
                st["last"] = s
            else:
                retry = math.ceil(60 - (s - st["last"]))
        out[i] = (ex, ok, retry, st["d"], st["m"])
        if ok:
            st["d"] += tok
            st["m"] += tok
            st["c"] += cents
    return out


def _frame(spark, rows):
    ts = (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("s").cast("decimal(18,6)"))).cast("timestamp_ntz")
    df = spark.createDataFrame(rows, "consumer_id string, s long, event_id long, usage_tokens long, cents long")
    return df.select("consumer_id", ts.alias("ts"), "event_id", "usage_tokens", (F.col("cents") / 100).cast("decimal(22,6)").alias("usage_cost"))


def _rows(seed):
    """Bursts around midnight and the turn of the month; throttled requests push the month over its limit."""
    rnd = random.Random(seed)
    rows = []
    for key in ("hot", "b", "c"):
        s = rnd.choice([0, 29 * DAY])
        for _ in range(250 if key == "hot" else 60):
            s += rnd.choice([0, 1, 20, 59, 60, 61, 900, 3600, 20000])
            rows.append((key, s, len(rows), rnd.choice([0, 10, 50, 120]), rnd.choice([0, 1, 7])))
    for key in ("b", "c"):
        for j in range(40):
            rows.append((key, 31 * DAY - 600 + j * 30, len(rows), 60, 3))
    return [r for r in rows if r[1] < 59 * DAY]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_throttle_equals_the_rule(spark, monkeypatch, seed):
    monkeypatch.setattr(walks, "FAN", 2)
    monkeypatch.setattr(walks.walk, "__defaults__", (7, 60))  # seven rows a chunk
    rows = _rows(seed)
    daily, monthly, usd = 300, 2500, 2
    got = Q.overage_replay(_frame(spark, rows), "throttle", daily, monthly, usd).collect()
    want = _sequential(rows, daily, monthly, usd, "throttle")
    found = {r["event_id"]: (r["exhausted"], r["final_allowed"], r["retry_after"], r["day_tokens_before"], r["month_tokens_before"]) for r in got}
    assert found == want
    assert any(ex and ok for ex, ok, *_ in want.values()) and any(not ok for _, ok, *_ in want.values())


def test_allow_counts_everything_and_alerts_once(spark):
    rows = _rows(4)
    got = Q.overage_replay(_frame(spark, rows), "allow", 300, 2500, 2).collect()
    want = _sequential(rows, 300, 2500, 2, "allow")
    assert {r["event_id"]: (r["exhausted"], r["final_allowed"], None, r["day_tokens_before"], r["month_tokens_before"]) for r in got} == want
    alerts = [(r["consumer_id"], r["reason"], str(r["ts"])[: 10 if r["reason"].startswith("daily") else 7]) for r in got if r["alert"]]
    assert len(alerts) == len(set(alerts)) > 0
    assert set(alerts) == {(r["consumer_id"], r["reason"], str(r["ts"])[: 10 if r["reason"].startswith("daily") else 7]) for r in got if r["exhausted"]}


def test_no_limit_and_no_rows(spark):
    df = _frame(spark, _rows(5)[:20])
    assert Q.overage_replay(df, "throttle").where("exhausted or not final_allowed").count() == 0
    assert Q.overage_replay(df.limit(0), "throttle", 1).count() == 0
    with pytest.raises(ValueError):
        Q.overage_replay(df, "block")
