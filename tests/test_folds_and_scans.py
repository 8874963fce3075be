"""Breaker replay (window formulation) against a sequential reference fold,
stage/shadow folds on scenario tables, and the entry contract."""

import random

import pandas as pd
from pyspark.sql import functions as F

from gatewise.operators import folds
from gatewise.operators import providers as B


def _sequential_breaker(events, threshold, cooldown):
    state, failures, opened = "closed", 0, None
    out = []
    for ts, ok in events:
        if state == "open" and ts - opened >= cooldown:
            state = "half_open"
        if ok:
            if state == "half_open":
                state, failures = "closed", 0
            elif state == "closed":
                failures = 0
        else:
            if state == "half_open":
                state, opened = "open", ts
            else:
                failures += 1
                if failures >= threshold:
                    state, opened = "open", ts
        out.append("open" if state == "open" else "closed")
    return out


def test_breaker_matches_sequential_fold(spark):
    rnd = random.Random(7)
    rows, expect = [], []
    for key in ["a", "b", "c"]:
        t, ev = 0, []
        for i in range(400):
            t += rnd.choice([1, 2, 5, 20, 40])
            ev.append((t, rnd.random() < 0.35))
        exp = _sequential_breaker(ev, 3, 30)
        for i, ((t0, ok), st) in enumerate(zip(ev, exp)):
            rows.append((key, i, t0, ok))
            expect.append((key, i, st))
    df = spark.createDataFrame(rows, "provider string, event_id long, t long, success boolean").withColumn(
        "ts", (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("t").cast("decimal(18,6)")))
    )
    got = B.breaker_replay(df, ["provider"], "ts", "event_id", 3, 30.0, chunk_s=300).select("provider", "event_id", "state").collect()
    assert sorted((r.provider, r.event_id, r.state) for r in got) == sorted(expect)


def test_shadow_disable_fold():
    ts = pd.to_datetime(["2024-01-01 00:00:00", "2024-01-01 00:01:00", "2024-01-01 00:02:00", "2024-01-01 00:03:00", "2024-01-01 00:08:00"])
    pdf = pd.DataFrame({"ts": ts, "id": range(5), "success": [False, False, False, False, False]})
    out = folds.shadow_disable_fold(pdf)
    assert out.tripped.tolist() == [False, False, True, False, False]
    assert out.skipped.tolist() == [False, False, False, True, False]


def test_stage_fold_advances_and_rolls_back():
    ts = pd.date_range("2024-01-01", periods=80, freq="10s")
    verdict = ["ok"] * 40 + ["breach"] * 10 + ["ok"] * 30
    pdf = pd.DataFrame({"ts": ts, "id": range(80), "verdict": verdict, "canary_total": 20, "latency_ok": True, "manual": None})
    out = folds.stage_fold(pdf, schedule=[(5, 60), (10, 60), (100, 0)])
    assert out.event.dropna().tolist()[:2] == ["advanced", "promoted"]
    pdf2 = pdf.assign(verdict=["ok"] * 3 + ["breach"] * 20 + ["ok"] * 57)
    ev2 = folds.stage_fold(pdf2).event.dropna().tolist()
    assert ev2[:2] == ["paused_breach", "rolled_back"]


def test_entry_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_shadow_walk_is_exact(spark):
    """Chunk maps give the same rows as one fold per key."""
    from gatewise.plans import q_canary
    from gatewise.plans.catalog import queries

    sf = "/root/testdata/sf0.01"
    got = queries()["c12_shadow_auto_disable"](spark, sf).toPandas()
    o = q_canary._shadow_outcomes(spark, sf).toPandas()
    exp = pd.concat([folds.shadow_disable_fold(g[["ts", "id", "success"]]) for _, g in o.groupby("route_id")]).sort_values("id")
    got["id"] = got["request_id"].str[4:].astype("int64")
    got = got.sort_values("id")
    assert (exp[["skipped", "tripped", "fail_count"]].to_numpy() == got[["skipped", "tripped", "fail_count"]].to_numpy()).all()
    assert exp.tripped.sum() > 0


def test_greedy_spacing_is_exact(spark):
    """One chunk per key and many chunks both equal the sequential rule."""
    from gatewise.operators.spacing import greedy_spacing

    rnd = random.Random(3)
    rows = []
    for k in ["a", "b", "c"]:
        t = 0.0
        for _ in range(300):
            t += rnd.choice([1, 3, 7, 13, 29, 61, 90]) if k != "c" else rnd.choice([1, 2, 5, 11, 20, 40])
            rows.append((k, t, len(rows)))
    exp = {}
    for k in "abc":
        last = None
        for _, t, i in [r for r in rows if r[0] == k]:
            ok = last is None or t - last >= 60
            exp[i] = ok
            last = t if ok else last
    df = spark.createDataFrame(rows, "k string, t double, id long").withColumn(
        "ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("t").cast("decimal(18,6)"))
    )
    for rows_of_chunk in (50_000, 5):
        got = {r.id: r.admitted for r in greedy_spacing(df, "k", "ts", "id", 60.0, chunk_rows=rows_of_chunk).collect()}
        assert got == exp
