"""Scenario tables of the reference's business rules, as tests.

Where the business document and the code disagree (email mask detail,
phone mask width) the code and its golden tests are followed (decision D2).
"""

import json

import pandas as pd
from pyspark.sql import functions as F

from gatewise.operators import canary as C
from gatewise.operators import folds
from gatewise.operators import jsonmask as J
from gatewise.operators import metrics as A
from gatewise.operators import providers as B
from gatewise.operators import quota as Q
from gatewise.operators.common import in_intervals


def _ts(col):
    return F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col(col).cast("decimal(18,6)"))


def _breaker(spark, outcomes, threshold=3, cooldown=30):
    rows = [("p", i, float(t), ok) for i, (t, ok) in enumerate(outcomes)]
    df = spark.createDataFrame(rows, "provider string, event_id long, t double, success boolean").withColumn("ts", _ts("t"))
    return [(r.state, r.streak) for r in B.breaker_replay(df, ["provider"], "ts", "event_id", threshold, cooldown).orderBy("event_id").collect()]


def test_breaker_scenarios(spark):
    assert _breaker(spark, [(0, True)]) == [("closed", 0)]  # normal operation
    assert _breaker(spark, [(0, False)])[-1] == ("closed", 1)  # first failure
    assert _breaker(spark, [(0, False), (1, False), (2, False)])[-1][0] == "open"  # threshold reached
    assert _breaker(spark, [(0, False), (1, False), (2, False), (40, True)])[-1][0] == "closed"  # successful probe
    # failed probe reopens and resets the cooldown: a success 10 s later is still refused
    assert [s for s, _ in _breaker(spark, [(0, False), (1, False), (2, False), (40, False), (50, True)])][-2:] == ["open", "open"]
    assert _breaker(spark, [(0, False), (1, True), (2, False)])[-1] == ("closed", 1)  # intermittent


def test_quota_scenarios(spark):
    rows = [(0, "c", 0.0, 50000), (1, "c", 10.0, 50000), (2, "c", 20.0, 1000), (3, "c", 30.0, 10)]
    df = spark.createDataFrame(rows, "event_id long, consumer_id string, t double, tok long").select(
        "event_id", "consumer_id", _ts("t").alias("ts"), F.col("tok").alias("tokens_input"), F.lit(0).cast("long").alias("tokens_output"),
        F.lit(200).alias("status"), F.lit("gpt-4o").alias("model"),
    )
    d = Q.quota_decision(Q.usage_columns(Q.with_cost(df)), monthly_tokens=100000).orderBy("event_id").collect()
    assert d[1].allowed and d[1].remaining_tokens == 50000  # under quota: 50K used of 100K
    assert not d[2].allowed and d[2].reason == "monthly_token_quota_exceeded" and d[2].used_value == 100000.0  # at limit
    assert not d[3].allowed  # over the limit stays blocked
    blk = Q.overage(Q.quota_decision(Q.usage_columns(Q.with_cost(df)), monthly_tokens=100000)).orderBy("event_id").collect()
    assert blk[2].overage_status == 402 and str(blk[2].resets_at) == "2024-02-01 00:00:00"
    # Redis down: fail-open passes degraded, fail-closed rejects with 503
    o = spark.createDataFrame([("2024-01-01 00:00:15", "2024-01-01 00:00:25")], "start string, end string").select(
        F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"))
    dec = Q.quota_decision(Q.usage_columns(Q.with_cost(df)), monthly_tokens=100000)
    assert Q.fail_policy(dec, o, "fail_open").where("event_id = 2").first().allowed is True
    closed = Q.fail_policy(dec, o, "fail_closed").where("event_id = 2").first()
    assert closed.allowed is False and closed.outage_status == 503


def test_multi_level_quota(spark):
    usage = spark.createDataFrame([("c1", "r1", 0, 0, 0)], "consumer_id string, route_id string, used_cr long, used_c long, used_r long")
    lim = spark.createDataFrame([("c1", None, 100000), (None, "r1", 50000)], "consumer_id string, route_id string, limit_tokens long")
    r = Q.most_restrictive_quota(usage, lim).first()
    assert (r.applied_scope, r.remaining_tokens) == ("route", 50000)


def test_cost_scenarios(spark):
    df = spark.createDataFrame([("gpt-4o", 0, 0), ("gpt-4o", 1000000, 1000000)], "model string, tokens_input long, tokens_output long")
    assert [float(r.cost_usd) for r in Q.with_cost(df).collect()] == [0.0, 12.5]


def test_json_masking_scenarios(spark):
    bodies = [
        (1, "support_agent", '{"email":"john@ex.com"}'),
        (2, "support_agent", '{"user":{"phone":"+905321234567"}}'),
        (3, "support_agent", '{"items":[{"pan":"4111111111111111"},{"pan":"5500000000000004"}]}'),
        (4, "support_agent", '{"name":"x"}'),
        (5, "support_agent", '{"email":null}'),
    ]
    b = spark.createDataFrame(bodies, "body_id long, role string, body string")
    rules = [
        {"id": "e", "path": "$.email", "strategy": "mask:email", "field_type": "email"},
        {"id": "p", "path": "$..phone", "strategy": "mask:phone", "field_type": "phone"},
        {"id": "c", "path": "$.items[*].pan", "strategy": "last4", "field_type": "pan"},
        {"id": "s", "path": "$.ssn", "strategy": "redact", "field_type": "national_id"},
    ]
    _, _, out = J.mask_bodies(b, rules, patterns=[])
    got = {r.body_id: r.masked_body for r in out.collect()}
    assert json.loads(got[1]) == {"email": "j***@e***.com"}
    assert json.loads(got[2]) == {"user": {"phone": "+9053***4567"}}
    assert json.loads(got[3]) == {"items": [{"pan": "************1111"}, {"pan": "************0004"}]}
    assert got[4] == '{"name":"x"}'  # no match: byte-identical
    assert got[5] == '{"email":null}'  # null stays null


def _ticks(verdicts, manual=None):
    n = len(verdicts)
    return pd.DataFrame({
        "ts": pd.date_range("2024-01-01", periods=n, freq="10s"), "id": range(n), "verdict": verdicts,
        "canary_total": 50, "latency_ok": True, "manual": manual or [None] * n,
    })


SCHED3 = [(10, 30), (50, 30), (100, 0)]


def test_stage_scenarios():
    ok = folds.stage_fold(_ticks(["ok"] * 12), schedule=SCHED3)
    assert ok.event.dropna().tolist() == ["advanced", "promoted"] and ok.traffic_pct.iloc[-1] == 100
    br = folds.stage_fold(_ticks(["ok"] * 4 + ["breach"]), schedule=SCHED3)
    assert (br.state.iloc[-1], br.stage.iloc[-1]) == ("PAUSED", 2)  # error during stage 2
    rb = folds.stage_fold(_ticks(["ok"] * 4 + ["breach"] * 8), schedule=SCHED3)
    assert rb.state.iloc[-1] == "ROLLED_BACK" and rb.traffic_pct.iloc[-1] == 0  # sustained breach
    mp = folds.stage_fold(_ticks(["ok"] * 2, manual=[None, "promote"]), schedule=SCHED3)
    assert (mp.state.iloc[-1], mp.traffic_pct.iloc[-1]) == ("PROMOTED", 100)
    rs = folds.stage_fold(_ticks(["ok"] * 4 + ["breach", "ok", "ok"], manual=[None] * 6 + ["resume"]), schedule=SCHED3)
    assert (rs.state.iloc[-1], rs.stage.iloc[-1]) == ("STAGE_2", 2)  # resume: same stage
    ar = folds.stage_fold(_ticks(["breach"] * 8 + ["ok"] * 70), schedule=SCHED3, auto_retry=True, retry_cooldown_s=600, max_retries=3)
    assert "retry" in ar.event.dropna().tolist()
    mx = folds.stage_fold(_ticks((["breach"] * 8 + ["ok"] * 61) * 4), schedule=[(10, 10_000), (100, 0)], auto_retry=True, retry_cooldown_s=600, max_retries=3)
    assert mx.event.tolist().count("retry") == 3 and mx.state.iloc[-1] == "ROLLED_BACK"  # terminal after 3 retries


def test_error_rate_verdicts(spark):
    rows = [  # route, version, requests, errors
        ("healthy", "canary", 1000, 5), ("healthy", "baseline", 1000, 3),
        ("breach", "canary", 1000, 40), ("breach", "baseline", 1000, 10),
        ("both", "canary", 1000, 150), ("both", "baseline", 1000, 120),
        ("few", "canary", 2, 1), ("few", "baseline", 1000, 0),
        ("zero", "canary", 1000, 30), ("zero", "baseline", 1000, 0),
        ("alone", "baseline", 1000, 0),
    ]
    df = spark.createDataFrame(rows, "route_id string, version string, n int, bad int").select("route_id", "version", "bad", F.explode(F.sequence(F.lit(1), "n")).alias("i"))
    df = df.withColumn("status", F.when(F.col("i") <= F.col("bad"), 500).otherwise(200)).withColumn("b", F.lit(0)).withColumn("ts_dense", _ts("b"))
    got = {r.route_id: r.verdict for r in C.verdicts_from_traffic(df).collect()}
    assert got == {"healthy": "ok", "breach": "breach", "both": "baseline_unhealthy", "few": "insufficient", "zero": "breach", "alone": "insufficient"}


def test_overlapping_intervals_give_one_row(spark):
    ts = lambda *c: [F.col(x).cast("timestamp_ntz").alias(x) for x in c]
    o = spark.createDataFrame([("2024-01-01 00:00:00", "2024-01-01 03:00:00"), ("2024-01-01 01:00:00", "2024-01-01 05:30:00"), ("2024-01-02 00:00:00", "2024-01-01 00:00:00")], "start string, end string").select(*ts("start", "end"))
    r = spark.createDataFrame([(1, "2024-01-01 02:00:00"), (2, "2024-01-01 05:30:00"), (3, "2024-01-01 05:30:01"), (4, "2023-12-31 23:59:59")], "id long, ts string").select("id", *ts("ts"))
    both = in_intervals(r, "ts", o, "left", closed=True).orderBy("id").collect()
    assert [(x.id, x._start is not None) for x in both] == [(1, True), (2, True), (3, False), (4, False)]
    out = in_intervals(r, "ts", o, "left_anti")
    assert sorted(x.id for x in out.collect()) == [2, 3, 4]
    assert "NestedLoop" not in out._jdf.queryExecution().toString()


def test_gap_between_ticks_breaks_an_alert(spark):
    df = spark.createDataFrame([("r", 60 * m) for m in (1, 2, 120, 240, 241)], "route string, b long").withColumn("ts", _ts("b"))
    got = A.alert_episodes(df, ["route"], "ts", F.lit(True), 2).orderBy("start_ts").collect()
    assert [(x.ticks, x.fired) for x in got] == [(2, True), (1, False), (2, True)]


def test_small_weights_get_their_share(spark):
    df = spark.range(200_000).select(F.col("id").cast("string").alias("k"))
    w = spark.createDataFrame([("a", 999), ("b", 1), ("c", 0)], "group string, weight int")
    n = {r.group: r["count"] for r in C.weighted_assignment(df, w, "k").groupBy("group").count().collect()}
    assert set(n) == {"a", "b"} and 120 <= n["b"] <= 290


def test_most_restrictive_quota_with_many_limits(spark):
    lim = spark.range(300_000).select(F.col("id").cast("string").alias("consumer_id"), F.lit(None).cast("string").alias("route_id"), (F.col("id") + 10).alias("limit_tokens"))
    use = spark.createDataFrame([("7", "r", 1, 4, 1), ("x", "r", 1, 1, 1)], "consumer_id string, route_id string, used_cr long, used_c long, used_r long")
    got = {r.consumer_id: r.remaining_tokens for r in Q.most_restrictive_quota(use, lim).collect()}
    assert got == {"7": 13, "x": None}
