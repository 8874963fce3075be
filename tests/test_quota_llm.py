"""Cost, token estimate, provider payload goldens and quota invariants."""

from decimal import Decimal

from pyspark.sql import functions as F

from gatewise.functions import llm as L
from gatewise.operators import quota as Q


def test_cost_goldens(spark):
    rows = [
        ("gpt-4o", 1000, 500, "0.0075"),
        ("gpt-4o-mini", 2000, 1000, "0.0009"),
        ("claude-sonnet-4-6", 1000, 1000, "0.018"),
        ("claude-opus-4-6", 1000, 1000, "0.09"),
        ("unknown", 1000, 1000, "0.04"),
        ("gpt-4o", 1000000, 500000, "7.5"),
        ("gpt-4o", 500, 0, "0.00125"),
        ("gpt-4o", 0, 500, "0.005"),
        ("gemini-2.0-flash", 1, 1, "0.000001"),
    ]
    df = spark.createDataFrame([(m, i, o) for m, i, o, _ in rows], "model string, tokens_input long, tokens_output long")
    got = [r.cost_usd for r in Q.with_cost(df).collect()]
    assert [Decimal(e) for *_, e in rows] == got


def test_custom_default_price(spark):
    df = spark.createDataFrame([("anything", 1000, 1000)], "model string, tokens_input long, tokens_output long")
    assert Q.with_cost(df, {"_default": ("0.05", "0.1")}).first().cost_usd == Decimal("0.15")


def test_approx_tokens(spark):
    df = spark.createDataFrame([("hello world",), ("hello",), ("a   b   c",)], "t string")
    assert [r.n for r in df.select(L.approx_tokens(F.col("t")).alias("n")).collect()] == [3, 2, 4]


def test_usage_goldens(spark):
    bodies = [
        '{"usage":{"prompt_tokens":50,"completion_tokens":100,"total_tokens":150}}',
        '{"usage":{"input_tokens":30,"output_tokens":70}}',
        '{"usageMetadata":{"promptTokenCount":25,"candidatesTokenCount":60,"totalTokenCount":85}}',
        '{"nothing":1}',
        "not json",
    ]
    df = spark.createDataFrame([(b,) for b in bodies], "b string")
    out = [r.u for r in df.select(L.extract_usage(F.col("b")).alias("u")).collect()]
    assert [tuple(u) if u else None for u in out] == [(50, 100, 150), (30, 70, 100), (25, 60, 85), None, None]


def test_quota_block_invariants(spark):
    """Blocked requests add no usage; the admitted usage never passes a limit
    by more than one request; verdicts follow the check order."""
    rows = [(i, "c1", f"2024-01-01 00:{i:02d}:00", 300) for i in range(30)]
    df = spark.createDataFrame(rows, "event_id long, consumer_id string, ts string, tok long").select(
        "event_id", "consumer_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("tok").alias("tokens_input"), F.lit(0).cast("long").alias("tokens_output"),
        F.lit(200).alias("status"), F.lit("gpt-4o").alias("model"),
    )
    d = Q.quota_decision(Q.usage_columns(Q.with_cost(df)), daily_tokens=2000).orderBy("event_id").collect()
    allowed = [r.allowed for r in d]
    assert allowed == [True] * 7 + [False] * 23  # 7 x 300 = 2100 >= 2000 after the 7th
    assert all(r.reason == "daily_token_quota_exceeded" for r in d[7:])
    assert d[-1].day_tokens_before == 2100


def test_multi_limit_decision_matches_sequential_replay(spark):
    """The three-pass window derivation equals a plain sequential replay of
    the block policy with daily tokens, monthly tokens and monthly dollars."""
    import random

    rnd = random.Random(11)
    rows = []
    for c in ["a", "b", "c"]:
        t = 0
        for _ in range(250):
            t += rnd.choice([600, 1800, 3600, 7200, 20000])
            rows.append((len(rows), c, t, rnd.randint(0, 3000), rnd.randint(0, 900), rnd.choice([200, 200, 200, 500])))
    LD, LM, LUSD = 9000, 60000, Decimal("0.25")
    df = spark.createDataFrame(rows, "event_id long, consumer_id string, t long, ti long, tout long, status int").select(
        "event_id", "consumer_id", (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("t").cast("decimal(18,6)"))).alias("ts"),
        F.col("ti").alias("tokens_input"), F.col("tout").alias("tokens_output"), "status", F.lit("gpt-4o").alias("model"),
    )
    priced = Q.usage_columns(Q.with_cost(df))
    got = {r.event_id: (r.allowed, r.reason) for r in Q.quota_decision(priced, LD, LM, str(LUSD)).collect()}
    exp = {}
    for r in sorted(priced.select("event_id", "consumer_id", "ts", "usage_tokens", "usage_cost").collect(), key=lambda r: (r.consumer_id, r.ts, r.event_id)):
        st = exp.setdefault(("state", r.consumer_id), {"day": None, "month": None, "d": 0, "m": 0, "usd": Decimal(0)})
        day, month = r.ts.date(), (r.ts.year, r.ts.month)
        if st["day"] != day:
            st["day"], st["d"] = day, 0
        if st["month"] != month:
            st["month"], st["m"], st["usd"] = month, 0, Decimal(0)
        if st["d"] >= LD:
            v = (False, "daily_token_quota_exceeded")
        elif st["m"] >= LM:
            v = (False, "monthly_token_quota_exceeded")
        elif st["usd"] >= LUSD:
            v = (False, "monthly_dollar_budget_exceeded")
        else:
            v = (True, None)
            st["d"] += r.usage_tokens
            st["m"] += r.usage_tokens
            st["usd"] += r.usage_cost
        exp[r.event_id] = v
    exp = {k: v for k, v in exp.items() if not isinstance(k, tuple)}
    assert got == exp
    assert {v[1] for v in exp.values()} >= {None, "daily_token_quota_exceeded", "monthly_token_quota_exceeded"}
