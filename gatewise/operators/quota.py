"""Quota, cost and budget operators (Q1-Q14).

Scale notes
-----------
* Prices are a config dimension of a few dozen rows: broadcast behind
  ``bounded_broadcast``.
* Running usage is never computed over a whole (consumer, month) window.
  Rows are ordered inside (consumer, UTC day); a day-totals table (one row
  per consumer-day, pre-aggregated) gives each day its month offset through
  a window over that small table, joined back on (consumer, day).  The
  largest sort unit is one consumer-day, and the big side keeps its
  (consumer, day) partitioning through the join-backs.
* Quota verdicts for ``block`` with up to three limits are exact with
  windows only: inside a period the allowed prefix is monotone, so the
  requests admitted under the daily limit alone are computed first, then the
  monthly prefix of those, then the true allowed prefix.  ``throttle`` (one
  admitted request per 60 s) feeds on its own output: ``overage_replay``
  repeats prefix sums and an ordered walk (``walks``) until nothing changes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewise.functions.pricing import (
    DEFAULT_KEY,
    DEFAULT_PRICING,
    FALLBACK_PRICE,
    PRICE_TYPE,
    cost_expr,
    pricing_frame,
)
from gatewise.operators.common import bounded_broadcast, in_intervals, materialize
from gatewise.operators.scan import join_back
from gatewise.operators.spacing import greedy_spacing

# ---------------------------------------------------------------- Q1 / Q2


def effective_pricing(default: DataFrame, custom: DataFrame) -> DataFrame:
    """Q2: custom prices override default ones per model."""
    return default.join(custom.select("model"), "model", "left_anti").unionByName(custom)


def with_cost(
    df: DataFrame,
    pricing: DataFrame | dict | None = None,
    model_col: str = "model",
    in_col: str = "tokens_input",
    out_col: str = "tokens_output",
    cost_col: str = "cost_usd",
) -> DataFrame:
    """Q1: add ``cost_usd`` (decimal(22,6), half-up) and ``price_known``.

    Unknown models take the table's ``_default`` row, else 0.01 / 0.03.
    """
    spark = df.sparkSession
    if pricing is None or isinstance(pricing, dict):
        table = DEFAULT_PRICING if pricing is None else pricing
        dim = pricing_frame(spark, table)
        n = len(table)
        dflt = table.get(DEFAULT_KEY, FALLBACK_PRICE)
    else:
        dim = pricing.select("model", F.col("input_per_1k").cast(PRICE_TYPE), F.col("output_per_1k").cast(PRICE_TYPE))
        n = None
        row = dim.where(F.col("model") == DEFAULT_KEY).limit(1).collect()  # one row at most
        dflt = (str(row[0][1]), str(row[0][2])) if row else FALLBACK_PRICE
    dim = dim.where(F.col("model") != DEFAULT_KEY).select(
        F.col("model").alias("_pm"), F.col("input_per_1k").alias("_pin"), F.col("output_per_1k").alias("_pout")
    )
    j = df.join(bounded_broadcast(dim, known_rows=n), F.col(model_col) == F.col("_pm"), "left")
    p_in = F.coalesce(F.col("_pin"), F.lit(dflt[0]).cast(PRICE_TYPE))
    p_out = F.coalesce(F.col("_pout"), F.lit(dflt[1]).cast(PRICE_TYPE))
    return j.withColumn(cost_col, cost_expr(F.col(in_col), F.col(out_col), p_in, p_out)).withColumn(
        "price_known", F.col("_pm").isNotNull()
    ).drop("_pm", "_pin", "_pout")


def spend_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Totals of requests, tokens and dollars per key (partial aggregation map-side)."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("tokens_input").alias("tokens_input"),
        F.sum("tokens_output").alias("tokens_output"),
        F.sum("cost_usd").cast("double").alias("cost_usd"),
        F.sum(F.when(~F.col("price_known"), 1).otherwise(0)).cast("bigint").alias("unknown_price_requests"),
    )


# ---------------------------------------------------------------- U6/U7 helpers used here


def usage_columns(df: DataFrame, status_col: str = "status") -> DataFrame:
    """Counted usage: successful requests with positive tokens (zero/negative skipped)."""
    total = F.col("tokens_input") + F.col("tokens_output")
    ok = (F.col(status_col) >= 200) & (F.col(status_col) < 300) & (total > 0)
    return df.withColumn("usage_tokens", F.when(ok, total).otherwise(F.lit(0)).cast("bigint")).withColumn(
        "usage_cost", F.when(ok, F.col("cost_usd")).otherwise(F.lit(0).cast("decimal(22,6)"))
    )


# ---------------------------------------------------------------- Q3 ledger


def _day_month(df: DataFrame, ts_col: str) -> DataFrame:
    return df.withColumn("day", F.to_date(F.col(ts_col))).withColumn("month", F.trunc(F.col(ts_col).cast("date"), "month"))


def _prefix_in_month(
    df: DataFrame, key: str, order: Sequence[str], cols: dict[str, Column], prefix: str
) -> DataFrame:
    """For every named value, the sum over earlier rows of the same key and
    day (``{prefix}_{name}_day``) and month (``{prefix}_{name}_month``).

    Two-level scan: rows are ordered only within (key, UTC hour); the day
    and month offsets of each hour come from windows over the pre-aggregated
    hour totals (one row per key and hour), joined back on (key, hour).
    """
    out = df.withColumn("_hour", F.date_format(F.col(order[0]), "HH").cast("int"))
    w_hr = Window.partitionBy(key, "day", "_hour").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    for name, c in cols.items():
        out = out.withColumn(f"_v_{name}", c).withColumn(f"_h_{name}", F.coalesce(F.sum(f"_v_{name}").over(w_hr), F.lit(0).cast(c_type(out, c))))
    hours = out.groupBy(key, "day", "_hour", "month").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in cols])
    w_d = Window.partitionBy(key, "day").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    w_m = Window.partitionBy(key, "month").orderBy("day", "_hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select(
        key, "day", "_hour",
        *[F.coalesce(F.sum(f"_t_{n}").over(w_d), F.lit(0)).alias(f"_od_{n}") for n in cols],
        *[F.coalesce(F.sum(f"_t_{n}").over(w_m), F.lit(0)).alias(f"_om_{n}") for n in cols],
    )
    out = join_back(out, hours, [key, "day", "_hour"])
    for n in cols:
        out = (
            out.withColumn(f"{prefix}_{n}_day", F.col(f"_od_{n}") + F.col(f"_h_{n}"))
            .withColumn(f"{prefix}_{n}_month", F.col(f"_om_{n}") + F.col(f"_h_{n}"))
            .drop(f"_od_{n}", f"_om_{n}", f"_h_{n}", f"_v_{n}")
        )
    return out.drop("_hour")


def c_type(df: DataFrame, c: Column) -> str:
    return df.select(c).schema[0].dataType.simpleString()


def usage_ledger(requests: DataFrame, key: str = "consumer_id", ts_col: str = "ts", id_col: str = "event_id") -> DataFrame:
    """Q3: usage of earlier requests per consumer in the same UTC day / month.

    Input needs ``usage_tokens`` and ``usage_cost`` (see ``usage_columns``).
    Adds ``day_tokens_before``, ``month_tokens_before``,
    ``month_dollars_before`` and the matching ``*_after`` values.
    """
    df = _day_month(requests, ts_col)
    df = _prefix_in_month(df, key, [ts_col, id_col], {"tok": F.col("usage_tokens"), "usd": F.col("usage_cost")}, "b")
    return (
        df.withColumnRenamed("b_tok_day", "day_tokens_before")
        .withColumnRenamed("b_tok_month", "month_tokens_before")
        .withColumn("month_dollars_before", F.col("b_usd_month").cast("decimal(22,6)"))
        .drop("b_usd_day", "b_usd_month")
        .withColumn("day_tokens_after", F.col("day_tokens_before") + F.col("usage_tokens"))
        .withColumn("month_tokens_after", F.col("month_tokens_before") + F.col("usage_tokens"))
        .withColumn("month_dollars_after", F.col("month_dollars_before") + F.col("usage_cost"))
    )


# ---------------------------------------------------------------- Q4 decision


def quota_decision(
    requests: DataFrame,
    daily_tokens: int | None = None,
    monthly_tokens: int | None = None,
    monthly_dollars: str | float | None = None,
    key: str = "consumer_id",
    ts_col: str = "ts",
    id_col: str = "event_id",
) -> DataFrame:
    """Q4: replay quota pre-checks under the ``block`` policy.

    Usage is counted only for admitted, successful requests; blocked
    requests add nothing.  Check order: daily tokens, monthly tokens,
    monthly dollars; ``used >= limit`` is exhausted.  Output columns:
    ``allowed, reason, period, limit_value, used_value, remaining_tokens,
    remaining_dollars`` plus the usage before the request.

    The three passes each read their input twice (rows and hour totals), so
    the output of passes 1 and 2 is checkpointed to the shared checkpoint
    folder: the plan stays linear in the number of passes.
    """
    order = [ts_col, id_col]
    big = 1 << 62
    ld = F.lit(daily_tokens if daily_tokens is not None else big).cast("bigint")
    lm = F.lit(monthly_tokens if monthly_tokens is not None else big).cast("bigint")
    lusd = F.lit(str(monthly_dollars) if monthly_dollars is not None else "1e15").cast("decimal(22,6)")

    df = _day_month(requests, ts_col)
    # 1. admitted under the daily limit alone (prefix of the day)
    df = _prefix_in_month(df, key, order, {"tok": F.col("usage_tokens")}, "_p0").withColumnRenamed("_p0_tok_day", "_d0").drop("_p0_tok_month")
    df = materialize(df.withColumn("_a_d", F.col("_d0") < ld))
    # 2. month prefix of usage admitted by the daily rule
    df = _prefix_in_month(
        df,
        key,
        order,
        {
            "tok": F.when(F.col("_a_d"), F.col("usage_tokens")).otherwise(F.lit(0).cast("bigint")),
            "usd": F.when(F.col("_a_d"), F.col("usage_cost")).otherwise(F.lit(0).cast("decimal(22,6)")),
        },
        "_m1",
    )
    df = materialize(df.withColumn("allowed", F.col("_a_d") & (F.col("_m1_tok_month") < lm) & (F.col("_m1_usd_month") < lusd)))
    # 3. true usage before each request = prefix of admitted usage
    df = _prefix_in_month(
        df,
        key,
        order,
        {
            "tok": F.when(F.col("allowed"), F.col("usage_tokens")).otherwise(F.lit(0).cast("bigint")),
            "usd": F.when(F.col("allowed"), F.col("usage_cost")).otherwise(F.lit(0).cast("decimal(22,6)")),
        },
        "u",
    )
    return _verdict(df, daily_tokens, monthly_tokens, monthly_dollars).drop("_d0", "_a_d", "_m1_tok_day", "_m1_tok_month", "_m1_usd_day", "_m1_usd_month")


def _hits(daily_tokens: int | None, monthly_tokens: int | None, monthly_dollars: str | float | None) -> tuple[Column, Column, Column]:
    """Which limits the usage before the row (``u_*``) has reached; ``used >= limit`` is exhausted."""
    none = F.lit(False)
    return (
        none if daily_tokens is None else F.col("u_tok_day") >= F.lit(daily_tokens),
        none if monthly_tokens is None else F.col("u_tok_month") >= F.lit(monthly_tokens),
        none if monthly_dollars is None else F.col("u_usd_month").cast("decimal(22,6)") >= F.lit(str(monthly_dollars)).cast("decimal(22,6)"),
    )


def _verdict(df: DataFrame, daily_tokens: int | None, monthly_tokens: int | None, monthly_dollars: str | float | None) -> DataFrame:
    """Reason, period, limit, used and remaining amounts from the usage before each row."""
    big = 1 << 62
    ld = F.lit(daily_tokens if daily_tokens is not None else big).cast("bigint")
    lm = F.lit(monthly_tokens if monthly_tokens is not None else big).cast("bigint")
    lusd = F.lit(str(monthly_dollars) if monthly_dollars is not None else "1e15").cast("decimal(22,6)")
    daily_hit, monthly_hit, usd_hit = _hits(daily_tokens, monthly_tokens, monthly_dollars)
    d_used, m_used, usd_used = F.col("u_tok_day"), F.col("u_tok_month"), F.col("u_usd_month").cast("decimal(22,6)")
    reason = (
        F.when(daily_hit, "daily_token_quota_exceeded")
        .when(monthly_hit, "monthly_token_quota_exceeded")
        .when(usd_hit, "monthly_dollar_budget_exceeded")
    )
    if daily_tokens is not None:
        remaining_tokens = F.when(daily_hit | monthly_hit, F.lit(0).cast("bigint")).otherwise(ld - d_used)
    elif monthly_tokens is not None:
        remaining_tokens = F.when(monthly_hit, F.lit(0).cast("bigint")).otherwise(lm - m_used)
    else:
        remaining_tokens = F.lit(None).cast("bigint")
    remaining_usd = (
        F.when(usd_hit, F.lit(0).cast("decimal(22,6)")).otherwise(lusd - usd_used)
        if monthly_dollars is not None
        else F.lit(None).cast("decimal(22,6)")
    )
    return (
        df.withColumn("reason", reason)
        .withColumn("period", F.when(daily_hit, "daily").when(monthly_hit | usd_hit, "monthly"))
        .withColumn(
            "limit_value",
            F.when(daily_hit, ld.cast("double")).when(monthly_hit, lm.cast("double")).when(usd_hit, lusd.cast("double")),
        )
        .withColumn(
            "used_value",
            F.when(daily_hit, d_used.cast("double")).when(monthly_hit, m_used.cast("double")).when(usd_hit, usd_used.cast("double")),
        )
        .withColumn("remaining_tokens", remaining_tokens)
        .withColumn("remaining_dollars", remaining_usd)
        .withColumnRenamed("u_tok_day", "day_tokens_before")
        .withColumnRenamed("u_tok_month", "month_tokens_before")
        .withColumn("month_dollars_before", usd_used)
        .drop("u_usd_day", "u_usd_month")
    )


# ---------------------------------------------------------------- Q10 reset time


def reset_time(period: Column, ts: Column) -> Column:
    """Q10: next UTC midnight (daily) or first instant of next month (monthly)."""
    # date arithmetic, then timestamp_ntz: independent of the session time zone
    d = F.to_date(ts)
    return F.when(period == "daily", F.date_add(d, 1).cast("timestamp_ntz")).when(
        period == "monthly", F.add_months(F.trunc(d, "month"), 1).cast("timestamp_ntz")
    )


# ---------------------------------------------------------------- Q6 overage


def overage(decisions: DataFrame, ts_col: str = "ts") -> DataFrame:
    """Q6, policy ``block``: exhausted requests (``allowed = false``) get 402 with the reset time.

    A blocked request adds no usage, so the decisions of ``quota_decision``
    are final.  The other policies let requests through, whose usage counts:
    see ``overage_replay``.
    """
    exhausted = ~F.col("allowed")
    return (
        decisions.withColumn("exhausted", exhausted)
        .withColumn("final_allowed", F.col("allowed"))
        .withColumn("overage_status", F.when(exhausted, 402))
        .withColumn("resets_at", F.when(exhausted, reset_time(F.col("period"), F.col(ts_col))))
        .withColumn("retry_after", F.lit(None).cast("bigint"))
    )


def overage_replay(
    requests: DataFrame,
    policy: str,
    daily_tokens: int | None = None,
    monthly_tokens: int | None = None,
    monthly_dollars: str | float | None = None,
    key: str = "consumer_id",
    ts_col: str = "ts",
    id_col: str = "event_id",
    throttle_s: int = 60,
) -> DataFrame:
    """Q6, policies ``allow`` and ``throttle``: what passes adds to the usage that later requests meet.

    ``requests`` needs ``usage_tokens`` and ``usage_cost``; ids are unique.
    Adds the columns of ``quota_decision`` and exhausted, final_allowed,
    overage_status, retry_after, resets_at (null here) and alert: the first
    exhausted request of a consumer, limit and period (the 100 % alert).

    ``allow`` admits everything, so the plain ledger holds.  ``throttle``
    admits one exhausted request per ``throttle_s``.  Which requests are
    exhausted and which of those are admitted depend on each other, but only
    forwards in time, so the rule has one solution: the set of exhausted
    requests that gives itself back.  It is found from the daily limit alone
    by repeating (exhausted -> throttle walk -> usage -> exhausted).  Every
    round settles at least the next crossing of each consumer's month; months
    start afresh, so two rounds and one that changes nothing are usual.  Each
    round is prefix sums over hours and a walk by chunk maps, and is written
    once; no task holds a consumer.
    """
    if policy not in ("allow", "throttle"):
        raise ValueError(policy)
    order = [ts_col, id_col]
    limits = daily_tokens, monthly_tokens, monthly_dollars

    def ledger(df: DataFrame, admitted: Column) -> DataFrame:
        sums = {"tok": F.when(admitted, F.col("usage_tokens")).otherwise(F.lit(0).cast("bigint")), "usd": F.when(admitted, F.col("usage_cost")).otherwise(F.lit(0).cast("decimal(22,6)"))}
        return _prefix_in_month(df, key, order, sums, "u")

    def exhausted(limits: tuple) -> Column:
        daily, monthly, usd = _hits(*limits)
        return daily | monthly | usd

    rows = _day_month(requests, ts_col)
    used = ["u_tok_day", "u_tok_month", "u_usd_day", "u_usd_month"]
    now = materialize(ledger(rows, F.lit(True)).withColumn("exhausted", exhausted(limits if policy == "allow" else (daily_tokens, None, None))), "overage")
    if policy == "allow":
        now = now.withColumn("final_allowed", F.lit(True)).withColumn("retry_after", F.lit(None).cast("bigint"))
    else:
        changed = 1
        while changed:
            spaced = greedy_spacing(now.where("exhausted").select(key, ts_col, id_col), key, ts_col, id_col, float(throttle_s))
            told = now.drop(*used).join(spaced, id_col, "left").withColumn("final_allowed", ~F.col("exhausted") | F.coalesce("admitted", F.lit(False))).withColumnRenamed("exhausted", "_was").drop("admitted")
            now = materialize(ledger(told, F.col("final_allowed")).withColumn("exhausted", exhausted(limits)), "overage")
            changed = now.where("exhausted <> _was").count()
            if changed:
                now = now.drop("_was", "final_allowed", "retry_after")
        now = now.drop("_was")
    out = _verdict(now, *limits)
    period_start = F.when(F.col("period") == "daily", F.col("day")).otherwise(F.col("month"))
    first = out.where("exhausted").groupBy(key, "reason", period_start.alias("_p")).agg(F.min_by(id_col, F.struct(*order)).alias("_first"))
    out = out.join(first.select(F.col("_first").alias(id_col), F.lit(True).alias("alert")), id_col, "left").withColumn("alert", F.coalesce("alert", F.lit(False)))
    return (
        out.withColumn("allowed", ~F.col("exhausted"))
        .withColumn("overage_status", F.when(~F.col("final_allowed"), 429))
        .withColumn("resets_at", F.lit(None).cast("timestamp_ntz"))
    )


# ---------------------------------------------------------------- Q7 fail policy


def fail_policy(decisions: DataFrame, outages: DataFrame, policy: str = "fail_open", ts_col: str = "ts") -> DataFrame:
    """Q7: requests inside a quota-store outage pass degraded or get 503.

    ``outages(start, end)`` may overlap and counts both ends in; each request
    gives one row.
    """
    j = in_intervals(decisions, ts_col, outages, "left", closed=True)
    in_outage = F.col("_start").isNotNull()
    j = j.withColumn("in_outage", in_outage)
    if policy == "fail_closed":
        j = j.withColumn("allowed", F.when(in_outage, F.lit(False)).otherwise(F.col("allowed"))).withColumn(
            "reason", F.when(in_outage, F.lit("quota_service_unavailable")).otherwise(F.col("reason"))
        ).withColumn("outage_status", F.when(in_outage, 503))
    else:
        j = j.withColumn("allowed", F.when(in_outage, F.lit(True)).otherwise(F.col("allowed"))).withColumn(
            "degraded", in_outage
        )
    return j.drop("_start")


# ---------------------------------------------------------------- Q8 / Q9 alerts and utilization


def budget_alerts(
    ledger: DataFrame,
    monthly_limit_tokens: int,
    thresholds: Sequence[int] = (80, 90, 100),
    key: str = "consumer_id",
    ts_col: str = "ts",
    id_col: str = "event_id",
    used_col: str = "month_tokens_after",
    quota_type: str = "monthly_tokens",
) -> DataFrame:
    """Q8: first request at which monthly utilization reaches each threshold,
    once per (consumer, quota type, threshold, month)."""
    th = F.explode(F.array(*[F.lit(int(t)) for t in thresholds])).alias("threshold_pct")
    pct = F.col(used_col).cast("double") / F.lit(float(monthly_limit_tokens)) * 100
    crossed = ledger.select(key, ts_col, id_col, "month", used_col, pct.alias("utilization_pct"), th).where(
        F.col("utilization_pct") >= F.col("threshold_pct")
    )
    first = crossed.groupBy(key, "month", "threshold_pct").agg(
        F.min_by(F.struct(ts_col, id_col, "utilization_pct", used_col), F.struct(ts_col, id_col)).alias("f")
    )
    return first.select(
        key,
        F.lit(quota_type).alias("quota_type"),
        "threshold_pct",
        F.date_format("month", "yyyy-MM").alias("period"),
        F.col(f"f.{ts_col}").alias("alert_ts"),
        F.col(f"f.{id_col}").alias(id_col),
        F.col(f"f.{used_col}").alias("current_used"),
        F.lit(monthly_limit_tokens).cast("bigint").alias("budget_limit"),
        F.col("f.utilization_pct").alias("utilization_pct"),
    )


def utilization(usage: DataFrame, daily_limit: int, monthly_limit: int, key: str = "consumer_id", ts_col: str = "ts") -> DataFrame:
    """Q9: utilization at the end of each period, each period from its own usage.

    The end of a period holds its sum: no ledger.  Input needs
    ``usage_tokens``; months add up the days.
    """
    days = _day_month(usage, ts_col).groupBy(key, "day", "month").agg(F.sum("usage_tokens").alias("used"))
    months = days.groupBy(key, "month").agg(F.sum("used").alias("used"))

    def period(df: DataFrame, name: str, start: str, limit: int) -> DataFrame:
        return df.select(key, F.lit(name).alias("period"), F.col(start).alias("period_start"), "used", (F.col("used") / F.lit(float(limit)) * 100).alias("utilization_pct"))

    return period(days, "daily", "day", daily_limit).unionByName(period(months, "monthly", "month", monthly_limit))


# ---------------------------------------------------------------- Q5 most restrictive


def most_restrictive_quota(usage: DataFrame, limits: DataFrame, key: str = "consumer_id", route: str = "route_id") -> DataFrame:
    """Q5: of (consumer+route), consumer-only and route-only limits, the one with
    the smallest remaining amount applies.

    ``limits(consumer_id, route_id, limit_tokens)`` with NULL meaning "any";
    ``usage(consumer_id, route_id, used_cr, used_c, used_r)``.
    """
    lim = limits  # may grow with the consumers: Spark picks the join from its size
    cr = lim.where(F.col(key).isNotNull() & F.col(route).isNotNull()).select(key, route, F.col("limit_tokens").alias("l_cr"))
    c = lim.where(F.col(key).isNotNull() & F.col(route).isNull()).select(key, F.col("limit_tokens").alias("l_c"))
    r = lim.where(F.col(key).isNull() & F.col(route).isNotNull()).select(route, F.col("limit_tokens").alias("l_r"))
    j = usage.join(cr, [key, route], "left").join(c, key, "left").join(r, route, "left")
    cands = F.array(
        F.struct((F.col("l_cr") - F.col("used_cr")).alias("remaining"), F.lit("consumer_route").alias("scope"), F.col("l_cr").alias("limit")),
        F.struct((F.col("l_c") - F.col("used_c")).alias("remaining"), F.lit("consumer").alias("scope"), F.col("l_c").alias("limit")),
        F.struct((F.col("l_r") - F.col("used_r")).alias("remaining"), F.lit("route").alias("scope"), F.col("l_r").alias("limit")),
    )
    best = F.array_min(F.filter(cands, lambda s: s["remaining"].isNotNull()))
    return j.withColumn("applied", best).select(
        "*", F.col("applied.scope").alias("applied_scope"), F.col("applied.remaining").alias("remaining_tokens"), F.col("applied.limit").alias("applied_limit")
    ).drop("applied", "l_cr", "l_c", "l_r")


# ---------------------------------------------------------------- Q11 reconcile


def reconcile(billing: DataFrame, exact: DataFrame, key: str = "consumer_id") -> DataFrame:
    """Q11: delta = exact - approximate tokens per request; missing exact stays
    unreconciled.  ``exact(request_id, exact_tokens)``."""
    j = billing.join(exact, "request_id", "left")
    approx = F.col("tokens_input") + F.col("tokens_output")
    return j.withColumn("approx_tokens", approx).withColumn("delta_tokens", F.col("exact_tokens") - approx).withColumn(
        "reconciled", F.col("exact_tokens").isNotNull()
    ).withColumn("corrected_tokens", F.coalesce(F.col("exact_tokens"), approx))


# ---------------------------------------------------------------- Q12 / Q13 / Q14


def spend_rollup(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Q12: spend with subtotals (ROLLUP) and ``grouping_id``."""
    return df.rollup(*dims).agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("cost_usd").cast("double").alias("cost_usd"),
        F.sum(F.col("tokens_input") + F.col("tokens_output")).alias("tokens"),
        F.grouping_id().alias("gid"),
    )


def chargeback(df: DataFrame, top_n: int, key: str = "consumer_id") -> DataFrame:
    """Q13: consumers by spend, share of total and rank; top-n is the feature.

    The total is a one-row aggregate joined back (no single-partition
    window over all consumers); ranking runs on the per-consumer aggregate.
    """
    per = df.groupBy(key).agg(F.sum("cost_usd").alias("spend"), F.count(F.lit(1)).alias("requests"))
    total = df.agg(F.sum("cost_usd")).scalar()  # scalar subquery, no join
    ranked = per.withColumn("share", F.col("spend").cast("double") / total.cast("double"))
    top = ranked.orderBy(F.col("spend").desc(), F.col(key)).limit(top_n)
    w = Window.orderBy(F.col("spend").desc())
    return top.withColumn("spend_rank", F.dense_rank().over(w)).select(
        key, F.col("spend").cast("double").alias("spend_usd"), "requests", "share", "spend_rank"
    )


def token_estimate_accuracy(df: DataFrame, est_col: str, actual_col: str, key: str = "model") -> DataFrame:
    """Q14: relative error of estimated vs reported tokens per model."""
    err = F.abs(F.col(est_col) - F.col(actual_col)) / F.col(actual_col)
    return df.where(F.col(actual_col) > 0).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx(err, 0.5).alias("p50_rel_error"),
        F.percentile_approx(err, 0.95).alias("p95_rel_error"),
        F.avg(F.when(err <= 0.2, 1.0).otherwise(0.0)).alias("share_within_20pct"),
    )
