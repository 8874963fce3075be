"""Registered queries: pricing, quota, budget (Q1-Q13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewise.operators import quota as Q
from gatewise.plans.catalog import register
from gatewise.plans.oracle_views import with_views
from gatewise.plans.sqlbits import USAGE, priced_requests, pricing_values
from gatewise.sources import gw_billing, gw_requests

PRICED = [("pricing", pricing_values()), ("priced", priced_requests())]

# Fixed parameters of the registered quota queries.
DAILY_LIMIT = 8000
MONTHLY_LIMIT = 200000
MONTHLY_DOLLARS = "3.5"


def _priced(spark, sf):
    return Q.with_cost(gw_requests(spark, sf))


def _usage(spark, sf):
    return Q.usage_columns(_priced(spark, sf))


# ---------------------------------------------------------------- q1


@register(
    "q1_cost_by_consumer_model",
    with_views(
        """select consumer_id, model, count(*) as requests, cast(sum(tokens_input) as bigint) as tokens_input,
 cast(sum(tokens_output) as bigint) as tokens_output, cast(sum(cost_usd) as double) as cost_usd,
 cast(sum(case when price_known then 0 else 1 end) as bigint) as unknown_price_requests
from priced group by consumer_id, model""",
        "gw_requests",
        extra=PRICED,
    ),
    bench=True,
)
def q1_cost_by_consumer_model(spark, sf):
    return Q.spend_by(_priced(spark, sf), ["consumer_id", "model"])


CUSTOM_PRICES = {"gpt-4o": ("0.005", "0.02"), "llama-custom": ("0.0002", "0.0002"), "_default": ("0.05", "0.1")}


@register(
    "q2_effective_pricing",
    with_views(
        """select model, count(*) as requests, cast(sum(cost_usd) as double) as cost_usd from priced group by model""",
        "gw_requests",
        extra=[
            (
                "pricing",
                "select * from ("
                + pricing_values()
                + ") d where model not in (select model from ("
                + pricing_values({k: v for k, v in CUSTOM_PRICES.items()})
                + ")) union all "
                + pricing_values(CUSTOM_PRICES),
            ),
            ("priced", priced_requests(default=CUSTOM_PRICES["_default"])),
        ],
    ),
)
def q2_effective_pricing(spark, sf):
    from gatewise.functions.pricing import pricing_frame

    eff = Q.effective_pricing(pricing_frame(spark), pricing_frame(spark, CUSTOM_PRICES))
    df = Q.with_cost(gw_requests(spark, sf), eff)
    return df.groupBy("model").agg(F.count(F.lit(1)).alias("requests"), F.sum("cost_usd").cast("double").alias("cost_usd"))


# ---------------------------------------------------------------- q3 ledger


@register(
    "q3_usage_ledger",
    with_views(
        """select event_id, consumer_id,
 coalesce(sum(usage_tokens) over (partition by consumer_id, day order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as day_tokens_before,
 coalesce(sum(usage_tokens) over (partition by consumer_id, month order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as month_tokens_before,
 cast(coalesce(sum(usage_cost) over (partition by consumer_id, month order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as double) as month_dollars_before,
 usage_tokens
from usage""",
        "gw_requests",
        extra=PRICED + [("usage", USAGE)],
    ),
    bench=True,
)
def q3_usage_ledger(spark, sf):
    led = Q.usage_ledger(_usage(spark, sf))
    return led.select(
        "event_id", "consumer_id", F.col("day_tokens_before").cast("bigint").alias("day_tokens_before"),
        F.col("month_tokens_before").cast("bigint").alias("month_tokens_before"),
        F.col("month_dollars_before").cast("double").alias("month_dollars_before"), "usage_tokens",
    )


# ---------------------------------------------------------------- q4 decision

_DECISION_SQL = f"""
s1 as (select *, coalesce(sum(usage_tokens) over (partition by consumer_id, day order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as d0 from usage),
s2 as (select *, d0 < {DAILY_LIMIT} as a_d,
  coalesce(sum(case when d0 < {DAILY_LIMIT} then usage_tokens else 0 end) over (partition by consumer_id, month order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as m1,
  coalesce(sum(case when d0 < {DAILY_LIMIT} then usage_cost else 0 end) over (partition by consumer_id, month order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as c1 from s1),
s3 as (select *, a_d and m1 < {MONTHLY_LIMIT} and c1 < {MONTHLY_DOLLARS} as allowed from s2),
s4 as (select *,
  coalesce(sum(case when allowed then usage_tokens else 0 end) over (partition by consumer_id, day order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as du,
  coalesce(sum(case when allowed then usage_tokens else 0 end) over (partition by consumer_id, month order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as mu,
  coalesce(sum(case when allowed then usage_cost else 0 end) over (partition by consumer_id, month order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as cu from s3),
dec as (select *, case when du >= {DAILY_LIMIT} then 'daily_token_quota_exceeded' when mu >= {MONTHLY_LIMIT} then 'monthly_token_quota_exceeded'
  when cu >= {MONTHLY_DOLLARS} then 'monthly_dollar_budget_exceeded' end as reason,
  case when du >= {DAILY_LIMIT} then cast(du as double) when mu >= {MONTHLY_LIMIT} then cast(mu as double) when cu >= {MONTHLY_DOLLARS} then cast(cu as double) end as used_value,
  case when du >= {DAILY_LIMIT} or mu >= {MONTHLY_LIMIT} then 0 else {DAILY_LIMIT} - du end as remaining_tokens,
  cast(case when cu >= {MONTHLY_DOLLARS} then 0 else {MONTHLY_DOLLARS} - cu end as double) as remaining_dollars,
  case when du >= {DAILY_LIMIT} then 'daily' when mu >= {MONTHLY_LIMIT} or cu >= {MONTHLY_DOLLARS} then 'monthly' end as period
  from s4)"""


def _decisions(spark, sf):
    # project first: the operator checkpoints between passes, and a
    # checkpoint materializes every column it is given
    u = _usage(spark, sf).select("event_id", "consumer_id", "ts", "usage_tokens", "usage_cost")
    return Q.quota_decision(u, DAILY_LIMIT, MONTHLY_LIMIT, MONTHLY_DOLLARS)


@register(
    "q4_quota_decision",
    with_views(
        "select event_id, consumer_id, allowed, reason, used_value, cast(remaining_tokens as bigint) as remaining_tokens, remaining_dollars from dec",
        "gw_requests",
        extra=PRICED + [("usage", USAGE)],
        raw=_DECISION_SQL,
    ),
    bench=True,
)
def q4_quota_decision(spark, sf):
    d = _decisions(spark, sf)
    return d.select(
        "event_id", "consumer_id", "allowed", "reason", "used_value", F.col("remaining_tokens").cast("bigint").alias("remaining_tokens"),
        F.col("remaining_dollars").cast("double").alias("remaining_dollars"),
    )


# ---------------------------------------------------------------- q5 most restrictive

LIMITS = [("team-1", "route-1", 20000), ("team-1", None, 50000), (None, "route-2", 600000), ("team-2", None, 1000), ("team-5", "route-0", 1500)]


def _lim_sql() -> str:
    def q(x):
        return "null" if x is None else (str(x) if isinstance(x, int) else f"'{x}'")

    return "select * from (values " + ", ".join(f"({q(a)}, {q(b)}, {q(c)})" for a, b, c in LIMITS) + ") t(consumer_id, route_id, limit_tokens)"


_TOK = "cast(tokens_input + tokens_output as bigint)"


@register(
    "q5_most_restrictive_quota",
    with_views(
        f"""with u as (select consumer_id, route_id, sum({_TOK}) as used_cr from gw_requests group by all),
 uc as (select consumer_id, sum({_TOK}) as used_c from gw_requests group by all),
 ur as (select route_id, sum({_TOK}) as used_r from gw_requests group by all),
 b as (select u.*, uc.used_c, ur.used_r from u join uc using (consumer_id) join ur using (route_id)),
 c as (select b.consumer_id, b.route_id, l.limit_tokens - b.used_cr as remaining, 'consumer_route' as scope, l.limit_tokens as lim from b join lim l on b.consumer_id = l.consumer_id and b.route_id = l.route_id
  union all select b.consumer_id, b.route_id, l.limit_tokens - b.used_c, 'consumer', l.limit_tokens from b join lim l on b.consumer_id = l.consumer_id and l.route_id is null
  union all select b.consumer_id, b.route_id, l.limit_tokens - b.used_r, 'route', l.limit_tokens from b join lim l on b.route_id = l.route_id and l.consumer_id is null),
 r as (select *, row_number() over (partition by consumer_id, route_id order by remaining, scope, lim) as rn from c)
 select b.consumer_id, b.route_id, cast(b.used_cr as bigint) as used_cr, r.scope as applied_scope, cast(r.remaining as bigint) as remaining_tokens, r.lim as applied_limit
 from b left join r on b.consumer_id = r.consumer_id and b.route_id = r.route_id and r.rn = 1""",
        "gw_requests",
        extra=[("lim", _lim_sql())],
    ),
)
def q5_most_restrictive_quota(spark, sf):
    r = gw_requests(spark, sf).withColumn("_t", F.col("tokens_input") + F.col("tokens_output"))
    u = r.groupBy("consumer_id", "route_id").agg(F.sum("_t").alias("used_cr"))
    uc = r.groupBy("consumer_id").agg(F.sum("_t").alias("used_c"))
    ur = r.groupBy("route_id").agg(F.sum("_t").alias("used_r"))
    usage = u.join(uc, "consumer_id").join(ur, "route_id")
    lim = spark.createDataFrame(LIMITS, "consumer_id string, route_id string, limit_tokens bigint")
    d = Q.most_restrictive_quota(usage, lim)
    return d.select("consumer_id", "route_id", F.col("used_cr").cast("bigint").alias("used_cr"), "applied_scope", F.col("remaining_tokens").cast("bigint").alias("remaining_tokens"), "applied_limit")


# ---------------------------------------------------------------- q6 overage / q10 reset


@register(
    "q6_overage_block",
    with_views(
        """select event_id, reason is null as final_allowed, case when reason is not null then 402 end as overage_status,
 case when period = 'daily' then date_trunc('day', ts) + interval 1 day when period = 'monthly' then date_trunc('month', ts) + interval 1 month end as resets_at
 from dec""",
        "gw_requests",
        extra=PRICED + [("usage", USAGE)],
        raw=_DECISION_SQL,
    ),
)
def q6_overage_block(spark, sf):
    d = Q.overage(_decisions(spark, sf))
    return d.select("event_id", "final_allowed", "overage_status", "resets_at")


# usage that throttle lets through counts: one row after another, with the rule's own state
_REPLAY_SQL = f"""
 ev as (select *, row_number() over (partition by consumer_id order by ts, event_id) as rn from usage),
 rec as (
  select consumer_id, rn, event_id, ts, day, month, 0::bigint as du, 0::bigint as mu, 0::decimal(22,6) as cu, false as ex, true as ok, null::timestamp as last_ok, null::bigint as retry,
   usage_tokens as add_tok, usage_cost::decimal(22,6) as add_usd from ev where rn = 1
  union all
  select consumer_id, rn, event_id, ts, day, month, du, mu, cu, ex, ok, case when ex and ok then ts else last_ok end, case when not ok then cast(ceil(60 - (epoch(ts) - epoch(last_ok))) as bigint) end,
   case when ok then usage_tokens else 0 end, case when ok then usage_cost else 0 end::decimal(22,6)
  from (select *, not ex or last_ok is null or epoch(ts) - epoch(last_ok) >= 60 as ok
   from (select *, du >= {DAILY_LIMIT} or mu >= {MONTHLY_LIMIT} or cu >= {MONTHLY_DOLLARS} as ex
    from (select x.consumer_id, x.rn, x.event_id, x.ts, x.day, x.month, x.usage_tokens, x.usage_cost, r.last_ok,
      case when x.day = r.day then r.du + r.add_tok else 0 end::bigint as du, case when x.month = r.month then r.mu + r.add_tok else 0 end::bigint as mu,
      case when x.month = r.month then r.cu + r.add_usd else 0 end::decimal(22,6) as cu
     from rec r join ev x on x.consumer_id = r.consumer_id and x.rn = r.rn + 1)))),
 led as (select *, case when du >= {DAILY_LIMIT} then 'daily_token_quota_exceeded' when mu >= {MONTHLY_LIMIT} then 'monthly_token_quota_exceeded' when cu >= {MONTHLY_DOLLARS} then 'monthly_dollar_budget_exceeded' end as reason from rec)"""

_ALLOW_SQL = f"""
 l0 as (select *, coalesce(sum(usage_tokens) over (partition by consumer_id, day order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as du,
   coalesce(sum(usage_tokens) over (partition by consumer_id, month order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as mu,
   coalesce(sum(usage_cost) over (partition by consumer_id, month order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as cu from usage),
 led as (select *, case when du >= {DAILY_LIMIT} then 'daily_token_quota_exceeded' when mu >= {MONTHLY_LIMIT} then 'monthly_token_quota_exceeded' when cu >= {MONTHLY_DOLLARS} then 'monthly_dollar_budget_exceeded' end as reason from l0)"""

_ALERT_SQL = "coalesce(reason is not null and row_number() over (partition by consumer_id, reason, case when reason like 'daily%' then day else month end order by ts, event_id) = 1, false) as alert"


def _replay(spark, sf, policy):
    u = _usage(spark, sf).select("event_id", "consumer_id", "ts", "usage_tokens", "usage_cost")
    return Q.overage_replay(u, policy, DAILY_LIMIT, MONTHLY_LIMIT, MONTHLY_DOLLARS)


@register(
    "q6_overage_throttle",
    "WITH RECURSIVE "
    + with_views(
        f"""select event_id, consumer_id, ts, ex as exhausted, ok as final_allowed, case when not ok then 429 end as overage_status, retry as retry_after,
 reason, du as day_tokens_before, mu as month_tokens_before, cast(cu as double) as month_dollars_before, {_ALERT_SQL} from led""",
        "gw_requests",
        extra=PRICED + [("usage", USAGE)],
        raw=_REPLAY_SQL,
    )[len("WITH ") :],
)
def q6_overage_throttle(spark, sf):
    d = _replay(spark, sf, "throttle")
    usage = [F.col(c).cast("bigint").alias(c) for c in ("day_tokens_before", "month_tokens_before")]
    return d.select("event_id", "consumer_id", "ts", "exhausted", "final_allowed", "overage_status", "retry_after", "reason", *usage, F.col("month_dollars_before").cast("double").alias("month_dollars_before"), "alert")


@register(
    "q6_overage_allow",
    with_views(
        f"select event_id, consumer_id, reason is not null as exhausted, true as final_allowed, reason, cast(du as bigint) as day_tokens_before, cast(mu as bigint) as month_tokens_before, cast(cu as double) as month_dollars_before, {_ALERT_SQL} from led",
        "gw_requests",
        extra=PRICED + [("usage", USAGE)],
        raw=_ALLOW_SQL,
    ),
)
def q6_overage_allow(spark, sf):
    d = _replay(spark, sf, "allow")
    usage = [F.col(c).cast("bigint").alias(c) for c in ("day_tokens_before", "month_tokens_before")]
    return d.select("event_id", "consumer_id", "exhausted", "final_allowed", "reason", *usage, F.col("month_dollars_before").cast("double").alias("month_dollars_before"), "alert")


@register(
    "q10_reset_time",
    with_views(
        "select event_id, date_trunc('day', ts) + interval 1 day as reset_daily, date_trunc('month', ts) + interval 1 month as reset_monthly from gw_requests",
        "gw_requests",
    ),
)
def q10_reset_time(spark, sf):
    r = gw_requests(spark, sf)
    return r.select("event_id", Q.reset_time(F.lit("daily"), F.col("ts")).alias("reset_daily"), Q.reset_time(F.lit("monthly"), F.col("ts")).alias("reset_monthly"))


# ---------------------------------------------------------------- q7 fail policy

OUTAGES = [("2024-01-05 00:00:00", "2024-01-05 06:00:00"), ("2024-01-20 12:00:00", "2024-01-20 13:00:00"), ("2024-01-05 03:00:00", "2024-01-05 09:00:00")]


_IN_OUTAGE = "exists (select 1 from (values " + ", ".join(f"(timestamp '{a}', timestamp '{b}')" for a, b in OUTAGES) + ") o(s, e) where dec.ts >= o.s and dec.ts <= o.e)"


def _outages(spark):
    return spark.createDataFrame(OUTAGES, "start string, end string").select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"))


@register(
    "q7_fail_policy_closed",
    with_views(
        f"""select event_id, not out_ and reason is null as allowed, case when out_ then 'quota_service_unavailable' else reason end as reason, out_ as in_outage
 from (select *, {_IN_OUTAGE} as out_ from dec)""",
        "gw_requests",
        extra=PRICED + [("usage", USAGE)],
        raw=_DECISION_SQL,
    ),
)
def q7_fail_policy_closed(spark, sf):
    return Q.fail_policy(_decisions(spark, sf), _outages(spark), "fail_closed").select("event_id", "allowed", "reason", "in_outage")


@register(
    "q7_fail_policy_open",
    with_views(
        f"select event_id, out_ or reason is null as allowed, reason, out_ as degraded from (select *, {_IN_OUTAGE} as out_ from dec)",
        "gw_requests",
        extra=PRICED + [("usage", USAGE)],
        raw=_DECISION_SQL,
    ),
)
def q7_fail_policy_open(spark, sf):
    return Q.fail_policy(_decisions(spark, sf), _outages(spark), "fail_open").select("event_id", "allowed", "reason", "degraded")


# ---------------------------------------------------------------- q8 / q9 alerts and utilization

_LEDGER_SQL = """select *, sum(usage_tokens) over (partition by consumer_id, month order by ts, event_id rows between unbounded preceding and current row) as month_tokens_after,
 sum(usage_tokens) over (partition by consumer_id, day order by ts, event_id rows between unbounded preceding and current row) as day_tokens_after from usage"""


def _ledger(spark, sf):
    return Q.usage_ledger(_usage(spark, sf))


@register(
    "q8_budget_alerts",
    with_views(
        f"""with x as (select consumer_id, ts, event_id, month, month_tokens_after, month_tokens_after / {float(MONTHLY_LIMIT)} * 100 as utilization_pct, t.th as threshold_pct
  from ledger, (values (80), (90), (100)) t(th) where month_tokens_after / {float(MONTHLY_LIMIT)} * 100 >= t.th),
 f as (select consumer_id, month, threshold_pct, arg_min(ts, (ts, event_id)) as alert_ts, arg_min(event_id, (ts, event_id)) as event_id,
  arg_min(month_tokens_after, (ts, event_id)) as current_used, arg_min(utilization_pct, (ts, event_id)) as utilization_pct from x group by all)
 select consumer_id, 'monthly_tokens' as quota_type, threshold_pct, strftime(month, '%Y-%m') as period, alert_ts, event_id, cast(current_used as bigint) as current_used,
  cast({MONTHLY_LIMIT} as bigint) as budget_limit, utilization_pct from f""",
        "gw_requests",
        extra=PRICED + [("usage", USAGE), ("ledger", _LEDGER_SQL)],
    ),
)
def q8_budget_alerts(spark, sf):
    a = Q.budget_alerts(_ledger(spark, sf), MONTHLY_LIMIT)
    return a.select("consumer_id", "quota_type", "threshold_pct", "period", "alert_ts", "event_id", F.col("current_used").cast("bigint").alias("current_used"), "budget_limit", "utilization_pct")


@register(
    "q9_utilization",
    with_views(
        f"""select consumer_id, 'daily' as period, day as period_start, cast(arg_max(day_tokens_after, (ts, event_id)) as bigint) as used,
  arg_max(day_tokens_after, (ts, event_id)) / {float(DAILY_LIMIT)} * 100 as utilization_pct from ledger group by consumer_id, day
 union all select consumer_id, 'monthly', month, cast(arg_max(month_tokens_after, (ts, event_id)) as bigint),
  arg_max(month_tokens_after, (ts, event_id)) / {float(MONTHLY_LIMIT)} * 100 from ledger group by consumer_id, month""",
        "gw_requests",
        extra=PRICED + [("usage", USAGE), ("ledger", _LEDGER_SQL)],
    ),
)
def q9_utilization(spark, sf):
    u = Q.utilization(_usage(spark, sf), DAILY_LIMIT, MONTHLY_LIMIT)
    return u.select("consumer_id", "period", "period_start", F.col("used").cast("bigint").alias("used"), "utilization_pct")


# ---------------------------------------------------------------- q11 reconcile


def _exact(b):
    return b.where(F.col("model_ix") % 3 != 0).select("request_id", (F.col("tokens_input") + F.col("tokens_output") + F.length("request_id") % 7 - 3).alias("exact_tokens"))


@register(
    "q11_reconcile",
    with_views(
        """with ex as (select request_id, tokens_input + tokens_output + length(request_id) % 7 - 3 as exact_tokens from gw_billing where model_ix % 3 <> 0),
 j as (select b.*, e.exact_tokens from gw_billing b left join ex e on b.request_id = e.request_id)
 select consumer_id, count(*) as requests, cast(sum(case when exact_tokens is not null then 1 else 0 end) as bigint) as reconciled,
  cast(sum(exact_tokens - (tokens_input + tokens_output)) as bigint) as delta_tokens, cast(sum(coalesce(exact_tokens, tokens_input + tokens_output)) as bigint) as corrected_tokens
 from j group by consumer_id""",
        "gw_billing",
    ),
)
def q11_reconcile(spark, sf):
    b = gw_billing(spark, sf)
    r = Q.reconcile(b, _exact(b))
    return r.groupBy("consumer_id").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum(F.col("reconciled").cast("int")).cast("bigint").alias("reconciled"),
        F.sum("delta_tokens").cast("bigint").alias("delta_tokens"),
        F.sum("corrected_tokens").cast("bigint").alias("corrected_tokens"),
    )


# ---------------------------------------------------------------- q12 / q13 / q14


@register(
    "q12_spend_rollup",
    with_views(
        """select consumer_id, model, cast(ts as date) as day, count(*) as requests, cast(sum(cost_usd) as double) as cost_usd,
 cast(sum(tokens_input + tokens_output) as bigint) as tokens, cast(grouping(consumer_id, model, cast(ts as date)) as int) as gid
 from priced group by rollup (consumer_id, model, cast(ts as date))""",
        "gw_requests",
        extra=PRICED,
    ),
)
def q12_spend_rollup(spark, sf):
    d = _priced(spark, sf).withColumn("day", F.to_date("ts"))
    r = Q.spend_rollup(d, ["consumer_id", "model", "day"])
    return r.select("consumer_id", "model", "day", "requests", "cost_usd", F.col("tokens").cast("bigint").alias("tokens"), F.col("gid").cast("int").alias("gid"))


@register(
    "q13_chargeback_top10",
    with_views(
        """with per as (select consumer_id, sum(cost_usd) as spend, count(*) as requests from priced group by consumer_id)
 select consumer_id, cast(spend as double) as spend_usd, requests, cast(spend as double) / (select cast(sum(cost_usd) as double) from priced) as share,
  dense_rank() over (order by spend desc) as spend_rank from per order by spend desc, consumer_id limit 10""",
        "gw_requests",
        extra=PRICED,
    ),
)
def q13_chargeback_top10(spark, sf):
    d = Q.chargeback(_priced(spark, sf), 10)
    return d.select("consumer_id", "spend_usd", "requests", "share", F.col("spend_rank").cast("bigint").alias("spend_rank"))


def _q14_sql() -> str:
    from gatewise.plans.q_llm import _U2_SQL

    return with_views(
        """with x as (select coalesce(model, 'unknown') as model, cast(ceil(len(regexp_extract_all(coalesce(content, ''), '\\S+')) * 1.3) as bigint) as est,
  completion_tokens as act from (""" + _U2_SQL + """) where completion_tokens > 0)
 select model, count(*) as n, quantile_disc(abs(est - act) / act, 0.5) as p50_rel_error, quantile_disc(abs(est - act) / act, 0.95) as p95_rel_error,
  avg(case when abs(est - act) / act <= 0.2 then 1.0 else 0.0 end) as share_within_20pct from x group by model""",
        "gw_payloads",
    )


@register("q14_token_estimate_accuracy", _q14_sql())
def q14_token_estimate_accuracy(spark, sf):
    from gatewise.functions import llm as L
    from gatewise.sources import gw_payloads

    p = gw_payloads(spark, sf)
    r = p.select(L.normalize_response(F.col("provider"), F.col("body")).alias("r")).select("r.*")
    r = r.withColumn("est", L.approx_tokens(F.col("content"))).withColumn("model", F.coalesce("model", F.lit("unknown")))
    return Q.token_estimate_accuracy(r, "est", "completion_tokens")
