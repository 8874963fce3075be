"""Registered queries: metrics, panels, alerts, compliance."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewise.functions import pii as PF
from gatewise.functions import status as ST
from gatewise.operators import alerting as AL
from gatewise.operators import metrics as A
from gatewise.operators import pii as P
from gatewise.operators import quota as Q
from gatewise.operators import requests as R
from gatewise.operators import sketches as SK
from gatewise.operators.common import materialize
from gatewise.plans.catalog import register
from gatewise.plans.oracle_views import with_views
from gatewise.plans.q_pii import PII_ACTIONS, WHITELIST_CONSUMERS, _inj_sql, _pii_action_sql, _INJ_ACTION
from gatewise.plans.q_quota import PRICED
from gatewise.sources import gw_canary, gw_prompts, gw_requests, read_table


@register(
    "a1_counters",
    with_views(
        """with g as (select consumer_id, model, cast(floor(status / 100) as bigint) || 'xx' as status_class, count(*) as requests,
  sum(tokens_input) as ti, sum(tokens_output) as tout, sum(cost_usd) as cost from priced group by all)
 select consumer_id, model, status_class, m.metric, m.value from g, lateral (select unnest([
  {'metric': 'requests_total', 'value': cast(requests as double)}, {'metric': 'tokens_input_total', 'value': cast(ti as double)},
  {'metric': 'tokens_output_total', 'value': cast(tout as double)}, {'metric': 'cost_dollars_total', 'value': cast(cost as double)}]) as m)""",
        "gw_requests",
        extra=PRICED,
    ),
)
def a1_counters(spark, sf):
    d = Q.with_cost(gw_requests(spark, sf)).withColumn("status_class", ST.status_class(F.col("status")))
    return A.counters(
        d,
        ["consumer_id", "model", "status_class"],
        {"requests_total": F.lit(1), "tokens_input_total": F.col("tokens_input"), "tokens_output_total": F.col("tokens_output"), "cost_dollars_total": F.col("cost_usd")},
    )


def _sliding_sql(src: str, labels: str, value: str = "1", width_min: int = 5) -> str:
    return f"""select ts, {labels}, cast(sum(v) as double) as increase, sum(v) / {width_min * 60} as rate from (
 select time_bucket(interval '1 minute', ts_dense) - to_minutes(k) + interval '{width_min} minutes' as ts, {labels}, {value} as v
 from {src}, range(0, {width_min}) t(k)) group by all"""


@register(
    "a2_rate_by_status",
    with_views(_sliding_sql("(select *, cast(floor(status / 100) as bigint) || 'xx' as status_class from gw_requests)", "status_class"), "gw_requests"),
)
def a2_rate_by_status(spark, sf):
    d = gw_requests(spark, sf).withColumn("status_class", ST.status_class(F.col("status")))
    return A.rate(d, "ts_dense", ["status_class"])


@register("a9_request_rate_by_version", with_views(_sliding_sql("gw_canary", "version"), "gw_canary"))
def a9_request_rate_by_version(spark, sf):
    return A.rate(gw_canary(spark, sf), "ts_dense", ["version"])


@register(
    "a7_cost_per_hour",
    with_views(
        "select time_bucket(interval '1 hour', ts) + interval '1 hour' as ts, consumer_id, cast(sum(cost_usd) as double) as increase, cast(sum(cost_usd) as double) / 3600 as rate from priced group by all",
        "gw_requests",
        extra=PRICED,
    ),
)
def a7_cost_per_hour(spark, sf):
    d = Q.with_cost(gw_requests(spark, sf))
    g = d.groupBy(F.window("ts", "1 hour").alias("w"), "consumer_id").agg(F.sum("cost_usd").cast("double").alias("increase"))
    return g.select(F.col("w.end").alias("ts"), "consumer_id", "increase", (F.col("increase") / 3600).alias("rate"))


_A3_TICKS = """select ts, route_id, count(*) as total, sum(case when status >= 500 then 1 else 0 end) as errors from (
 select time_bucket(interval '1 minute', ts_dense) - to_minutes(k) + interval '5 minutes' as ts, route_id, status from gw_requests, range(0, 5) t(k)) group by all"""


@register(
    "a3_alert_5xx_ratio",
    with_views(
        """select route_id, min(ts) as start_ts, max(ts) as end_ts, count(*) as ticks, count(*) >= 5 as fired,
 case when count(*) >= 5 then min(ts) + interval '4 minutes' end as fires_at from (
 select *, ts - to_minutes(row_number() over (partition by route_id order by ts)) as isl from ticks where errors / total > 0.05)
 group by route_id, isl""",
        "gw_requests",
        extra=[("ticks", _A3_TICKS)],
    ),
)
def a3_alert_5xx_ratio(spark, sf):
    r = gw_requests(spark, sf)
    t = r.groupBy(F.window("ts_dense", "5 minutes", "1 minute").alias("w"), "route_id").agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.when(F.col("status") >= 500, 1).otherwise(0)).alias("errors")
    ).select(F.col("w.end").alias("ts"), "route_id", "total", "errors")
    return A.alert_episodes(t, ["route_id"], "ts", (F.col("errors") / F.col("total")) > 0.05, 5)


@register(
    "a4_latency_summary",
    with_views(
        """select route_id, version, count(*) as n, round(avg(latency_ms), 6) as mean, quantile_disc(latency_ms, 0.5) as p50,
 quantile_disc(latency_ms, 0.95) as p95, quantile_disc(latency_ms, 0.99) as p99 from gw_canary group by all""",
        "gw_canary",
    ),
)
def a4_latency_summary(spark, sf):
    return A.latency_summary(gw_canary(spark, sf), ["route_id", "version"])


@register("a5_gauge_last_latency", with_views("select model, arg_max(latency_ms, (ts_dense, event_id)) as latency_ms, max(ts_dense) as as_of from gw_requests group by model", "gw_requests"))
def a5_gauge_last_latency(spark, sf):
    return A.gauge(gw_requests(spark, sf), ["model"], "latency_ms", "ts_dense", "event_id")


MAX_SETS = 1000


@register(
    "a6_cardinality_guard",
    with_views(
        f"""select 'requests_total' as metric, consumer_id, route_id, model, status, fs.ts as first_seen_ts,
 row_number() over (order by fs.ts, fs.event_id) <= {MAX_SETS} as kept from (
 select consumer_id, route_id, model, status, min({{'ts': ts, 'event_id': event_id}}) as fs from gw_requests group by all)""",
        "gw_requests",
    ),
)
def a6_cardinality_guard(spark, sf):
    return A.cardinality_guard(gw_requests(spark, sf), "requests_total", ["consumer_id", "route_id", "model", "status"], "ts", "event_id", MAX_SETS)


@register(
    "a10_compliance_report",
    f"""select m.pii_type as pii_type, source, count(*) as fields, count(distinct doc_id) as items, cast(grouping(m.pii_type, source) as int) as gid
 from (select doc_id, source, unnest({PF.sql_scan('text')}) as m from documents) group by grouping sets ((), (m.pii_type), (source))""",
)
def a10_compliance_report(spark, sf):
    m = P.pii_scan(read_table(spark, sf, "documents"), "text", ["doc_id", "source"])
    r = A.compliance_report(m, "doc_id", ["pii_type", "source"])
    return r.select("pii_type", "source", "fields", "items", F.col("gid").cast("int").alias("gid"))


@register(
    "a11_error_totals",
    with_views(
        """select error_code, consumer_id, route_id, count(*) as errors from (select *, case when status is null then 'ARIA_SH_PROVIDER_UNREACHABLE' when status >= 500 then 'ARIA_SH_PROVIDER_ERROR'
 when status in (401, 403) then 'ARIA_SH_PROVIDER_AUTH_FAILED' when status = 429 then 'ARIA_SH_PROVIDER_RATE_LIMITED' end as error_code from gw_requests)
 where error_code is not null group by all""",
        "gw_requests",
    ),
)
def a11_error_totals(spark, sf):
    d = R.with_status(gw_requests(spark, sf)).where(F.col("error_code").isNotNull())
    return d.groupBy("error_code", "consumer_id", "route_id").agg(F.count(F.lit(1)).alias("errors"))


@register(
    "a12_security_event_rate",
    with_views(
        f"""select time_bucket(interval '10 minutes', ts) as window_start, event_type, count(*) as events, count(*) / 600.0 as rate, count(*) / 600.0 > 1.0 as spike from (
 select timestamp '2024-01-01 00:00:00' + to_seconds(conv_id * 60 + turn * 5) as ts,
  case when ia in ('block', 'confirm') then 'PROMPT_BLOCKED' when pii_action in ('block', 'mask', 'warn') then 'PII_DETECTED' end as event_type
 from (select *, {_INJ_ACTION} as ia from inj)) where event_type is not null group by all""",
        "gw_prompts",
        extra=[("pa", _pii_action_sql()), ("inj", _inj_sql("pa"))],
    ),
)
def a12_security_event_rate(spark, sf):
    d = P.injection_scan(P.prompt_pii_action(gw_prompts(spark, sf), PII_ACTIONS, WHITELIST_CONSUMERS), whitelist_consumers=WHITELIST_CONSUMERS)
    d = P.security_action(d).where(F.col("event_type").isNotNull())
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("conv_id") * 60 + F.col("turn") * 5).cast("decimal(18,6)"))
    g = d.withColumn("ts", ts).groupBy(F.window("ts", "10 minutes").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "events", (F.col("events") / 600.0).alias("rate"), (F.col("events") / 600.0 > 1.0).alias("spike"))


@register(
    "a13_audit_volume_lag",
    with_views(
        """select time_bucket(interval '1 hour', ts) as hour, count(*) as events, quantile_disc(event_id % 7 + 1, 0.95) as p95_lag_s, max(event_id % 7 + 1) as max_lag_s
 from gw_requests where status >= 500 group by all""",
        "gw_requests",
    ),
)
def a13_audit_volume_lag(spark, sf):
    ev = gw_requests(spark, sf).where(F.col("status") >= 500)
    ev = ev.withColumn("created_at", F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("event_id") % 7 + 1).cast("decimal(18,6)")))
    lag = (F.unix_micros(F.col("created_at").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1000000
    g = ev.groupBy(F.window("ts", "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("events"), F.percentile_approx(lag.cast("bigint"), 0.95).alias("p95_lag_s"), F.max(lag.cast("bigint")).alias("max_lag_s")
    )
    return g.select(F.col("w.start").alias("hour"), "events", "p95_lag_s", "max_lag_s")


@register(
    "a14_pii_leak_check",
    with_views(
        f"""with ex as (select conv_id, turn, left({PF.sql_mask_text('text', PF.sql_scan('text'))}, 200) as payload_excerpt from gw_prompts)
 select count(*) as excerpts, cast(sum(len({PF.sql_scan('payload_excerpt')})) as bigint) as leaks from ex""",
        "gw_prompts",
    ),
)
def a14_pii_leak_check(spark, sf):
    ex = P.audit_excerpt(gw_prompts(spark, sf))
    m = ex.withColumn("_n", F.size(PF.scan(F.col("payload_excerpt"))))
    return m.agg(F.count(F.lit(1)).alias("excerpts"), F.sum("_n").cast("bigint").alias("leaks"))


# every status of 500 and more is dealt to one of the ruled codes; the first ones come in bursts of 4096 events
_CODES = [r.code for r in AL.CODE_RULES]
_DEALT = "case " + " ".join(f"when event_id % 7 = {i} then '{c}'" for i, c in enumerate(_CODES)) + " end"
_FAULT = "status >= 500 and (event_id % 7 > 1 or floor(event_id / 4096) % 2 = 0)"
_RUNS = """select {keys}, make_timestamp(a * 60000000) as pending_at, case when a + wait <= b then make_timestamp((a + wait) * 60000000) end as firing_at,
 case when b < until then make_timestamp((b + 1) * 60000000) end as resolved_at,
 case when b >= until then case when a + wait <= b then 'firing' else 'pending' end when a + wait <= b then 'resolved' else 'dropped' end as state{more}
 from (select {keys}, min(tick) as a, max(tick) as b, any_value(wait) as wait, any_value(until) as until{any}
  from (select *, tick - row_number() over (partition by {keys} order by tick) as run from met where tick <= until) group by {keys}, run)"""


@register(
    "a3_error_code_alerts",
    with_views(
        f"""with e as (select {_DEALT} as code, ts_dense as ts from gw_requests where {_FAULT}),
 rules(code, window_s, over, for_s, severity) as (values {", ".join(f"('{r.code}', {r.window_s}, {r.over}, {r.for_s}, '{r.severity}')" for r in AL.CODE_RULES)}),
 grid as (select code, unnest(generate_series(1, (select cast(ceil(epoch_us(max(ts)) / 60000000) as bigint) - cast(floor(epoch_us(min(ts)) / 60000000) as bigint) from e))) + (select cast(floor(epoch_us(min(ts)) / 60000000) as bigint) from e) as tick from rules),
 met as (select g.code, g.tick, r.severity, r.for_s // 60 as wait, (select cast(ceil(epoch_us(max(ts)) / 60000000) as bigint) from e) as until
  from grid g join rules r on r.code = g.code join e on e.code = g.code and epoch_us(e.ts) >= (g.tick * 60 - r.window_s) * 1000000 and epoch_us(e.ts) < g.tick * 60000000
  group by all having count(*) > any_value(r.over))
 {_RUNS.format(keys="code", more=", severity", any=", any_value(severity) as severity")}""",
        "gw_requests",
    ),
)
def a3_error_code_alerts(spark, sf):
    errors = gw_requests(spark, sf).where(_FAULT).select(F.expr(_DEALT).alias("code"), F.col("ts_dense").alias("ts"))
    return AL.code_alerts(errors, "code", "ts")


@register(
    "a3_stale_gauge_alert",
    with_views(
        f"""with s as (select user_id, ts, event_id, epoch_us(ts) as us, value from events),
 grid as (select user_id, unnest(generate_series(cast(ceil(min(us) / 60000000) as bigint), cast(ceil(max(us) / 60000000) as bigint) + 5)) as tick from s group by user_id),
 seen as (select g.user_id, g.tick, s.us, s.value from grid g asof join (select user_id, us, arg_max(value, event_id) as value from s group by all) s on s.user_id = g.user_id and g.tick * 60000000 >= s.us),
 met as (select user_id, tick, 2 as wait, (select cast(ceil(max(us) / 60000000) as bigint) from s) as until from seen where tick * 60000000 < us + 300000000 and value > 20)
 {_RUNS.format(keys="user_id", more="", any="")}""",
    ),
)
def a3_stale_gauge_alert(spark, sf):
    s = read_table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    ticks = AL.gauge_ticks(s, ["user_id"], "ts", "event_id", "value")
    return AL.alert_runs(ticks, ["user_id"], F.col("value") > 20, 120, AL.last_tick(s, "ts"))


@register(
    "a6_distinct_from_states",
    with_views(
        """select model, count(request_id) as rows, count(distinct request_id) as exact_requests, true as within_2pct from gw_requests group by model""",
        "gw_requests",
    ),
)
def a6_distinct_from_states(spark, sf):
    r = gw_requests(spark, sf)
    state = materialize(SK.distinct_state(r, ["model", "status"], F.to_date("ts"), "request_id"), "distinct-state")
    exact = r.groupBy("model").agg(F.count_distinct("request_id").alias("exact_requests"))
    rolled = SK.distinct_rollup(state, ["model"]).join(exact, "model")
    near = F.abs(F.col("distinct_values") - F.col("exact_requests")) <= 0.02 * F.col("exact_requests")
    return rolled.select("model", "rows", "exact_requests", near.alias("within_2pct"))


@register(
    "a4_quantiles_from_states",
    with_views("select route_id, version, quantile, count(*) as rows, true as within_2pct_rank from gw_canary, (values ('p50'), ('p95'), ('p99')) q(quantile) group by all", "gw_canary"),
)
def a4_quantiles_from_states(spark, sf):
    labels, ranks = ["route_id", "version"], {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    r = gw_canary(spark, sf)
    state = materialize(SK.quantile_state(r, labels, F.window("ts_dense", "1 minute")["start"], "latency_ms"), "quantile-state")
    rolled = SK.quantile_rollup(state, labels, ranks)
    est = rolled.select(*labels, "rows", F.explode(F.create_map(*[x for n in ranks for x in (F.lit(n), F.col(n))])).alias("quantile", "value"))
    want = F.coalesce(*[F.when(F.col("quantile") == n, v) for n, v in ranks.items()])
    # the exact share of rows below and up to the estimate must enclose the rank, 2 % aside
    seen = r.select(*labels, "latency_ms").join(est, labels).groupBy(*labels, "quantile", "rows", "value").agg(
        F.avg((F.col("latency_ms") < F.col("value")).cast("int")).alias("below"), F.avg((F.col("latency_ms") <= F.col("value")).cast("int")).alias("upto")
    )
    return seen.select(*labels, "quantile", "rows", ((F.col("below") <= want + 0.02) & (F.col("upto") >= want - 0.02)).alias("within_2pct_rank"))
