"""Registered queries: progressive delivery."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewise.operators import canary as C
from gatewise.operators.common import spread
from gatewise.operators.jsontree import sql_leaves
from gatewise.plans.catalog import register
from gatewise.plans.oracle_views import with_views
from gatewise.sources import gw_canary, gw_requests, gw_shadow
from gatewise.sources.tables import dense_ts

PCT = 10
MD5PCT = "((('0x' || substr(md5({k}), 1, 8))::BIGINT) % 100)"


# CRC-32 bit by bit: the table of a byte's eight steps, then one step per byte of an (ASCII) key.
_CRC_TABLE = "select list(v order by i) as tab from (select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as v from range(256) t(i))"
_CRC32 = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split({k}, ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1])), 4294967295)"


@register(
    "c1_assign_version_crc32",
    with_views(
        f"select event_id, client_ip, case when {_CRC32.format(k='client_ip')} % 100 < {PCT} then 'canary' else 'baseline' end as assigned_version from gw_requests, crc",
        "gw_requests",
        extra=[("crc", _CRC_TABLE)],
    ),
)
def c1_assign_version_crc32(spark, sf):
    return C.assign_version(gw_requests(spark, sf), "client_ip", PCT, "crc32").select("event_id", "client_ip", "assigned_version")


@register(
    "c1_assign_version_md5",
    with_views(
        f"select event_id, client_ip, case when {MD5PCT.format(k='client_ip')} < {PCT} then 'canary' else 'baseline' end as assigned_version from gw_requests",
        "gw_requests",
    ),
)
def c1_assign_version_md5(spark, sf):
    return C.assign_version(gw_requests(spark, sf), "client_ip", PCT, "md5").select("event_id", "client_ip", "assigned_version")


@register(
    "c2_split_accuracy",
    with_views(
        f"""select route_id, count(*) as requests, sum(case when {MD5PCT.format(k='client_ip')} < {PCT} then 1 else 0 end) as canary,
 sum(case when {MD5PCT.format(k='client_ip')} < {PCT} then 1 else 0 end) / count(*) * 100 as canary_pct,
 abs(sum(case when {MD5PCT.format(k='client_ip')} < {PCT} then 1 else 0 end) / count(*) * 100 - {float(PCT)}) as deviation_pp,
 abs(sum(case when {MD5PCT.format(k='client_ip')} < {PCT} then 1 else 0 end) / count(*) * 100 - {float(PCT)}) <= 1.0 as within_tolerance
 from gw_requests group by route_id""",
        "gw_requests",
    ),
)
def c2_split_accuracy(spark, sf):
    a = C.assign_version(gw_requests(spark, sf), "client_ip", PCT, "md5")
    return C.split_accuracy(a, PCT).select("route_id", "requests", F.col("canary").cast("bigint").alias("canary"), "canary_pct", "deviation_pp", "within_tolerance")


_C3_SQL = """select route_id, version, time_bucket(interval '10 seconds', ts_dense) as bucket_start, count(*) as total,
 cast(sum(case when status >= 500 then 1 else 0 end) as bigint) as errors from gw_canary group by route_id, version, bucket_start"""


def _buckets(spark, sf):
    return C.error_buckets(gw_canary(spark, sf))


@register("c3_error_buckets", with_views(_C3_SQL, "gw_canary"), bench=True)
def c3_error_buckets(spark, sf):
    return _buckets(spark, sf)


_C4_SQL = """select route_id, version, bucket_start, total, errors,
 sum(total) over w as win_total, cast(sum(errors) over w as bigint) as win_errors,
 case when sum(total) over w > 0 then (sum(errors) over w) / (sum(total) over w) else 0.0 end as error_rate
 from c3 window w as (partition by route_id, version order by cast(epoch(bucket_start) as bigint) range between 50 preceding and current row)"""


def _rates(spark, sf):
    return C.error_rate(_buckets(spark, sf))


@register("c4_error_rate", with_views(_C4_SQL, "gw_canary", extra=[("c3", _C3_SQL)]), bench=True)
def c4_error_rate(spark, sf):
    r = _rates(spark, sf)
    return r.select("route_id", "version", "bucket_start", "total", "errors", F.col("win_total").cast("bigint").alias("win_total"), F.col("win_errors").cast("bigint").alias("win_errors"), "error_rate")


_C5_SQL = """with vb as (select route_id, time_bucket(interval '10 seconds', ts_dense) as bucket_start,
  sum(case when version = 'canary' then 1 else 0 end) as c_n, sum(case when version = 'canary' and status >= 500 then 1 else 0 end) as c_e,
  sum(case when version <> 'canary' then 1 else 0 end) as b_n, sum(case when version <> 'canary' and status >= 500 then 1 else 0 end) as b_e
  from gw_canary group by all),
 vr as (select route_id, bucket_start, sum(c_n) over w as c_n, sum(c_e) over w as c_e, sum(b_n) over w as b_n, sum(b_e) over w as b_e from vb
  window w as (partition by route_id order by cast(epoch(bucket_start) as bigint) range between 50 preceding and current row)),
 vx as (select route_id, bucket_start, cast(c_n as bigint) as canary_total, cast(b_n as bigint) as baseline_total,
  case when c_n > 0 then c_e / c_n else 0.0 end as canary_rate, case when b_n > 0 then b_e / b_n else 0.0 end as baseline_rate from vr)
select *, (canary_rate - baseline_rate) * 100 as delta_pp,
 case when baseline_rate > 0.10 then 'baseline_unhealthy' when canary_total >= 10 and (canary_rate - baseline_rate) * 100 > 2.0 then 'breach'
  when canary_total < 10 then 'insufficient' else 'ok' end as verdict from vx"""


def _verdicts(spark, sf):
    return C.verdicts_from_traffic(gw_canary(spark, sf))


@register("c5_health_verdict", with_views(_C5_SQL, "gw_canary", extra=[("c3", _C3_SQL), ("c4", _C4_SQL)]))
def c5_health_verdict(spark, sf):
    v = _verdicts(spark, sf)
    return v.select("route_id", "bucket_start", F.col("canary_total").cast("bigint").alias("canary_total"), F.col("baseline_total").cast("bigint").alias("baseline_total"), "canary_rate", "baseline_rate", "delta_pp", "verdict")


@register(
    "c6_latency_guard",
    with_views(
        """with g as (select route_id, time_bucket(interval '60 seconds', ts_dense) as window_start, version, count(*) as n, quantile_disc(latency_ms, 0.95) as p95
  from gw_canary group by all)
 select coalesce(c.route_id, b.route_id) as route_id, coalesce(c.window_start, b.window_start) as window_start, c.n as canary_n, b.n as baseline_n,
  c.p95 as canary_p95, b.p95 as baseline_p95, coalesce(c.n >= 50 and b.n >= 50 and c.p95 > b.p95 * 1.5, false) as latency_pause
 from (select * from g where version = 'canary') c full outer join (select * from g where version = 'baseline') b
 on c.route_id = b.route_id and c.window_start = b.window_start""",
        "gw_canary",
    ),
)
def c6_latency_guard(spark, sf):
    return C.latency_guard(gw_canary(spark, sf))


def _replay(spark, sf):
    return C.stage_replay(_verdicts(spark, sf))


from gatewise.operators.folds import DEFAULT_SCHEDULE as _SCHED  # noqa: E402

_PCTS = "[" + ", ".join(str(p) for p, _ in _SCHED) + "]"
_HOLDS = "[" + ", ".join(str(h) for _, h in _SCHED) + "]"
_N = len(_SCHED)
_ADV = f"(st like 'STAGE%' and x.t - started >= {_HOLDS}[stage + 1] and x.verdict = 'ok' and x.ctot >= 10)"
_NEXT_IS_STAGE = f"(stage + 1 < {_N} and {_PCTS}[stage + 2] < 100)"
_BEFF = "(case when b is not null and x.t - b > 300 then null else b end)"

_C7_SQL = f"""WITH RECURSIVE ticks as (select route_id, bucket_start + interval '10 seconds' as ts, epoch(bucket_start) + 10 as t, verdict, canary_total as ctot,
  row_number() over (partition by route_id order by bucket_start) as rn from c5),
 rec as (
  select route_id, 0::bigint as rn, null::timestamp as ts, null::varchar as verdict, 0 as stage, 'STAGE_1' as st, t as started, null::double as b, null::varchar as ev
  from ticks where rn = 1
  union all
  select x.route_id, x.rn, x.ts, x.verdict,
   case when st in ('PROMOTED', 'ROLLED_BACK') or x.verdict in ('baseline_unhealthy', 'breach') then stage
    when {_ADV} then (case when {_NEXT_IS_STAGE} then stage + 1 else {_N - 1} end) else stage end,
   case when st in ('PROMOTED', 'ROLLED_BACK') or x.verdict = 'baseline_unhealthy' then st
    when x.verdict = 'breach' then (case when {_BEFF} is null then (case when st like 'STAGE%' then 'PAUSED' else st end)
      when x.t - {_BEFF} >= 60 then 'ROLLED_BACK' else st end)
    when {_ADV} then (case when {_NEXT_IS_STAGE} then 'STAGE_' || cast(stage + 2 as varchar) else 'PROMOTED' end) else st end,
   case when st in ('PROMOTED', 'ROLLED_BACK') or x.verdict in ('baseline_unhealthy', 'breach') then started when {_ADV} then x.t else started end,
   case when st in ('PROMOTED', 'ROLLED_BACK') or x.verdict = 'baseline_unhealthy' then b
    when x.verdict = 'breach' then (case when {_BEFF} is null then x.t when x.t - {_BEFF} >= 60 then null else {_BEFF} end) else null end,
   case when st in ('PROMOTED', 'ROLLED_BACK') then null when x.verdict = 'baseline_unhealthy' then 'baseline_unhealthy'
    when x.verdict = 'breach' then (case when {_BEFF} is null then (case when st like 'STAGE%' then 'paused_breach' end) when x.t - {_BEFF} >= 60 then 'rolled_back' end)
    when {_ADV} then (case when {_NEXT_IS_STAGE} then 'advanced' else 'promoted' end) end
  from rec r join ticks x on x.route_id = r.route_id and x.rn = r.rn + 1)
select route_id, ts, verdict, st as state, case when st = 'ROLLED_BACK' then 0 when st = 'PROMOTED' then 100 else {_PCTS}[stage + 1] end as traffic_pct,
 stage + 1 as stage, ev as event from rec where rn >= 1"""

_C7_ORACLE = "WITH RECURSIVE " + with_views("with " + _C7_SQL[len("WITH RECURSIVE ") :], "gw_canary", extra=[("c3", _C3_SQL), ("c4", _C4_SQL), ("c5", _C5_SQL)])[len("WITH ") :]


@register("c7_stage_replay", _C7_ORACLE)
def c7_stage_replay(spark, sf):
    r = _replay(spark, sf)
    return r.select("route_id", "ts", "verdict", "state", F.col("traffic_pct").cast("int").alias("traffic_pct"), F.col("stage").cast("int").alias("stage"), "event")


@register("c8_stage_timeline", "WITH RECURSIVE " + with_views("with " + _C7_SQL[len("WITH RECURSIVE ") :].replace("\nselect route_id, ts, verdict, st as state", ", rp as (select route_id, ts, verdict, st as state") + ")" + '\nselect route_id, traffic_pct, state, ts as start_ts, lead(ts) over (partition by route_id order by ts) as end_ts,\n cast(epoch(lead(ts) over (partition by route_id order by ts)) - epoch(ts) as bigint) as duration_s\n from (select *, lag(traffic_pct) over (partition by route_id order by ts) as prev from rp) where prev is null or prev <> traffic_pct', "gw_canary", extra=[("c3", _C3_SQL), ("c4", _C4_SQL), ("c5", _C5_SQL)])[len("WITH ") :])
def c8_stage_timeline(spark, sf):
    t = C.stage_timeline(_replay(spark, sf))
    return t.select("route_id", F.col("traffic_pct").cast("int").alias("traffic_pct"), "state", "start_ts", "end_ts", F.col("duration_s").cast("bigint").alias("duration_s"))


@register("c9_rollback_events", "WITH RECURSIVE " + with_views("with " + _C7_SQL[len("WITH RECURSIVE ") :].replace("\nselect route_id, ts, verdict, st as state", ", rp as (select route_id, ts, verdict, st as state") + ")" + "\nselect route_id, ts, event, 'CANARY_ROLLBACK' as event_type, 'ROLLED_BACK' as action_taken,\n json_object('type', 'canary_rollback', 'route_id', route_id, 'reason', event, 'timestamp', strftime(ts, '%Y-%m-%dT%H:%M:%SZ'))::varchar as notification\n from rp where event like 'rolled_back%'", "gw_canary", extra=[("c3", _C3_SQL), ("c4", _C4_SQL), ("c5", _C5_SQL)])[len("WITH ") :])
def c9_rollback_events(spark, sf):
    return C.rollback_events(_replay(spark, sf))


DISABLED = ("2024-01-01 00:10:00", "2024-01-01 00:20:00")


@register(
    "c11_shadow_sample",
    with_views(
        f"""select request_id, ts_dense from gw_requests where {MD5PCT.format(k='request_id')} < 10
 and not (ts_dense >= timestamp '{DISABLED[0]}' and ts_dense < timestamp '{DISABLED[1]}')""",
        "gw_requests",
    ),
)
def c11_shadow_sample(spark, sf):
    d = spark.createDataFrame([DISABLED], "start string, end string").select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"))
    return C.shadow_sample(gw_requests(spark, sf), 10, "request_id", "md5", d, "ts_dense").select("request_id", "ts_dense")


SHADOW_TIMEOUT_MS = 500


def _shadow_outcomes(spark, sf):
    """A shadow call fails on a 5xx or when it exceeds the shadow timeout."""
    s = gw_shadow(spark, sf)
    eid = F.substring(F.col("request_id"), 5, 20).cast("bigint")
    ok = (F.col("status") < 500) & (F.col("latency_shadow_ms") <= SHADOW_TIMEOUT_MS)
    return s.select("request_id", eid.alias("id"), F.concat(F.lit("route-"), (eid % 5).cast("string")).alias("route_id"), dense_ts(eid).alias("ts"), ok.alias("success"))


_C12_SQL = """WITH RECURSIVE o as (select request_id, cast(substr(request_id, 5) as bigint) as id, 'route-' || cast(cast(substr(request_id, 5) as bigint) % 5 as varchar) as route_id,
  timestamp '2024-01-01 00:00:00' + to_milliseconds(cast(substr(request_id, 5) as bigint) * 250) as ts,
  status < 500 and latency_shadow_ms <= 500 as success from gw_shadow),
 e as (select *, epoch(ts) as t, row_number() over (partition by route_id order by ts, id) as rn from o),
 rec as (
  select route_id, rn, request_id, t, case when success then 0 else 1 end as fails, case when success then null else t end as last_fail,
   null::double as until, false as skipped, false as tripped from e where rn = 1
  union all
  select x.route_id, x.rn, x.request_id, x.t,
   case when r.until is not null and x.t < r.until then r.fails when x.success then 0
    when (case when r.last_fail is not null and x.t - r.last_fail <= 300 then r.fails else 0 end) + 1 >= 3 then 0
    else (case when r.last_fail is not null and x.t - r.last_fail <= 300 then r.fails else 0 end) + 1 end,
   case when r.until is not null and x.t < r.until then r.last_fail when x.success then r.last_fail else x.t end,
   case when r.until is not null and x.t < r.until then r.until
    when not x.success and (case when r.last_fail is not null and x.t - r.last_fail <= 300 then r.fails else 0 end) + 1 >= 3 then x.t + 300 else r.until end,
   r.until is not null and x.t < r.until,
   not (r.until is not null and x.t < r.until) and not x.success and (case when r.last_fail is not null and x.t - r.last_fail <= 300 then r.fails else 0 end) + 1 >= 3
  from rec r join e x on x.route_id = r.route_id and x.rn = r.rn + 1)
select o.request_id, o.route_id, o.ts, o.success, r.skipped, r.tripped, cast(r.fails as bigint) as fail_count from o join rec r on o.request_id = r.request_id"""


@register("c12_shadow_auto_disable", "WITH RECURSIVE " + with_views("with " + _C12_SQL[len("WITH RECURSIVE ") :], "gw_shadow")[len("WITH ") :])
def c12_shadow_auto_disable(spark, sf):
    return C.shadow_auto_disable(_shadow_outcomes(spark, sf), "route_id").select("request_id", "route_id", "ts", "success", "skipped", "tripped", "fail_count")


WEIGHTS = [("v1", 700), ("v2", 296), ("v3", 4)]


@register(
    "c13_weighted_assignment",
    with_views(
        """select event_id, case when part < 700 * 4294967296 then 'v1' when part < 996 * 4294967296 then 'v2' else 'v3' end as "group" from (
 select event_id, cast('0x' || substr(md5(request_id), 1, 8) as bigint) * 1000 as part from gw_requests)""",
        "gw_requests",
    ),
)
def c13_weighted_assignment(spark, sf):
    w = spark.createDataFrame(WEIGHTS, "group string, weight int")
    return C.weighted_assignment(gw_requests(spark, sf), w, "request_id").select("event_id", "group")


def _pairs(spark, sf):
    s = gw_shadow(spark, sf)
    p = s.select("request_id", F.lit(200).alias("status_p"), F.col("bytes_primary").alias("bytes_p"), F.col("latency_primary_ms").alias("latency_p"), F.col("body_primary").alias("body_p"))
    sh = s.select("request_id", F.col("status").alias("status_s"), F.col("bytes_shadow").alias("bytes_s"), F.col("latency_shadow_ms").alias("latency_s"), F.col("body_shadow").alias("body_s"))
    return p, sh


_C14_SQL = """select request_id, 200 = status as status_match, abs(bytes_shadow - bytes_primary) as body_length_delta,
 cast(floor(latency_shadow_ms - latency_primary_ms) as bigint) as latency_delta_ms,
 case when 200 <> status then 'status' when abs(bytes_shadow - bytes_primary) <> 0 then 'body_length' else 'none' end as diff_type from gw_shadow"""


@register("c14_basic_diff", with_views(_C14_SQL, "gw_shadow"))
def c14_basic_diff(spark, sf):
    p, s = _pairs(spark, sf)
    return C.basic_diff(p, s)


_C15_SQL = f"""with a as ({sql_leaves('gw_shadow', ['request_id'], 'body_primary')}),
 b as ({sql_leaves('gw_shadow', ['request_id'], 'body_shadow')}),
 j as (select coalesce(a.request_id, b.request_id) as request_id, coalesce(a.path, b.path) as path, a.path is not null as has_a, b.path is not null as has_b,
  a.path is not null and b.path is not null and a.value_type = b.value_type and a.value is not distinct from b.value as same
  from a full outer join b on a.request_id = b.request_id and a.path = b.path),
 g as (select request_id, sum(has_a::int) as n_a, sum(has_b::int) as n_b, sum(same::int) as n_same,
  array_to_string(list_sort(list(path) filter (where not same)), ',') as diff_fields from j group by request_id)
select s.request_id, round(coalesce(case when n_a + n_b = 0 then 1.0 else 2.0 * n_same / (n_a + n_b) end, 1.0), 6) as similarity, coalesce(g.diff_fields, '') as diff_fields
from gw_shadow s left join g on s.request_id = g.request_id"""


def _structural(spark, sf):
    # both bodies stand in one row of the view, so nothing is joined
    return C.structural_diff(spread(gw_shadow(spark, sf)), body_p="body_primary", body_s="body_shadow")


@register("c15_structural_diff", with_views(_C15_SQL, "gw_shadow"), bench=True)
def c15_structural_diff(spark, sf):
    return _structural(spark, sf).withColumn("diff_fields", F.array_join("diff_fields", ","))


@register(
    "c16_diff_choice",
    with_views(
        """select request_id, case when body_primary is not null and body_shadow is not null and octet_length(encode(body_primary)) <= 1048576
  and octet_length(encode(body_shadow)) <= 1048576 and not contains(lower(case when cast(substr(request_id, 5) as bigint) % 7 = 0 then 'text/event-stream' else 'application/json' end), 'event-stream')
  then 'structural' else 'basic' end as diff_mode from gw_shadow""",
        "gw_shadow",
    ),
)
def c16_diff_choice(spark, sf):
    p, s = _pairs(spark, sf)
    j = p.join(s, "request_id").withColumn(
        "content_type", F.when(F.substring(F.col("request_id"), 5, 20).cast("bigint") % 7 == 0, "text/event-stream").otherwise("application/json")
    )
    return C.diff_choice(j).select("request_id", "diff_mode")


@register(
    "c17_diff_report",
    with_views(
        f"""with d as ({_C14_SQL}), s as ({_C15_SQL.replace(chr(10), ' ')})
 select 'route-' || cast(cast(substr(d.request_id, 5) as bigint) % 5 as varchar) as route_id, d.diff_type, count(*) as n,
  quantile_disc(d.latency_delta_ms, 0.5) as latency_delta_p50, quantile_disc(d.latency_delta_ms, 0.95) as latency_delta_p95,
  quantile_disc(s.similarity, 0.5) as similarity_p50, min(s.similarity) as similarity_min
 from d join s on d.request_id = s.request_id group by all""",
        "gw_shadow",
    ),
)
def c17_diff_report(spark, sf):
    p, s = _pairs(spark, sf)
    d = C.basic_diff(p, s).join(_structural(spark, sf), "request_id")
    d = d.withColumn("route_id", F.concat(F.lit("route-"), (F.substring(F.col("request_id"), 5, 20).cast("bigint") % 5).cast("string")))
    return C.diff_report(d)


@register("c18_canary_status", "WITH RECURSIVE " + with_views("with " + _C7_SQL[len("WITH RECURSIVE ") :].replace("\nselect route_id, ts, verdict, st as state", ", rp as (select route_id, ts, verdict, st as state") + ")" + '\nselect s.route_id, s.ts, s.state, s.traffic_pct, s.stage, v.canary_rate, v.baseline_rate, v.canary_total, v.baseline_total\n from (select route_id, arg_max(ts, ts) as ts, arg_max(state, ts) as state, arg_max(traffic_pct, ts) as traffic_pct, arg_max(stage, ts) as stage from rp group by route_id) s\n join (select route_id, arg_max(canary_rate, bucket_start) as canary_rate, arg_max(baseline_rate, bucket_start) as baseline_rate,\n  arg_max(canary_total, bucket_start) as canary_total, arg_max(baseline_total, bucket_start) as baseline_total from c5 group by route_id) v on s.route_id = v.route_id', "gw_canary", extra=[("c3", _C3_SQL), ("c4", _C4_SQL), ("c5", _C5_SQL)])[len("WITH ") :])
def c18_canary_status(spark, sf):
    from gatewise.operators.common import materialize

    v = materialize(_verdicts(spark, sf), "verdicts")  # read by the replay and by the status join
    st = C.canary_status(C.stage_replay(v), v)
    return st.select("route_id", "ts", "state", F.col("traffic_pct").cast("int").alias("traffic_pct"), F.col("stage").cast("int").alias("stage"),
                     "canary_rate", "baseline_rate", F.col("canary_total").cast("bigint").alias("canary_total"), F.col("baseline_total").cast("bigint").alias("baseline_total"))
