"""Registered queries: request validation and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewise.functions import pii as PF
from gatewise.functions import status as ST
from gatewise.operators import requests as R
from gatewise.plans.catalog import register
from gatewise.plans.oracle_views import with_views
from gatewise.sources import gw_bodies, gw_customers, gw_request_bodies, gw_requests

_T1_SQL = """select conv_id, turn,
 case when body is null or body = '' then 'body_missing' when not json_valid(body) then 'invalid_json'
  when json_type(body, '$.messages') is distinct from 'ARRAY' or json_array_length(body, '$.messages') = 0 then 'messages_missing_or_empty'
  when json_extract_string(body, '$.model') is null or json_extract_string(body, '$.model') = '' then 'model_missing' end as reject_detail,
 case when json_valid(body) then json_extract_string(body, '$.model') end as req_model,
 case when json_valid(body) and json_type(body, '$.messages') = 'ARRAY' then cast(json_array_length(body, '$.messages') as int) end as n_messages
from gw_request_bodies"""


@register("t1_request_log_valid", with_views("select conv_id, turn, req_model, n_messages from t1 where reject_detail is null", "gw_request_bodies", extra=[("t1", _T1_SQL)]))
def t1_request_log_valid(spark, sf):
    valid, _ = R.request_log(gw_request_bodies(spark, sf))
    return valid.select("conv_id", "turn", "req_model", "n_messages")


@register(
    "t1_request_log_rejects",
    with_views(
        "select conv_id, turn, reject_detail, 'ARIA_SH_INVALID_REQUEST_FORMAT' as error_code from t1 where reject_detail is not null",
        "gw_request_bodies",
        extra=[("t1", _T1_SQL)],
    ),
)
def t1_request_log_rejects(spark, sf):
    _, rej = R.request_log(gw_request_bodies(spark, sf))
    return rej.select("conv_id", "turn", "reject_detail", "error_code")


ROUTE_PINS = [("route-1", "gpt-4o-mini"), ("route-3", "claude-haiku-4-5")]
CONSUMER_PINS = [("team-4", "gpt-4.1-nano"), ("team-7", "claude-opus-4-6")]


@register(
    "f1_model_pin",
    with_views(
        """select event_id, requested_model, model, model <> requested_model as pinned from (
 select r.event_id, r.model as requested_model,
  case when cp.m is not null and regexp_extract(cp.m, '^([a-z]+)', 1) = regexp_extract(coalesce(rp.m, r.model), '^([a-z]+)', 1) then cp.m else coalesce(rp.m, r.model) end as model
 from gw_requests r left join (values """
        + ", ".join(f"('{a}', '{b}')" for a, b in ROUTE_PINS)
        + """) rp(route_id, m) on r.route_id = rp.route_id
 left join (values """
        + ", ".join(f"('{a}', '{b}')" for a, b in CONSUMER_PINS)
        + """) cp(consumer_id, m) on r.consumer_id = cp.consumer_id)""",
        "gw_requests",
    ),
)
def f1_model_pin(spark, sf):
    rp = spark.createDataFrame(ROUTE_PINS, "route_id string, model string")
    cp = spark.createDataFrame(CONSUMER_PINS, "consumer_id string, model string")
    return R.model_pin(gw_requests(spark, sf), rp, cp).select("event_id", "requested_model", "model", "pinned")


def _cat_values() -> str:
    def q(x):
        return "null" if x is None else (str(x) if isinstance(x, int) else f"'{x}'")

    return ", ".join("(" + ", ".join(q(v) for v in row) + ")" for row in ST.ERROR_CATALOGUE)


def _severity_values() -> str:
    return ", ".join(f"('{code}', '{level}')" for code, level, needs in ST.SEVERITIES if needs is None)


_F3_SQL = """case when status is null then 'ARIA_SH_PROVIDER_UNREACHABLE' when status >= 500 then 'ARIA_SH_PROVIDER_ERROR'
 when status in (401, 403) then 'ARIA_SH_PROVIDER_AUTH_FAILED' when status = 429 then 'ARIA_SH_PROVIDER_RATE_LIMITED' end"""


@register(
    "f2_f5_status_and_errors",
    with_views(
        f"""select r.event_id, cast(floor(r.status / 100) as bigint) || 'xx' as status_class, r.status >= 500 as is_error, r.error_code,
 c.http_status as gateway_http_status, c.category, c.log_level, c.retry_class,
 s.severity
 from (select *, {_F3_SQL} as error_code from gw_requests) r
 left join (values {_cat_values()}) c(error_code, http_status, category, log_level, retry_class) on r.error_code = c.error_code
 left join (values {_severity_values()}) s(error_code, severity) on r.error_code = s.error_code""",
        "gw_requests",
    ),
)
def f2_f5_status_and_errors(spark, sf):
    d = R.with_error_catalogue(R.with_status(gw_requests(spark, sf)))
    return d.select("event_id", "status_class", "is_error", "error_code", "gateway_http_status", "category", "log_level", "retry_class", "severity")


# internal faults: what the gateway reports as its own for statuses of 500 and more, every fifth as a lost sidecar
_F5_CODES = [("ARIA_SYS_INTERNAL_ERROR", "not event_id % 5 = 0"), ("ARIA_RT_SIDECAR_UNAVAILABLE", "event_id % 5 = 0")]


@register(
    "f5_alert_severities",
    with_views(
        f"""select code, minute, errors, sustained_s, case when code = '{_F5_CODES[0][0]}' and errors > {ST.RATE_PER_MINUTE} or code = '{_F5_CODES[1][0]}' and sustained_s > {ST.SUSTAINED_S} then 'critical' end as severity
 from (select code, minute, errors, row_number() over (partition by code, run order by minute) * 60 as sustained_s
  from (select *, epoch(minute) / 60 - row_number() over (partition by code order by minute) as run
   from (select case when {_F5_CODES[0][1]} then '{_F5_CODES[0][0]}' else '{_F5_CODES[1][0]}' end as code, date_trunc('minute', ts_dense) as minute, count(*) as errors from gw_requests where status >= 500 group by all)))""",
        "gw_requests",
    ),
)
def f5_alert_severities(spark, sf):
    code = F.when(F.expr(_F5_CODES[0][1]), _F5_CODES[0][0]).otherwise(_F5_CODES[1][0])
    errors = gw_requests(spark, sf).where("status >= 500").select(code.alias("error_code"), F.col("ts_dense").alias("ts"))
    return ST.alert_severities(errors).select("code", "minute", "errors", F.col("sustained_s").cast("bigint").alias("sustained_s"), "severity")


@register(
    "f6_maskable_gate",
    with_views(
        """select skip_reason, count(*) as bodies, cast(sum(octet_length(encode(body))) as bigint) as bytes from (
 select body, case when not contains(lower(coalesce(content_type, '')), 'json') then 'not_json_content_type'
  when octet_length(encode(body)) > 10485760 then 'body_too_large' when not json_valid(body) then 'invalid_json' end as skip_reason from gw_bodies)
 group by skip_reason""",
        "gw_bodies",
    ),
)
def f6_maskable_gate(spark, sf):
    d = R.maskable_gate(gw_bodies(spark, sf))
    return d.groupBy("skip_reason").agg(F.count(F.lit(1)).alias("bodies"), F.sum("body_bytes").cast("bigint").alias("bytes"))


F7_COLUMNS = ["cust_id", "email", "phone", "pan", "national_id", "iban", "imei", "ip", "dob", "role"]


def _f7_sql() -> str:
    parts = []
    for c in F7_COLUMNS:
        rank = f"list_max(list_transform({PF.sql_scan(f'cast({c} as varchar)')}, lambda mm: cast(substr(mm.classification, 2, 1) as int)))"
        parts.append(f"select '{c}' as column_name, greatest(coalesce(max({rank}), 2), 2) as r from gw_customers")
    body = " union all ".join(parts)
    return f"select column_name, 'L' || cast(r as varchar) as level, 'L' || cast(max(r) over () as varchar) as dataset_level from ({body})"


@register("f7_classification_rollup", with_views(_f7_sql(), "gw_customers"))
def f7_classification_rollup(spark, sf):
    return R.classification_rollup(gw_customers(spark, sf), F7_COLUMNS)
