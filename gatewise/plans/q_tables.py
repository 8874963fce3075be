"""Registered queries: fact tables, sinks, maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewise.operators import quota as Q
from gatewise.plans.catalog import register
from gatewise.plans.oracle_views import with_views
from gatewise.plans.q_quota import PRICED
from gatewise.sources import gw_billing, gw_requests
from gatewise.sources import sinks as T
from gatewise.sources.tables import REQUEST_MODELS, _case


def _billing_rows(spark, sf, shift: int = 0):
    b = gw_billing(spark, sf)
    return b.select(
        "request_id", "consumer_id", "route_id", _case(F.col("model_ix"), REQUEST_MODELS).alias("model"),
        _case(F.col("provider_ix") % 3, ["openai", "anthropic", "google"]).alias("provider"),
        "tokens_input", (F.col("tokens_output") - shift).alias("tokens_output"),
        (F.col("tokens_input") * F.lit(0.00001)).cast("decimal(12,6)").alias("cost_dollars"), "is_reconciled", F.col("ts").alias("timestamp"),
    )


@register(
    "t2_write_monthly",
    with_views("select strftime(ts, '%Y-%m') as month, count(*) as rows, cast(sum(tokens_input) as bigint) as tokens_input from gw_billing group by all", "gw_billing"),
)
def t2_write_monthly(spark, sf):
    path = T.write_monthly(_billing_rows(spark, sf), T.table_root(spark, "billing_records"))
    back = spark.read.parquet(path)
    return back.groupBy("month").agg(F.count(F.lit(1)).alias("rows"), F.sum("tokens_input").cast("bigint").alias("tokens_input"))


AS_OF = "2001-06-15"


@register(
    "t3_retention_plan",
    with_views(
        f"""select strftime(ts, '%Y-%m') as month, count(*) as rows, date_trunc('month', date '{AS_OF}' - interval 84 month)::date as cutoff,
 case when strptime(strftime(ts, '%Y-%m') || '-01', '%Y-%m-%d')::date < date_trunc('month', date '{AS_OF}' - interval 84 month)::date then 'drop' else 'keep' end as action
 from gw_billing group by all""",
        "gw_billing",
    ),
)
def t3_retention_plan(spark, sf):
    return T.retention_plan(spark, T.with_month(_billing_rows(spark, sf)), AS_OF, 84)


SHIFT = 300


@register(
    "t4_constraint_rejects",
    with_views(
        f"""select request_id, array_to_string(list_filter([case when tokens_output - {SHIFT} < 0 then 'tokens_output_negative' end], lambda x: x is not null), ',') as violations
 from gw_billing where tokens_output - {SHIFT} < 0""",
        "gw_billing",
    ),
)
def t4_constraint_rejects(spark, sf):
    _, bad = T.constraint_split(_billing_rows(spark, sf, SHIFT), "billing_records")
    return bad.select("request_id", F.array_join("violations", ",").alias("violations"))


def _raw_events(spark, sf):
    r = gw_requests(spark, sf).where(F.col("status") != 200)
    et = F.when(F.col("status") == 429, "QUOTA_EXCEEDED").otherwise("PROVIDER_FAILOVER")
    ev = F.to_json(
        F.struct(
            F.col("request_id").alias("id"), "consumer_id", "route_id", et.alias("event_type"), F.lit("BLOCKED").alias("action_taken"),
            F.lit("").alias("payload_excerpt"), F.lit("").alias("rule_id"), F.lit("{}").alias("metadata"), "request_id",
            F.col("ts").alias("timestamp"), F.col("ts").alias("created_at"),
        ),
        T.JSON_TS_OPTIONS,
    )
    value = F.when(F.col("event_id") % 50 == 0, F.substring(ev, 1, 40)).when(F.col("event_id") % 31 == 0, F.replace(ev, F.lit("PROVIDER_FAILOVER"), F.lit("NOT_AN_EVENT"))).otherwise(ev)
    once = r.select(value.alias("value"), "event_id")
    dup = once.where(F.col("event_id") % 13 == 0)
    return once.unionByName(dup).select("value")


_T5_BASE = """select *, case when status = 429 then 'QUOTA_EXCEEDED' else 'PROVIDER_FAILOVER' end as et,
 case when event_id % 50 = 0 then 'unparseable' when event_id % 31 = 0 and status <> 429 then 'bad_event_type' end as bad
 from gw_requests where status <> 200"""


@register(
    "t5_audit_drain",
    with_views(
        """select 'persisted' as outcome, et as kind, count(distinct request_id) as n from b where bad is null group by all
 union all select 'dead_letter', bad, sum(case when event_id % 13 = 0 then 2 else 1 end) from b where bad is not null group by all""",
        "gw_requests",
        extra=[("b", _T5_BASE)],
    ),
)
def t5_audit_drain(spark, sf):
    good, dead = T.audit_drain(_raw_events(spark, sf))
    g = good.groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n")).withColumn("outcome", F.lit("persisted"))
    d = dead.groupBy(F.col("reason").alias("kind")).agg(F.count(F.lit(1)).alias("n")).withColumn("outcome", F.lit("dead_letter"))
    return g.unionByName(d).select("outcome", "kind", "n")


@register(
    "t7_audit_search",
    with_views(
        """select request_id, consumer_id, et as event_type, ts as timestamp from (select distinct on (request_id, et) * from b where bad is null)
 where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-20' and consumer_id = 'team-3' and et = 'PROVIDER_FAILOVER'""",
        "gw_requests",
        extra=[("b", _T5_BASE)],
    ),
)
def t7_audit_search(spark, sf):
    good, _ = T.audit_drain(_raw_events(spark, sf))
    s = T.audit_search(T.with_month(good), "2024-01-10 00:00:00", "2024-01-20 00:00:00", "team-3", "PROVIDER_FAILOVER")
    return s.select("request_id", "consumer_id", "event_type", "timestamp")


@register(
    "t8_unreconciled",
    with_views(
        """select consumer_id, count(*) as unreconciled, cast(sum(tokens_input + tokens_output) as bigint) as tokens, min(ts) as oldest,
 datediff('day', min(ts)::date, date '1999-01-01') as max_age_days from gw_billing where not is_reconciled group by all""",
        "gw_billing",
    ),
)
def t8_unreconciled(spark, sf):
    u = T.unreconciled(gw_billing(spark, sf), "1999-01-01")
    return u.select("consumer_id", "unreconciled", F.col("tokens").cast("bigint").alias("tokens"), "oldest", F.col("max_age_days").cast("bigint").alias("max_age_days"))


@register(
    "t9_billing_facts",
    with_views(
        """select substr(sha256('billing|' || request_id), 1, 32) as id, consumer_id, route_id, model, provider, tokens_input, tokens_output,
 cast(cost_usd as double) as cost_dollars, request_id, false as is_reconciled, ts as timestamp from priced""",
        "gw_requests",
        extra=PRICED,
    ),
)
def t9_billing_facts(spark, sf):
    b = T.billing_facts(Q.with_cost(gw_requests(spark, sf)))
    return b.withColumn("cost_dollars", F.col("cost_dollars").cast("double"))


@register(
    "t11_append_only_check",
    with_views(
        """select 'append_only' as snapshot, (select count(*) from (select * from gw_billing where ts < timestamp '1997-01-01' except all select * from gw_billing)) as violations
 union all select 'tampered', (select count(*) from (select * from gw_billing where ts < timestamp '1997-01-01' except all
  select request_id, consumer_id, route_id, model_ix, provider_ix, tokens_input + case when model_ix = 7 and ts < timestamp '1993-01-01' then 1 else 0 end, tokens_output, is_reconciled, ts from gw_billing))""",
        "gw_billing",
    ),
)
def t11_append_only_check(spark, sf):
    b = gw_billing(spark, sf)
    before = b.where(F.col("ts") < F.lit("1997-01-01").cast("timestamp_ntz"))
    tampered = b.withColumn(
        "tokens_input", F.col("tokens_input") + F.when((F.col("model_ix") == 7) & (F.col("ts") < F.lit("1993-01-01").cast("timestamp_ntz")), 1).otherwise(0)
    )
    ok = T.append_only_violations(before, b).agg(F.count(F.lit(1)).alias("violations")).withColumn("snapshot", F.lit("append_only"))
    bad = T.append_only_violations(before, tampered).agg(F.count(F.lit(1)).alias("violations")).withColumn("snapshot", F.lit("tampered"))
    return ok.unionByName(bad).select("snapshot", "violations")


@register(
    "t12_report_export_csv",
    with_views(
        "select consumer_id, model, count(*) as requests, cast(sum(cost_usd) as double) as cost_usd from priced group by all",
        "gw_requests",
        extra=PRICED,
    ),
)
def t12_report_export_csv(spark, sf):
    rep = Q.spend_by(Q.with_cost(gw_requests(spark, sf)), ["consumer_id", "model"]).select("consumer_id", "model", "requests", "cost_usd")
    path = T.report_export(rep, T.table_root(spark, "report"), "csv")
    return spark.read.schema("consumer_id string, model string, requests bigint, cost_usd double").option("header", True).csv(path)
