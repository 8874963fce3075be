"""Registered queries: mask strategies, role policy."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewise.functions import strategies as S
from gatewise.operators import masking as M
from gatewise.plans.catalog import register
from gatewise.plans.oracle_views import with_views
from gatewise.sources import gw_customers, gw_requests

# strategy -> column of the customer view it is applied to
STRATEGY_COLUMNS = [
    ("last4", "pan"),
    ("first2last2", "email"),
    ("hash", "national_id"),
    ("redact", "phone"),
    ("mask:email", "email"),
    ("mask:phone", "phone"),
    ("mask:national_id", "national_id"),
    ("mask:iban", "iban"),
    ("mask:ip", "ip"),
    ("mask:dob", "dob"),
    ("full", "pan"),
    ("imei", "imei"),
]


def _alias(s: str) -> str:
    return "m_" + s.replace(":", "_")


@register(
    "m1_m12_strategies",
    with_views(
        "select cust_id, " + ", ".join(f"{S.sql_apply(c, s, literal=True)} as {_alias(s)}" for s, c in STRATEGY_COLUMNS) + " from gw_customers",
        "gw_customers",
    ),
)
def m1_m12_strategies(spark, sf):
    c = gw_customers(spark, sf)
    return c.select("cust_id", *[S.apply_strategy(F.col(col), s).alias(_alias(s)) for s, col in STRATEGY_COLUMNS])


ROW_STRATEGIES = list(S.STRATEGIES) + ["no_such_strategy"]


def _row_strategy_sql() -> str:
    return "case cust_id % " + str(len(ROW_STRATEGIES)) + " " + " ".join(f"when {i} then '{s}'" for i, s in enumerate(ROW_STRATEGIES)) + " end"


@register(
    "m14_apply_strategy",
    with_views(
        f"""select cust_id, strategy, {S.sql_apply('v', 'strategy')} as masked from (
 select cust_id, {_row_strategy_sql()} as strategy,
  case cust_id % 4 when 0 then pan when 1 then email when 2 then phone else null end as v from gw_customers)""",
        "gw_customers",
    ),
)
def m14_apply_strategy(spark, sf):
    c = gw_customers(spark, sf)
    k = F.col("cust_id") % len(ROW_STRATEGIES)
    strat = None
    for i, s in enumerate(ROW_STRATEGIES):
        strat = F.when(k == i, s) if strat is None else strat.when(k == i, s)
    v = F.when(F.col("cust_id") % 4 == 0, F.col("pan")).when(F.col("cust_id") % 4 == 1, F.col("email")).when(F.col("cust_id") % 4 == 2, F.col("phone"))
    d = c.select("cust_id", strat.alias("strategy"), v.alias("v"))
    return d.select("cust_id", "strategy", S.apply_strategy(F.col("v"), F.col("strategy")).alias("masked"))


TOKEN_KEY = "0123456789abcdef0123456789abcdef"


@register(
    "m13_tokenize_roundtrip",
    with_views(
        f"select cust_id, 'tok_' || substr(sha256('{TOKEN_KEY}' || email), 1, 32) as token, true as roundtrip_ok from gw_customers",
        "gw_customers",
    ),
)
def m13_tokenize_roundtrip(spark, sf):
    c = gw_customers(spark, sf).select("cust_id", "email")
    tok, mapping = M.tokenize(c, "email", TOKEN_KEY)
    back = M.detokenize(tok, "token", mapping, TOKEN_KEY, "back")
    return back.select("cust_id", "token", (F.col("back") == F.col("email")).alias("roundtrip_ok"))


PROJECTED = {"email": "email", "phone": "phone", "pan": "pan", "national_id": "national_id", "iban": "iban", "imei": "imei", "ip": "ip", "dob": "dob"}


def _policy_sql(ft: str) -> str:
    whens = " ".join(f"when '{r}' then '{o.get(ft, d)}'" for r, (d, o) in M.DEFAULT_POLICIES.items())
    return f"coalesce(case lower(role) {whens} end, 'redact')"


@register(
    "m15_role_projection",
    with_views(
        "select cust_id, role, "
        + ", ".join(f"{S.sql_apply(c, _policy_sql(ft))} as {c}" for c, ft in PROJECTED.items())
        + " from gw_customers",
        "gw_customers",
    ),
    bench=True,
)
def m15_role_projection(spark, sf):
    c = gw_customers(spark, sf)
    return M.masked_projection(c, "role", PROJECTED).select("cust_id", "role", *PROJECTED)


@register(
    "r1_resolve_strategy",
    with_views(
        "select cust_id, field_type, case lower(role) "
        + " ".join(
            f"when '{r}' then case field_type " + " ".join(f"when '{f}' then '{s}'" for f, s in o.items()) + f" else '{d}' end"
            if o
            else f"when '{r}' then '{d}'"
            for r, (d, o) in M.DEFAULT_POLICIES.items()
        )
        + " else 'redact' end as strategy from gw_customers, (select unnest(['"
        + "','".join(M.FIELD_TYPES)
        + "']) as field_type)",
        "gw_customers",
    ),
)
def r1_resolve_strategy(spark, sf):
    c = gw_customers(spark, sf).select("cust_id", "role", F.explode(F.array(*[F.lit(f) for f in M.FIELD_TYPES])).alias("field_type"))
    return M.resolve_strategy(c, "role", "field_type").select("cust_id", "field_type", "strategy")


ROLES6 = ["admin", "operator", "support_agent", "external_partner", "auditor", None]


@register(
    "r2_consumer_role",
    with_views(
        """select r.event_id, case when r.consumer_id is null then 'anonymous' else coalesce(m.role, 'unknown') end as consumer_role
 from gw_requests r left join meta m on r.consumer_id = m.consumer_id""",
        "gw_requests",
        extra=[
            ("cons", "select distinct consumer_id, cast(substr(consumer_id, 6) as int) as n from gw_requests"),
            (
                "meta",
                """select consumer_id, case n % 6 when 0 then 'admin' when 1 then 'operator' when 2 then 'support_agent' when 3 then 'external_partner' when 4 then 'auditor' end as role
  from cons where n % 7 <> 0""",
            ),
        ],
    ),
)
def r2_consumer_role(spark, sf):
    r = gw_requests(spark, sf)
    n = F.substring(F.col("consumer_id"), 6, 10).cast("int")
    role = None
    for i, x in enumerate(ROLES6):
        if x is not None:
            role = F.when(n % 6 == i, x) if role is None else role.when(n % 6 == i, x)
    meta = r.select("consumer_id").distinct().where(n % 7 != 0).select("consumer_id", role.alias("role"))
    return M.consumer_role(r, meta).select("event_id", "consumer_role")
