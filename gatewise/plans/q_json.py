"""Registered queries: JSON body masking."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewise.functions import pii as PF
from gatewise.functions import strategies as S
from gatewise.operators import jsonmask as J
from gatewise.operators import requests as R
from gatewise.operators.common import materialize
from gatewise.operators.jsontree import json_leaves, json_nodes, sql_leaves, sql_nodes
from gatewise.operators.masking import DEFAULT_POLICIES
from gatewise.plans.catalog import register
from gatewise.plans.oracle_views import with_views
from gatewise.sources import gw_bodies

RULES = [
    {"id": "r-email", "path": "$.user.email", "strategy": "mask:email", "field_type": "email"},
    {"id": "r-pan", "path": "$.items[*].pan", "strategy": "last4", "field_type": "pan"},
    {"id": "r-any-pan", "path": "$..pan", "strategy": "hash", "field_type": "card"},  # again on r-pan's values; full for operators
    {"id": "r-extra", "path": "$.extra", "strategy": "redact", "field_type": "secret"},  # a container
]
FIND = [*RULES, {"id": "r-any-note", "path": "$..note"}, {"id": "r-items", "path": "$.items[*]"}, {"id": "r-dotted", "path": "$..a.b"}]
# What each path means, written out for the oracle.
FIND_SQL = {
    "r-email": "path = '$.user.email'",
    "r-pan": "path in ('$.items[0].pan', '$.items[1].pan')",
    "r-any-pan": "suffix(path, '.pan')",
    "r-extra": "path = '$.extra'",
    "r-any-note": "suffix(path, '.note')",
    "r-items": "path in ('$.items[0]', '$.items[1]')",
    "r-dotted": "path = '$.\"a.b\"'",
}


def _maskable(spark, sf):
    return R.maskable_gate(gw_bodies(spark, sf)).where(F.col("maskable")).select("body_id", "role", "body")


def _nodes(spark, sf):
    return materialize(json_nodes(_maskable(spark, sf), ["body_id", "role"], "body"))


_MASKABLE_SQL = "select body_id, role, body from gw_bodies where contains(lower(content_type), 'json') and json_valid(body)"


def _ctes():
    keys = ["body_id", "role"]
    return [("mb", _MASKABLE_SQL), ("nd", sql_nodes("mb", keys, "body")), ("lv", sql_leaves("mb", keys, "body"))]


@register("j1_json_leaves", with_views("select body_id, path, value_type, value from lv", "gw_bodies", extra=_ctes()))
def j1_json_leaves(spark, sf):
    return json_leaves(_maskable(spark, sf), ["body_id"], "body").select("body_id", "path", "value_type", "value")


@register(
    "j2_jsonpath_find",
    with_views(
        " union all ".join(f"select body_id, path, '{i}' as rule_id from nd where {cond}" for i, cond in FIND_SQL.items()),
        "gw_bodies",
        extra=_ctes(),
    ),
)
def j2_jsonpath_find(spark, sf):
    hits = F.filter(F.array(*[F.when(F.col("path").rlike(J.jsonpath_regex(r["path"])), F.lit(r["id"])) for r in FIND]), lambda h: h.isNotNull())
    nodes = json_nodes(_maskable(spark, sf), ["body_id"], "body")
    return nodes.select("body_id", "path", F.explode(hits).alias("rule_id"))


def _role_case(ft: str, default: str) -> str:
    whens = " ".join(f"when '{r}' then '{o.get(ft, d or default)}'" for r, (d, o) in DEFAULT_POLICIES.items())
    return f"case lower(coalesce(role, '')) {whens} else 'redact' end"


def _j3_sql() -> str:
    """The rules one after another: the second pan rule works on what the first left."""

    def facts(step: int, source: str, value: str) -> str:
        r = RULES[step]
        new = "'[REDACTED]'" if r["id"] == "r-extra" else S.sql_apply("value", "strategy")
        return f"""select body_id, role, path, value_type, rule_id, field_type, strategy, step, {new} as new_value, 'explicit_rule' as source from (
 select body_id, role, path, value_type, {value} as value, '{r["id"]}' as rule_id, '{r["field_type"]}' as field_type, {_role_case(r["field_type"], r["strategy"])} as strategy, {step} as step
 from {source} where value is not null and {FIND_SQL[r["id"]]}) where strategy <> 'full'"""

    return f"""with pan as ({facts(1, "nd", "value")}), left_over as (select nd.*, pan.new_value from nd left join pan using (body_id, path))
 {facts(0, "nd", "value")} union all select * from pan union all {facts(2, "left_over", "coalesce(new_value, value)")} union all {facts(3, "nd", "value")}"""


_HIDDEN_SQL = f"(starts_with(path, '$.extra.') and {_role_case('secret', 'redact')} <> 'full')"


def _explicit(spark, sf, nodes=None):
    return J.explicit_masking(_nodes(spark, sf) if nodes is None else nodes, RULES)


_J3_COLS = ["body_id", "path", "rule_id", "field_type", "strategy", "step", "new_value"]


@register("j3_explicit_masking", with_views(f"select {', '.join(_J3_COLS)} from j3", "gw_bodies", extra=_ctes() + [("j3", _j3_sql())]))
def j3_explicit_masking(spark, sf):
    return _explicit(spark, sf).select(*_J3_COLS)


def _j4_sql() -> str:
    fams = PF.AUTO_DETECT_DEFAULT
    first = "coalesce(" + ", ".join(f"({PF.sql_scan('value', [f])})[1]" for f in fams) + ")"
    fts = sorted({PF.resolve([f])[0].field_type for f in fams})
    strat = "case " + " ".join(
        f"when m.field_type = '{ft}' then (case when {_role_case(ft, 'mask')} = 'mask' then '{J.MASK_BY_TYPE.get(ft, 'redact')}' else {_role_case(ft, 'mask')} end)" for ft in fts
    ) + " end"
    return f"""select body_id, role, path, value, m.field_type as field_type, m.pii_type as pii_type, {strat} as strategy from (
 select *, {first} as m from lv where value_type = 'string' and not {_HIDDEN_SQL} and not exists (select 1 from j3 where j3.body_id = lv.body_id and j3.path = lv.path)) where m is not null"""


def _auto(spark, sf, nodes=None, j3=None):
    nodes = _nodes(spark, sf) if nodes is None else nodes
    j3 = _explicit(spark, sf, nodes) if j3 is None else j3
    return J.auto_masking(nodes, j3, rules=RULES)


def _facts(spark, sf, nodes=None):
    nodes = _nodes(spark, sf) if nodes is None else nodes
    j3 = _explicit(spark, sf, nodes)
    return J.masked_facts(j3, _auto(spark, sf, nodes, j3))


_J4_OUT = f"select body_id, path, 'auto:' || pii_type as rule_id, field_type, strategy, {S.sql_apply('value', 'strategy')} as new_value, 'auto_detect' as source, 0 as step from j4a where strategy <> 'full'"


@register(
    "j4_auto_masking",
    with_views(f"select body_id, path, rule_id, field_type, strategy, new_value from ({_J4_OUT})", "gw_bodies", extra=_ctes() + [("j3", _j3_sql()), ("j4a", _j4_sql())]),
)
def j4_auto_masking(spark, sf):
    return _auto(spark, sf).select("body_id", "path", "rule_id", "field_type", "strategy", "new_value")


_FACTS_SQL = "select body_id, path, rule_id, field_type, strategy, new_value, source, step from j3 union all " + _J4_OUT


@register(
    "j10_masking_counters",
    with_views(
        "select f.field_type, f.strategy, b.role, count(*) as applied from facts f join mb b on f.body_id = b.body_id group by all",
        "gw_bodies",
        extra=_ctes() + [("j3", _j3_sql()), ("j4a", _j4_sql()), ("facts", _FACTS_SQL)],
    ),
)
def j10_masking_counters(spark, sf):
    return J.masking_counters(_facts(spark, sf), _maskable(spark, sf))


_J5_SQL = f"""select body_id, role, path, value, coalesce(sum(length(value) + 1) over (partition by body_id order by path rows between unbounded preceding and 1 preceding), 0) as part_start
 from lv where value_type = 'string' and length(value) >= 3 and not {_HIDDEN_SQL} and not exists (select 1 from facts f where f.body_id = lv.body_id and f.path = lv.path)"""


def _candidates(spark, sf):
    nodes = _nodes(spark, sf)
    return nodes, materialize(J.ner_candidates(nodes, _facts(spark, sf, nodes), rules=RULES))


@register(
    "j5_ner_candidates",
    with_views(
        "select body_id, path, part_start, part_start + length(value) as part_end from j5",
        "gw_bodies",
        extra=_ctes() + [("j3", _j3_sql()), ("j4a", _j4_sql()), ("facts", _FACTS_SQL), ("j5", _J5_SQL)],
    ),
)
def j5_ner_candidates(spark, sf):
    _, c = _candidates(spark, sf)
    return c.select("body_id", "path", F.col("part_start").cast("bigint").alias("part_start"), F.col("part_end").cast("bigint").alias("part_end"))


def _entities(c):
    """Detector output fixture derived from the candidates: a PERSON span on
    every name, a span straddling into the next part, a low-confidence one."""
    name = c.where(F.col("path") == "$.user.name")
    person = name.select("body_id", F.col("part_start").cast("int").alias("start"), (F.col("part_start") + F.length("value")).cast("int").alias("end"), F.lit("PERSON").alias("entity_type"), F.lit(0.9).alias("confidence"))
    straddle = name.select("body_id", (F.col("part_start") + F.length("value") - 1).cast("int").alias("start"), (F.col("part_start") + F.length("value") + 2).cast("int").alias("end"), F.lit("LOCATION").alias("entity_type"), F.lit(0.95).alias("confidence"))
    weak = c.where(F.col("path").endswith(".note")).select("body_id", F.col("part_start").cast("int").alias("start"), (F.col("part_start") + 2).cast("int").alias("end"), F.lit("ORGANIZATION").alias("entity_type"), F.lit(0.5).alias("confidence"))
    return person.unionByName(straddle).unionByName(weak)


_ENT_SQL = """select body_id, part_start as start, part_start + length(value) as "end", 'PERSON' as entity_type, 0.9 as confidence from j5 where path = '$.user.name'
 union all select body_id, part_start + length(value) - 1, part_start + length(value) + 2, 'LOCATION', 0.95 from j5 where path = '$.user.name'
 union all select body_id, part_start, part_start + 2, 'ORGANIZATION', 0.5 from j5 where suffix(path, '.note')"""

_J6_SQL = """select e.body_id, p.path, e.start, e."end", e.entity_type, e.confidence
 from (select * from ents where "end" > start and confidence >= 0.7) e
 asof join (select body_id, path, part_start, part_start + length(value) as part_end from j5) p on e.body_id = p.body_id and e.start >= p.part_start
 where e."end" <= p.part_end"""


@register(
    "j6_j7_ner_masking",
    with_views(
        f"""select body_id, path, entity_type, rule_id, strategy, {S.sql_apply('value', 'strategy')} as new_value from (
 select a.body_id, a.path, entity_type, 'ner:' || entity_type as rule_id, value, {_role_case('PERSON', 'redact')} as strategy from (
 select *, row_number() over (partition by body_id, path order by confidence desc, start) as rn from ({_J6_SQL})) a join j5 on a.body_id = j5.body_id and a.path = j5.path where rn = 1) where strategy <> 'full'""",
        "gw_bodies",
        extra=_ctes() + [("j3", _j3_sql()), ("j4a", _j4_sql()), ("facts", _FACTS_SQL), ("j5", _J5_SQL), ("ents", _ENT_SQL)],
    ),
)
def j6_j7_ner_masking(spark, sf):
    lv, c = _candidates(spark, sf)
    assigned = J.assign_entities(c, _entities(c))
    m = J.ner_masking(assigned, lv)
    return m.select("body_id", "path", "entity_type", "rule_id", "strategy", "new_value")


@register(
    "j8_ner_fail_closed",
    with_views(
        "select body_id, path, 'redact' as strategy from j5 where body_id % 7 = 0",
        "gw_bodies",
        extra=_ctes() + [("j3", _j3_sql()), ("j4a", _j4_sql()), ("facts", _FACTS_SQL), ("j5", _J5_SQL)],
    ),
)
def j8_ner_fail_closed(spark, sf):
    _, c = _candidates(spark, sf)
    detected = c.where(F.col("body_id") % 7 != 0).select("body_id")
    return J.ner_fail_closed(c, detected, "closed").select("body_id", "path", "strategy")


def _j9_sql() -> str:
    """The body template again, each place filled from the last fact of its path."""

    def at(path: str, raw: str) -> str:
        return f"coalesce(to_json(u['{path}']), {raw})"

    def text(path: str, raw: str) -> str:
        return at(path, f"to_json({raw})")

    parts = [
        """'{"id":' || cast(body_id as varchar) || ',"user":{"name":' """, """to_json('N' || cast(body_id as varchar))""", """',"email":'""", text("$.user.email", "email"), """',"phone":'""", text("$.user.phone", "phone"),
        """'},"items":[{"pan":'""", text("$.items[0].pan", "pan"), """',"note":'""", text("$.items[0].note", "'call ' || phone"),
        """'},{"pan":null,"note":'""", text("$.items[1].note", "'ip ' || ip"), """'}],"tc":'""", text("$.tc", "national_id"),
        """',"amt":1.10,"e":1e2,"z":1.0,"a.b":'""", text('$."a.b"', "email"),
        """',"extra":'""", at("$.extra", "'{\"owner\":' || " + text("$.extra.owner", "email") + " || ',\"tags\":[]}'"),
        """',"deep":' || repeat('{"l":', case when body_id % 3 = 0 then 9 else 1 end)""",
        f"case when body_id % 3 = 0 then {text('$.deep' + '.l' * 9, 'email')} else {text('$.deep.l', 'email')} end",
        "repeat('}', case when body_id % 3 = 0 then 10 else 2 end)",
    ]
    return f"""select body_id, role, {" || ".join(parts)} as masked_body from (
 select mb.body_id, mb.role, email, phone, pan, ip, national_id, coalesce(u, map([], [])) as u from mb join gw_customers c on c.cust_id = mb.body_id
 left join (select body_id, map(list(path), list(new_value)) as u from (select body_id, path, arg_max(new_value, step) as new_value from facts group by all) group by all) f on f.body_id = mb.body_id)"""


@register("j9_rewrite_bodies", with_views(_j9_sql(), "gw_bodies", extra=_ctes() + [("j3", _j3_sql()), ("j4a", _j4_sql()), ("facts", _FACTS_SQL)]))
def j9_rewrite_bodies(spark, sf):
    _, _, out = J.mask_bodies(_maskable(spark, sf), RULES)
    return out.select("body_id", "role", "masked_body")


@register(
    "j12_j13_entity_merge_and_regex_missed",
    with_views(
        f"""select entity_type as field_type, count(*) as missed_by_regex from (
 select body_id, entity_type, row_number() over (partition by body_id, path order by confidence desc, start) as rn from (
  {_J6_SQL.replace("from ents", "from merged")})) join mb using (body_id) where rn = 1 and {_role_case('PERSON', 'redact')} <> 'full' group by entity_type""",
        "gw_bodies",
        extra=_ctes()
        + [("j3", _j3_sql()), ("j4a", _j4_sql()), ("facts", _FACTS_SQL), ("j5", _J5_SQL), ("ents", _ENT_SQL),
           ("ents_both", "select * from ents union all select body_id, start, \"end\", entity_type, confidence - 0.05 from ents"),
           ("merged", "select body_id, start, \"end\", entity_type, confidence from (select *, row_number() over (partition by body_id, start, \"end\", entity_type order by confidence desc) as rn from ents_both where confidence >= 0.7) where rn = 1")],
    ),
)
def j12_j13_entity_merge_and_regex_missed(spark, sf):
    lv, c = _candidates(spark, sf)
    e1 = _entities(c)
    e2 = e1.withColumn("confidence", F.col("confidence") - 0.05)
    merged = J.merge_entities(e1, e2)
    ner = J.ner_masking(J.assign_entities(c, merged), lv)
    return J.regex_missed(ner, _facts(spark, sf, lv))


# ---------------------------------------------------------------- T6 masking_audit from MASK_APPLIED events


def _mask_events(spark, sf):
    """MASK_APPLIED audit events: one per body, field details in metadata."""
    facts = _facts(spark, sf)
    b = _maskable(spark, sf)
    per = facts.groupBy("body_id").agg(
        F.collect_list(F.struct("path", "strategy", "rule_id", F.col("field_type").alias("pii_type"), "source")).alias("field_details")
    )
    ev = per.join(b.select("body_id", "role"), "body_id")
    return ev.select(
        F.concat(F.lit("team-"), (F.col("body_id") % 20).cast("string")).alias("consumer_id"),
        F.lit("route-mask").alias("route_id"),
        F.lit("MASK_APPLIED").alias("event_type"),
        F.col("body_id").cast("string").alias("request_id"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("body_id").cast("decimal(18,6)"))).alias("timestamp"),
        F.to_json(F.struct("role", "field_details")).alias("metadata"),
    )


@register(
    "t6_masking_audit_from_events",
    with_views(
        """select 'team-' || cast(f.body_id % 20 as varchar) as consumer_id, coalesce(b.role, 'unknown') as consumer_role, cast(f.body_id as varchar) as request_id,
 f.path as field_path, f.strategy as mask_strategy, f.rule_id, f.field_type as pii_type, f.source from facts f join mb b on f.body_id = b.body_id""",
        "gw_bodies",
        extra=_ctes() + [("j3", _j3_sql()), ("j4a", _j4_sql()), ("facts", _FACTS_SQL)],
    ),
)
def t6_masking_audit_from_events(spark, sf):
    from gatewise.sources import sinks as T

    m = T.masking_audit_from_events(_mask_events(spark, sf))
    return m.select("consumer_id", "consumer_role", "request_id", "field_path", "mask_strategy", "rule_id", "pii_type", "source")


# ---------------------------------------------------------------- J11 entity detection with a user detector


def capitalized_token_detector(pdf):
    """Example detector: capitalised tokens are PERSON candidates (0.8)."""
    import re as _re

    import pandas as _pd

    rows = []
    for bid, val, start in zip(pdf["body_id"], pdf["value"], pdf["part_start"]):
        for m in _re.finditer(r"\b[A-Z][A-Za-z0-9]+\b", val or ""):
            rows.append((int(bid), int(start + m.start()), int(start + m.end()), "PERSON", 0.8))
    return _pd.DataFrame(rows, columns=["body_id", "start", "end", "entity_type", "confidence"])


@register("j11_detect_entities")
def j11_detect_entities(spark, sf):
    lv, c = _candidates(spark, sf)
    ents = J.detect_entities(c, capitalized_token_detector)
    return J.assign_entities(c, ents)


# ---------------------------------------------------------------- A8 privacy panels


@register(
    "a8_masking_rate_panel",
    with_views(
        """select time_bucket(interval '1 minute', timestamp '2024-01-01 00:00:00' + to_seconds(body_id)) - to_minutes(k) + interval '5 minutes' as ts,
 field_type, strategy, count(*) / 300.0 as rate from facts, range(0, 5) t(k) group by all""",
        "gw_bodies",
        extra=_ctes() + [("j3", _j3_sql()), ("j4a", _j4_sql()), ("facts", _FACTS_SQL)],
    ),
)
def a8_masking_rate_panel(spark, sf):
    from gatewise.operators import metrics as A

    facts = _facts(spark, sf)
    facts = facts.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("body_id").cast("decimal(18,6)")))
    return A.rate(facts, "ts", ["field_type", "strategy"]).select("ts", "field_type", "strategy", "rate")


@register(
    "a8_violations_and_skips_panel",
    with_views(
        """select 'violations' as panel, pii_type as label, count(*) as n from (select pii_type from j4a where strategy <> 'full') group by all
 union all select 'large_body_skips', skip_reason, count(*) from (select case when not contains(lower(coalesce(content_type, '')), 'json') then 'not_json_content_type'
  when octet_length(encode(body)) > 10485760 then 'body_too_large' when not json_valid(body) then 'invalid_json' end as skip_reason from gw_bodies) where skip_reason is not null group by all""",
        "gw_bodies",
        extra=_ctes() + [("j3", _j3_sql()), ("j4a", _j4_sql())],
    ),
)
def a8_violations_and_skips_panel(spark, sf):
    v = _auto(spark, sf).groupBy(F.col("pii_type").alias("label")).agg(F.count(F.lit(1)).alias("n")).withColumn("panel", F.lit("violations"))
    g = R.maskable_gate(gw_bodies(spark, sf)).where(F.col("skip_reason").isNotNull())
    k = g.groupBy(F.col("skip_reason").alias("label")).agg(F.count(F.lit(1)).alias("n")).withColumn("panel", F.lit("large_body_skips"))
    return v.unionByName(k).select("panel", "label", "n")
