"""Registered queries: personal data and prompt security."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewise.functions import pii as PF
from gatewise.operators import pii as P
from gatewise.plans.catalog import register
from gatewise.plans.oracle_views import with_views
from gatewise.sources import gw_customers, gw_prompts, read_table

CUSTOMER_TEXT_COLS = ["email", "phone", "pan", "national_id", "iban", "imei", "ip", "dob"]


def _customer_text(spark, sf):
    c = gw_customers(spark, sf)
    return c.select("cust_id", F.concat_ws(" ", *[F.col(x) for x in CUSTOMER_TEXT_COLS]).alias("text"))


_CUST_TEXT_SQL = "select cust_id, concat_ws(' ', " + ", ".join(CUSTOMER_TEXT_COLS) + ") as text from gw_customers"

_MATCH_COLS = "m.pii_type as pii_type, m.field_type as field_type, m.value as value, m.classification as classification, m.placeholder as placeholder"


@register(
    "p1_pii_scan_documents",
    f"select doc_id, {_MATCH_COLS} from (select doc_id, unnest({PF.sql_scan('text')}) as m from documents)",
    bench=True,
)
def p1_pii_scan_documents(spark, sf):
    return P.pii_scan(read_table(spark, sf, "documents"), "text", ["doc_id"])


@register(
    "p1_pii_scan_customers",
    with_views(
        f"select cust_id, {_MATCH_COLS} from (select cust_id, unnest({PF.sql_scan('text')}) as m from ct)",
        "gw_customers",
        extra=[("ct", _CUST_TEXT_SQL)],
    ),
)
def p1_pii_scan_customers(spark, sf):
    return P.pii_scan(_customer_text(spark, sf), "text", ["cust_id"])


WL = ["admin@internal.com", "10.0.0.1"]


@register(
    "p1_pii_scan_pages_whitelist",
    f"select page_id, {_MATCH_COLS} from (select page_id, unnest({PF.sql_scan('html', ['email', 'ip_address', 'pan'], WL)}) as m from pages)",
)
def p1_pii_scan_pages_whitelist(spark, sf):
    return P.pii_scan(read_table(spark, sf, "pages"), "html", ["page_id"], ["email", "ip_address", "pan"], WL)


@register(
    "p2_pii_mask_documents",
    f"select doc_id, {PF.sql_mask_text('text', 'm')} as masked_text, len(m) as match_count from (select doc_id, text, {PF.sql_scan('text')} as m from documents)",
    bench=True,
)
def p2_pii_mask_documents(spark, sf):
    d = P.pii_mask(read_table(spark, sf, "documents"), "text")
    return d.select("doc_id", "masked_text", F.col("match_count").cast("bigint").alias("match_count"))


@register(
    "p3_pii_contains_documents",
    f"select doc_id, len(m) > 0 as has_pii, m[1].pii_type as first_type, m[1].value as first_value from (select doc_id, {PF.sql_scan('text')} as m from documents)",
)
def p3_pii_contains_documents(spark, sf):
    d = P.pii_contains(read_table(spark, sf, "documents"), "text")
    return d.select("doc_id", "has_pii", F.col("first_match.pii_type").alias("first_type"), F.col("first_match.value").alias("first_value"))


@register(
    "p4_pii_profile_documents",
    f"""select m.pii_type as pii_type, count(distinct doc_id) as docs_hit, count(*) as matches, count(distinct m.value) as distinct_values,
 count(distinct doc_id) / (select count(*) from documents) as doc_share
 from (select doc_id, unnest({PF.sql_scan('text')}) as m from documents) group by m.pii_type""",
)
def p4_pii_profile_documents(spark, sf):
    docs = read_table(spark, sf, "documents")
    return P.pii_profile(P.pii_scan(docs, "text", ["doc_id"]), docs, "doc_id")


# Fixed parameters of the prompt queries.
PII_ACTIONS = {"pan": "block", "tc_kimlik": "block", "email": "mask", "msisdn": "mask", "iban": "warn", "ip_address": "warn"}
WHITELIST_CONSUMERS = ["team-3"]


def _pii_action_sql(src: str = "gw_prompts") -> str:
    fams = list(PII_ACTIONS)
    rank = {"warn": 1, "mask": 2, "block": 3}
    rank_case = "case " + " ".join(f"when s.pii_type = '{PF.resolve([f])[0].name}' then {rank[a]}" for f, a in PII_ACTIONS.items()) + " end"
    wl = ",".join(f"'{w}'" for w in WHITELIST_CONSUMERS)
    return f"""select *, case when len(m) = 0 then 'none' when consumer_id in ({wl}) then 'bypass'
 when list_max(list_transform(m, lambda s: {rank_case})) = 3 then 'block'
 when list_max(list_transform(m, lambda s: {rank_case})) = 2 then 'mask' else 'warn' end as pii_action
 from (select *, {PF.sql_scan('text', fams)} as m from {src})"""


@register(
    "p5_prompt_pii_action",
    with_views(
        f"""select conv_id, turn, pii_action, array_to_string(list_sort(list_distinct(list_transform(m, lambda s: s.pii_type))), ',') as pii_types,
 case when pii_action = 'mask' then {PF.sql_mask_text('text', 'm')} when pii_action = 'block' then null else text end as prompt_out from pa""",
        "gw_prompts",
        extra=[("pa", _pii_action_sql())],
    ),
)
def p5_prompt_pii_action(spark, sf):
    d = P.prompt_pii_action(gw_prompts(spark, sf), PII_ACTIONS, WHITELIST_CONSUMERS)
    return d.select("conv_id", "turn", "pii_action", F.array_join("pii_types", ",").alias("pii_types"), "prompt_out")


def _inj_sql(src: str = "gw_prompts") -> str:
    case = " ".join(f"when regexp_matches(text, '{rx}') then '{n}'" for n, c, rx in P.INJECTION_RULES)
    conf = " ".join(f"when regexp_matches(text, '{rx}') then '{c}'" for n, c, rx in P.INJECTION_RULES)
    hi = "(?i)(" + P.HIGH_RX + ")"
    enc = f"(regexp_matches(translate(text, '{P.HOMOGLYPHS_FROM}', '{P.HOMOGLYPHS_TO}'), '{hi}') and translate(text, '{P.HOMOGLYPHS_FROM}', '{P.HOMOGLYPHS_TO}') <> text)"
    wl = ",".join(f"'{w}'" for w in WHITELIST_CONSUMERS)
    return f"""select *, case {case} when {enc} then 'encoding_bypass' end as injection_category,
 case {conf} when {enc} then 'MEDIUM' end as injection_confidence from {src}"""


_INJ_ACTION = f"""case when injection_category is null then 'allow' when consumer_id in ({",".join(f"'{w}'" for w in WHITELIST_CONSUMERS)}) then 'allow_whitelisted'
 when injection_confidence = 'HIGH' then 'block' else 'confirm' end"""


@register(
    "p6_injection_scan",
    with_views(
        f"select conv_id, turn, injection_category, injection_confidence, {_INJ_ACTION} as injection_action from inj",
        "gw_prompts",
        extra=[("inj", _inj_sql())],
    ),
)
def p6_injection_scan(spark, sf):
    d = P.injection_scan(gw_prompts(spark, sf), whitelist_consumers=WHITELIST_CONSUMERS)
    return d.select("conv_id", "turn", "injection_category", "injection_confidence", "injection_action")


@register(
    "p7_injection_similarity",
    """with q as (select vec_id, embedding::double[] as e from embeddings where label <> 0),
 c as (select vec_id as match_id, label as match_category, embedding::double[] as e from embeddings where label = 0),
 s as (select q.vec_id, c.match_id, c.match_category, list_cosine_similarity(q.e, c.e) as sim from q, c),
 b as (select vec_id, arg_max(match_id, sim * 1e9 - match_id * 1e-9) as match_id, max(sim) as sim from s group by vec_id)
 select b.vec_id, b.match_id, c.match_category, round(b.sim, 4) as confidence, b.sim >= 0.9 as is_injection,
  case when b.sim >= 0.9 then 'block' else 'allow' end as recommendation from b join c on b.match_id = c.match_id""",
)
def p7_injection_similarity(spark, sf):
    e = read_table(spark, sf, "embeddings")
    return P.injection_similarity(e.where(F.col("label") != 0), e.where(F.col("label") == 0), threshold=0.9).select(
        "vec_id", "match_id", "match_category", "confidence", "is_injection", "recommendation"
    )


def _sql_words(c: str) -> str:
    return f"regexp_split_to_array(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '\\s+')"


def _sql_shingles(w: str) -> str:
    return (
        f"case when len({w}) >= 8 then list_transform(range(1, len({w}) - 8 + 2), lambda i: array_to_string({w}[i:i+7], ' ')) "
        f"else [array_to_string({w}, ' ')] end"
    )


@register(
    "p8_exfiltration_scan",
    f"""with sp as (select conv_id, string_agg(text, chr(10) order by turn) as system_prompt from conversations where role = 'system' group by conv_id),
 a as (select c.conv_id, c.turn, c.text, sp.system_prompt from conversations c left join sp on c.conv_id = sp.conv_id where c.role = 'assistant'),
 s as (select *, list_distinct({_sql_shingles(_sql_words('system_prompt'))}) as ss, list_distinct({_sql_shingles(_sql_words('text'))}) as rs from a)
 select conv_id, turn, regexp_matches(text, '{P.LEAK_PATTERNS}') as leak_phrase, coalesce(strpos(text, system_prompt) > 0, false) as verbatim,
  round(case when system_prompt is null then 0.0 else len(list_filter(ss, lambda x: list_contains(rs, x))) / len(ss) end, 6) as containment,
  regexp_matches(text, '{P.LEAK_PATTERNS}') or coalesce(strpos(text, system_prompt) > 0, false)
   or round(case when system_prompt is null then 0.0 else len(list_filter(ss, lambda x: list_contains(rs, x))) / len(ss) end, 6) >= 0.5 as is_exfiltration
 from s""",
)
def p8_exfiltration_scan(spark, sf):
    return P.exfiltration_scan(read_table(spark, sf, "conversations"))


@register(
    "p9_audit_excerpt",
    with_views(
        f"select conv_id, turn, left({PF.sql_mask_text('text', PF.sql_scan('text'))}, 200) as payload_excerpt from gw_prompts",
        "gw_prompts",
    ),
)
def p9_audit_excerpt(spark, sf):
    return P.audit_excerpt(gw_prompts(spark, sf)).select("conv_id", "turn", "payload_excerpt")


@register(
    "p10_security_action",
    with_views(
        f"""select conv_id, turn,
 case when ia = 'block' then 'BLOCKED' when pii_action = 'block' then 'BLOCKED' when pii_action = 'mask' then 'MASKED'
  when ia = 'confirm' or pii_action = 'warn' then 'WARNED' else 'ALLOWED' end as action_taken,
 case when ia in ('block', 'confirm') then 'PROMPT_BLOCKED' when pii_action in ('block', 'mask', 'warn') then 'PII_DETECTED' end as event_type,
 case when ia = 'block' then 403 when pii_action = 'block' then 400 else 200 end as http_status
 from (select *, {_INJ_ACTION} as ia from inj)""",
        "gw_prompts",
        extra=[("pa", _pii_action_sql()), ("inj", _inj_sql("pa"))],
    ),
)
def p10_security_action(spark, sf):
    d = P.injection_scan(P.prompt_pii_action(gw_prompts(spark, sf), PII_ACTIONS, WHITELIST_CONSUMERS), whitelist_consumers=WHITELIST_CONSUMERS)
    return P.security_action(d).select("conv_id", "turn", "action_taken", "event_type", "http_status")
