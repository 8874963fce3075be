"""Registered queries: provider payloads and tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatewise.functions import llm as L
from gatewise.operators import llm as U
from gatewise.plans.catalog import register
from gatewise.plans.oracle_views import with_views
from gatewise.sources import gw_payloads, gw_request_bodies, gw_stream_chunks, read_table


def _jb(path: str) -> str:
    return f"try_cast(json_extract_string(body, '{path}') as bigint)"


_U1_SQL = f"""select event_id,
 case when json_extract(body, '$.usage') is not null then coalesce({_jb('$.usage.prompt_tokens')}, {_jb('$.usage.input_tokens')}, 0)
  when json_extract(body, '$.usageMetadata') is not null then coalesce({_jb('$.usageMetadata.promptTokenCount')}, 0) end as prompt_tokens,
 case when json_extract(body, '$.usage') is not null then coalesce({_jb('$.usage.completion_tokens')}, {_jb('$.usage.output_tokens')}, 0)
  when json_extract(body, '$.usageMetadata') is not null then coalesce({_jb('$.usageMetadata.candidatesTokenCount')}, 0) end as completion_tokens,
 case when json_extract(body, '$.usage') is not null then coalesce({_jb('$.usage.total_tokens')},
   coalesce({_jb('$.usage.prompt_tokens')}, {_jb('$.usage.input_tokens')}, 0) + coalesce({_jb('$.usage.completion_tokens')}, {_jb('$.usage.output_tokens')}, 0))
  when json_extract(body, '$.usageMetadata') is not null then coalesce({_jb('$.usageMetadata.totalTokenCount')}, 0) end as total_tokens
from gw_payloads"""


@register("u1_extract_usage", with_views(_U1_SQL, "gw_payloads"), bench=True)
def u1_extract_usage(spark, sf):
    return U.extract_usage(gw_payloads(spark, sf)).select("event_id", "prompt_tokens", "completion_tokens", "total_tokens")


def _case_map(expr: str, d: dict, default: str) -> str:
    return "coalesce(case " + expr + " " + " ".join(f"when '{k}' then '{v}'" for k, v in d.items()) + f" end, {default})"


_U2_SQL = f"""with p as (select event_id, provider, body, provider like 'anthropic%' as is_a, provider = 'google' as is_g,
  (provider like 'anthropic%' and json_extract_string(body, '$.type') = 'error') or (provider = 'google' and json_extract(body, '$.error') is not null) as is_err
  from gw_payloads),
 q as (select *,
  case when is_err then null when is_a then coalesce({_jb('$.usage.input_tokens')}, 0) when is_g then coalesce({_jb('$.usageMetadata.promptTokenCount')}, 0) else {_jb('$.usage.prompt_tokens')} end as pin,
  case when is_err then null when is_a then coalesce({_jb('$.usage.output_tokens')}, 0) when is_g then coalesce({_jb('$.usageMetadata.candidatesTokenCount')}, 0) else {_jb('$.usage.completion_tokens')} end as pout,
  coalesce(json_extract_string(body, '$.error.type'), 'unknown') as a_type from p)
select event_id,
 case when is_err or is_g then null else json_extract_string(body, '$.id') end as id,
 case when is_err or is_g then null else json_extract_string(body, '$.model') end as model,
 case when is_err then null
  when is_a then coalesce(array_to_string(list_transform(list_filter(json_extract(body, '$.content[*]'), lambda b: json_extract_string(b, '$.type') = 'text'), lambda b: json_extract_string(b, '$.text')), ''), '')
  when is_g then coalesce(array_to_string(list_transform(list_filter(json_extract(body, '$.candidates[0].content.parts[*]'), lambda b: json_extract_string(b, '$.text') is not null), lambda b: json_extract_string(b, '$.text')), ''), '')
  else json_extract_string(body, '$.choices[0].message.content') end as content,
 case when is_err then null when is_a then {_case_map("json_extract_string(body, '$.stop_reason')", L.ANTHROPIC_STOP_MAP, "'stop'")}
  when is_g then {_case_map("json_extract_string(body, '$.candidates[0].finishReason')", L.GOOGLE_FINISH_MAP, "'stop'")}
  else json_extract_string(body, '$.choices[0].finish_reason') end as finish_reason,
 pin as prompt_tokens, pout as completion_tokens, pin + pout as total_tokens, is_err as is_error,
 case when is_err and not is_g then {_case_map('a_type', L.ANTHROPIC_ERROR_MAP, "'server_error'")} end as error_type,
 case when is_err and not is_g then a_type end as error_code,
 case when is_err and not is_g then coalesce(json_extract_string(body, '$.error.message'), 'Unknown Anthropic error') end as error_message
from q"""

U2_COLS = ["event_id", "id", "model", "content", "finish_reason", "prompt_tokens", "completion_tokens", "total_tokens", "is_error", "error_type", "error_code", "error_message"]


@register("u2_u3_normalize_response", with_views(_U2_SQL, "gw_payloads"))
def u2_u3_normalize_response(spark, sf):
    return U.normalize_response(gw_payloads(spark, sf)).select(*U2_COLS)


_PROVIDER4 = "case conv_id % 4 when 0 then 'openai' when 1 then 'anthropic' when 2 then 'google' else 'azure' end"

_U4_SQL = f"""with b as (select conv_id, turn, {_PROVIDER4} as provider, body, json_extract(body, '$.messages[*]') as msgs
  from gw_request_bodies where json_valid(body) and json_type(body, '$.messages') = 'ARRAY'),
 c as (select *, list_filter(msgs, lambda m: json_extract_string(m, '$.role') = 'system') as sys,
  list_filter(msgs, lambda m: json_extract_string(m, '$.role') <> 'system') as oth from b)
select conv_id, turn, provider,
 case when provider in ('azure', 'google') then null else json_extract_string(body, '$.model') end as model,
 case when provider = 'anthropic' and len(sys) > 0 then array_to_string(list_transform(sys, lambda m: json_extract_string(m, '$.content')), chr(10))
  when provider = 'google' then json_extract_string(sys[-1], '$.content') end as system,
 array_to_string(case when provider = 'anthropic' then list_transform(oth, lambda m: json_extract_string(m, '$.role'))
  when provider = 'google' then list_transform(oth, lambda m: case when json_extract_string(m, '$.role') = 'assistant' then 'model' else 'user' end)
  else list_transform(msgs, lambda m: json_extract_string(m, '$.role')) end, ',') as roles,
 case when provider = 'anthropic' then coalesce({_jb('$.max_tokens')}, {L.ANTHROPIC_DEFAULT_MAX_TOKENS}) else {_jb('$.max_tokens')} end as max_tokens
from c"""


@register("u4_normalize_request", with_views(_U4_SQL, "gw_request_bodies"))
def u4_normalize_request(spark, sf):
    b = gw_request_bodies(spark, sf)
    k = F.col("conv_id") % 4
    prov = F.when(k == 0, "openai").when(k == 1, "anthropic").when(k == 2, "google").otherwise("azure")
    v = F.try_parse_json("body")
    b = b.where(F.try_variant_get(v, "$.messages", "array<variant>").isNotNull()).withColumn("provider", prov)
    d = U.normalize_request(b)
    return d.select("conv_id", "turn", "provider", "model", "system", F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"), "max_tokens")


_U5_SQL = """with c as (select stream_id, seq, regexp_extract(data, '^data: (.+)$', 1) as payload from gw_stream_chunks),
 d as (select stream_id, seq, trim(payload) = '[DONE]' as is_done,
  case when trim(payload) <> '[DONE]' then json_extract_string(payload, '$.choices[0].delta.content') end as delta,
  case when trim(payload) <> '[DONE]' then json_extract_string(payload, '$.choices[0].finish_reason') end as fin from c)
select stream_id, coalesce(string_agg(delta, '' order by seq) filter (where delta is not null), '') as content, count(*) as n_chunks,
 bool_or(is_done) as done, case when bool_or(is_done) then coalesce(arg_max(fin, seq) filter (where fin is not null), 'stop') end as finish_reason,
 not bool_or(is_done) as interrupted
from d group by stream_id"""


@register("u5_reassemble_stream", with_views(_U5_SQL, "gw_stream_chunks"), bench=True)
def u5_reassemble_stream(spark, sf):
    return U.reassemble_stream(gw_stream_chunks(spark, sf))


@register("u6_approx_tokens", "select doc_id, cast(ceil(len(regexp_extract_all(coalesce(text, ''), '\\S+')) * 1.3) as bigint) as approx_tokens from documents")
def u6_approx_tokens(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", L.approx_tokens(F.col("text")).alias("approx_tokens"))


@register(
    "u7_usage_or_estimate",
    with_views(
        f"""select event_id, coalesce(total_tokens, cast(ceil(len(regexp_extract_all(coalesce(content, ''), '\\S+')) * 1.3) as bigint)) as tokens,
 total_tokens is null as estimated from (select u1.event_id, u1.total_tokens, u2.content from ({_U1_SQL}) u1 join ({_U2_SQL.replace(chr(10), ' ')}) u2 on u1.event_id = u2.event_id)""",
        "gw_payloads",
    ),
)
def u7_usage_or_estimate(spark, sf):
    p = gw_payloads(spark, sf)
    d = p.select("event_id", L.extract_usage(F.col("body"))["total_tokens"].alias("total_tokens"), L.normalize_response(F.col("provider"), F.col("body"))["content"].alias("content"))
    return U.usage_or_estimate(d, "total_tokens", "content").select("event_id", "tokens", "estimated")


@register(
    "u8_conversation_token_report",
    """select conv_id, role, count(*) as messages, cast(sum(t) as bigint) as tokens, cast(sum(t) + count(*) * 3 as bigint) as tokens_with_overhead
 from (select conv_id, role, cast(ceil(len(regexp_extract_all(coalesce(text, ''), '\\S+')) * 1.3) as bigint) as t from conversations) group by conv_id, role""",
)
def u8_conversation_token_report(spark, sf):
    return U.conversation_token_report(read_table(spark, sf, "conversations"))
