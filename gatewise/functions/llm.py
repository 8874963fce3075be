"""Provider payload expressions (U1-U4, U6): Column functions over JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Finish reason and error type maps.
ANTHROPIC_STOP_MAP = {"end_turn": "stop", "max_tokens": "length", "stop_sequence": "stop", "tool_use": "tool_calls"}
GOOGLE_FINISH_MAP = {"STOP": "stop", "MAX_TOKENS": "length", "SAFETY": "content_filter", "RECITATION": "content_filter"}
ANTHROPIC_ERROR_MAP = {
    "overloaded_error": "server_error",
    "rate_limit_error": "rate_limit",
    "authentication_error": "authentication_error",
    "invalid_request_error": "invalid_request_error",
    "not_found_error": "not_found_error",
}
GOOGLE_ERROR_CODE_MAP = {429: "rate_limit", 400: "invalid_request_error", 403: "authentication_error"}
ANTHROPIC_DEFAULT_MAX_TOKENS = 4096


def _map(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def _get(v: Column, path: str, t: str = "string") -> Column:
    return F.try_variant_get(v, path, t)


def extract_usage(body: Column) -> Column:
    """struct(prompt_tokens, completion_tokens, total_tokens) or NULL."""
    v = F.try_parse_json(body)
    has_usage = _get(v, "$.usage", "variant").isNotNull()
    has_meta = _get(v, "$.usageMetadata", "variant").isNotNull()
    p = F.coalesce(_get(v, "$.usage.prompt_tokens", "bigint"), _get(v, "$.usage.input_tokens", "bigint"), F.lit(0).cast("bigint"))
    c = F.coalesce(_get(v, "$.usage.completion_tokens", "bigint"), _get(v, "$.usage.output_tokens", "bigint"), F.lit(0).cast("bigint"))
    t = F.coalesce(_get(v, "$.usage.total_tokens", "bigint"), p + c)
    gp = F.coalesce(_get(v, "$.usageMetadata.promptTokenCount", "bigint"), F.lit(0).cast("bigint"))
    gc = F.coalesce(_get(v, "$.usageMetadata.candidatesTokenCount", "bigint"), F.lit(0).cast("bigint"))
    gt = F.coalesce(_get(v, "$.usageMetadata.totalTokenCount", "bigint"), F.lit(0).cast("bigint"))

    def st(a, b, cc):
        return F.struct(a.alias("prompt_tokens"), b.alias("completion_tokens"), cc.alias("total_tokens"))

    return F.when(has_usage, st(p, c, t)).when(has_meta, st(gp, gc, gt))


def normalize_response(provider: Column, body: Column) -> Column:
    """U2 (+U3 on error bodies): one chat-completion struct for every provider."""
    v = F.try_parse_json(body)
    is_anthropic = provider.startswith("anthropic")
    is_google = provider == "google"
    # content
    a_blocks = _get(v, "$.content", "array<struct<type:string,text:string>>")
    a_text = F.array_join(F.transform(F.filter(a_blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "")
    g_parts = _get(v, "$.candidates[0].content.parts", "array<struct<text:string>>")
    g_text = F.array_join(F.transform(F.filter(g_parts, lambda b: b["text"].isNotNull()), lambda b: b["text"]), "")
    o_text = _get(v, "$.choices[0].message.content")
    a_err = is_anthropic & (_get(v, "$.type") == "error")
    g_err = is_google & _get(v, "$.error", "variant").isNotNull()
    is_err = a_err | g_err
    content = F.when(is_err, F.lit(None)).when(is_anthropic, F.coalesce(a_text, F.lit(""))).when(is_google, F.coalesce(g_text, F.lit(""))).otherwise(o_text)
    finish = (
        F.when(is_err, F.lit(None))
        .when(is_anthropic, F.coalesce(_map(ANTHROPIC_STOP_MAP)[_get(v, "$.stop_reason")], F.lit("stop")))
        .when(is_google, F.coalesce(_map(GOOGLE_FINISH_MAP)[_get(v, "$.candidates[0].finishReason")], F.lit("stop")))
        .otherwise(_get(v, "$.choices[0].finish_reason"))
    )
    a_in = F.coalesce(_get(v, "$.usage.input_tokens", "bigint"), F.lit(0).cast("bigint"))
    a_out = F.coalesce(_get(v, "$.usage.output_tokens", "bigint"), F.lit(0).cast("bigint"))
    g_in = F.coalesce(_get(v, "$.usageMetadata.promptTokenCount", "bigint"), F.lit(0).cast("bigint"))
    g_out = F.coalesce(_get(v, "$.usageMetadata.candidatesTokenCount", "bigint"), F.lit(0).cast("bigint"))
    o_in, o_out = _get(v, "$.usage.prompt_tokens", "bigint"), _get(v, "$.usage.completion_tokens", "bigint")
    pin = F.when(is_err, F.lit(None)).when(is_anthropic, a_in).when(is_google, g_in).otherwise(o_in)
    pout = F.when(is_err, F.lit(None)).when(is_anthropic, a_out).when(is_google, g_out).otherwise(o_out)
    err = normalize_error(provider, body)
    return F.struct(
        F.when(is_err, F.lit(None)).when(is_google, F.lit(None)).otherwise(_get(v, "$.id")).alias("id"),
        F.when(is_err | is_google, F.lit(None)).otherwise(_get(v, "$.model")).alias("model"),
        content.alias("content"),
        finish.alias("finish_reason"),
        pin.cast("bigint").alias("prompt_tokens"),
        pout.cast("bigint").alias("completion_tokens"),
        (pin + pout).cast("bigint").alias("total_tokens"),
        is_err.alias("is_error"),
        F.when(is_err, err["type"]).alias("error_type"),
        F.when(is_err, err["code"]).alias("error_code"),
        F.when(is_err, err["message"]).alias("error_message"),
    )


def normalize_error(provider: Column, body: Column) -> Column:
    """{type, code, message} for Anthropic and Google error bodies."""
    v = F.try_parse_json(body)
    a_type = F.coalesce(_get(v, "$.error.type"), F.lit("unknown"))
    a = F.struct(
        F.coalesce(_map(ANTHROPIC_ERROR_MAP)[a_type], F.lit("server_error")).alias("type"),
        a_type.alias("code"),
        F.coalesce(_get(v, "$.error.message"), F.lit("Unknown Anthropic error")).alias("message"),
    )
    g_code = _get(v, "$.error.code", "bigint")
    g = F.struct(
        F.coalesce(_map(GOOGLE_ERROR_CODE_MAP)[g_code], F.lit("server_error")).alias("type"),
        F.coalesce(g_code.cast("string"), F.lit("unknown")).alias("code"),
        F.coalesce(_get(v, "$.error.message"), F.lit("Google API error")).alias("message"),
    )
    return F.when(provider == "google", g).otherwise(a)


def approx_tokens(text: Column) -> Column:
    """ceil(words x 1.3)."""
    return F.ceil(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")) * F.lit(1.3)).cast("bigint")


MSG = "array<struct<role:string,content:string>>"


def normalize_request(provider: Column, body: Column) -> Column:
    """U4: request reshaped for the target provider, as a struct."""
    v = F.try_parse_json(body)
    msgs = _get(v, "$.messages", MSG)
    system_msgs = F.filter(msgs, lambda m: m["role"] == "system")
    others = F.filter(msgs, lambda m: m["role"] != "system")
    a_system = F.when(F.size(system_msgs) > 0, F.array_join(F.transform(system_msgs, lambda m: m["content"]), "\n"))
    g_system = F.try_element_at(system_msgs, F.lit(-1))["content"]
    g_msgs = F.transform(others, lambda m: F.struct(F.when(m["role"] == "assistant", "model").otherwise("user").alias("role"), m["content"].alias("content")))
    max_tokens = _get(v, "$.max_tokens", "bigint")
    is_a, is_g, is_az = provider == "anthropic", provider == "google", provider == "azure"
    return F.struct(
        F.when(is_az | is_g, F.lit(None)).otherwise(_get(v, "$.model")).alias("model"),
        F.when(is_a, a_system).when(is_g, g_system).alias("system"),
        F.when(is_a, others).when(is_g, g_msgs).otherwise(msgs).alias("messages"),
        F.when(is_a, F.coalesce(max_tokens, F.lit(ANTHROPIC_DEFAULT_MAX_TOKENS).cast("bigint"))).otherwise(max_tokens).alias("max_tokens"),
    )
