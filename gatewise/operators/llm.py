"""LLM payload operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewise.functions import llm as L


def extract_usage(df: DataFrame, body_col: str = "body") -> DataFrame:
    """U1."""
    u = L.extract_usage(F.col(body_col))
    return df.withColumn("_u", u).select("*", F.col("_u.prompt_tokens").alias("prompt_tokens"), F.col("_u.completion_tokens").alias("completion_tokens"), F.col("_u.total_tokens").alias("total_tokens")).drop("_u")


def normalize_response(df: DataFrame, provider_col: str = "provider", body_col: str = "body") -> DataFrame:
    """U2 + U3: flatten every provider payload to one chat-completion shape."""
    return df.withColumn("_r", L.normalize_response(F.col(provider_col), F.col(body_col))).select("*", "_r.*").drop("_r")


def normalize_request(df: DataFrame, provider_col: str = "provider", body_col: str = "body") -> DataFrame:
    """U4."""
    return df.withColumn("_q", L.normalize_request(F.col(provider_col), F.col(body_col))).select("*", "_q.*").drop("_q")


def reassemble_stream(chunks: DataFrame, key: str = "stream_id", seq: str = "seq", data: str = "data") -> DataFrame:
    """Per stream, ordered text deltas joined; done flag, finish reason;
    streams without ``[DONE]`` are interrupted.

    One shuffle by stream id with partial aggregation; each group is one
    response (bounded by the provider's max output), ordered inside the
    aggregate by ``array_sort`` on (seq, text).
    """
    payload = F.regexp_extract(F.col(data), r"^data: (.+)$", 1)
    is_done = F.trim(payload) == "[DONE]"
    delta = F.when(~is_done, F.get_json_object(payload, "$.choices[0].delta.content"))
    finish = F.when(~is_done, F.get_json_object(payload, "$.choices[0].finish_reason"))
    c = chunks.select(key, seq, is_done.alias("_done"), delta.alias("_delta"), finish.alias("_finish"))
    g = c.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(F.col("_delta").isNotNull(), F.struct(F.col(seq).alias("s"), F.col("_delta").alias("t"))))).alias("_parts"),
        F.max(F.col("_done").cast("int")).alias("_d"),
        F.max_by(F.col("_finish"), F.when(F.col("_finish").isNotNull(), F.col(seq))).alias("_f"),
        F.count(F.lit(1)).alias("n_chunks"),
    )
    return g.select(
        key,
        F.array_join(F.transform("_parts", lambda p: p["t"]), "").alias("content"),
        "n_chunks",
        (F.col("_d") == 1).alias("done"),
        F.when(F.col("_d") == 1, F.coalesce(F.col("_f"), F.lit("stop"))).alias("finish_reason"),
        (F.col("_d") == 0).alias("interrupted"),
    )


def usage_or_estimate(df: DataFrame, usage_col: str, text_col: str) -> DataFrame:
    """Provider usage when present, else the words x 1.3 estimate."""
    est = L.approx_tokens(F.col(text_col))
    return df.withColumn("estimated", F.col(usage_col).isNull()).withColumn("tokens", F.coalesce(F.col(usage_col), est))


def conversation_token_report(conv: DataFrame, per_message_overhead: int = 3) -> DataFrame:
    """U8: estimated tokens per conversation and role, with the optional
    per-message overhead."""
    t = conv.withColumn("_t", L.approx_tokens(F.col("text")))
    return t.groupBy("conv_id", "role").agg(
        F.count(F.lit(1)).alias("messages"),
        F.sum("_t").alias("tokens"),
        (F.sum("_t") + F.count(F.lit(1)) * per_message_overhead).alias("tokens_with_overhead"),
    )
