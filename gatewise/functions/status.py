"""HTTP status helpers and the gateway error catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Error catalogue (code, http status, category, log level, retry class).
ERROR_CATALOGUE = [
    ("ARIA_SH_INVALID_REQUEST_FORMAT", 400, "VAL", "WARN", "not_retryable"),
    ("ARIA_SH_INVALID_MODEL", 400, "VAL", "WARN", "not_retryable"),
    ("ARIA_SH_PII_IN_PROMPT_DETECTED", 400, "BUS", "WARN", "not_retryable"),
    ("ARIA_SH_PROMPT_INJECTION_DETECTED", 403, "BUS", "WARN", "not_retryable"),
    ("ARIA_SH_QUOTA_EXCEEDED", 402, "BUS", "WARN", "not_retryable_until_reset"),
    ("ARIA_SH_QUOTA_THROTTLED", 429, "BUS", "WARN", "retry_after"),
    ("ARIA_SH_PROVIDER_AUTH_FAILED", 502, "EXT", "ERROR", "not_retryable"),
    ("ARIA_SH_PROVIDER_RATE_LIMITED", 429, "EXT", "WARN", "retry_after"),
    ("ARIA_SH_PROVIDER_ERROR", 502, "EXT", "ERROR", "retry_backoff"),
    ("ARIA_SH_PROVIDER_TIMEOUT", 504, "EXT", "ERROR", "retry_backoff"),
    ("ARIA_SH_PROVIDER_UNREACHABLE", 502, "EXT", "ERROR", "retry_backoff"),
    ("ARIA_SH_ALL_PROVIDERS_DOWN", 503, "EXT", "ERROR", "retry_after_recovery"),
    ("ARIA_SH_PROVIDER_NOT_CONFIGURED", 500, "SYS", "ERROR", "not_retryable"),
    ("ARIA_SH_CONTENT_FILTERED", 422, "BUS", "WARN", "not_retryable"),
    ("ARIA_SH_EXFILTRATION_DETECTED", 422, "BUS", "WARN", "not_retryable"),
    ("ARIA_SH_STREAM_INTERRUPTED", 502, "EXT", "ERROR", "retry_immediately"),
    ("ARIA_SH_QUOTA_SERVICE_UNAVAILABLE", 503, "SYS", "ERROR", "retry_after_recovery"),
    ("ARIA_MK_MASKING_ENGINE_ERROR", 500, "SYS", "ERROR", "retry_immediately"),
    ("ARIA_MK_INVALID_JSONPATH", 500, "SYS", "ERROR", "not_retryable"),
    ("ARIA_MK_TOKENIZE_UNAVAILABLE", 500, "SYS", "ERROR", "retry_after_recovery"),
    ("ARIA_MK_NER_SIDECAR_UNAVAILABLE", None, "EXT", "WARN", "circuit_breaker"),
    ("ARIA_MK_NER_FAIL_CLOSED_REDACTED", None, "INF", "INFO", "none"),
    ("ARIA_MK_NER_CIRCUIT_OPEN", None, "INF", "WARN", "none"),
    ("ARIA_CN_NO_ACTIVE_CANARY", 404, "RES", "WARN", "not_retryable"),
    ("ARIA_CN_CANARY_UPSTREAM_UNHEALTHY", 503, "EXT", "ERROR", "retry_after_recovery"),
    ("ARIA_CN_INVALID_SCHEDULE", 400, "VAL", "WARN", "not_retryable"),
    ("ARIA_CN_ALREADY_PROMOTED", 409, "BUS", "WARN", "not_retryable"),
    ("ARIA_CN_ALREADY_ROLLED_BACK", 409, "BUS", "WARN", "not_retryable"),
    ("ARIA_CN_SHADOW_DIFF_UNAVAILABLE", None, "EXT", "WARN", "skip"),
    ("ARIA_CN_SHADOW_BRIDGE_TIMEOUT", None, "EXT", "WARN", "circuit_breaker"),
    ("ARIA_RT_SIDECAR_UNAVAILABLE", 502, "EXT", "ERROR", "retry_immediately"),
    ("ARIA_RT_RESOURCE_EXHAUSTED", 503, "SYS", "ERROR", "retry_backoff"),
    ("ARIA_RT_HANDLER_NOT_FOUND", 404, "VAL", "WARN", "not_retryable"),
    ("ARIA_RT_DEPENDENCY_UNAVAILABLE", 503, "EXT", "ERROR", "retry_after_recovery"),
    ("ARIA_RT_TOKENIZER_FALLBACK", None, "INF", "INFO", "none"),
    ("ARIA_SYS_INTERNAL_ERROR", 500, "SYS", "ERROR", "retry_immediately"),
    ("ARIA_SYS_CONFIG_INVALID", 500, "SYS", "ERROR", "not_retryable"),
]


def catalogue_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ERROR_CATALOGUE, "error_code string, http_status int, category string, log_level string, retry_class string")


def status_class(status: Column) -> Column:
    """'2xx' / '4xx' / '5xx'."""
    return F.concat(F.floor(status / 100).cast("string"), F.lit("xx"))


def is_error(status: Column) -> Column:
    return status >= 500


def outcome_code(status: Column, error_kind: Column | None = None) -> Column:
    """gateway error code of a provider outcome (NULL on success)."""
    ek = error_kind if error_kind is not None else F.lit(None).cast("string")
    return (
        F.when(ek == "timeout", "ARIA_SH_PROVIDER_TIMEOUT")
        .when((ek == "connection") | status.isNull(), "ARIA_SH_PROVIDER_UNREACHABLE")
        .when(status >= 500, "ARIA_SH_PROVIDER_ERROR")
        .when(status.isin(401, 403), "ARIA_SH_PROVIDER_AUTH_FAILED")
        .when(status == 429, "ARIA_SH_PROVIDER_RATE_LIMITED")
    )


# Alert severity per code, and what must hold besides (None: nothing).
SEVERITIES = [
    ("ARIA_SH_ALL_PROVIDERS_DOWN", "critical", None),
    ("ARIA_RT_SIDECAR_UNAVAILABLE", "critical", "sustained"),
    ("ARIA_SYS_INTERNAL_ERROR", "critical", "rate"),
    ("ARIA_SH_QUOTA_SERVICE_UNAVAILABLE", "warning", None),
    ("ARIA_SH_PROVIDER_AUTH_FAILED", "warning", None),
    ("ARIA_CN_CANARY_UPSTREAM_UNHEALTHY", "warning", None),
    ("ARIA_MK_TOKENIZE_UNAVAILABLE", "warning", None),
    ("ARIA_RT_DEPENDENCY_UNAVAILABLE", "warning", None),
    ("ARIA_SH_QUOTA_EXCEEDED", "info", None),
    ("ARIA_SH_PROMPT_INJECTION_DETECTED", "info", None),
    ("ARIA_SH_PII_IN_PROMPT_DETECTED", "info", None),
    ("ARIA_SH_CONTENT_FILTERED", "info", None),
    ("ARIA_SH_EXFILTRATION_DETECTED", "info", None),
]
SUSTAINED_S = 300
RATE_PER_MINUTE = 10


def severity(code: Column, per_minute: Column | None = None, sustained_s: Column | None = None) -> Column:
    """alert severity of a code; NULL for codes that raise no alert.

    A lost sidecar counts once it lasts over five minutes, internal errors
    above ten a minute; without the measured column they raise none.
    """
    met = {
        None: F.lit(True),
        "rate": F.lit(False) if per_minute is None else per_minute > RATE_PER_MINUTE,
        "sustained": F.lit(False) if sustained_s is None else sustained_s > SUSTAINED_S,
    }
    return F.coalesce(*[F.when((code == c) & met[needs], level) for c, level, needs in SEVERITIES])


def alert_severities(errors: DataFrame, code_col: str = "error_code", ts_col: str = "ts", bucket_s: int = 60) -> DataFrame:
    """F5 with its rates: (code, minute, errors, sustained_s, severity) of every minute with errors of a code.

    ``sustained_s`` is how long, up to the end of the minute, every minute
    held the code.  Minutes are pre-aggregated; null codes are left out.
    """
    minute = F.floor(F.unix_timestamp(F.col(ts_col).cast("timestamp")) / bucket_s)
    counts = errors.where(F.col(code_col).isNotNull()).groupBy(F.col(code_col).alias("code"), minute.alias("minute")).agg(F.count(F.lit(1)).alias("errors"))
    order = Window.partitionBy("code").orderBy("minute")
    run = F.col("minute") - F.row_number().over(order)  # the same along neighbouring minutes
    runs = counts.withColumn("_run", run).withColumn("sustained_s", F.row_number().over(Window.partitionBy("code", "_run").orderBy("minute")) * bucket_s)
    return runs.select("code", F.timestamp_seconds(F.col("minute") * bucket_s).cast("timestamp_ntz").alias("minute"), "errors", "sustained_s", severity(F.col("code"), F.col("errors") * 60 / bucket_s, F.col("sustained_s")).alias("severity"))
