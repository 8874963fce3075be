"""Fact tables, sinks and table maintenance.

Writes go to a folder under the shared ``spark.checkpoint.dir`` unless a
path is given; nothing is written to a machine-local folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewise.session import ensure_checkpoint_dir

# Enum domains of the fact tables.
EVENT_TYPES = ["PROMPT_BLOCKED", "PII_DETECTED", "QUOTA_EXCEEDED", "CONTENT_FILTERED", "EXFILTRATION_ATTEMPT", "MASK_APPLIED", "CANARY_ROLLBACK", "PROVIDER_FAILOVER"]
ACTIONS = ["BLOCKED", "MASKED", "WARNED", "ALLOWED", "ROLLED_BACK"]
MASK_SOURCES = ["explicit_rule", "auto_detect", "ner_detect"]

# JSON timestamps keep microseconds (the default writer format cuts to ms)
JSON_TS_OPTIONS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}

AUDIT_EVENT_SCHEMA = (
    "id string, consumer_id string, route_id string, event_type string, action_taken string, payload_excerpt string, "
    "rule_id string, metadata string, request_id string, timestamp timestamp_ntz, created_at timestamp_ntz"
)


def table_root(spark: SparkSession, name: str) -> str:
    """A fresh folder for table ``name`` under the shared checkpoint dir."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:8]}"


def with_month(df: DataFrame, ts_col: str = "timestamp") -> DataFrame:
    return df.withColumn("month", F.date_format(F.col(ts_col), "yyyy-MM"))


def write_monthly(df: DataFrame, path: str, ts_col: str = "timestamp") -> str:
    """Append rows into month partitions (``month=yyyy-MM``); rows of a
    month are clustered before the write so each task writes few files, and a
    large month is split over tasks by size (adaptive rebalancing)."""
    out = with_month(df, ts_col)
    out.hint("rebalance", "month").write.mode("append").partitionBy("month").parquet(path)
    return path


def retention_plan(spark: SparkSession, path_or_df, as_of: str, months: int = 84) -> DataFrame:
    """keep/drop decision per month partition: months before
    trunc(as_of - 84 months) are dropped.  Reads only the partition column."""
    df = spark.read.parquet(path_or_df) if isinstance(path_or_df, str) else path_or_df
    cutoff = F.trunc(F.add_months(F.lit(as_of).cast("date"), -months), "month")
    parts = df.groupBy("month").agg(F.count(F.lit(1)).alias("rows"))
    return parts.withColumn("cutoff", cutoff).withColumn(
        "action", F.when(F.to_date(F.concat(F.col("month"), F.lit("-01"))) < F.col("cutoff"), "drop").otherwise("keep")
    )


def _reason(cond: Column, text: str) -> Column:
    return F.when(cond, F.lit(text))


def constraint_split(df: DataFrame, table: str = "billing_records") -> tuple[DataFrame, DataFrame]:
    """T4: rows breaking NOT NULL, CHECK >= 0, length or enum rules are split
    off with their reasons ("log, skip record")."""
    checks: list[Column] = []
    if table == "billing_records":
        for c in ("consumer_id", "route_id", "model", "provider"):
            checks.append(_reason(F.col(c).isNull(), f"{c}_null"))
        for c in ("tokens_input", "tokens_output", "cost_dollars"):
            checks.append(_reason(F.col(c) < 0, f"{c}_negative"))
        checks.append(_reason(F.length("consumer_id") > 255, "consumer_id_too_long"))
        checks.append(_reason(F.length("provider") > 100, "provider_too_long"))
    elif table == "audit_events":
        for c in ("consumer_id", "route_id", "event_type", "action_taken"):
            checks.append(_reason(F.col(c).isNull(), f"{c}_null"))
        checks.append(_reason(~F.col("event_type").isin(*EVENT_TYPES), "event_type_not_in_enum"))
        checks.append(_reason(~F.col("action_taken").isin(*ACTIONS), "action_taken_not_in_enum"))
    elif table == "masking_audit":
        for c in ("consumer_id", "route_id", "field_path", "mask_strategy", "rule_id", "pii_type"):
            checks.append(_reason(F.col(c).isNull(), f"{c}_null"))
        checks.append(_reason(F.length("field_path") > 500, "field_path_too_long"))
        checks.append(_reason(~F.col("source").isin(*MASK_SOURCES), "source_not_in_enum"))
    else:
        raise ValueError(table)
    flagged = df.withColumn("violations", F.array_compact(F.array(*checks)))
    return flagged.where(F.size("violations") == 0).drop("violations"), flagged.where(F.size("violations") > 0)


def audit_drain(raw: DataFrame, value_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """T5 (batch): ``audit_split`` with the good rows deduplicated on (request_id, event_type)."""
    good, dead = audit_split(raw, value_col)
    return good.dropDuplicates(["request_id", "event_type"]), dead


def audit_split(raw: DataFrame, value_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """Parse buffered JSON events; rows without the required fields go to a
    dead-letter table with the reason."""
    parsed = raw.withColumn("e", F.from_json(F.col(value_col), AUDIT_EVENT_SCHEMA, {"mode": "PERMISSIVE", **JSON_TS_OPTIONS})).withColumn(
        "_valid_json", F.try_parse_json(F.col(value_col)).isNotNull()
    )
    ok = F.col("_valid_json") & F.col("e.consumer_id").isNotNull() & F.col("e.event_type").isin(*EVENT_TYPES) & F.col("e.timestamp").isNotNull()
    reason = F.when(~F.col("_valid_json"), "unparseable").when(~F.coalesce(F.col("e.event_type").isin(*EVENT_TYPES), F.lit(False)), "bad_event_type").otherwise("missing_field")
    good = parsed.where(ok).select("e.*")
    dead = parsed.where(~F.coalesce(ok, F.lit(False))).select(F.col(value_col).alias("raw"), reason.alias("reason"))
    return good, dead


def masking_audit_from_events(audit: DataFrame) -> DataFrame:
    """One masking_audit row per field in MASK_APPLIED metadata
    (``field_details``); the value is never carried."""
    fd = "array<struct<path:string,strategy:string,rule_id:string,pii_type:string,source:string>>"
    m = audit.where(F.col("event_type") == "MASK_APPLIED").select(
        "consumer_id", "route_id", "request_id", "timestamp", F.get_json_object("metadata", "$.role").alias("consumer_role"),
        F.explode(F.from_json(F.get_json_object("metadata", "$.field_details"), fd)).alias("f"),
    )
    src = F.when(F.col("f.source").startswith("ner"), "ner_detect").otherwise(F.col("f.source"))
    return m.select(
        "consumer_id", F.coalesce("consumer_role", F.lit("unknown")).alias("consumer_role"), "route_id", "request_id",
        F.col("f.path").alias("field_path"), F.col("f.strategy").alias("mask_strategy"), F.coalesce("f.rule_id", F.lit("")).alias("rule_id"),
        F.col("f.pii_type").alias("pii_type"), src.alias("source"), F.col("f.source").alias("source_raw"), "timestamp",
    )


def audit_search(audit: DataFrame, start: str, end: str, consumer: str | None = None, event_type: str | None = None, ts_col: str = "timestamp") -> DataFrame:
    """Filter by consumer, range and type; month bounds are derived from
    the range so a month-partitioned table is pruned."""
    cond = (F.col(ts_col) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts_col) < F.lit(end).cast("timestamp_ntz"))
    if "month" in audit.columns:
        cond = cond & (F.col("month") >= start[:7]) & (F.col("month") <= end[:7])
    if consumer is not None:
        cond = cond & (F.col("consumer_id") == consumer)
    if event_type is not None:
        cond = cond & (F.col("event_type") == event_type)
    return audit.where(cond)


def unreconciled(billing: DataFrame, as_of: str, key: str = "consumer_id", ts_col: str = "ts") -> DataFrame:
    """Unreconciled rows per consumer with count, tokens and age."""
    u = billing.where(~F.col("is_reconciled"))
    return u.groupBy(key).agg(
        F.count(F.lit(1)).alias("unreconciled"),
        F.sum(F.col("tokens_input") + F.col("tokens_output")).alias("tokens"),
        F.min(ts_col).alias("oldest"),
        F.datediff(F.lit(as_of).cast("date"), F.min(ts_col).cast("date")).alias("max_age_days"),
    )


def billing_facts(priced_requests: DataFrame) -> DataFrame:
    """billing_records rows from the priced request log."""
    return priced_requests.select(
        F.sha2(F.concat_ws("|", F.lit("billing"), F.col("request_id")), 256).substr(1, 32).alias("id"),
        "consumer_id", "route_id", "model", "provider", "tokens_input", "tokens_output",
        F.col("cost_usd").cast("decimal(12,6)").alias("cost_dollars"), "request_id", F.lit(False).alias("is_reconciled"),
        F.col("ts").alias("timestamp"),
    )


def month_fingerprints(df: DataFrame, ts_col: str = "ts") -> DataFrame:
    """(month, rows, h1, h2): the multiset of rows of each month as a count and two sums of 64-bit halves of a row hash.

    Sums do not depend on row order, so they are built map-side and can be
    stored with a snapshot.  Rows without a time form the month ''.  Nulls,
    column names and microseconds are part of a row's hash; repeated rows count.
    """
    row = F.md5(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false", **JSON_TS_OPTIONS}))
    half = [F.conv(F.substring(row, at, 16), 16, 10).cast("decimal(20,0)") for at in (1, 17)]
    rows = df.select(_month(ts_col).alias("month"), half[0].alias("_1"), half[1].alias("_2"))
    return rows.groupBy("month").agg(F.count(F.lit(1)).alias("rows"), F.sum("_1").alias("h1"), F.sum("_2").alias("h2"))


def _month(ts_col: str) -> Column:
    return F.coalesce(F.date_format(F.col(ts_col), "yyyy-MM"), F.lit(""))


def changed_months(before_prints: DataFrame, after_prints: DataFrame) -> DataFrame:
    """Months of the earlier snapshot whose fingerprint the later one does not show."""
    return before_prints.join(after_prints, ["month", "rows", "h1", "h2"], "left_anti").select("month")


def append_only_violations(before: DataFrame, after: DataFrame, ts_col: str = "ts", before_prints: DataFrame | None = None) -> DataFrame:
    """Rows of the earlier snapshot that changed or vanished (must be
    empty for an append-only table), as a multiset difference of whole rows.

    Months of equal fingerprints hold the same rows and are not compared; only
    rows of other months (appended to or tampered with) are shuffled.
    ``before_prints`` are fingerprints stored with the earlier snapshot.
    """
    after = after.select(*before.columns)
    prints = month_fingerprints(before, ts_col) if before_prints is None else before_prints
    months = changed_months(prints, month_fingerprints(after, ts_col)).agg(F.collect_list("month")).scalar()
    return before.where(F.array_contains(months, _month(ts_col))).exceptAll(after.where(F.array_contains(months, _month(ts_col))))


def report_export(df: DataFrame, path: str, fmt: str = "json") -> str:
    """Write a report as JSON lines or CSV with header."""
    w = df.write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.json(path))
    return path
