"""Request log validation and request-level projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewise.functions import pii as PF
from gatewise.functions import status as ST
from gatewise.operators.common import bounded_broadcast

MAX_BODY_SIZE = 10 * 1024 * 1024


def request_log(df: DataFrame, body_col: str = "body") -> tuple[DataFrame, DataFrame]:
    """Split into (valid, rejected).  Valid: body present, JSON parses,
    ``messages`` is a non-empty array, ``model`` non-empty.  One pass computes
    the flag; the two outputs are two filters on it."""
    v = F.try_parse_json(F.col(body_col))
    model = F.try_variant_get(v, "$.model", "string")
    msgs = F.try_variant_get(v, "$.messages", "array<variant>")
    reason = (
        F.when(F.col(body_col).isNull() | (F.col(body_col) == ""), "body_missing")
        .when(v.isNull(), "invalid_json")
        .when(msgs.isNull() | (F.size(msgs) == 0), "messages_missing_or_empty")
        .when(model.isNull() | (model == ""), "model_missing")
    )
    flagged = df.withColumn("req_model", model).withColumn("n_messages", F.size(msgs)).withColumn("reject_detail", reason)
    valid = flagged.where(F.col("reject_detail").isNull()).drop("reject_detail")
    rejected = flagged.where(F.col("reject_detail").isNotNull()).withColumn("error_code", F.lit("ARIA_SH_INVALID_REQUEST_FORMAT"))
    return valid, rejected


def model_pin(requests: DataFrame, route_pins: DataFrame | None = None, consumer_pins: DataFrame | None = None) -> DataFrame:
    """route pins rewrite the model; consumer pins only within the same
    base model family.  Broadcast left joins (config tables, size-checked)."""
    out = requests.withColumn("requested_model", F.col("model"))
    if route_pins is not None:
        rp = bounded_broadcast(route_pins.select(F.col("route_id").alias("_pr"), F.col("model").alias("_pm")))
        out = out.join(rp, F.col("route_id") == F.col("_pr"), "left").withColumn("model", F.coalesce("_pm", "model")).drop("_pr", "_pm")
    if consumer_pins is not None:
        cp = bounded_broadcast(consumer_pins.select(F.col("consumer_id").alias("_pc"), F.col("model").alias("_cm")))
        base = lambda c: F.regexp_extract(c, r"^([a-z]+)", 1)
        out = out.join(cp, F.col("consumer_id") == F.col("_pc"), "left").withColumn(
            "model", F.when(F.col("_cm").isNotNull() & (base(F.col("_cm")) == base(F.col("model"))), F.col("_cm")).otherwise(F.col("model"))
        ).drop("_pc", "_cm")
    return out.withColumn("pinned", F.col("model") != F.col("requested_model"))


def with_status(df: DataFrame, status_col: str = "status", error_kind_col: str | None = None) -> DataFrame:
    """F2 + F3: status class, error flag, gateway outcome code."""
    s = F.col(status_col)
    ek = F.col(error_kind_col) if error_kind_col else None
    return df.withColumn("status_class", ST.status_class(s)).withColumn("is_error", ST.is_error(s)).withColumn(
        "error_code", ST.outcome_code(s, ek)
    )


def with_error_catalogue(df: DataFrame, code_col: str = "error_code") -> DataFrame:
    """F4 + F5: http status, category, log level, retry class and severity."""
    cat = ST.catalogue_frame(df.sparkSession).withColumnRenamed("error_code", "_code").withColumnRenamed("http_status", "gateway_http_status")
    j = df.join(bounded_broadcast(cat, known_rows=len(ST.ERROR_CATALOGUE)), F.col(code_col) == F.col("_code"), "left").drop("_code")
    return j.withColumn("severity", ST.severity(F.col(code_col)))


def maskable_gate(bodies: DataFrame, max_body_size: int = MAX_BODY_SIZE) -> DataFrame:
    """maskable iff JSON content type, size <= cap and body parses.
    The parse is guarded by the cheap checks inside one CASE."""
    ct = F.lower(F.coalesce(F.col("content_type"), F.lit("")))
    size = F.octet_length("body")
    reason = (
        F.when(~ct.contains("json"), "not_json_content_type")
        .when(size > max_body_size, "body_too_large")
        .when(F.try_parse_json("body").isNull() & F.get_json_object("body", "$").isNull(), "invalid_json")  # VARIANT refuses repeated keys
    )
    return bodies.withColumn("body_bytes", size).withColumn("skip_reason", reason).withColumn("maskable", F.col("skip_reason").isNull())


LEVEL_RANK = {"L1": 1, "L2": 2, "L3": 3, "L4": 4}


def classification_rollup(df: DataFrame, columns: list[str], default_level: str = "L2") -> DataFrame:
    """per column the highest level of any personal data found in its
    values (default L2), and the dataset level = max over columns.

    One scan of the table: per column the max rank of its matches, a single
    global aggregate (partial aggregation map-side), then unpivot.
    """
    rank = lambda c: F.array_max(F.transform(PF.scan(F.col(c).cast("string")), lambda m: F.substring(m["classification"], 2, 1).cast("int")))
    agg = df.agg(*[F.coalesce(F.max(rank(c)), F.lit(int(default_level[1]))).alias(c) for c in columns])
    long = agg.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("r")) for c in columns])).alias("x"))
    long = long.select("x.column_name", F.greatest(F.col("x.r"), F.lit(int(default_level[1]))).alias("r"))
    ds = long.agg(F.max("r")).scalar()
    return long.select("column_name", F.concat(F.lit("L"), F.col("r").cast("string")).alias("level"), F.concat(F.lit("L"), ds.cast("string")).alias("dataset_level"))
