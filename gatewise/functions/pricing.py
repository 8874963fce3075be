"""Model pricing dimension (dollars per 1K tokens)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRICE_TYPE = "decimal(12,8)"
DEFAULT_KEY = "_default"

# Default price list, $ per 1K input / output tokens.
DEFAULT_PRICING: dict[str, tuple[str, str]] = {
    "gpt-4o": ("0.0025", "0.01"),
    "gpt-4o-mini": ("0.00015", "0.0006"),
    "gpt-4.1": ("0.002", "0.008"),
    "gpt-4.1-mini": ("0.0004", "0.0016"),
    "gpt-4.1-nano": ("0.0001", "0.0004"),
    "claude-sonnet-4-6": ("0.003", "0.015"),
    "claude-opus-4-6": ("0.015", "0.075"),
    "claude-haiku-4-5": ("0.0008", "0.004"),
    "gemini-2.0-flash": ("0.0001", "0.0004"),
    "gemini-2.5-pro": ("0.00125", "0.01"),
    "_default": ("0.01", "0.03"),
}
# used when a custom table carries no `_default` row either
FALLBACK_PRICE = ("0.01", "0.03")


def pricing_frame(spark: SparkSession, table: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Pricing dimension ``(model, input_per_1k, output_per_1k)`` as exact decimals."""
    table = DEFAULT_PRICING if table is None else table
    rows = [(m, str(i), str(o)) for m, (i, o) in table.items()]
    df = spark.createDataFrame(rows, "model string, input_per_1k string, output_per_1k string")
    return df.select(
        "model",
        F.col("input_per_1k").cast(PRICE_TYPE).alias("input_per_1k"),
        F.col("output_per_1k").cast(PRICE_TYPE).alias("output_per_1k"),
    )


def cost_expr(tokens_in: Column, tokens_out: Column, p_in: Column, p_out: Column) -> Column:
    """in/1000*p_in + out/1000*p_out, half-up to 6 places, exact decimal arithmetic."""
    raw = (tokens_in.cast("decimal(20,0)") * p_in + tokens_out.cast("decimal(20,0)") * p_out) * F.lit(0.001).cast("decimal(4,3)")
    return F.round(raw, 6).cast("decimal(22,6)")
