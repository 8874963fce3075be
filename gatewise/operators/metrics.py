"""Metrics, dashboards, alerts and compliance reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counters(df: DataFrame, labels: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """A1: metric samples (metric, labels..., value) in long form: one
    aggregate per label set (partial aggregation), then ``stack``."""
    agg = df.groupBy(*labels).agg(*[F.sum(c).cast("double").alias(n) for n, c in values.items()])
    stack = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in values])).alias("s")
    return agg.select(*labels, stack).select(*labels, "s.metric", "s.value")


def rate(df: DataFrame, ts_col: str, labels: Sequence[str], value: Column | None = None, window: str = "5 minutes", slide: str = "1 minute", seconds: int = 300) -> DataFrame:
    """A2: per-second rate (or increase) over a sliding window per label set."""
    v = F.lit(1) if value is None else value
    g = df.groupBy(F.window(ts_col, window, slide).alias("w"), *labels).agg(F.sum(v).alias("increase"))
    return g.select(F.col("w.end").alias("ts"), *labels, F.col("increase").cast("double").alias("increase"), (F.col("increase") / seconds).alias("rate"))


def alert_episodes(ticks: DataFrame, keys: Sequence[str], ts_col: str, condition: Column, for_ticks: int, step_s: int = 60) -> DataFrame:
    """A3: runs of consecutive evaluation ticks where ``condition`` holds
    (gaps and islands on the tick sequence); a tick more than ``step_s`` seconds
    after the one before it starts a new run.  An episode fires once its run
    reaches ``for_ticks`` (the rule's for-duration)."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(ts_col)
    t = ticks.withColumn("_c", F.coalesce(condition, F.lit(False)))
    gap = F.unix_timestamp(F.col(ts_col).cast("timestamp")) - F.unix_timestamp(F.lag(ts_col).over(w).cast("timestamp"))
    fresh = ~F.coalesce(F.lag("_c").over(w), F.lit(False)) | (gap > step_s)
    t = t.withColumn("_island", F.sum((F.col("_c") & fresh).cast("int")).over(w)).where("_c")
    ep = t.groupBy(*keys, "_island").agg(F.min(ts_col).alias("start_ts"), F.max(ts_col).alias("end_ts"), F.count(F.lit(1)).alias("ticks"))
    return ep.withColumn("fired", F.col("ticks") >= for_ticks).withColumn(
        "fires_at", F.when(F.col("fired"), F.col("start_ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit((for_ticks - 1) * step_s)))
    ).drop("_island")


def latency_summary(df: DataFrame, keys: Sequence[str], col: str = "latency_ms") -> DataFrame:
    """A4: count, mean and p50/p95/p99 (the reference stores only sum and
    count, so its histogram_quantile panels cannot work; we compute them)."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(col), 6).alias("mean"),
        F.percentile_approx(col, 0.5).alias("p50"),
        F.percentile_approx(col, 0.95).alias("p95"),
        F.percentile_approx(col, 0.99).alias("p99"),
    )


def gauge(df: DataFrame, keys: Sequence[str], value: str, ts_col: str, tiebreak: str) -> DataFrame:
    """A5: last value per label set."""
    return df.groupBy(*keys).agg(F.max_by(F.col(value), F.struct(ts_col, tiebreak)).alias(value), F.max(ts_col).alias("as_of"))


def cardinality_guard(df: DataFrame, metric: str, labels: Sequence[str], ts_col: str, tiebreak: str, max_sets: int = 10000) -> DataFrame:
    """Label sets of a metric in first-seen order; the first ``max_sets``
    are kept, later ones flagged.  The cut-off is an exact distributed top-k
    (bounded by ``max_sets``), no global window."""
    first = df.groupBy(*labels).agg(F.min(F.struct(ts_col, tiebreak)).alias("first_seen"))
    cut = first.orderBy("first_seen").limit(max_sets).agg(F.max("first_seen")).scalar()
    return first.select(F.lit(metric).alias("metric"), *labels, F.col("first_seen").getField(ts_col).alias("first_seen_ts"), (F.col("first_seen") <= cut).alias("kept"))


def compliance_report(facts: DataFrame, key: str, dims: Sequence[str]) -> DataFrame:
    """A10: totals and per-dimension breakdowns via GROUPING SETS."""
    return facts.groupingSets([[]] + [[F.col(d)] for d in dims], *dims).agg(
        F.count(F.lit(1)).alias("fields"), F.count_distinct(key).alias("items"), F.grouping_id().alias("gid")
    )


def pii_leak_check(excerpts: DataFrame, text_col: str, key: Sequence[str]) -> DataFrame:
    """Rescan stored excerpts; any match is a leak (expected empty)."""
    from gatewise.operators.pii import pii_scan

    return pii_scan(excerpts, text_col, list(key))
