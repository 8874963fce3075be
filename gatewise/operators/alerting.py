"""Alert rules on an evaluation grid.

Rules are evaluated at every full ``step_s``.  Samples are first reduced to
one row per label set and step (map-side), so what is windowed by label set
grows with time and not with traffic.

* Counters: a tick sees the events of the window before it.  A tick without
  events in its window has an increase of 0, so it is not generated: it ends a run.
* Gauges: a tick sees the latest sample, at most ``lookback_s`` old.  Older
  samples are stale, and a tick that sees none ends a run.

A run of ticks that meet the condition is pending from its first tick, fires
once it has lasted ``for_s`` and is resolved at the first tick that does not
meet it.  Null times are left out; empty inputs give no alerts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CounterRule:
    """``increase(errors{code}[window_s]) > over`` for ``for_s`` seconds."""

    code: str
    window_s: int
    over: float
    for_s: int
    severity: str


# Alert rules on error codes (0.17 a second over five minutes is 51).
CODE_RULES = [
    CounterRule("ALL_PROVIDERS_DOWN", 300, 0, 120, "critical"),
    CounterRule("SIDECAR_UNAVAILABLE", 300, 5, 300, "critical"),
    CounterRule("INTERNAL_ERROR", 300, 51, 180, "critical"),
    CounterRule("PROVIDER_AUTH_FAILED", 600, 0, 60, "warning"),
    CounterRule("QUOTA_SERVICE_UNAVAILABLE", 300, 0, 120, "warning"),
    CounterRule("CANARY_UPSTREAM_UNHEALTHY", 300, 0, 120, "warning"),
    CounterRule("DEPENDENCY_UNAVAILABLE", 300, 3, 180, "warning"),
]


def _micros(ts_col: str) -> Column:
    return F.unix_micros(F.col(ts_col).cast("timestamp"))


def _time(tick: Column, step_s: int) -> Column:
    return F.timestamp_seconds(tick * step_s).cast("timestamp_ntz")


def counter_ticks(events: DataFrame, keys: Sequence[str], ts_col: str, window_s: Column | int, step_s: int = 60) -> DataFrame:
    """(keys, tick, increase): events in the ``window_s`` before each tick; ``window_s`` may depend on ``keys``."""
    steps = F.floor(_micros(ts_col) / (step_s * 1_000_000)).cast("bigint")
    counts = events.where(F.col(ts_col).isNotNull()).groupBy(*keys, steps.alias("_step")).agg(F.count(F.lit(1)).alias("_n"))
    width = (window_s if isinstance(window_s, Column) else F.lit(window_s)) / step_s
    seen = counts.select(*keys, "_n", F.explode(F.sequence(F.col("_step") + 1, F.col("_step") + width.cast("bigint"))).alias("tick"))
    return seen.groupBy(*keys, "tick").agg(F.sum("_n").alias("increase"))


def gauge_ticks(samples: DataFrame, keys: Sequence[str], ts_col: str, id_col: str, value: str, lookback_s: int = 300, step_s: int = 60) -> DataFrame:
    """(keys, tick, value): the latest sample at each tick, while it is younger than ``lookback_s``."""
    unit = step_s * 1_000_000
    first = F.ceil(_micros(ts_col) / unit).cast("bigint")
    place = F.struct(ts_col, id_col)
    latest = samples.where(F.col(ts_col).isNotNull()).groupBy(*keys, first.alias("_from")).agg(F.max_by(F.col(value), place).alias("value"), F.max(_micros(ts_col)).alias("_us"))
    following = F.lead("_from").over(Window.partitionBy(*keys).orderBy("_from"))
    stale = F.ceil((F.col("_us") + lookback_s * 1_000_000) / unit).cast("bigint")
    spans = latest.withColumn("_to", F.least(F.coalesce(following, stale), stale) - 1).where(F.col("_to") >= F.col("_from"))
    return spans.select(*keys, F.explode(F.sequence("_from", "_to")).alias("tick"), "value")


def alert_runs(ticks: DataFrame, keys: Sequence[str], condition: Column, for_s: Column | int, until: Column, step_s: int = 60) -> DataFrame:
    """(keys, pending_at, firing_at, resolved_at, state): one row per run of ticks that meet ``condition``.

    ``until`` is the last evaluated tick: runs that reach it are open (pending
    or firing); others are resolved if they fired, else dropped.
    """
    keys = list(keys)
    met = ticks.where(condition & (F.col("tick") <= until))
    island = F.col("tick") - F.row_number().over(Window.partitionBy(*keys).orderBy("tick"))
    runs = met.withColumn("_run", island).groupBy(*keys, "_run").agg(F.min("tick").alias("_from"), F.max("tick").alias("_to"))
    wait = F.ceil((for_s if isinstance(for_s, Column) else F.lit(for_s)) / step_s).cast("bigint")
    fires = F.col("_from") + wait <= F.col("_to")
    open_ = F.col("_to") >= until
    state = F.when(open_, F.when(fires, "firing").otherwise("pending")).otherwise(F.when(fires, "resolved").otherwise("dropped"))
    return runs.select(
        *keys,
        _time(F.col("_from"), step_s).alias("pending_at"),
        F.when(fires, _time(F.col("_from") + wait, step_s)).alias("firing_at"),
        F.when(~open_, _time(F.col("_to") + 1, step_s)).alias("resolved_at"),
        state.alias("state"),
    )


def last_tick(df: DataFrame, ts_col: str, step_s: int = 60) -> Column:
    """The first tick at or after the latest sample, as a scalar."""
    return df.agg(F.ceil(F.max(_micros(ts_col)) / (step_s * 1_000_000)).cast("bigint")).scalar()


def code_alerts(errors: DataFrame, code_col: str, ts_col: str, rules: Sequence[CounterRule] = tuple(CODE_RULES)) -> DataFrame:
    """Runs of every counter rule, with its code and severity; codes without a rule raise none."""

    def of(field: str) -> Column:
        return F.coalesce(*[F.when(F.col("code") == r.code, F.lit(getattr(r, field))) for r in rules])

    e = errors.select(F.col(code_col).alias("code"), F.col(ts_col).alias("ts")).where(F.col("code").isin([r.code for r in rules]))
    ticks = counter_ticks(e, ["code"], "ts", of("window_s"))
    return alert_runs(ticks, ["code"], F.col("increase") > of("over"), of("for_s"), last_tick(errors, ts_col)).withColumn("severity", of("severity"))
