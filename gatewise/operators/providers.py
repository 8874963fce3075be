"""Provider breaker, failover and routing operators.

The breaker (B1) needs no sequential fold.  With failures counted per key:
a *trigger* is a failure that completes ``threshold`` consecutive failures;
a *reset* is a success whose time since the previous failure is at least the
cooldown (the open -> half_open -> closed path: while open every failure
renews ``opened_at``).  After any event the breaker is open exactly when the
latest trigger-or-reset at or before it is a trigger.  Every quantity is a
running count or a "last value" scan, computed with ``scan`` (chunked by
time, so a hot provider is spread over many tasks).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatewise.functions.pricing import DEFAULT_PRICING
from gatewise.operators import scan as SC
from gatewise.operators.common import materialize


def _secs(c):
    return F.unix_micros(F.col(c).cast("timestamp")) / 1e6 if isinstance(c, str) else F.unix_micros(c.cast("timestamp")) / 1e6


def breaker_replay(
    outcomes: DataFrame,
    key: Sequence[str] = ("provider",),
    ts_col: str = "ts",
    id_col: str = "event_id",
    threshold: int = 3,
    cooldown_s: float = 30.0,
    chunk_s: int = 3600,
) -> DataFrame:
    """B1: breaker state after every outcome (input column ``success``).

    Adds ``streak``, ``state`` (closed/open), ``prev_state``,
    ``transition`` (opened / closed / probe_failed) and ``last_fail_ts``.

    Two chunked passes.  Pass 1 needs one window inside (key, chunk): the
    local failure count, the local count at the latest success and the latest
    earlier failure time; their carries across chunks (total failures, the
    global count at the latest success, the latest failure time) are combined
    on the small chunk table.  Pass 2 scans the trigger/reset markers.
    """
    key = list(key)
    order = [ts_col, id_col]
    pos = F.struct(*[F.col(o) for o in order])
    d = outcomes.withColumn("_chunk", SC.time_chunk(F.col(ts_col), chunk_s)).withColumn("_fail", (~F.col("success")).cast("int"))
    w_in = Window.partitionBy(*key, "_chunk").orderBy(*order)
    incl = w_in.rowsBetween(Window.unboundedPreceding, 0)
    excl = w_in.rowsBetween(Window.unboundedPreceding, -1)
    d = (
        d.withColumn("_lcf", F.sum("_fail").over(incl))
        .withColumn("_lcf_succ", F.last(F.when(F.col("success"), F.col("_lcf")), ignorenulls=True).over(incl))
        .withColumn("_lprev_fail", F.last(F.when(F.col("_fail") == 1, F.col(ts_col)), ignorenulls=True).over(excl))
    )
    summ = d.groupBy(*key, "_chunk").agg(
        F.sum("_fail").alias("_tf"),
        F.max_by(F.col("_lcf"), F.when(F.col("success"), pos)).alias("_scf"),
        F.max(F.when(F.col("_fail") == 1, F.col(ts_col))).alias("_slf"),
    )
    w_k = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.withColumn("_cfail", F.coalesce(F.sum("_tf").over(w_k), F.lit(0)))
    summ = summ.select(
        *key, "_chunk", "_cfail",
        F.last(F.col("_cfail") + F.col("_scf"), ignorenulls=True).over(w_k).alias("_ccf_succ"),
        F.last("_slf", ignorenulls=True).over(w_k).alias("_clast_fail"),
    )
    d = SC.join_back(d, summ, [*key, "_chunk"])
    cum_fail = F.col("_lcf") + F.col("_cfail")
    cf_at_succ = F.coalesce(F.col("_lcf_succ") + F.col("_cfail"), F.col("_ccf_succ"), F.lit(0))
    d = d.withColumn("streak", (cum_fail - cf_at_succ).cast("bigint")).withColumn("_prev_fail_ts", F.coalesce("_lprev_fail", "_clast_fail"))
    gap = _secs(ts_col) - _secs(F.col("_prev_fail_ts"))
    marker = F.when((F.col("_fail") == 1) & (F.col("streak") == threshold), F.lit("T")).when(
        F.col("success") & F.col("_prev_fail_ts").isNotNull() & (gap >= cooldown_s), F.lit("R")
    )
    d = d.withColumn("_marker", marker)
    d = SC.last_values(d, key, "_chunk", order, {"_last_marker": F.col("_marker")}, inclusive=True, also_exclusive={"_prev_marker": F.col("_marker")})
    state = F.when(F.col("_last_marker") == "T", "open").otherwise("closed")
    prev = F.when(F.col("_prev_marker") == "T", "open").otherwise("closed")
    transition = (
        F.when((prev == "closed") & (state == "open"), "opened")
        .when((prev == "open") & (state == "closed"), "closed")
        .when((prev == "open") & (F.col("_fail") == 1) & (gap >= cooldown_s), "probe_failed")
    )
    last_fail = F.when(F.col("_fail") == 1, F.col(ts_col)).otherwise(F.col("_prev_fail_ts"))
    return (
        d.withColumn("state", state)
        .withColumn("prev_state", prev)
        .withColumn("transition", transition)
        .withColumn("last_fail_ts", last_fail)
        .drop("_chunk", "_fail", "_lcf", "_lcf_succ", "_lprev_fail", "_cfail", "_ccf_succ", "_clast_fail", "_prev_fail_ts", "_marker", "_last_marker", "_prev_marker")
    )


def provider_breaker(
    outcomes: DataFrame,
    key: Sequence[str] = ("provider", "route_id"),
    ts_col: str = "ts",
    id_col: str = "event_id",
    threshold: int = 5,
    cooldown_s: float = 30.0,
    chunk_s: int = 3600,
) -> DataFrame:
    """B1, provider variant: any success closes the breaker and clears its failures.

    Adds ``seen`` (closed / open / half_open: what a call finds before its own
    outcome; half_open from ``cooldown_s`` after the failure that opened it or
    kept it open), ``failures`` and ``state`` after the outcome, and
    ``transition`` (opened / probe_failed / closed).  As one success is enough,
    a call's state follows from the failures since the latest success: one
    running sum and one last-value scan, both in chunks, so no task holds a key.
    """
    key = list(key)
    d = outcomes.withColumn("_chunk", SC.time_chunk(F.col(ts_col), chunk_s))
    d = SC.running_sums(d, key, "_chunk", [ts_col, id_col], {"_failed": (~F.col("success")).cast("bigint")})
    marks = {"_at_success": F.when(F.col("success"), F.col("_failed")), "_last_fail": F.when(~F.col("success"), F.col(ts_col))}
    d = SC.last_values(d, key, "_chunk", [ts_col, id_col], marks, inclusive=False)
    before = F.col("_failed") - (~F.col("success")).cast("bigint") - F.coalesce(F.col("_at_success"), F.lit(0))
    cooled = _secs(F.col(ts_col)) - _secs(F.col("_last_fail")) >= cooldown_s
    d = d.withColumn("seen", F.when(before < threshold, "closed").when(cooled, "half_open").otherwise("open"))
    d = d.withColumn("failures", F.when(F.col("success"), F.lit(0)).otherwise(before + 1))
    d = d.withColumn("state", F.when(F.col("failures") >= threshold, "open").otherwise("closed"))
    transition = (
        F.when((F.col("seen") == "closed") & (F.col("state") == "open"), "opened")
        .when((F.col("seen") != "closed") & F.col("success"), "closed")
        .when((F.col("seen") == "half_open") & ~F.col("success"), "probe_failed")
    )
    return d.select(*outcomes.columns, "seen", "failures", "state", transition.alias("transition"))


def failure_streaks(outcomes: DataFrame, key: Sequence[str] = ("provider",), ts_col: str = "ts", id_col: str = "event_id", chunk_s: int = 3600) -> DataFrame:
    """B2: longest run of consecutive failures per key (gaps and islands:
    island id = running count of successes)."""
    key = list(key)
    d = outcomes.withColumn("_chunk", SC.time_chunk(F.col(ts_col), chunk_s))
    d = SC.running_sums(d, key, "_chunk", [ts_col, id_col], {"_island": F.col("success").cast("int")})
    runs = d.where(~F.col("success")).groupBy(*key, "_island").agg(F.count(F.lit(1)).alias("run"), F.min(ts_col).alias("run_start"))
    return runs.groupBy(*key).agg(
        F.max("run").alias("longest_failure_streak"),
        F.count(F.lit(1)).alias("failure_runs"),
        F.min_by("run_start", F.struct(-F.col("run"), F.col("run_start"))).alias("longest_run_start"),
    )


def asof_breaker_state(
    probes: DataFrame,
    breaker: DataFrame,
    key: Sequence[str] = ("provider",),
    ts_col: str = "ts",
    id_col: str = "event_id",
    cooldown_s: float = 30.0,
    chunk_s: int = 3600,
) -> DataFrame:
    """As-of join: breaker state of ``key`` as seen by each probe row, from
    outcomes strictly before it ((ts, id) order, probe before the outcome of
    the same id).  Union + last-non-null scan; no range join."""
    key = list(key)
    p = probes.select(*key, ts_col, id_col, F.lit(0).alias("_kind"), F.lit(None).cast("string").alias("_st"), F.lit(None).cast(probes.schema[ts_col].dataType).alias("_lf"), F.col("_probe_id"))
    b = breaker.select(*key, ts_col, id_col, F.lit(1).alias("_kind"), F.col("state").alias("_st"), F.col("last_fail_ts").alias("_lf"), F.lit(None).cast("bigint").alias("_probe_id"))
    u = p.unionByName(b).withColumn("_chunk", SC.time_chunk(F.col(ts_col), chunk_s))
    u = SC.last_values(u, key, "_chunk", [ts_col, id_col, "_kind"], {"_asof_state": F.col("_st"), "_asof_lf": F.col("_lf")}, inclusive=False)
    u = u.where(F.col("_kind") == 0)
    eff = F.when(
        (F.col("_asof_state") == "open") & ((_secs(ts_col) - _secs(F.col("_asof_lf"))) >= cooldown_s), "half_open"
    ).otherwise(F.coalesce(F.col("_asof_state"), F.lit("closed")))
    return u.select("_probe_id", *key, eff.alias("breaker_state"))


def provider_choice(
    requests: DataFrame, breaker: DataFrame, chain: Sequence[str], ts_col: str = "ts", id_col: str = "event_id", cooldown_s: float = 30.0, key: str = "provider"
) -> DataFrame:
    """First provider of the chain (the request's own provider first,
    then the configured order) whose breaker is not open at request time;
    none -> ALL_PROVIDERS_DOWN.  Each request fans out to the (short,
    fixed) chain only."""
    ch = F.array(*[F.lit(c) for c in chain])
    order = F.array_distinct(F.concat(F.array(F.col(key)), ch))
    fan = requests.select(F.col(id_col).alias("_probe_id"), ts_col, id_col, F.col(key).alias("requested_provider"), F.posexplode(order).alias("priority", key))
    st = asof_breaker_state(fan.select("_probe_id", key, ts_col, id_col, "priority"), materialize(breaker.select(key, ts_col, id_col, "state", "last_fail_ts")), [key], ts_col, id_col, cooldown_s)
    fan = fan.join(st, ["_probe_id", key])
    ok = fan.where(F.col("breaker_state") != "open")
    best = ok.groupBy("_probe_id").agg(F.min_by(key, "priority").alias("chosen_provider"), F.min("priority").alias("fallback_depth"))
    base = requests.select(F.col(id_col).alias("_probe_id"), F.col(key).alias("requested_provider"))
    out = base.join(best, "_probe_id", "left")
    return out.select(
        F.col("_probe_id").alias(id_col),
        "requested_provider",
        "chosen_provider",
        F.coalesce("fallback_depth", F.lit(-1)).alias("fallback_depth"),
        F.when(F.col("chosen_provider").isNull(), "ARIA_SH_ALL_PROVIDERS_DOWN").alias("error_code"),
    )


def failover_counts(choices: DataFrame) -> DataFrame:
    """(from, to) failover counts."""
    return (
        choices.where(F.col("chosen_provider").isNotNull() & (F.col("chosen_provider") != F.col("requested_provider")))
        .groupBy(F.col("requested_provider").alias("from_provider"), F.col("chosen_provider").alias("to_provider"))
        .agg(F.count(F.lit(1)).alias("failovers"))
    )


def latency_ranking(
    requests: DataFrame, ts_col: str = "ts", window: str = "5 minutes", slide: str = "1 minute", min_samples: int = 10, excluded: DataFrame | None = None
) -> DataFrame:
    """B5 (+B7): per sliding window rank provider+model by p95 then p50;
    any candidate under ``min_samples`` -> round-robin for that window.
    ``excluded(window_start, provider)`` removes breaker-open providers."""
    g = requests.groupBy(F.window(ts_col, window, slide).alias("w"), "provider", "model").agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("latency_ms", 0.5).alias("p50"),
        F.percentile_approx("latency_ms", 0.95).alias("p95"),
    ).select(F.col("w.start").alias("window_start"), "provider", "model", "n", "p50", "p95")
    if excluded is not None:
        g = g.join(excluded, [c for c in excluded.columns if c in ("window_start", "provider", "model")], "left_anti")
    w = Window.partitionBy("window_start")
    mode = F.when(F.min("n").over(w) >= min_samples, "latency").otherwise("round_robin")
    r = F.row_number().over(Window.partitionBy("window_start").orderBy("p95", "p50", "provider", "model"))
    return g.withColumn("mode", mode).withColumn("rank", r)


def cost_ranking(stats: DataFrame, quality_threshold: float, key: str = "route_id") -> DataFrame:
    """Cheapest model with quality >= threshold (tie: lower latency);
    none qualifies -> highest quality with a warning.  ``stats(route_id,
    model, price, quality, p50)``, small per-route candidate table."""
    w_cheap = Window.partitionBy(key).orderBy("price", "p50", "model")
    w_best = Window.partitionBy(key).orderBy(F.col("quality").desc(), "price", "model")
    ok = stats.where(F.col("quality") >= quality_threshold).withColumn("_r", F.row_number().over(w_cheap)).where(F.col("_r") == 1)
    fallback = stats.join(ok.select(key), key, "left_anti").withColumn("_r", F.row_number().over(w_best)).where(F.col("_r") == 1)
    return ok.withColumn("selection", F.lit("cheapest_qualified")).unionByName(fallback.withColumn("selection", F.lit("highest_quality_warning"))).drop("_r")


def price_table_rows() -> list[tuple[str, float]]:
    return [(m, float(i) + float(o)) for m, (i, o) in DEFAULT_PRICING.items() if m != "_default"]


def availability_report(breaker: DataFrame, key: Sequence[str] = ("provider",), ts_col: str = "ts", id_col: str = "event_id", chunk_s: int = 3600) -> DataFrame:
    """Success share and seconds spent open per key.  Open time is the
    sum over open events of (next event time - event time); the next event is
    found inside the time chunk, or for a chunk's last row from the small
    table of chunk start times (no window over a whole key)."""
    key = list(key)
    d = breaker.withColumn("_chunk", SC.time_chunk(F.col(ts_col), chunk_s))
    w = Window.partitionBy(*key, "_chunk").orderBy(ts_col, id_col)
    d = d.withColumn("_next", F.lead(ts_col).over(w))
    firsts = d.groupBy(*key, "_chunk").agg(F.min(ts_col).alias("_first"))
    firsts = firsts.select(*key, "_chunk", F.lead("_first").over(Window.partitionBy(*key).orderBy("_chunk")).alias("_next_chunk_first"))
    d = d.join(firsts, [*key, "_chunk"], "left").withColumn("_next", F.coalesce("_next", "_next_chunk_first"))
    dur = F.when(F.col("state") == "open", _secs("_next") - _secs(ts_col)).otherwise(F.lit(0.0))
    return d.groupBy(*key).agg(
        F.count(F.lit(1)).alias("requests"),
        F.avg(F.col("success").cast("double")).alias("success_share"),
        F.round(F.sum(F.coalesce(dur, F.lit(0.0))), 3).alias("open_seconds"),
        F.sum(F.when(F.col("transition") == "opened", 1).otherwise(0)).cast("bigint").alias("times_opened"),
    )
