"""Progressive delivery operators.

Traffic is first reduced to 10-second buckets per (route, version) with
partial aggregation; every rate, verdict and fold runs on those buckets, so
the only full-volume shuffle is the bucket aggregate itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewise.operators import folds
from gatewise.operators.common import in_intervals
from gatewise.operators.jsondiff import diff_bodies
from gatewise.operators.walks import failure_rule, walk

BUCKET_S = 10


def hash_pct(key: Column, hash_fn: str = "crc32") -> Column:
    """0..99 bucket of a key: crc32 (reference) or md5 prefix (portable)."""
    if hash_fn == "crc32":
        return F.pmod(F.crc32(key.cast("binary")), F.lit(100))
    if hash_fn == "md5":
        return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint"), F.lit(100))
    if hash_fn == "xxhash64":
        return F.pmod(F.xxhash64(key), F.lit(100))
    raise ValueError(hash_fn)


def assign_version(df: DataFrame, key_col: str, pct: int, hash_fn: str = "crc32", seed: int | None = None) -> DataFrame:
    """``hash(client) % 100 < pct`` -> canary; ``seed`` switches to seeded random mode."""
    bucket = (F.rand(seed) * 100).cast("int") if seed is not None else hash_pct(F.col(key_col), hash_fn)
    return df.withColumn("assigned_version", F.when(bucket < pct, "canary").otherwise("baseline"))


def split_accuracy(assigned: DataFrame, pct: int, keys: Sequence[str] = ("route_id",), tolerance_pp: float = 1.0) -> DataFrame:
    """Observed canary share vs configured pct."""
    g = assigned.groupBy(*keys).agg(F.count(F.lit(1)).alias("requests"), F.sum(F.when(F.col("assigned_version") == "canary", 1).otherwise(0)).alias("canary"))
    share = F.col("canary") / F.col("requests") * 100
    return g.withColumn("canary_pct", share).withColumn("deviation_pp", F.abs(share - F.lit(float(pct)))).withColumn(
        "within_tolerance", F.col("deviation_pp") <= tolerance_pp
    )


def error_buckets(df: DataFrame, ts_col: str = "ts_dense", keys: Sequence[str] = ("route_id", "version"), bucket_s: int = BUCKET_S) -> DataFrame:
    """10-second tumbling counts of requests and 5xx."""
    return (
        df.groupBy(*keys, F.window(ts_col, f"{bucket_s} seconds").alias("w"))
        .agg(F.count(F.lit(1)).alias("total"), F.sum(F.when(F.col("status") >= 500, 1).otherwise(0)).cast("bigint").alias("errors"))
        .select(*keys, F.col("w.start").alias("bucket_start"), "total", "errors")
    )


def error_rate(buckets: DataFrame, window_seconds: int = 60, keys: Sequence[str] = ("route_id", "version"), bucket_s: int = BUCKET_S) -> DataFrame:
    """C4: sums over the last floor(window/10) buckets including the current
    one (range frame on bucket epoch seconds); rate 0 without traffic."""
    n = max(window_seconds // bucket_s, 1)
    epoch = F.unix_timestamp(F.col("bucket_start").cast("timestamp"))
    w = Window.partitionBy(*keys).orderBy(epoch).rangeBetween(-(n - 1) * bucket_s, 0)
    return (
        buckets.withColumn("win_total", F.sum("total").over(w))
        .withColumn("win_errors", F.sum("errors").over(w))
        .withColumn("error_rate", F.when(F.col("win_total") > 0, F.col("win_errors") / F.col("win_total")).otherwise(F.lit(0.0)))
    )


def verdicts_from_traffic(
    df: DataFrame,
    ts_col: str = "ts_dense",
    window_seconds: int = 60,
    threshold_pp: float = 2.0,
    min_requests: int = 10,
    baseline_max: float = 0.10,
    key: str = "route_id",
    bucket_s: int = BUCKET_S,
) -> DataFrame:
    """C3 -> C5 in one pass: 10-second buckets per route with canary and
    baseline counts side by side (conditional sums, one shuffle), then one
    rolling range window per route for both versions -- no per-version
    windows and no full outer join."""
    is_c = F.col("version") == "canary"
    is_err = F.col("status") >= 500
    b = df.groupBy(key, F.window(ts_col, f"{bucket_s} seconds").alias("w")).agg(
        F.sum(is_c.cast("int")).alias("c_n"), F.sum((is_c & is_err).cast("int")).alias("c_e"),
        F.sum((~is_c).cast("int")).alias("b_n"), F.sum((~is_c & is_err).cast("int")).alias("b_e"),
    ).select(key, F.col("w.start").alias("bucket_start"), "c_n", "c_e", "b_n", "b_e")
    n = max(window_seconds // bucket_s, 1)
    epoch = F.unix_timestamp(F.col("bucket_start").cast("timestamp"))
    w = Window.partitionBy(key).orderBy(epoch).rangeBetween(-(n - 1) * bucket_s, 0)
    r = b.select(key, "bucket_start", *[F.sum(c).over(w).alias(c) for c in ("c_n", "c_e", "b_n", "b_e")])
    rate = lambda e, t: F.when(F.col(t) > 0, F.col(e) / F.col(t)).otherwise(F.lit(0.0))
    r = r.select(
        key, "bucket_start", F.col("c_n").alias("canary_total"), F.col("b_n").alias("baseline_total"),
        rate("c_e", "c_n").alias("canary_rate"), rate("b_e", "b_n").alias("baseline_rate"),
    )
    delta = (F.col("canary_rate") - F.col("baseline_rate")) * 100
    verdict = (
        F.when(F.col("baseline_rate") > baseline_max, "baseline_unhealthy")
        .when((F.col("canary_total") >= min_requests) & (delta > threshold_pp), "breach")
        .when(F.col("canary_total") < min_requests, "insufficient")
        .otherwise("ok")
    )
    return r.withColumn("delta_pp", delta).withColumn("verdict", verdict)


def latency_guard(df: DataFrame, window: str = "60 seconds", ratio: float = 1.5, min_requests: int = 50, ts_col: str = "ts_dense", key: str = "route_id") -> DataFrame:
    """Canary p95 > baseline p95 x 1.5 with >= 50 requests each -> pause."""
    g = df.groupBy(key, F.window(ts_col, window).alias("w"), "version").agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("latency_ms", 0.95).alias("p95")
    )
    c = g.where(F.col("version") == "canary").select(key, "w", F.col("n").alias("canary_n"), F.col("p95").alias("canary_p95"))
    b = g.where(F.col("version") == "baseline").select(key, "w", F.col("n").alias("baseline_n"), F.col("p95").alias("baseline_p95"))
    j = c.join(b, [key, "w"], "full_outer")
    pause = (F.col("canary_n") >= min_requests) & (F.col("baseline_n") >= min_requests) & (F.col("canary_p95") > F.col("baseline_p95") * ratio)
    return j.select(key, F.col("w.start").alias("window_start"), "canary_n", "baseline_n", "canary_p95", "baseline_p95", F.coalesce(pause, F.lit(False)).alias("latency_pause"))


def stage_replay(verdicts: DataFrame, key: str = "route_id", bucket_s: int = BUCKET_S, **policy) -> DataFrame:
    """Keyed ordered fold of the rollout state machine over the verdict
    ticks (one per route and bucket; tick time = bucket end)."""
    ticks = verdicts.select(
        F.col(key).alias("k"),
        (F.col("bucket_start") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(bucket_s))).alias("ts"),
        F.unix_timestamp(F.col("bucket_start").cast("timestamp")).alias("id"),
        "verdict",
        F.col("canary_total").cast("bigint").alias("canary_total"),
        (F.lit(True) if "latency_pause" not in verdicts.columns else ~F.col("latency_pause")).alias("latency_ok"),
        (F.col("manual") if "manual" in verdicts.columns else F.lit(None).cast("string")).alias("manual"),
    )

    def fn(pdf):
        out = folds.stage_fold(pdf, **policy)
        out.insert(0, "k", pdf["k"].iloc[0] if len(pdf) else None)
        return out

    res = ticks.groupBy("k").applyInPandas(fn, "k string, id long, state string, traffic_pct int, stage int, event string")
    return ticks.join(res, ["k", "id"]).select(F.col("k").alias(key), "ts", "verdict", "state", "traffic_pct", "stage", "event")


def stage_timeline(replay: DataFrame, key: str = "route_id") -> DataFrame:
    """Intervals of constant traffic_pct per route with durations."""
    w = Window.partitionBy(key).orderBy("ts")
    chg = replay.withColumn("_prev", F.lag("traffic_pct").over(w)).where(F.col("_prev").isNull() | (F.col("_prev") != F.col("traffic_pct")))
    w2 = Window.partitionBy(key).orderBy("ts")
    return chg.select(
        key,
        "traffic_pct",
        "state",
        F.col("ts").alias("start_ts"),
        F.lead("ts").over(w2).alias("end_ts"),
    ).withColumn("duration_s", F.unix_timestamp(F.col("end_ts").cast("timestamp")) - F.unix_timestamp(F.col("start_ts").cast("timestamp")))


def rollback_events(replay: DataFrame, key: str = "route_id") -> DataFrame:
    """Rollback transitions with a notification payload."""
    r = replay.where(F.col("event").startswith("rolled_back"))
    payload = F.to_json(F.struct(F.lit("canary_rollback").alias("type"), F.col(key).alias("route_id"), F.col("event").alias("reason"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp")))
    return r.select(key, "ts", "event", F.lit("CANARY_ROLLBACK").alias("event_type"), F.lit("ROLLED_BACK").alias("action_taken"), payload.alias("notification"))


def shadow_sample(requests: DataFrame, pct: int = 10, key: str = "request_id", hash_fn: str = "xxhash64", disabled: DataFrame | None = None, ts_col: str = "ts") -> DataFrame:
    """C11: deterministic hash sample; rows inside disabled periods
    (``disabled(start, end)``) are excluded."""
    s = requests.where(hash_pct(F.col(key), hash_fn) < pct)
    if disabled is not None:
        s = in_intervals(s, ts_col, disabled, "left_anti")
    return s


def shadow_auto_disable(
    outcomes: DataFrame, key: str, ts_col: str = "ts", id_col: str = "id", threshold: int = 3, window_s: float = 300.0, disable_s: float = 300.0, **how
) -> DataFrame:
    """At ``threshold`` failures, each within ``window_s`` of the one before,
    shadowing pauses for ``disable_s``; rows inside the pause are skipped.

    A walk by chunk maps (``walks``): an outage of any length and a key with
    all rows are many tasks.
    """
    found = walk(outcomes, key, ts_col, id_col, "success", failure_rule(threshold, window_s, disable_s), threshold, max(window_s, disable_s), **how)
    marks = found.select(id_col, (~F.col("visited")).alias("skipped"), F.col("jumped").alias("tripped"), F.col("lane").alias("fail_count"))
    return outcomes.join(marks, id_col, "left")


def weighted_assignment(df: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """Each row goes to the group whose cumulative weight range holds the
    row's place: the first 32 bits of the key's md5, scaled to the total weight,
    so that small weights get their share too.  The weights of a route are one
    array (a scalar subquery), so the rows are only projected.  NULL keys and
    tables without weight give a NULL group."""
    w = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, 0)
    ends = weights.where(F.col("weight") > 0).select(F.sum("weight").over(w).alias("hi"), "group")
    d = df.withColumn("_table", ends.agg(F.array_sort(F.collect_list(F.struct("hi", "group")))).scalar())
    place = F.conv(F.substring(F.md5(F.col(key)), 1, 8), 16, 10).cast("bigint") * F.try_element_at("_table", F.lit(-1))["hi"]
    hit = F.filter("_table", lambda g: F.col("_place") < g["hi"] * F.lit(1 << 32))
    return d.withColumn("_place", place).withColumn("group", F.try_element_at(hit, F.lit(1))["group"]).drop("_table", "_place")


def basic_diff(primary: DataFrame, shadow: DataFrame, key: str = "request_id") -> DataFrame:
    """C14: status match, body-length delta, latency delta, diff type."""
    j = primary.join(shadow, key)
    status_match = F.col("status_p") == F.col("status_s")
    dbytes = F.abs(F.col("bytes_s") - F.col("bytes_p"))
    return j.select(
        key,
        status_match.alias("status_match"),
        dbytes.alias("body_length_delta"),
        F.floor(F.col("latency_s") - F.col("latency_p")).cast("bigint").alias("latency_delta_ms"),
        F.when(~status_match, "status").when(dbytes != 0, "body_length").otherwise("none").alias("diff_type"),
    )


def structural_diff(pairs: DataFrame, key: str = "request_id", body_p: str = "body_p", body_s: str = "body_s") -> DataFrame:
    """Leaf-level diff of two JSON bodies: Sorensen-Dice similarity over
    (path, type, value) leaves and the differing paths.

    One pass over each row (``jsondiff``): equal subtrees are settled by their
    text, no shuffle.  Bodies without leaves on either side are alike (1.0).
    """
    d = diff_bodies(pairs.select(key, body_p, body_s), body_p, body_s)
    leaves = F.col("n_a") + F.col("n_b")
    sim = F.when(leaves == 0, F.lit(1.0)).otherwise(2.0 * F.col("n_same") / leaves)
    return d.select(key, F.round(sim, 6).alias("similarity"), "diff_fields")


def diff_choice(pairs: DataFrame, max_bytes: int = 1024 * 1024) -> DataFrame:
    """Structural diff when both bodies exist, <= 1 MiB, not event-stream."""
    ok = (
        F.col("body_p").isNotNull()
        & F.col("body_s").isNotNull()
        & (F.octet_length("body_p") <= max_bytes)
        & (F.octet_length("body_s") <= max_bytes)
        & ~F.coalesce(F.lower(F.col("content_type")).contains("event-stream"), F.lit(False))
    )
    return pairs.withColumn("diff_mode", F.when(ok, "structural").otherwise("basic"))


def diff_report(diffs: DataFrame, keys: Sequence[str] = ("route_id", "diff_type")) -> DataFrame:
    """C17: counts and quantiles of latency delta and similarity."""
    return diffs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("latency_delta_ms", 0.5).alias("latency_delta_p50"),
        F.percentile_approx("latency_delta_ms", 0.95).alias("latency_delta_p95"),
        F.percentile_approx("similarity", 0.5).alias("similarity_p50"),
        F.min("similarity").alias("similarity_min"),
    )


def canary_status(replay: DataFrame, verdicts: DataFrame, key: str = "route_id") -> DataFrame:
    """Latest state per route with its rates (``max_by`` per route)."""
    last = replay.groupBy(key).agg(F.max_by(F.struct("ts", "state", "traffic_pct", "stage"), F.col("ts")).alias("s"))
    lv = verdicts.groupBy(key).agg(F.max_by(F.struct("canary_rate", "baseline_rate", "canary_total", "baseline_total"), F.col("bucket_start")).alias("r"))
    return last.join(lv, key).select(key, "s.ts", "s.state", "s.traffic_pct", "s.stage", "r.canary_rate", "r.baseline_rate", "r.canary_total", "r.baseline_total")
