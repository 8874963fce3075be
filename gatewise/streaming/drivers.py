"""Structured Streaming drivers (T5, C3/C4, Q8, U5, B1; the walks of C12 and Q6 are in ``walks``).

The same Column expressions as the batch operators, on ``readStream``
sources.  Event time is the ``ts`` column; watermarks play the role of the
reference's counter TTLs (2 minutes for error buckets, 48 hours for quota
and alert keys); late rows are dropped by the watermark and show up in
``numRowsDroppedByWatermark`` of the query progress.  Checkpoints go under
the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gatewise.session import ensure_checkpoint_dir
from gatewise.sources import sinks as T


def _evt(df: DataFrame, ts_col: str) -> DataFrame:
    """Watermarks need TIMESTAMP; NTZ event times are read as UTC."""
    return df.withColumn(ts_col, F.col(ts_col).cast("timestamp"))


def checkpoint_for(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"


def commit_batch(batch: DataFrame, epoch: int, path: str, partition: str | None = None) -> bool:
    """Publishes a micro-batch once, however often it is replayed.

    Its rows go to ``path/batch=<epoch>``, which a replay overwrites; then the
    epoch is written to ``path``'s manifest.  An epoch that the manifest holds
    is left alone, one that it does not hold is invisible to ``committed``.
    Returns whether the batch was written now.
    """
    spark = batch.sparkSession
    manifest = f"{path.rstrip('/')}_commits"
    if _commits(spark, manifest).where(F.col("batch") == epoch).count():
        return False
    writer = batch.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(f"{path.rstrip('/')}/batch={epoch}")
    spark.range(1).select(F.lit(epoch).cast("long").alias("batch")).write.mode("append").parquet(manifest)
    return True


def _commits(spark: SparkSession, manifest: str) -> DataFrame:
    # no file yet: an empty manifest (only Spark's own readers look at the path)
    try:
        return spark.read.schema("batch long").parquet(manifest)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "batch long")


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all published batches under ``path``, each batch once."""
    commits = _commits(spark, f"{path.rstrip('/')}_commits").distinct()
    return spark.read.parquet(path).withColumn("batch", F.col("batch").cast("long")).join(commits, "batch", "left_semi")


def audit_drain_stream(
    spark: SparkSession, raw_dir: str, table_path: str, dead_path: str, name: str = "audit_drain", trigger: dict | None = None, watermark: str = "48 hours", files_per_trigger: int | None = None
) -> list[StreamingQuery]:
    """T5: JSON lines -> audit events by month, each (request_id, event_type)
    once, and a dead-letter table with reasons.

    Duplicates are dropped across micro-batches, within the watermark on the
    event's own time; both tables are published batch by batch through a
    manifest (``commit_batch``), so a replayed batch leaves no second row.
    Read them with ``committed``.  Two queries: dead letters have no event time.
    """
    trigger = trigger or {"processingTime": "5 seconds"}

    def lines() -> DataFrame:
        reader = spark.readStream.format("text")
        return (reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)).load(raw_dir)

    def started(df: DataFrame, path: str, part: str, partition: str | None) -> StreamingQuery:
        def sink(batch: DataFrame, epoch: int) -> None:
            commit_batch(T.with_month(batch) if partition else batch, epoch, path, partition)

        return df.writeStream.queryName(f"{name}-{part}").foreachBatch(sink).option("checkpointLocation", checkpoint_for(spark, f"{name}-{part}")).trigger(**trigger).start()

    good, _ = T.audit_split(lines())
    _, dead = T.audit_split(lines())
    once = good.withColumn("_at", F.col("timestamp").cast("timestamp")).withWatermark("_at", watermark).dropDuplicatesWithinWatermark(["request_id", "event_type"]).drop("_at")
    return [started(once, table_path, "events", "month"), started(dead, dead_path, "dead", None)]


def error_buckets_stream(events: DataFrame, ts_col: str = "ts", watermark: str = "2 minutes") -> DataFrame:
    """C3 on a stream: 10-second buckets per route and version (append mode
    emits a bucket once the watermark passes its end)."""
    return (
        _evt(events, ts_col).withWatermark(ts_col, watermark)
        .groupBy(F.window(ts_col, "10 seconds").alias("w"), "route_id", "version")
        .agg(F.count(F.lit(1)).alias("total"), F.sum(F.when(F.col("status") >= 500, 1).otherwise(0)).alias("errors"))
        .select("route_id", "version", F.col("w.start").alias("bucket_start"), "total", "errors")
    )


def error_rate_stream(events: DataFrame, ts_col: str = "ts", watermark: str = "2 minutes") -> DataFrame:
    """C4 on a stream: 60-second windows sliding by 10 seconds."""
    return (
        _evt(events, ts_col).withWatermark(ts_col, watermark)
        .groupBy(F.window(ts_col, "60 seconds", "10 seconds").alias("w"), "route_id", "version")
        .agg(F.count(F.lit(1)).alias("total"), F.sum(F.when(F.col("status") >= 500, 1).otherwise(0)).alias("errors"))
        .select("route_id", "version", F.col("w.end").alias("ts"), "total", "errors", F.when(F.col("total") > 0, F.col("errors") / F.col("total")).otherwise(0.0).alias("error_rate"))
    )


def alert_dedupe_stream(alerts: DataFrame, ts_col: str = "alert_ts", watermark: str = "48 hours") -> DataFrame:
    """Q8 on a stream: one alert per (consumer, quota type, threshold, period)."""
    return _evt(alerts, ts_col).withWatermark(ts_col, watermark).dropDuplicatesWithinWatermark(["consumer_id", "quota_type", "threshold_pct", "period"])


def reassemble_stream(chunks: DataFrame, ts_col: str = "ts", idle: str = "30 seconds", watermark: str = "2 minutes") -> DataFrame:
    """U5 on a stream: a stream's chunks are a session closed after 30 s idle."""
    payload = F.regexp_extract(F.col("data"), r"^data: (.+)$", 1)
    is_done = F.trim(payload) == "[DONE]"
    delta = F.when(~is_done, F.get_json_object(payload, "$.choices[0].delta.content"))
    c = _evt(chunks, ts_col).withWatermark(ts_col, watermark).select("stream_id", "seq", ts_col, is_done.alias("_done"), delta.alias("_delta"))
    g = c.groupBy(F.session_window(ts_col, idle).alias("s"), "stream_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("_delta").isNotNull(), F.struct(F.col("seq").alias("s"), F.col("_delta").alias("t"))))).alias("_parts"),
        F.max(F.col("_done").cast("int")).alias("_d"),
        F.count(F.lit(1)).alias("n_chunks"),
    )
    return g.select("stream_id", F.array_join(F.transform("_parts", lambda p: p["t"]), "").alias("content"), "n_chunks", (F.col("_d") == 1).alias("done"), (F.col("_d") == 0).alias("interrupted"))


BREAKER_STATE_SCHEMA = "state string, failures long, opened_at double, last_fail double"
BREAKER_OUT_SCHEMA = "key string, event_id long, ts timestamp, state string"


def breaker_stream(outcomes: DataFrame, key: str = "provider", ts_col: str = "ts", id_col: str = "event_id", threshold: int = 3, cooldown_s: float = 30.0) -> DataFrame:
    """B1 on a stream: keyed state (state, failures, opened_at) carried across
    micro-batches with ``applyInPandasWithState``; each batch's rows of a key
    are folded in (ts, id) order.  Emits the state after every outcome, the
    same rows the batch replay gives."""
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def fold(k, pdfs, state):
        if state.exists:
            st, failures, opened, _ = state.get
        else:
            st, failures, opened = "closed", 0, float("nan")
        outs = []
        for pdf in pdfs:
            pdf = pdf.sort_values([ts_col, id_col], kind="mergesort")
            t = pdf[ts_col].astype("datetime64[us]").astype("int64").to_numpy() / 1e6
            ok = pdf["success"].to_numpy(dtype=bool)
            res = []
            for i in range(len(pdf)):
                if st == "open" and t[i] - opened >= cooldown_s:
                    st = "half_open"
                if ok[i]:
                    if st == "half_open":
                        st, failures = "closed", 0
                    elif st == "closed":
                        failures = 0
                else:
                    if st == "half_open":
                        st, opened = "open", t[i]
                    else:
                        failures += 1
                        if failures >= threshold:
                            st, opened = "open", t[i]
                res.append("open" if st == "open" else "closed")
            outs.append(pd.DataFrame({"key": k[0], "event_id": pdf[id_col].to_numpy(), "ts": pdf[ts_col].to_numpy(), "state": res}))
        state.update((st, int(failures), float(opened) if opened == opened else float("nan"), float("nan")))
        yield pd.concat(outs) if outs else pd.DataFrame({"key": [], "event_id": np.array([], dtype="int64"), "ts": [], "state": []})

    src = _evt(outcomes, ts_col).select(F.col(key).alias("key"), ts_col, id_col, "success")
    return src.groupBy("key").applyInPandasWithState(fold, BREAKER_OUT_SCHEMA, BREAKER_STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def verdict_stream(traffic: DataFrame, ts_col: str = "ts", watermark: str = "2 minutes", threshold_pp: float = 2.0, min_requests: int = 10, baseline_max: float = 0.10) -> DataFrame:
    """C3-C5 on a stream: one sliding-window aggregation (60 s every 10 s)
    with canary and baseline counts side by side, then the verdict.  The row
    for window [s, s+60) equals the batch verdict of bucket s+50."""
    is_c = F.col("version") == "canary"
    is_err = F.col("status") >= 500
    g = (
        _evt(traffic, ts_col).withWatermark(ts_col, watermark)
        .groupBy(F.window(ts_col, "60 seconds", "10 seconds").alias("w"), "route_id")
        .agg(
            F.sum(is_c.cast("int")).alias("canary_total"), F.sum((is_c & is_err).cast("int")).alias("c_e"),
            F.sum((~is_c).cast("int")).alias("baseline_total"), F.sum((~is_c & is_err).cast("int")).alias("b_e"),
        )
    )
    cr = F.when(F.col("canary_total") > 0, F.col("c_e") / F.col("canary_total")).otherwise(F.lit(0.0))
    br = F.when(F.col("baseline_total") > 0, F.col("b_e") / F.col("baseline_total")).otherwise(F.lit(0.0))
    delta = (cr - br) * 100
    verdict = (
        F.when(br > baseline_max, "baseline_unhealthy")
        .when((F.col("canary_total") >= min_requests) & (delta > threshold_pp), "breach")
        .when(F.col("canary_total") < min_requests, "insufficient")
        .otherwise("ok")
    )
    return g.select(
        "route_id", (F.col("w.end") - F.expr("INTERVAL 10 SECONDS")).alias("bucket_start"), "canary_total", "baseline_total",
        cr.alias("canary_rate"), br.alias("baseline_rate"), verdict.alias("verdict"),
    )
