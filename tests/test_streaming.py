"""Stream/batch equality on a file source driven with availableNow."""

import os
import tempfile

from pyspark.sql import functions as F

from gatewise.operators import canary as C
from gatewise.sources import gw_canary
from gatewise.streaming import drivers as D

SF = "/root/testdata/sf0.001"


def test_error_buckets_stream_equals_batch(spark):
    batch = gw_canary(spark, SF).withColumnRenamed("ts_dense", "ts")
    d = tempfile.mkdtemp(prefix="gw-stream-")
    src = os.path.join(d, "in")
    batch.write.parquet(src)
    stream = spark.readStream.schema(batch.schema).parquet(src)
    q = (
        D.error_buckets_stream(stream, "ts", "0 seconds")
        .writeStream.outputMode("append")
        .format("memory")
        .queryName("buckets_out")
        .option("checkpointLocation", os.path.join(d, "ckpt"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination(120)
    got = spark.sql("select * from buckets_out")
    exp = C.error_buckets(batch, "ts").withColumn("bucket_start", F.col("bucket_start").cast("timestamp"))
    # append mode emits every bucket closed by the final watermark; the last
    # open bucket per key may remain in state
    diff = got.exceptAll(exp.select(*got.columns))
    assert diff.count() == 0
    assert got.count() >= exp.count() - 10


def test_breaker_stream_equals_batch(spark):
    from gatewise.operators import providers as B
    from gatewise.sources import gw_requests

    r = gw_requests(spark, SF).select("model", F.col("ts_dense").alias("ts"), "event_id", (F.col("status") < 500).alias("success"))
    d = tempfile.mkdtemp(prefix="gw-brk-")
    src = os.path.join(d, "in")
    r.write.parquet(src)
    stream = spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (
        D.breaker_stream(stream, "model", "ts", "event_id", 2, 30.0)
        .writeStream.outputMode("append").format("memory").queryName("brk_out")
        .option("checkpointLocation", os.path.join(d, "ckpt")).trigger(availableNow=True).start()
    )
    q.awaitTermination(180)
    got = {(x.key, x.event_id, x.state) for x in spark.sql("select * from brk_out").collect()}
    exp = {(x.model, x.event_id, x.state) for x in B.breaker_replay(r, ["model"], "ts", "event_id", 2, 30.0).collect()}
    assert got == exp


def test_audit_drain_stream(spark):
    from gatewise.sources import sinks as T

    d = tempfile.mkdtemp(prefix="gw-audit-")
    raw = os.path.join(d, "raw")
    os.makedirs(raw)
    good = '{"id":"1","consumer_id":"c1","route_id":"r1","event_type":"QUOTA_EXCEEDED","action_taken":"BLOCKED","request_id":"q1","timestamp":"2024-01-01T00:00:01.000000"}'
    lines = [good, good, '{"id":"2","consumer_id":"c1","event_type":"NOT_AN_EVENT","timestamp":"2024-01-01T00:00:02.000000"}', '{"trunc']
    with open(os.path.join(raw, "part-0.json"), "w") as f:
        f.write("\n".join(lines) + "\n")
    table, dead = os.path.join(d, "audit"), os.path.join(d, "dead")
    for q in D.audit_drain_stream(spark, raw, table, dead, name=f"audit-{os.path.basename(d)}", trigger={"availableNow": True}):
        q.awaitTermination(120)
    got = D.committed(spark, table)
    assert got.count() == 1 and got.first().event_type == "QUOTA_EXCEEDED" and "month" in got.columns
    reasons = sorted(r.reason for r in D.committed(spark, dead).collect())
    assert reasons == ["bad_event_type", "unparseable"]
    assert T.EVENT_TYPES[2] == "QUOTA_EXCEEDED"


def test_verdict_stream_equals_batch(spark):
    batch_in = gw_canary(spark, SF).withColumnRenamed("ts_dense", "ts")
    d = tempfile.mkdtemp(prefix="gw-verdict-")
    src = os.path.join(d, "in")
    batch_in.write.parquet(src)
    stream = spark.readStream.schema(batch_in.schema).parquet(src)
    q = (
        D.verdict_stream(stream, "ts", "0 seconds").writeStream.outputMode("append").format("memory").queryName("verdict_out")
        .option("checkpointLocation", os.path.join(d, "ckpt")).trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    got = spark.sql("select route_id, bucket_start, canary_total, baseline_total, verdict from verdict_out")
    exp = C.verdicts_from_traffic(batch_in, "ts").select(
        "route_id", F.col("bucket_start").cast("timestamp").alias("bucket_start"), "canary_total", "baseline_total", "verdict"
    )
    common = exp.join(got.select("route_id", "bucket_start"), ["route_id", "bucket_start"])
    assert common.count() >= exp.count() - 10  # all but the still-open windows at the end
    assert common.exceptAll(got.join(exp.select("route_id", "bucket_start"), ["route_id", "bucket_start"]).select(*common.columns)).count() == 0


def _event(n, kind="QUOTA_EXCEEDED", second=0):
    return f'{{"id":"{n}","consumer_id":"c","route_id":"r","event_type":"{kind}","action_taken":"BLOCKED","request_id":"q{n}","timestamp":"2024-01-01T00:00:{second:02d}.000000"}}'


def test_audit_drain_is_exactly_once(spark):
    """A duplicate two batches later, a restart, and a replayed batch leave one row each."""
    d = tempfile.mkdtemp(prefix="gw-once-")
    raw, table, dead = (os.path.join(d, x) for x in ("raw", "audit", "dead"))
    os.makedirs(raw)

    def drop(i, lines):
        with open(os.path.join(raw, f"f{i}.json"), "w") as f:
            f.write("\n".join(lines) + "\n")
        os.utime(os.path.join(raw, f"f{i}.json"), (1_700_000_000 + i * 10,) * 2)

    def drain():
        for q in D.audit_drain_stream(spark, raw, table, dead, name=f"once-{os.path.basename(d)}", trigger={"availableNow": True}, files_per_trigger=1):
            q.awaitTermination(180)

    drop(0, [_event(1), _event(1), "{broken"])
    drop(1, [_event(2, second=5)])
    drop(2, [_event(1, second=9), _event(1, "PII_DETECTED", 9)])
    drain()
    drop(3, [_event(2, second=7), _event(3, second=2), "{broken"])
    drain()  # a restart from the checkpoint
    rows = sorted((r["request_id"], r["event_type"]) for r in D.committed(spark, table).collect())
    assert rows == [("q1", "PII_DETECTED"), ("q1", "QUOTA_EXCEEDED"), ("q2", "QUOTA_EXCEEDED"), ("q3", "QUOTA_EXCEEDED")]
    assert D.committed(spark, dead).count() == 2 and "month" in D.committed(spark, table).columns


def test_commit_batch_replays(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="gw-commit-"), "t")
    assert D.commit_batch(spark.range(3), 0, path) and not D.commit_batch(spark.range(3), 0, path)
    # a batch whose rows were written but which never reached the manifest: invisible, then written over
    spark.range(100, 107).write.parquet(f"{path}/batch=1")
    assert D.committed(spark, path).count() == 3
    assert D.commit_batch(spark.range(10, 12), 1, path)
    assert sorted(r["id"] for r in D.committed(spark, path).collect()) == [0, 1, 2, 10, 11]
