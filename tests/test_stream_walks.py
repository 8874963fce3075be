"""C12 and the throttle on streams: several micro-batches, rows out of order inside a batch, a restart."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from gatewise.operators.canary import shadow_auto_disable
from gatewise.operators.spacing import greedy_spacing
from gatewise.streaming import walks as W

BATCHES = 6


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    keep = spark.conf.get(name)
    W.use_rocksdb(spark)
    yield
    spark.conf.set(name, keep)


def _rows():
    rnd = random.Random(12)
    rows, s = [], 0.0
    for i in range(240):
        s += rnd.choice([0.0, 1.0, 20.0, 45.0, 59.5, 200.0, 301.0])
        rows.append((rnd.choice(["hot", "hot", "b"]), 1_700_000_000 + s, i, rnd.random() < 0.25))
    return rows


def _frame(spark, rows):
    df = spark.createDataFrame(rows, "k string, s double, id long, success boolean")
    return df.select("k", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("ts"), "id", "success")


def _drain(spark, src, schema, make, folder, out):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = make(stream).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", os.path.join(folder, "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None


@pytest.mark.parametrize("which", ["shadow", "throttle"])
def test_stream_equals_batch(spark, rocksdb, which):
    rows = _rows()
    folder = tempfile.mkdtemp(prefix="gw-walk-")
    src, out = os.path.join(folder, "in"), os.path.join(folder, "out")
    per = len(rows) // BATCHES
    rnd = random.Random(1)
    parts = [rows[i * per : (i + 1) * per] for i in range(BATCHES)]
    end = rows[-1][1]
    parts.append([("flush", end + 100_000, 10_000, True)])  # moves the watermark past all rows
    parts.append([("flush", end + 200_000, 10_001, True)])
    for part in parts:
        rnd.shuffle(part)

    def make(s):
        return W.shadow_disable_stream(s, "k", watermark="1 second") if which == "shadow" else W.throttle_stream(s, "k", id_col="id", watermark="1 second")

    def put(some):
        for i in some:
            _frame(spark, parts[i]).coalesce(1).write.mode("append").parquet(src)

    schema = _frame(spark, rows[:1]).schema
    put(range(3))
    _drain(spark, src, schema, make, folder, out)
    put(range(3, len(parts)))  # a restart from the checkpoint
    _drain(spark, src, schema, make, folder, out)
    got = spark.read.parquet(out).where("key <> 'flush'")
    batch = _frame(spark, rows)
    if which == "shadow":
        want = shadow_auto_disable(batch, "k", "ts", "id").select(F.col("id").cast("string"), "skipped", "tripped", "fail_count")
        got = got.select("id", "skipped", "tripped", "fail_count")
    else:
        want = greedy_spacing(batch, "k", "ts", "id", 60.0).select(F.col("id").cast("string"), "admitted", "retry_after")
        got = got.select("id", "admitted", "retry_after")
    found, expected = sorted(map(tuple, got.collect())), sorted(map(tuple, want.collect()), key=lambda r: r[0])
    assert sorted(found, key=lambda r: r[0]) == expected and len(found) == len(rows)
