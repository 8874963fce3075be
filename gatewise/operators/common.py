"""Shared helpers for operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Dimensions above this many rows are joined by shuffle instead of broadcast.
BROADCAST_MAX_ROWS = 200_000


def bounded_broadcast(dim: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, known_rows: int | None = None) -> DataFrame:
    """Broadcast ``dim`` only when its row count is proven below ``max_rows``.

    ``known_rows`` skips the check for dimensions built from a Python list of
    known length.  Otherwise one cheap ``count`` over the (small) dimension
    decides; a dimension that has grown past the bound is returned unchanged
    and Spark/AQE picks a shuffle join.
    """
    n = known_rows if known_rows is not None else dim.limit(max_rows + 1).count()
    return F.broadcast(dim) if n <= max_rows else dim


def in_intervals(rows: DataFrame, ts_col: str, intervals: DataFrame, how: str, closed: bool = False, bucket_s: int = 3600) -> DataFrame:
    """``rows`` joined (``how``: left, left_anti or left_semi) to ``intervals(start, end)``.

    Overlapping intervals are merged first, so a row meets one at most; each is
    dealt over the time buckets it touches, which makes the join an equality on
    the bucket.  ``closed`` counts ``end`` itself in.  Spark picks broadcast or
    shuffle from the sizes.  A left join adds ``_start`` (NULL: in none).
    """
    before = Window.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    known = intervals.where(F.col("start") <= F.col("end")).select("start", "end")
    apart = F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True))
    runs = known.withColumn("_new", apart.cast("int")).withColumn("_run", F.sum("_new").over(Window.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy("_run").agg(F.min("start").alias("_start"), F.max("end").alias("_end")).drop("_run")
    bucket = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / bucket_s)
    dealt = merged.withColumn("_bucket", F.explode(F.sequence(bucket("_start"), bucket("_end"))))
    inside = (F.col(ts_col) >= F.col("_start")) & (F.col(ts_col) <= F.col("_end") if closed else F.col(ts_col) < F.col("_end"))
    out = rows.withColumn("_at", bucket(ts_col)).join(dealt, (F.col("_at") == F.col("_bucket")) & inside, how)
    return out.drop("_at", "_bucket", "_end")


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy row-wise work (regex scans, JSON walks) at least one
    partition per core.

    Large inputs already have far more splits than cores and pass through
    untouched; a small input stored as one row group (one busy task) is
    round-robin repartitioned, a shuffle of the few rows it has.
    """
    par = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(par) if df.rdd.getNumPartitions() < par else df


def bound_batch_bytes(spark: SparkSession, most: int = 16 * 1024 * 1024) -> None:
    """Lower the session's bound on the bytes of an Arrow batch to ``most``, for
    rows of megabytes each (a lower bound that the caller has set stays)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("bB")
    if not now.isdigit() or not 0 < int(now) <= most:
        spark.conf.set(name, str(most))


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage between stages of a multi-pass operator.

    Writes ``df`` once as parquet to a fresh folder under the shared
    ``spark.checkpoint.dir`` and reads it back.  Later passes that read it
    twice (rows and their chunk summary) do not recompute its upstream, the
    read-back is column-pruned, and the files survive executor loss.  (An
    eager ``checkpoint()`` would compute the plan twice: once to count, once
    to write.)
    """
    import uuid

    from gatewise.session import ensure_checkpoint_dir

    root = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{root}/stages/{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
