"""Batch bounds for operators that read whole texts.

Spark cuts batches by rows; thousands of long texts are more than a reader or
a Python worker should hold, so the operators of this folder lower the session's bounds to
these (a lower bound that the caller has set stays).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

ROWS = 1000
BYTES = 16 * 1024 * 1024
READ_ROWS = 512


def bound_batches(spark: SparkSession) -> None:
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BYTES), ("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)):
        now = spark.conf.get(name, str(most))
        value = int(now.rstrip("bB")) if now.rstrip("bB").lstrip("-").isdigit() else 0
        if value <= 0 or value > most:
            spark.conf.set(name, str(most))
