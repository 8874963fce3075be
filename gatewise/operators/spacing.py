"""Greedy spacing: admit a row when ``window`` seconds have passed since the
last admitted row of its key (the throttle rule, one request per 60 s).

The rule feeds on its own output, so it is not a window function; it is a walk
that skips (``walks``), exact for keys of any length without a group that
holds a whole key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewise.operators.walks import spacing_rule, walk


def greedy_spacing(df: DataFrame, key: str, ts_col: str, id_col: str, window_s: float, **how) -> DataFrame:
    """(``id_col``, admitted, retry_after) for every input row; ids may be of any type."""
    rows = df.select(F.col(key).alias("_k"), F.col(ts_col).alias("_ts"), F.col(id_col), F.lit(True).alias("_m"))
    found = walk(rows, "_k", "_ts", id_col, "_m", spacing_rule(window_s), 1, window_s, **how)
    left = F.col("_waits") - F.unix_micros(F.col("_ts").cast("timestamp"))
    timed = found.select(F.col(id_col), F.col("visited").alias("admitted"), F.col("waits_us").alias("_waits")).join(rows.select(id_col, "_ts"), id_col)
    return timed.select(id_col, "admitted", F.when(~F.col("admitted"), F.ceil(left / 1_000_000)).cast("long").alias("retry_after"))
