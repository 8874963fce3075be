"""Two-level (chunked) ordered scans for hot keys.

A running sum or "last non-null value" over all rows of a key is an
associative scan, so it splits exactly:

1. rows are ordered only inside (key, chunk) -- chunk is a time bucket --
   and scanned there with a window;
2. each chunk is reduced to one summary row (its total / its last value),
   pre-aggregated on the map side;
3. a window over the small summary table (one row per key and chunk) gives
   every chunk the carry of all earlier chunks;
4. the carry is joined back on (key, chunk) and combined.

The largest sort unit is one key-chunk instead of one key, so a key holding
a third of all rows is spread over as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_back(rows: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of per-chunk carries onto the rows on ``keys``.

    Null-safe equality keeps the optimizer from inferring IS NOT NULL filters
    on one branch only, so both branches keep an identical upstream and the
    shuffle feeding them is computed once (ReusedExchange).
    """
    s = summary.select(*[F.col(k).alias(f"_j_{k}") for k in keys], *[c for c in summary.columns if c not in keys])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_j_{k}"))
        cond = c if cond is None else cond & c
    return rows.join(s, cond, "left").drop(*[f"_j_{k}" for k in keys])


def time_chunk(ts: Column, seconds: int = 3600) -> Column:
    """Chunk id of a timestamp: floor(epoch / seconds)."""
    return F.floor(F.unix_timestamp(ts.cast("timestamp")) / seconds).cast("bigint")


def running_sums(df: DataFrame, key: Sequence[str], chunk: str, order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Inclusive running sums per key in ``order``; adds one column per name."""
    key = list(key)
    w_in = Window.partitionBy(*key, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = df
    for n, c in sums.items():
        d = d.withColumn(f"_v_{n}", c).withColumn(f"_ls_{n}", F.sum(f"_v_{n}").over(w_in))
    summ = d.groupBy(*key, chunk).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    w_k = Window.partitionBy(*key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.select(*key, chunk, *[F.coalesce(F.sum(f"_t_{n}").over(w_k), F.lit(0)).alias(f"_c_{n}") for n in sums])
    d = join_back(d, summ, [*key, chunk])
    for n in sums:
        d = d.withColumn(n, F.col(f"_ls_{n}") + F.col(f"_c_{n}")).drop(f"_v_{n}", f"_ls_{n}", f"_c_{n}")
    return d


def last_values(
    df: DataFrame,
    key: Sequence[str],
    chunk: str,
    order: Sequence[str],
    lasts: dict[str, Column],
    inclusive: bool = True,
    also_exclusive: dict[str, Column] | None = None,
) -> DataFrame:
    """Last non-null value per key in ``order`` (up to and including the row,
    or strictly before it with ``inclusive=False``).  ``also_exclusive``
    adds strictly-before scans of more values in the same pass."""
    key = list(key)
    specs = [(n, c, inclusive) for n, c in lasts.items()] + [(n, c, False) for n, c in (also_exclusive or {}).items()]
    w_base = Window.partitionBy(*key, chunk).orderBy(*order)
    ordk = F.struct(*[F.col(o) for o in order])
    d = df
    for n, c, inc in specs:
        w_in = w_base.rowsBetween(Window.unboundedPreceding, 0 if inc else -1)
        d = d.withColumn(f"_v_{n}", c).withColumn(f"_ll_{n}", F.last(f"_v_{n}", ignorenulls=True).over(w_in))
    summ = d.groupBy(*key, chunk).agg(*[F.max_by(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), ordk)).alias(f"_t_{n}") for n, _, _ in specs])
    w_k = Window.partitionBy(*key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.select(*key, chunk, *[F.last(f"_t_{n}", ignorenulls=True).over(w_k).alias(f"_c_{n}") for n, _, _ in specs])
    d = join_back(d, summ, [*key, chunk])
    for n, _, _ in specs:
        d = d.withColumn(n, F.coalesce(F.col(f"_ll_{n}"), F.col(f"_c_{n}"))).drop(f"_v_{n}", f"_ll_{n}", f"_c_{n}")
    return d
