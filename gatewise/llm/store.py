"""Intermediate tables that an operator reads more than once.

``hold`` keeps a table on the executors' disks with its lineage: a lost
executor's part is computed again.  Loops cut their lineage with ``written``:
a table under ``spark.checkpoint.dir`` in as many files as its rows need.
Held tables go with ``release``, which a job calls once their results are written.
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewise.operators.common import materialize
from gatewise.session import ensure_checkpoint_dir

ROWS_PER_FILE = 1_000_000
MOST_BROADCAST = 1_000_000  # rows of a few longs: at most 50 MB


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, for files that executors and driver share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


_HELD: list[DataFrame] = []


def hold(df: DataFrame) -> DataFrame:
    df = df.persist(StorageLevel.DISK_ONLY)
    _HELD.append(df)
    return df


def release() -> None:
    """Gives back all tables held so far; one that is still read is computed again from its lineage."""
    while _HELD:
        _HELD.pop().unpersist()


def small(rows: DataFrame) -> DataFrame:
    """A table of ids, held; marked for broadcast when it has few enough rows, else joined by shuffle."""
    rows = hold(rows)
    return F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows


def hot_join(rows: DataFrame, keyed: DataFrame, key: str, share: int = 1000, few: int | None = None) -> DataFrame:
    """Left join of ``rows`` to ``keyed`` (one row per ``key``) when a key may hold many of the rows.

    A ``keyed`` of at most ``few`` rows is broadcast.  Otherwise a key with more than
    1/``share`` of the rows is hot; there are fewer than ``share`` of them, so
    their part of ``keyed`` is broadcast and their rows do not move.  All other
    rows are joined by shuffle.  Null keys meet nothing.
    """
    keyed = hold(keyed)
    if keyed.count() <= (MOST_BROADCAST // 4 if few is None else few):
        return rows.join(F.broadcast(keyed), key, "left")
    counts = hold(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = counts.where(F.col("_n") * share > total).select(key, F.lit(True).alias("_hot"))
    marked = rows.join(F.broadcast(hot), key, "left")
    few = keyed.join(F.broadcast(hot.select(key)), key, "left_semi")
    light = keyed.join(F.broadcast(hot.select(key)), key, "left_anti")
    return marked.where("_hot").drop("_hot").join(F.broadcast(few), key, "left").unionByName(marked.where("_hot is null").drop("_hot").join(light, key, "left"))


def written(df: DataFrame, rows: int, name: str) -> DataFrame:
    """``df`` of about ``rows`` narrow rows, written once and read back."""
    return materialize(df.coalesce(rows // ROWS_PER_FILE + 1), name)
