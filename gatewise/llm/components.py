"""Connected components over an edge table, as Spark joins.

Alternating large-star / small-star rounds: every round links each node to the
smallest neighbour it knows; the edge table turns into one star per component.
Each round is a partial aggregate (map-side combine, so a hub node is never
gathered in one task) and a join back, and writes its edges under
``spark.checkpoint.dir``, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewise.llm.store import hold, written


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionAll(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links -> (node, component): the smallest node it can reach.

    Nodes that are the smallest of their component and nodes without links do
    not appear; self links are ignored.  An empty table gives an empty result.
    """
    first = hold(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _fingerprint(first)
    now = written(first, seen[0], "edges")
    first.unpersist()
    while seen[0]:
        now = written(_small_star(_large_star(now)), seen[0], "edges")
        after = _fingerprint(now)
        if after == seen:
            break
        seen = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
