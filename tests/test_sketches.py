"""Roll-ups of stored states against exact answers."""

import random

from pyspark.sql import functions as F

from gatewise.operators import sketches as SK

SCHEMA = "k string, day int, v long"


def _rows():
    rng = random.Random(8)
    rows = [("hot", rng.randrange(30), rng.randrange(20_000)) for _ in range(40_000)]
    return rows + [("few", rng.randrange(3), rng.choice([1, 2, 2, 3, None])) for _ in range(50)] + [(None, 1, 7), ("none", 1, None)]


def test_distinct_states_merge_over_days_and_labels(spark, tmp_path):
    rows = _rows()
    path = str(tmp_path / "state")
    SK.distinct_state(spark.createDataFrame(rows, SCHEMA), ["k"], F.col("day"), "v").write.parquet(path)
    state = spark.read.parquet(path)
    for labels, of in (((), lambda r: ()), (("k",), lambda r: (r[0],))):
        got = {tuple(r[c] for c in labels): (r.rows, r.distinct_values) for r in SK.distinct_rollup(state, labels).collect()}
        for key in {of(r) for r in rows}:
            mine = [r[2] for r in rows if of(r) == key and r[2] is not None]
            assert got[key][0] == len(mine)
            assert abs(got[key][1] - len(set(mine))) <= 0.02 * len(set(mine))
    week = {r.k: r.distinct_values for r in SK.distinct_rollup(state.where("period < 7"), ["k"]).collect()}
    exact = len({v for k, d, v in rows if k == "hot" and d < 7})
    assert abs(week["hot"] - exact) <= 0.02 * exact


def test_quantile_states_keep_the_rank(spark):
    rows = _rows()
    state = SK.quantile_state(spark.createDataFrame(rows, SCHEMA), ["k"], F.col("day"), "v")
    got = {r.k: r for r in SK.quantile_rollup(state, ["k"], {"p50": 0.5, "p99": 0.99}).collect()}
    assert set(got) == {"hot", "few", None}
    for key, r in got.items():
        mine = [v for k, _, v in rows if k == key and v is not None]
        assert r["rows"] == len(mine)
        for value, rank in ((r.p50, 0.5), (r.p99, 0.99)):
            assert sum(v < value for v in mine) / len(mine) <= rank + 0.02
            assert sum(v <= value for v in mine) / len(mine) >= rank - 0.02


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert SK.distinct_rollup(SK.distinct_state(none, ["k"], F.col("day"), "v"), ["k"]).collect() == []
    assert SK.quantile_rollup(SK.quantile_state(none, ["k"], F.col("day"), "v"), ["k"], {"p50": 0.5}).collect() == []
