"""T11 by month fingerprints against the whole-row multiset difference."""

import random
from datetime import datetime

from gatewise.sources import sinks as T

SCHEMA = "id long, v string, ts timestamp_ntz"


def _rows(rng, n):
    return [(rng.randrange(6), rng.choice(["a", "b", None]), rng.choice([None, datetime(2024, rng.randrange(1, 5), 1, 0, 0, 0, rng.randrange(3))])) for _ in range(n)]


def test_violations_equal_except_all(spark):
    rng = random.Random(3)
    for case in range(4):
        before = _rows(rng, 60)
        after = list(before) + _rows(rng, 10)
        if case:  # a change, a row moved to another month, a repeat lost
            after[0] = (99, "x", after[0][2])
            after[1] = (*after[1][:2], datetime(2025, 1, 1))
            after.pop(2)
        rng.shuffle(after)
        b, a = spark.createDataFrame(before, SCHEMA), spark.createDataFrame(after, SCHEMA)
        want = sorted(map(str, b.exceptAll(a).collect()))
        assert sorted(map(str, T.append_only_violations(b, a.select("ts", "v", "id")).collect())) == want
        assert sorted(map(str, T.append_only_violations(b, a, before_prints=T.month_fingerprints(b)).collect())) == want
        assert bool(want) == bool(case)


def test_only_months_that_differ_are_named(spark):
    b = spark.createDataFrame([(1, "a", datetime(2024, 1, 1)), (1, "a", datetime(2024, 1, 1)), (2, None, datetime(2024, 2, 1)), (3, "c", None)], SCHEMA)
    lost = spark.createDataFrame([(1, "a", datetime(2024, 1, 1)), (3, "c", None), (2, None, datetime(2024, 2, 1)), (4, "d", datetime(2024, 3, 1))], SCHEMA)
    assert [r.month for r in T.changed_months(T.month_fingerprints(b), T.month_fingerprints(lost)).collect()] == ["2024-01"]
    empty = spark.createDataFrame([], SCHEMA)
    assert T.append_only_violations(empty, b).count() == 0
    assert T.append_only_violations(b, empty).count() == 4
