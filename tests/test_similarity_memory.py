"""P7's workers multiply a few queries by a block at a time, and read small batches."""

import types

import numpy as np

from gatewise.operators import pii as P


def test_products_and_batches_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_VECTORS", 40)
    monkeypatch.setattr(P, "SCORED_AT_ONCE", 10, raising=False)

    def small(a, digits):
        if a.size > 10 * 100:  # ten queries, a block of some 40 vectors
            raise ValueError(f"{a.shape} at once")
        return np.round(a, digits)

    used = ("vstack", "float64", "linalg", "where", "int64", "frombuffer", "arange")
    monkeypatch.setattr(P, "np", types.SimpleNamespace(round=small, **{name: getattr(np, name) for name in used}))
    rng = np.random.default_rng(8)
    corpus = [(i, rng.normal(size=8).tolist(), i % 3) for i in range(300)]
    queries = [(1000 + i, v, 0) for i, v, _ in corpus[:150]]
    schema = "vec_id long, embedding array<double>, label int"
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    try:
        found = P.injection_similarity(spark.createDataFrame(queries, schema).coalesce(1), spark.createDataFrame(corpus, schema))
        assert int(spark.conf.get(name).rstrip("bB")) <= 16 * 1024 * 1024
        assert {(r["vec_id"], r["match_id"], r["match_category"], r["confidence"]) for r in found.collect()} == {(1000 + i, i, i % 3, 1.0) for i in range(150)}
    finally:
        spark.conf.unset(name)
