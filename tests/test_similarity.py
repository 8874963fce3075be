"""P7 against brute force, with few and with many blocks of the corpus."""

import numpy as np
import pytest

from gatewise.operators import pii as P


@pytest.mark.parametrize("few", [16, 0])
def test_top_one_is_exact(spark, monkeypatch, few):
    monkeypatch.setattr(P, "BLOCK_VECTORS", 40)
    monkeypatch.setattr(P, "FEW_BLOCKS", few)
    rng = np.random.default_rng(6)
    corpus = [(i, rng.normal(size=8).tolist(), i % 3) for i in range(300)]
    corpus += [(1000, corpus[5][1], 7), (1001, [0.0] * 8, 1), (1002, None, 1)]  # a copy with a larger id loses the tie
    queries = [(i, rng.normal(size=8).tolist(), 0) for i in range(150)] + [(500, corpus[5][1], 0), (501, [0.0] * 8, 0), (502, None, 0)]
    schema = "vec_id long, embedding array<double>, label int"
    got = {r["vec_id"]: r for r in P.injection_similarity(spark.createDataFrame(queries, schema), spark.createDataFrame(corpus, schema)).collect()}
    assert set(got) == {q[0] for q in queries if q[1] is not None}
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, v, _ in corpus if v is not None}
    for i, v, _ in queries:
        if v is None:
            continue
        q = np.array(v) / (np.linalg.norm(v) or 1)
        sims = {c: round(float(q @ u), 12) for c, u in unit.items()}
        top = max(sims.values())
        assert got[i]["match_id"] == min(c for c, s in sims.items() if s == top)
        assert got[i]["confidence"] == pytest.approx(top, abs=1e-4) and got[i]["is_injection"] == (top >= 0.9)
    assert got[500]["match_id"] == 5 and got[500]["recommendation"] == "block"


def test_empty_corpus_and_no_queries(spark):
    schema = "vec_id long, embedding array<double>, label int"
    one, none = spark.createDataFrame([(1, [1.0, 0.0], 0)], schema), spark.createDataFrame([], schema)
    row = P.injection_similarity(one, none).first()
    assert (row["match_id"], row["confidence"], row["is_injection"], row["recommendation"]) == (None, 0.0, False, "allow")
    assert P.injection_similarity(none, one).collect() == []


def test_severities(spark):
    from pyspark.sql import functions as F

    from gatewise.functions import status as ST

    rows = [(c, r, s) for c in ("ARIA_SYS_INTERNAL_ERROR", "ARIA_RT_SIDECAR_UNAVAILABLE", "ARIA_SH_PROVIDER_AUTH_FAILED", "ARIA_SH_QUOTA_EXCEEDED", "ARIA_SH_PROVIDER_ERROR", None) for r, s in ((10, 300), (11, 301))]
    df = spark.createDataFrame(rows, "c string, r long, s long")
    got = {(x["c"], x["r"]): x["v"] for x in df.select("*", ST.severity(F.col("c"), F.col("r"), F.col("s")).alias("v")).collect()}
    assert got["ARIA_SYS_INTERNAL_ERROR", 10] is None and got["ARIA_SYS_INTERNAL_ERROR", 11] == "critical"
    assert got["ARIA_RT_SIDECAR_UNAVAILABLE", 10] is None and got["ARIA_RT_SIDECAR_UNAVAILABLE", 11] == "critical"
    assert got["ARIA_SH_PROVIDER_AUTH_FAILED", 10] == "warning" and got["ARIA_SH_QUOTA_EXCEEDED", 10] == "info"
    assert got["ARIA_SH_PROVIDER_ERROR", 11] is None and got[None, 11] is None
