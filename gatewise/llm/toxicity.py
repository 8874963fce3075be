"""Toxicity by non-negative positive-unlabelled (nnPU) learning.

Confirmed toxic documents are the positives; every other text of the training
rows is unlabelled, whatever its label says.  A linear classifier over word
features is trained in numpy on the class-prior-corrected risk

    pi * R(positives as 1) + max(0, R(unlabelled as 0) - pi * R(positives as 0))

whose second term is kept non-negative (when a batch drives it below zero the
step goes the other way).  The class prior pi is the share of toxic rows among
the labelled training rows.

Features of a word are the word and its 3- to 6-letter beginnings.  Kept are
those whose log ratio between positives and unlabelled stays above zero by three
standard errors; that bound is the feature's scale.  A document's logit is the
bias plus the weights of its distinct words, so a word's weight is looked up
once per task and long texts are scored whole.

The classifier is fitted on a bounded sample (``max_positive`` and
``max_unlabelled`` documents of smallest hash); every document is scored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewise.llm.batches import bound_batches

WORD = re.compile(r"[^\W\d_]+")
MAX_POSITIVE = 3000
MAX_UNLABELLED = 8000
SURE = 3.0  # standard errors by which a feature's log ratio must stay above zero
_CACHE_LIMIT = 200_000


def features_of(word: str) -> list[int]:
    """32-bit ids of the word and of its beginnings."""
    return [zlib.crc32(f.encode("utf-8", "replace")) for f in (word, *(word[:k] + "~" for k in range(3, 7) if len(word) > k))]


def document_features(text: str) -> np.ndarray:
    """Sorted distinct feature ids of a whole text."""
    return np.unique(np.array([f for w in set(WORD.findall(text.lower())) for f in features_of(w)], dtype=np.uint32))


def in_training(doc_id: Column) -> Column:
    """Rows that labels may be learnt from: crc32 of the id as text, modulo 5, is not 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[int, float]
    bias: float
    prior: float

    def word_weight(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features_of(word))


def _sample(rows: DataFrame, bound: int) -> DataFrame:
    """The ``bound`` doc_ids of smallest hash, found without sorting them all."""
    n = rows.count()
    if n > 4 * bound:
        share = 2.0 * bound / n  # twice the bound is expected below this hash
        rows = rows.where(F.xxhash64("doc_id", F.lit("toxicity")) < int((share * 2 - 1) * 2**63))
    return rows.orderBy(F.xxhash64("doc_id", F.lit("toxicity")), "doc_id").limit(bound)


def training_rows(docs: DataFrame, labels: DataFrame, max_positive: int, max_unlabelled: int) -> tuple[DataFrame, float]:
    """(positive, text) of the sampled training rows, and the class prior."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    learnt = ids.where("doc_id is not null").where(in_training(F.col("doc_id"))).distinct()
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    marked = marked.where(in_training(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = marked.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0] or 0.0
    positive = _sample(marked.where("toxic > 0").select("doc_id").join(learnt, "doc_id"), max_positive).select("doc_id", F.lit(1).alias("positive"))
    unlabelled = _sample(learnt, max_unlabelled).select("doc_id", F.lit(0).alias("positive"))
    wanted = F.broadcast(positive.unionAll(unlabelled))  # at most max_positive + max_unlabelled ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(wanted, "doc_id").select("positive", "text"), share


def _places(ids: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Where the features of one example stand in the sorted ``ids`` (those that do)."""
    if not len(ids):
        return np.empty(0, np.int64)
    at = np.searchsorted(ids, own)
    at[at == len(ids)] = 0
    return at[ids[at] == own]


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = 60, rate: float = 0.05, seed: int = 7) -> ToxicityModel:
    """nnPU training; each example is its set of features."""
    if not positive or not unlabelled:
        return ToxicityModel({}, -4.0, prior)
    prior = min(max(prior, 1e-3), 0.5)
    ids, a = np.unique(np.concatenate(positive), return_counts=True)
    ids, a = ids[a >= 3], a[a >= 3]
    b = np.zeros(len(ids), np.int64)
    for own in unlabelled:  # example by example: no second copy of all features
        b[_places(ids, own)] += 1
    ratio = np.log((a + 0.5) / (len(positive) + 1)) - np.log((b + 0.5) / (len(unlabelled) + 1))
    sure = ratio - SURE * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    names, scale = ids[sure > 0], sure[sure > 0]

    def matrix(examples: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        cols = [_places(names, own) for own in examples]
        return np.repeat(np.arange(len(examples)), list(map(len, cols))), np.concatenate(cols)

    (pr, pc), (ur, uc) = matrix(positive), matrix(unlabelled)
    w, bias = np.full(len(names), 0.5), -1.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)

    def logits(r: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
        return bias + np.bincount(r, weights=(w * scale)[c], minlength=n)

    rng, step = np.random.default_rng(seed), 0
    pick_p, pick_u = rng.integers(0, 4, len(positive)), rng.integers(0, 4, len(unlabelled))
    for _ in range(epochs):
        for part in rng.permutation(4):
            sp, su = pick_p == part, pick_u == part
            if not sp.any() or not su.any():
                continue
            zp, zu = logits(pr, pc, len(positive)), logits(ur, uc, len(unlabelled))
            soft = lambda z: np.logaddexp(0, z)  # noqa: E731  loss of calling z negative
            as_negative = soft(zu)[su].mean() - prior * soft(zp)[sp].mean()
            sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            gp, gu = np.zeros(len(positive)), np.zeros(len(unlabelled))
            if as_negative >= 0:
                gp[sp] = prior * (sig(zp[sp]) - 1) / sp.sum() - prior * sig(zp[sp]) / sp.sum()
                gu[su] = sig(zu[su]) / su.sum()
            else:  # the corrected risk is below zero: step against it
                gp[sp] = prior * sig(zp[sp]) / sp.sum()
                gu[su] = -sig(zu[su]) / su.sum()
            g = np.bincount(pc, weights=gp[pr], minlength=len(names)) + np.bincount(uc, weights=gu[ur], minlength=len(names))
            g = np.append(g * scale + 1e-4 * w, gp.sum() + gu.sum())
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w, bias = w - move[:-1], bias - move[-1]
    return ToxicityModel(dict(zip(names.tolist(), (w * scale).tolist(), strict=True)), float(bias), prior)


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> ToxicityModel:
    """Trains in one task on the bounded sample; only the weights come to the driver."""
    bound_batches(docs.sparkSession)
    rows, prior = training_rows(docs, labels, max_positive, max_unlabelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: tuple[list, list] = ([], [])
        for b in batches:
            for positive, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sets[positive].append(document_features(text))
        model = train(*(sorted(x, key=lambda f: f.tobytes()) for x in (sets[1], sets[0])), prior)  # in an order of its own
        yield pa.RecordBatch.from_arrays([pa.array([-1, *model.weights], pa.int64()), pa.array([model.bias, *model.weights.values()], pa.float64())], ["feature", "weight"])

    found = dict(rows.repartition(1).mapInArrow(run, "feature long, weight double").collect())
    bias = found.pop(-1, -4.0)  # no training row at all
    return ToxicityModel(found, bias, prior)


def score_column(model: ToxicityModel):
    """Column function text -> probability of being toxic, from the whole text (null: empty)."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, float] = {}
        for texts in parts:
            out = []
            for text in texts:
                z = model.bias
                if text:
                    for w in set(WORD.findall(text.lower())):
                        x = known.get(w)
                        if x is None:
                            if len(known) > _CACHE_LIMIT:
                                known.clear()
                            x = known[w] = model.word_weight(w)
                        if x:
                            z += x
                out.append(1 / (1 + math.exp(-max(-40.0, min(40.0, z)))))
            yield pd.Series(out, dtype="float64")

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return pandas_udf(run, "double")


def score_documents(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Learns only from rows that are not held out (a null doc_id is held out and
    scored); neither labels, ids nor other columns enter a score.  Null texts
    are empty.  Without a confirmed toxic training document all scores are low.
    """
    model = fit(docs, labels, **bounds)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = rows.select("doc_id", F.coalesce(~in_training(F.col("doc_id")), F.lit(True)).alias("held_out"), score_column(model)(F.col("text")).alias("score"))
    return scored.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """``docs`` without the rows predicted toxic; all columns."""
    model = fit(docs, labels, **bounds)
    return docs.where(score_column(model)(F.col("text")) < 0.5)


def crc_remainder(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5
