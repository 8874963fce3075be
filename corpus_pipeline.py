"""Corpus pipeline: toxicity, near duplicates, benchmark leaks, PII, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next stage's ``docs``.  All stages but the
last return the columns of ``docs``; a stage's decisions take effect in what it
returns:

* ``toxicity`` drops documents that the nnPU classifier predicts toxic;
* ``near_duplicates`` keeps one document (smallest doc_id) of each group linked
  by a Jaccard similarity of 0.8 or more over five-word shingles;
* ``decontamination`` drops rows whose text holds a benchmark item;
* ``pii`` replaces personal data by surrogates;
* ``packing`` packs the tokens of what is left into sequences.

Null texts are empty (kept by every filter); rows with a null doc_id are kept;
of repeated rows with one doc_id and text one stays; empty tables give empty
results; extra columns are passed on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gatewise.llm import decontam, jaccard, packing, surrogates, toxicity
from gatewise.llm.store import release
from gatewise.session import ensure_checkpoint_dir, ship_package
from gatewise.sources import read_table

NEAR = jaccard.Rule(n=5, num=80, den=100)


def _begin(spark: SparkSession) -> None:
    """The stage before is written by now: what it held on executors goes."""
    release()
    ship_package(spark)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    return jaccard.keep_one(docs, NEAR)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    return surrogates.surrogate_texts(docs).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: A learnt classifier and a keyed digest cannot be stated in SQL; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to and read from the shared folder."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex[:12]}"
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
