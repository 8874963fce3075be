"""Personal data and prompt security operators."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewise.functions import pii as PF
from gatewise.operators.common import bound_batch_bytes, spread

# ---------------------------------------------------------------- P1-P4


def pii_scan(df: DataFrame, text_col: str, keys: Sequence[str], patterns=None, whitelist=None) -> DataFrame:
    """One row per match (keys, pii_type, field_type, value, classification, placeholder)."""
    return spread(df).select(*keys, F.inline(PF.scan(F.col(text_col), patterns, whitelist)))


def pii_mask(df: DataFrame, text_col: str, patterns=None, out_col: str = "masked_text") -> DataFrame:
    """Masked text and number of matches (repeats of a value count)."""
    m = PF.scan(F.col(text_col), patterns)
    return spread(df).withColumn("_m", m).withColumn(out_col, PF.mask_text(F.col(text_col), F.col("_m"))).withColumn(
        "match_count", F.size("_m")
    ).drop("_m")


def pii_contains(df: DataFrame, text_col: str, patterns=None) -> DataFrame:
    """Flag and first match."""
    m = PF.scan(F.col(text_col), patterns)
    return spread(df).withColumn("_m", m).withColumn("has_pii", F.size("_m") > 0).withColumn(
        "first_match", F.try_element_at("_m", F.lit(1))
    ).drop("_m")


def pii_profile(matches: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """Per family documents hit, matches, distinct values and share of documents."""
    n_docs = docs.select(key).agg(F.count(F.lit(1))).scalar()
    return matches.groupBy("pii_type").agg(
        F.count_distinct(key).alias("docs_hit"),
        F.count(F.lit(1)).alias("matches"),
        F.count_distinct("value").alias("distinct_values"),
        (F.count_distinct(key) / n_docs).alias("doc_share"),
    )


# ---------------------------------------------------------------- P5 prompt PII action

ACTION_RANK = {"warn": 1, "mask": 2, "block": 3}


def prompt_pii_action(
    prompts: DataFrame,
    actions: dict[str, str],
    whitelist_consumers: Sequence[str] = (),
    text_col: str = "text",
    consumer_col: str = "consumer_id",
) -> DataFrame:
    """P5: per prompt the strongest configured action of its matches
    (block > mask > warn); whitelisted consumers bypass; mask rewrites the
    text.  Adds ``pii_action``, ``pii_types``, ``prompt_out``."""
    fams = list(actions)
    m = PF.scan(F.col(text_col), fams)
    rank_map = F.create_map(*[x for f, a in actions.items() for x in (F.lit(PF.resolve([f])[0].name), F.lit(ACTION_RANK[a]))])
    ranks = F.transform(F.col("_m"), lambda s: rank_map[s["pii_type"]])
    top = F.array_max(ranks)
    action = (
        F.when(F.size("_m") == 0, F.lit("none"))
        .when(F.col(consumer_col).isin(*whitelist_consumers) if whitelist_consumers else F.lit(False), F.lit("bypass"))
        .when(top == 3, "block")
        .when(top == 2, "mask")
        .otherwise("warn")
    )
    mask_fams = F.col("_m")
    return (
        prompts.withColumn("_m", m)
        .withColumn("pii_action", action)
        .withColumn("pii_types", F.array_sort(F.array_distinct(F.transform("_m", lambda s: s["pii_type"]))))
        .withColumn(
            "prompt_out",
            F.when(F.col("pii_action") == "mask", PF.mask_text(F.col(text_col), mask_fams))
            .when(F.col("pii_action") == "block", F.lit(None).cast("string"))
            .otherwise(F.col(text_col)),
        )
        .drop("_m")
    )


# ---------------------------------------------------------------- P6 injection scan

# Injection phrases by category and confidence.
INJECTION_RULES = [
    ("direct_override", "HIGH", r"(?i)(ignore previous instructions|forget your rules|you are now|system prompt override)"),
    ("data_extraction", "HIGH", r"(?i)(repeat everything above|show me your system prompt|what are your instructions)"),
    ("role_manipulation", "MEDIUM", r"(?i)(act as|pretend to be|roleplay as)\s+(\w+\s+){0,3}(system|admin)"),
]
# Cyrillic look-alike letters folded to Latin before re-scan.
HOMOGLYPHS_FROM = "аеорсухіАЕОРСХІ"
HOMOGLYPHS_TO = "aeopcyxiAEOPCXI"
BASE64_TOKEN = r"[A-Za-z0-9+/]{16,}={0,2}"
HIGH_RX = "|".join(r[2].replace("(?i)", "") for r in INJECTION_RULES if r[1] == "HIGH")


def _high_match(c: Column) -> Column:
    return c.rlike("(?i)(" + HIGH_RX + ")")


def injection_scan(
    prompts: DataFrame, text_col: str = "text", consumer_col: str = "consumer_id", whitelist_consumers: Sequence[str] = ()
) -> DataFrame:
    """First matching category in rule order; HIGH blocks, MEDIUM asks for
    confirmation (allowed with audit).  Encoding bypass: base64 tokens are
    decoded and homoglyphs folded, then the HIGH phrases re-checked."""
    t = F.col(text_col)
    folded = F.translate(t, HOMOGLYPHS_FROM, HOMOGLYPHS_TO)
    decoded = F.transform(
        F.regexp_extract_all(t, F.lit("(" + BASE64_TOKEN + ")"), 1),
        lambda s: F.coalesce(F.try_to_binary(s, F.lit("base64")).cast("string"), F.lit("")),
    )
    enc_hit = (_high_match(folded) & (folded != t)) | F.exists(decoded, _high_match)
    cat = None
    for name, conf, rx in INJECTION_RULES:
        cat = F.when(t.rlike(rx), F.struct(F.lit(name).alias("c"), F.lit(conf).alias("k"))) if cat is None else cat.when(
            t.rlike(rx), F.struct(F.lit(name).alias("c"), F.lit(conf).alias("k"))
        )
    cat = cat.when(enc_hit, F.struct(F.lit("encoding_bypass").alias("c"), F.lit("MEDIUM").alias("k")))
    wl = F.col(consumer_col).isin(*whitelist_consumers) if whitelist_consumers else F.lit(False)
    return (
        prompts.withColumn("_c", cat)
        .withColumn("injection_category", F.col("_c.c"))
        .withColumn("injection_confidence", F.col("_c.k"))
        .withColumn(
            "injection_action",
            F.when(F.col("_c").isNull(), "allow")
            .when(wl, "allow_whitelisted")
            .when(F.col("_c.k") == "HIGH", "block")
            .otherwise("confirm"),
        )
        .drop("_c")
    )


# ---------------------------------------------------------------- P7 similarity to an attack corpus

BLOCK_VECTORS = 4096
SCORED_AT_ONCE = 256  # queries of a batch in one matrix product
FEW_BLOCKS = 16  # blocks of the corpus that are broadcast; more are joined by shuffle
DEALS = 16


def _unit_rows(vectors: pd.Series) -> np.ndarray:
    m = np.vstack(vectors.to_numpy()).astype(np.float64)
    norms = np.linalg.norm(m, axis=1)
    return m / np.where(norms == 0, 1, norms)[:, None]


def injection_similarity(
    queries: DataFrame,
    corpus: DataFrame,
    threshold: float = 0.9,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    category_col: str = "label",
) -> DataFrame:
    """Cosine top-1 of each query vector against a known-attack corpus.

    Exact, and on executors only.  The corpus becomes blocks of about
    ``BLOCK_VECTORS`` unit vectors, queries come in Arrow batches; each (batch,
    block) pair leaves a row per query, and the best row per query is taken with
    partial aggregation.  A worker reads its pairs in place and multiplies
    ``SCORED_AT_ONCE`` queries by the block at a time, so its memory does not
    grow with the tables.  A corpus of at most
    ``FEW_BLOCKS`` blocks is broadcast, a larger one is joined by shuffle on
    (block, deal).  Ties (to twelve digits) go to the lowest corpus id; null
    vectors take no part; an empty corpus leaves null matches and ``allow``.
    """
    bound_batch_bytes(corpus.sparkSession)
    rows = corpus.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(category_col).cast("int").alias("category"), F.col(vec_col).cast("array<double>").alias("v"))
    n_blocks = rows.count() // BLOCK_VECTORS + 1
    keyed = rows.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(n_blocks)).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="mergesort")
        m = _unit_rows(pdf["v"])
        category = pdf["category"].fillna(-1).to_numpy(np.int64)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "categories": [category.tobytes()], "unit": [m.tobytes()]})

    blocks = keyed.groupBy("block").applyInPandas(pack, "block int, ids binary, categories binary, unit binary")
    numbered = queries.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias(id_col), F.col(vec_col).cast("array<double>").alias("v"))

    def batched(it):
        for b in it:
            for i in range(0, len(b), BLOCK_VECTORS):
                part = b.iloc[i : i + BLOCK_VECTORS]
                yield pd.DataFrame({"asked": [part[id_col].to_numpy(np.int64).tobytes()], "q": [_unit_rows(part["v"]).tobytes()]})

    packed = numbered.mapInPandas(batched, "asked binary, q binary")
    each = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block")
    if n_blocks <= FEW_BLOCKS:
        pairs = packed.select("asked", "q", each).join(F.broadcast(blocks), "block")
    else:
        deals = F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))).alias("deal")
        pairs = packed.select("asked", "q", F.pmod(F.crc32("asked"), F.lit(DEALS)).cast("int").alias("deal"), each).join(blocks.select("*", deals), ["block", "deal"])

    def score(it):
        for b in it:
            for row in range(b.num_rows):
                asked, q, ids, categories, unit = (np.frombuffer(column[row].as_buffer(), kind) for column, kind in zip(b.columns, (np.int64, float, np.int64, np.int64, float), strict=True))
                q, m = q.reshape(len(asked), -1), unit.reshape(len(ids), -1)
                for i in range(0, len(asked), SCORED_AT_ONCE):
                    sims = np.round(q[i : i + SCORED_AT_ONCE] @ m.T, 12)
                    best = sims.argmax(axis=1)  # the first of equals: ids are in order
                    columns = (asked[i : i + SCORED_AT_ONCE], sims[np.arange(len(best)), best], ids[best], categories[best])
                    yield pa.RecordBatch.from_arrays([pa.array(c, from_pandas=True) for c in columns], names=[id_col, "sim", "match_id", "category"])

    scored = pairs.select("asked", "q", "ids", "categories", "unit").mapInArrow(score, f"{id_col} long, sim double, match_id long, category long")
    best = scored.groupBy(id_col).agg(F.max(F.struct("sim", (-F.col("match_id")).alias("least"), "category")).alias("b"))
    found = numbered.select(id_col).distinct().join(best, id_col, "left")
    sim, category = F.col("b.sim"), F.col("b.category").cast("int")
    hit = F.coalesce(sim >= threshold, F.lit(False))
    return found.select(
        id_col, (-F.col("b.least")).alias("match_id"), F.when(category >= 0, category).alias("match_category"), F.round(F.coalesce(sim, F.lit(0.0)), 4).alias("confidence"), hit.alias("is_injection"), F.when(hit, "block").otherwise("allow").alias("recommendation")
    )


# ---------------------------------------------------------------- P8 exfiltration

# Phrases that reveal a leaked instruction block.
LEAK_PATTERNS = r"(?i)(my instructions are:|my system prompt is|here are my instructions)"
SHINGLE = 8


def _words(c: Column) -> Column:
    return F.split(F.regexp_replace(c, r"^\s+|\s+$", ""), r"\s+")


def _shingles(words: Column, k: int = SHINGLE) -> Column:
    n = F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))).otherwise(
        F.array(F.array_join(words, " "))
    )


def exfiltration_scan(conversations: DataFrame, min_containment: float = 0.5) -> DataFrame:
    """Assistant turns that state a leak phrase or repeat the system prompt.

    System turns are first folded to one prompt per conversation (pre-aggregated),
    then looked up by an equi-join on conv_id, so each assistant turn meets
    exactly one row.  Containment = share of the prompt's distinct word
    8-grams found in the reply, over the whole texts.
    """
    sys_ = (
        conversations.where(F.col("role") == "system")
        .groupBy("conv_id")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), "\n").alias("system_prompt"))
    )
    asst = conversations.where(F.col("role") == "assistant").select("conv_id", "turn", "text")
    j = asst.join(sys_, "conv_id", "left")
    sp = F.array_distinct(_shingles(_words(F.col("system_prompt"))))
    rp = F.array_distinct(_shingles(_words(F.col("text"))))
    containment = F.when(F.col("system_prompt").isNull(), F.lit(0.0)).otherwise(F.size(F.array_intersect(sp, rp)) / F.size(sp))
    return (
        j.withColumn("leak_phrase", F.col("text").rlike(LEAK_PATTERNS))
        .withColumn("verbatim", F.coalesce(F.instr(F.col("text"), F.col("system_prompt")) > 0, F.lit(False)))
        .withColumn("containment", F.round(containment, 6))
        .withColumn("is_exfiltration", F.col("leak_phrase") | F.col("verbatim") | (F.col("containment") >= min_containment))
        .drop("system_prompt", "text")
    )


# ---------------------------------------------------------------- P9 / P10


def audit_excerpt(df: DataFrame, text_col: str = "text", n: int = 200) -> DataFrame:
    """First ``n`` characters of the text, masked before cutting."""
    m = PF.scan(F.col(text_col))
    return spread(df).withColumn("payload_excerpt", F.left(PF.mask_text(F.col(text_col), m), F.lit(n)))


def security_action(findings: DataFrame) -> DataFrame:
    """P10: one verdict and audit event per prompt from P5 and P6 columns."""
    inj, pii = F.col("injection_action"), F.col("pii_action")
    action = (
        F.when(inj == "block", "BLOCKED")
        .when(pii == "block", "BLOCKED")
        .when(pii == "mask", "MASKED")
        .when((inj == "confirm") | (pii == "warn"), "WARNED")
        .otherwise("ALLOWED")
    )
    event = (
        F.when(inj.isin("block", "confirm"), "PROMPT_BLOCKED")
        .when(pii.isin("block", "mask", "warn"), "PII_DETECTED")
    )
    return findings.withColumn("action_taken", action).withColumn("event_type", event).withColumn(
        "http_status", F.when(action == "BLOCKED", F.when(inj == "block", 403).otherwise(400)).otherwise(200)
    )
