"""Registered queries of the training-data operators (thin calls) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewise.llm import alignment, decontam, jaccard, licenses, packing, ranked, secrets, suffix_dedup, surrogates, token_counts, topk, toxicity, warc
from gatewise.llm.store import shared_path
from gatewise.sources import read_table

QueryFn = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.jaccard_components(read_table(spark, sf_dir, "documents"), jaccard.Rule(n=3, num=90, den=100))
    return found.select("doc_id", "n_shingles", "component_id")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = token_counts.cleaning_edits(read_table(spark, sf_dir, "documents"))
    return token_counts.apply_edits(token_counts.count_trees(edited))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(read_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.surrogate_texts(read_table(spark, sf_dir, "documents")).select("doc_id", "n_entities", "text")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(read_table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_pages(read_table(spark, sf_dir, "pages"), path)
    return warc.page_digests(warc.read_records(spark, path))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=10)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, QueryFn] = {
    f.__name__: f
    for f in (op1_decontamination, op2_jaccard_join, op3_token_counts, op4_suffix_dedup, op5_toxicity, op6_topk, op7_pii_surrogates, op8_license_scan, op9_packing, op10_secret_scan, op11_warc, op12_ranked_search, op13_alignment)
}

# ---- SQL ---------------------------------------------------------------------------

#: Lower-case A-Z only.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = f"""
with d as (select row_number() over () rid, doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') w from documents where text is not null),
b as (select row_number() over () bid, item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') w from benchmark where text is not null),
bi as (select *, least({decontam.N}, len(w)) g from b where len(w) > 0),
bs as (select distinct bid, item_id, g, array_to_string(w[p : p + g - 1], ' ') s from (select *, unnest(generate_series(1, len(w) - g + 1)) p from bi)),
bn as (select bid, count(*) q from bs group by bid),
gs as (select distinct g from bs),
ds as (select distinct rid, doc_id, g, array_to_string(w[p : p + g - 1], ' ') s from (select rid, doc_id, w, g, unnest(generate_series(1, len(w) - g + 1)) p from d, gs where len(w) >= g)),
hit as (select rid, doc_id, bid, item_id, count(*) n from ds join bs using (g, s) group by all)
select doc_id, item_id, q as n_item_shingles, n as n_shared, n / q as containment
from hit join bn using (bid) where {decontam.SHARE[1]} * n >= {decontam.SHARE[0]} * q
"""

_OP6 = """
with v as (select distinct vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) q from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id query_id, b.vec_id vec_id, list_dot_product(a.q, b.q)::bigint score from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) k from s)
select query_id, k::int as rank, vec_id, score from r where k <= 5
"""

_WORD8 = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _op8() -> str:
    num, den = licenses.SHARE
    templates = ", ".join(f"('{label}', [{', '.join(repr(w.decode()) for w in licenses.template_words(text))}])" for label, text in licenses.TEMPLATES)
    return f"""
with t(label, tw) as (values {templates}),
d as (select row_number() over () rid, doc_id, {_LOWER} x from documents),
w as (select rid, doc_id, x, regexp_extract_all(x, '{_WORD8}') w from d),
place as (select rid, unnest(generate_series(0, len(w) - 2)) p, w from w where len(w) > 1),
base as (select rid, p, case when w[p + 1] = 'mit' and w[p + 2] = 'license' then 'mit' when w[p + 1] = 'apache' and w[p + 2] = 'license' then 'apache'
  when w[p + 1] = 'general' and w[p + 2] = 'public' and w[p + 3] = 'license' then 'gpl' end label from place),
b as (select rid, count(*) n_base, min(p) first_word, max(p) last_word from base where label is not null group by rid),
block as (select rid, list_distinct(regexp_extract_all(unnest(string_split(x, chr(10))), '{_WORD8}')) bw from d),
m as (select rid, label, len(list_intersect(bw, tw)) / len(tw) share, len(list_intersect(bw, tw)) n, len(tw) q from block, t),
hit as (select rid, label, share from m where {den} * n >= {num} * q),
labelled as (select rid, label from hit union select rid, label from base where label is not null),
lab as (select rid, string_agg(label, ',' order by label) labels from labelled group by rid),
blab as (select rid, string_agg(label, ',' order by label) base_labels from (select distinct rid, label from base where label is not null) group by rid),
sc as (select rid, max(share) share from hit group by rid)
select doc_id, len(w.w)::bigint n_words, coalesce(n_base, 0)::bigint n_base, first_word::bigint first_word, last_word::bigint last_word,
  coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, case when n_base > 0 then 1.0::double else coalesce(share, 0)::double end score
from w left join b using (rid) left join lab using (rid) left join blab using (rid) left join sc using (rid)
"""


_OP11 = f"""
with p as (select page_id, encode(coalesce(html, '')) b from pages),
d as (select page_id, octet_length(b)::bigint n, sha1(b) h, sha256(b) s from p),
k as (select *, max(page_id) over (partition by s) top from d)
select page_id, n payload_bytes, h payload_digest, case when n >= {warc.LEAST_REVISIT} and top <> page_id then 'revisit' else 'response' end record_type,
  case when n >= {warc.LEAST_REVISIT} and top <> page_id then top end refers_to, null::varchar problem from k
"""


_TERM12 = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

_OP12 = f"""
with d as (select row_number() over () rid, doc_id, regexp_extract_all({_LOWER}, '{_TERM12}') w from documents),
st as (select count(*) filter (len(w) > 0) n_docs, sum(len(w))::bigint n_terms from d),
i as (select row_number() over () iid, item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM12}')) t from (select distinct item_id, text from benchmark)),
it as (select iid, item_id, t, count(*) c from i group by all),
p as (select rid, t, count(*) tf from (select rid, unnest(w) t from d) where t in (select t from it) group by all),
f as (select t, count(*) df from p group by t),
wt as (select t, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)::double))::bigint w from f, st),
m as (select rid, doc_id, 25 + ((75 * len(w)::bigint * n_docs) // n_terms) m from d, st where len(w) > 0),
s as (select iid, item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint score from it join wt using (t) join p using (t) join m using (rid) group by iid, item_id, rid, doc_id),
r as (select *, row_number() over (partition by iid order by score desc, doc_id nulls last) k from s where score > 0)
select item_id, k::int as rank, doc_id, score from r where k <= 10
"""

ORACLES: dict[str, str] = {"op12_ranked_search": _OP12, "op11_warc": _OP11, "op1_decontamination": _OP1, "op6_topk": _OP6, "op8_license_scan": _op8()}
