"""Each operator against a brute-force version, and on awkward inputs."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, LongType, StringType, StructField, StructType

from gatewise.llm import decontam, jaccard, licenses, packing, queries, secrets, suffix_dedup, surrogates, token_counts, topk, toxicity

SF = "/root/testdata/sf0.001"
DOCS = StructType([StructField(n, t) for n, t in (("doc_id", LongType()), ("text", StringType()), ("lang", StringType()), ("source", StringType()), ("n_chars", LongType()), ("score", StringType()), ("component_id", StringType()))])
LONG = " ".join(f"w{i % 700}x{i % 13}" for i in range(30_000))
AWKWARD = [(1, None), (2, ""), (3, " \n "), (None, "some words of a text without an id at all"), (4, "one"), (5, LONG), (6, LONG), (6, LONG), (7, "Licensed under the Apache License, Version 2.0. token = abcdef12 a@b.org"), (8, "é\tü  x")]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(i, t, None, "s", None, "clash", "clash") for i, t in AWKWARD], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}


def words_of(text):
    return (text or "").encode().lower().split()


def shingles(words, n):
    return frozenset(zip(*(words[i:] for i in range(n)), strict=False)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def brute_components(rows, n, num):
    sets = {d: shingles(words_of(t), n) for d, t in rows.items()}
    parent = {d: d for d in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(rows)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}, {d: len(s) for d, s in sets.items()}


def edited_family(rng, size, words, edits):
    base = [f"v{rng.integers(0, 10**6)}" for _ in range(words)]
    for _ in range(size):
        w = list(base)
        for _ in range(rng.integers(0, edits)):
            w[rng.integers(0, words)] = f"e{rng.integers(0, 10**6)}"
        yield " ".join(w)


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80)])
def test_jaccard_components_match_all_pairs(spark, docs, texts, n, num):
    rng = np.random.default_rng(n)
    rows = dict(texts)
    for words, edits, size in ((14, 2, 12), (26, 3, 12), (60, 4, 40), (200, 9, 60)):  # light, boundary, long lists
        for t in edited_family(rng, size, words, edits):
            rows[10_000 + len(rows)] = t
    table = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = jaccard.jaccard_components(table, jaccard.Rule(n, num, 100)).collect()
    want, sizes = brute_components(rows, n, num)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes


def test_parity_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(200):
        pool = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
        a, b = (np.sort(rng.choice(pool, rng.integers(1, 250), replace=False)) for _ in range(2))
        bits = np.bitwise_count((jaccard.parity_sketch(a) ^ jaccard.parity_sketch(b)).view(np.uint64)).sum(dtype=int)
        assert bits <= len(np.setxor1d(a, b))


def test_keep_one(awkward):
    kept = jaccard.keep_one(awkward, jaccard.Rule(5, 80, 100))
    assert kept.columns == awkward.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8]


def test_contained_items(spark, docs, texts):
    items = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    items[900] = "Short item"
    items[901] = None
    rows = dict(texts)
    rows[90_001] = "before " + items[0].upper() + " behind it, a SHORT... item"
    cut = items[1].split()
    rows[90_002] = " ".join(cut[: int(len(cut) * 0.6)])
    table = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_item_shingles, r.n_shared) for r in decontam.contained_items(table, bench).collect()}
    want = {}
    for d, t in rows.items():
        w = re.findall(r"\w+", t.lower())
        for i, q in items.items():
            qw = re.findall(r"\w+", (q or "").lower())
            qs = shingles(qw, min(5, len(qw)) or 1)
            shared = len(qs & shingles(w, min(5, len(qw)) or 1)) if len(w) >= min(5, len(qw)) else 0
            if qs and 10 * shared >= 8 * len(qs):
                want[d, i] = (len(qs), shared)
    assert got == want and (90_001, 0) in got and (90_001, 900) in got and not any(d == 90_002 for d, _ in got)


def test_edited_counts_equal_fresh_counts(spark, docs):
    rng = np.random.default_rng(5)
    rows, edited = [], {}
    for i, text in enumerate([r[0] for r in docs.select("text").limit(60).collect()] + ["", "a b'll c", "x" * 2000, "  \n\n a\tb é"]):
        points = sorted(int(x) for x in rng.integers(0, len(text) + 1, 4))
        edits = [(points[0], points[1], "new 'll"), (points[2], points[3], " ")]
        new = text[: points[0]] + "new 'll" + text[points[1] : points[2]] + " " + text[points[3] :]
        rows.append((i, text, edits))
        edited[i] = new
    table = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:long,end:long,replacement:string>>")
    from gatewise.llm.bpe import Encoder

    exact = Encoder().exact
    for r in token_counts.apply_edits(token_counts.count_trees(table, leaf=64)).collect():
        assert r.n_tokens_after == len(exact.encode(edited[r.doc_id], add_special_tokens=False).ids)
        assert r.n_tokens == len(exact.encode(rows[r.doc_id][1], add_special_tokens=False).ids)
        assert r.n_chars_after == len(edited[r.doc_id])


def test_repeated_passages(docs, texts):
    got = defaultdict(set)
    for r in suffix_dedup.repeated_passages(docs).collect():
        assert r.n_words >= 50 and r.other_doc != r.doc_id
        got[r.doc_id].update(range(r.start_word, r.end_word))
    seen, want = defaultdict(set), defaultdict(set)
    words = {d: words_of(t) for d, t in texts.items()}
    for d, w in words.items():
        for i in range(len(w) - 49):
            seen[tuple(w[i : i + 50])].add(d)
    for d, w in words.items():
        for i in range(len(w) - 49):
            if len(seen[tuple(w[i : i + 50])]) > 1:
                want[d].update(range(i, i + 50))
    assert got == want and want


def test_toxicity_learns_from_training_rows_only(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score_documents(docs, labels)
    rows = scored.join(labels, "doc_id").where("held_out").select("doc_id", "predicted", "toxic").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.97
    assert np.mean([r.predicted for r in rows if r.toxic]) > 0.8
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.predicted for r in toxicity.score_documents(docs, flipped).where("held_out").collect()}
    assert all(again[r.doc_id] == r.predicted for r in rows)


def test_top_k_on_awkward_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(300 + i, [0.5] * 8) for i in range(40)] + [(50, rows[50][1]), (400, None), (401, [float("nan")] * 8), (402, [1.0, None]), (None, [1.0] * 8), (403, [1.0, 2.0]), (404, [])]
    schema = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(FloatType())), StructField("rank", LongType())])
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], schema)
    got = defaultdict(list)
    for r in topk.top_k(table, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-r.score, r.vec_id))
    vectors = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            vectors[i] = np.pad(np.floor(256 * np.array(v, dtype=np.float32).astype(float)), (0, 8 - len(v)))
    want = {q: sorted((-int(vectors[q] @ v), i) for i, v in vectors.items() if i != q)[:5] for q in vectors if q % 50 == 0}
    assert got == want


def test_surrogates(spark):
    base = ["write to jo.b1@mail3.example.com now", "JO.B1@mail3.example.com, 4041894974608795 and 4041 8949 7460 8795", "tel +1 (988) 555-2485 at 10.20.30.40", "Mrs. Jane Smith and Mr Smith", "г-жа Иванова", None, "", "clean 2024 text"]
    rows = [(i, t, "en", "s", len(t or ""), None, None) for i, t in enumerate(base)] + [(100 + i, f"box{i}@a{i % 7}.org 4{i:015d} 10.0.{i // 250}.{i % 250}", "en", "s", 0, None, None) for i in range(600)]
    table = spark.createDataFrame(rows, DOCS)
    out = {r.doc_id: r for r in surrogates.surrogate_texts(table).collect()}
    again = {r.doc_id: r.text for r in surrogates.surrogate_texts(table).collect()}
    assert {d: r.text for d, r in out.items()} == again
    for i, text, *_ in rows:
        for secret in re.findall(r"[\w.]+@[\w.]+|\d{16}|(?:\d+\.){3}\d+|555-2485|Smith|Jane|Иванова", text or ""):
            assert secret not in out[i].text
    assert out[7].text == base[7] and out[5].text is None and out[6].text == ""
    first = out[0].text.split()[2]
    assert out[1].text.startswith(first)  # the same address, in either case
    cards = re.findall(r"\d{4} ?\d{4} ?\d{4} ?\d{4}", out[1].text)
    assert len({c.replace(" ", "") for c in cards}) == 1 and " " in cards[1]
    luhn = lambda n: sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(n))) % 10 == 0
    assert luhn(cards[0])
    assert re.fullmatch(r"tel \+1 \(\d{3}\) \d{3}-\d{4} at (\d+\.){3}\d+", out[2].text)
    name = re.fullmatch(r"Mrs\. (\w+) (\w+) and Mr (\w+)", out[3].text)
    assert name and name[2] == name[3] and name[1].endswith("lia")
    assert re.fullmatch(r"г-жа [А-Я][а-я]+", out[4].text)
    parts = list(zip(*(out[100 + i].text.split() for i in range(600)), strict=True))
    assert [len(set(p)) for p in parts] == [600, 600, 600]  # distinct entities stay distinct


def test_surrogate_collisions_are_drawn_again(spark):
    forms = spark.createDataFrame([("phone", f"{i:03d}") for i in range(0, 1000, 3)], "type string, form string")
    table = surrogates.surrogate_table(forms, "k").collect()
    assert len({r.surrogate for r in table}) == len(table) == 334
    assert not {r.surrogate for r in table} & {r.form for r in table}


def test_license_templates(docs, texts):
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for d, text in texts.items():
        words = word.findall(text.translate(low))
        places = sorted((i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
        labels, score = {label for _, label in places}, 1.0 if places else 0.0
        for line in text.split("\n"):
            block = set(word.findall(line.translate(low)))
            for label, t in licenses.TEMPLATES:
                tw = set(word.findall(t.translate(low)))
                if 10 * len(tw & block) >= 9 * len(tw):
                    labels.add(label)
                    score = max(score, len(tw & block) / len(tw))
        r = got[d]
        assert (r.n_words, r.n_base, r.labels, r.score) == (len(words), len(places), ",".join(sorted(labels)), score)
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))


def best_fit_brute(lengths, size):
    bins = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(bins) if room >= x]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= x
        else:
            bins.append(size - x)
    return sorted(bins)


def test_packing(docs, texts):
    from gatewise.llm.bpe import Encoder

    exact = Encoder().exact
    rows = packing.pack(docs).collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append((r.offset, r.length))
    for d, text in texts.items():
        ids = np.array([*exact.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
        at = 0
        for k, r in enumerate(sorted(by_doc[d], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == 1024)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    rooms = []
    for spans in by_bin.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        rooms.append(1024 - at)
    assert sorted(rooms) == best_fit_brute([r.length for r in rows], 1024)


ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")


def secret_brute(text):
    data = text.encode()
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(data) if len(m[2]) >= 6]
    spans += [("access", m.start(), m.end()) for m in re.finditer(rb"AKIA[A-Z0-9]+", data) if len(m[0]) >= 20]
    spans += [("hex", m.start(), m.end()) for m in re.finditer(rb"[0-9a-f]+", data) if len(m[0]) >= 24]
    order = {"assign": 0, "access": 1, "hex": 2}
    at = lambda i: len(data[:i].decode())
    return [f"{k}:{at(s)}:{at(e)}" for k, s, e in sorted(spans, key=lambda x: (x[1], order[x[0]]))]


def test_secrets(spark, texts):
    rng = np.random.default_rng(4)
    bits = ["password", "TOKEN", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "A9B8C7D6E5F4G3H2", "abcdef0123", "x", "\n", "é", "AK"]
    rows = dict(texts) | {10**6 + i: "".join(rng.choice(bits, rng.integers(0, 14))) for i in range(1500)}
    table = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    for r in secrets.secret_report(table).collect():
        want = secret_brute(rows[r.doc_id])
        assert r.base_sha256 == secrets.sha256_of(want)
        kinds = Counter(x.split(":")[0] for x in want)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert set(want) <= set(r.spans.split(",")) | {""}
    added = spark.createDataFrame([(1, "é ghp_" + "z9" * 18 + " AIza" + "Y" * 35)], "doc_id long, text string")
    assert secrets.secret_report(added).first().spans == "github:2:42,google:43:82"


def test_awkward_and_empty_tables(spark, awkward, empty):
    bench = spark.createDataFrame([(1, None), (2, ""), (None, "some words of a text without an id")], "item_id long, text string")
    labels = spark.createDataFrame([(5, 1, 1), (6, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    runs = {
        "op1": lambda d: decontam.contained_items(d, bench),
        "op2": lambda d: jaccard.jaccard_components(d),
        "op3": lambda d: token_counts.apply_edits(token_counts.count_trees(token_counts.cleaning_edits(d))),
        "op4": lambda d: suffix_dedup.repeated_passages(d),
        "op5": lambda d: toxicity.score_documents(d, labels),
        "op7": lambda d: surrogates.surrogate_texts(d),
        "op8": lambda d: licenses.scan_licenses(d),
        "op9": lambda d: packing.pack(d),
        "op10": lambda d: secrets.secret_report(d),
    }
    for name, run in runs.items():
        rows, none = run(awkward).collect(), run(empty).collect()
        assert none == [], name
        if name not in ("op1", "op4", "op9"):
            assert len(rows) == len(AWKWARD), name
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect() == []


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as p

    now = docs
    for name, stage in p.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, now, SF).collect(), now.schema)
        assert after.columns == docs.columns, name
        before, kept = ({r.doc_id: r.text for r in x.collect()} for x in (now, after))
        if name == "near_duplicates":
            want, _ = brute_components(before, 5, 80)
            assert set(kept) == set(want.values())
        if name == "decontamination":
            leaks = {r.doc_id for r in decontam.contained_items(now, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert set(kept) == set(before) - leaks and leaks
        if name == "pii":
            assert set(kept) == set(before)
        now = after
    packed = p.STAGES[-1][1](spark, now, SF)
    assert packed.select("doc_id").distinct().count() == now.count()
    assert set(queries.ORACLES) <= set(queries.QUERIES)
