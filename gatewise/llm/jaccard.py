"""N-gram Jaccard join: size-aware heavy-light join over word-shingle sets.

Two texts link when ``den * |A n B| >= num * |A u B|`` over their n-word
shingles.  Copies with the same set are one class (its 64-bit set id), so
groups of copies never multiply the work.

* **Light sets** (fewer than ``x`` shingles): for every partner size the
  overlap ``c`` that a link needs is known, and all c-subsets are enumerated;
  two light sets link exactly when they share one.
* **Heavy sets**: inverted lists.  A list per single shingle would make any
  passage that many documents share quadratic, so the lists are keyed by parts
  of a set: the shingle universe is hashed into more parts than two linked
  sets can differ in, hence linked sets agree in at least one whole part
  (``1 + z`` of them, so near-empty parts are left out unless a set has more
  than z of those).  Sets of neighbouring size classes share lists, and light
  sets that can still reach a heavy one are listed too.
* **The boundary x** is chosen by cost from the counted sizes of all sets:
  subsets to enumerate against list entries to write plus tokens to verify.

Each list is first linked by a star (every member against the smallest), built
locally in each task and again after the shuffle, so a list that holds a third
of all sets is one row per task.  Star pairs are verified on the whole sets.
Lists whose members still lie in different components are then verified in
full: pairs for short lists, blocks of a matrix product for long ones, which
return only spanning links.  No link is lost and no group's pairs are emitted.

Set ids are 64 bits of the set: among N different sets the expected number of
confused ones is N^2 / 2^65 (0.03 at a billion).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewise.llm.batches import bound_batches
from gatewise.llm.components import components
from gatewise.llm.hashing import U64, WordHashes, ascii_words, mix, set_id, shingle_set
from gatewise.llm.store import hold, small, written

MAX_LIGHT = 40  # the boundary is searched among set sizes up to this
FLUSH_ROWS = 500_000  # list entries a task sorts at once
ROWS_PER_BUCKET = 1_000_000
SKETCH_WORDS = 64  # longs of a set's parity sketch
SHORT_LIST = 16
BLOCK = 1024


@dataclass(frozen=True)
class Rule:
    """Shingle length and the similarity ``num / den`` that links two sets."""

    n: int = 3
    num: int = 90
    den: int = 100
    words: Callable[[bytes], list[bytes]] = field(default=ascii_words)

    def overlap(self, a: int, b: int) -> int:
        """Smallest intersection that links sets of sizes a and b."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def lowest(self, n: int) -> int:
        return -(-self.num * n // self.den)

    def highest(self, n: int) -> int:
        return self.den * n // self.num


@dataclass(frozen=True)
class SizeClass:
    """Parts of the lists for pairs whose smaller set has start <= size < stop."""

    start: int
    stop: int
    parts: int
    weak: int  # a part with fewer shingles is weak
    spare: int  # a set with at most so many weak parts need not list them


def size_classes(rule: Rule, start: int, upto: int) -> list[SizeClass]:
    out = []
    while start <= upto:
        stop = start * rule.den * rule.den // (rule.num * rule.num) + 1
        differ = (rule.den - rule.num) * (stop - 1) // rule.num
        spare = 0
        for _ in range(4):  # settles the spare parts and what counts as weak
            parts = differ + 1 + spare
            mean = start / parts
            weak = math.ceil(mean / 4)
            expect = parts * sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(weak))
            spare = int(expect + 2 * math.sqrt(expect) + 0.5)
        out.append(SizeClass(start, stop, differ + 1 + spare, weak, spare))
        start = stop
    return out


def light_cost(rule: Rule, n: int) -> int:
    """Subsets that a light set of n shingles enumerates."""
    total = 0
    for m in range(rule.lowest(n), rule.highest(n) + 1):
        c = rule.overlap(n, m)
        if c <= min(n, m) and (m != n or c < n):
            total += math.comb(n, c)
    return total


def choose_boundary(rule: Rule, counts: dict[int, int]) -> int:
    """Size from which sets are heavy: least subsets + list entries + tokens to verify."""

    def cost(x: int) -> int:
        total = 0
        for n, k in counts.items():
            if n < x:
                total += k * light_cost(rule, n)
            if n >= rule.lowest(x):
                total += k * (2 * ((rule.den - rule.num) * n // rule.num + 1) + n)
        return total

    return min(range(2, MAX_LIGHT + 1), key=cost)


def subset_signatures(rule: Rule, s: np.ndarray, boundary: int) -> np.ndarray:
    """One signature per (size pair, c-subset) of a light set."""
    n, out = len(s), []
    total = s.sum(dtype=U64)
    for m in range(rule.lowest(n), min(rule.highest(n), boundary - 1) + 1):
        c = rule.overlap(n, m)
        if c > min(n, m) or (m == n and c == n):
            continue
        if c == n:
            left = np.array([total], dtype=U64)
        else:
            gone = np.array(list(itertools.combinations(range(n), n - c)))
            left = total - s[gone].sum(axis=1, dtype=U64)
        a, b = min(n, m), max(n, m)
        out.append(mix(left + U64((a * 1_000_003 + b) * 0x9E3779B9)))
    return np.concatenate(out) if out else np.empty(0, dtype=U64)


def part_signatures(rule: Rule, s: np.ndarray, classes: list[SizeClass], stops: np.ndarray) -> np.ndarray:
    """Signatures of the parts of a heavy (or nearly heavy) set, for each class it can meet."""
    n, out = len(s), []
    k = int(np.searchsorted(stops, n, side="right"))
    low = rule.lowest(n)
    spread, high = mix(s ^ U64(0xE7037ED1A0B428DB)), s >> U64(32)
    while k >= 0:
        c = classes[k]
        part = ((high * U64(c.parts)) >> U64(32)).astype(np.int64)
        size = np.bincount(part, minlength=c.parts)
        sums = np.zeros(c.parts + 1, dtype=U64)
        ends = np.cumsum(size)
        acc = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(spread, dtype=U64)])  # s is sorted, so parts are runs
        sums = acc[ends] - acc[ends - size]
        keep = size >= c.weak
        if c.parts - int(keep.sum()) > c.spare:
            keep[:] = True
        ids = np.flatnonzero(keep).astype(U64)
        out.append(mix(sums[keep] + mix(ids + U64((k + 1) << 32))))
        if low >= c.start or k == 0:
            break
        k -= 1
    return np.concatenate(out)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("body"))


def set_sizes(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, n_shingles, set_id) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batches:
            sizes, ids = [], []
            for body in b.column(1).to_pylist():
                s = shingle_set(cache.array(rule.words(body)), rule.n) if body else ()
                sizes.append(len(s))
                ids.append(set_id(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64())], ["doc_id", "n_shingles", "set_id"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_shingles long, set_id long")


class _Lists:
    """List entries of a task, sorted and thinned before the shuffle."""

    def __init__(self, buckets: int):
        self.buckets, self.sigs, self.ids, self.n, self.turn = buckets, [], [], 0, 0

    def add(self, sigs: np.ndarray, owner: int) -> None:
        self.sigs.append(sigs)
        self.ids.append((owner, len(sigs)))
        self.n += len(sigs)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        sigs = np.concatenate(self.sigs)
        owners = np.repeat(np.array([i for i, _ in self.ids], dtype=np.int64), [k for _, k in self.ids])
        self.sigs, self.ids, self.n = [], [], 0
        # 32 bits of the signature under its bucket; a chance match is only a pair to verify
        sigs, owners, first, rep = star(((sigs % U64(self.buckets)) << U64(32)) | (sigs >> U64(32)), owners)
        linked = ~first
        s, o = sigs[first], owners[first]
        bucket = (s >> U64(32)).astype(np.int64)
        s = s.astype(np.uint32)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(s)]])
        rows = [(int(bucket[a]), s[a:e].tobytes(), o[a:e].tobytes(), b"") for a, e in zip(starts, ends, strict=True)]
        ls, lo, lr = sigs[linked], owners[linked], rep[linked]
        at = (TaskContext.get().partitionId() * 31 + self.turn * 17) if TaskContext.get() else 0
        for i, a in enumerate(range(0, len(ls), 20_000)):  # links found here only pass through the shuffle
            rows.append(((at + i) % self.buckets, ls[a : a + 20_000].tobytes(), lo[a : a + 20_000].tobytes(), lr[a : a + 20_000].tobytes()))
        self.turn += 1
        for a in range(0, len(rows), 500):
            yield pa.RecordBatch.from_pylist([dict(zip(("bucket", "sigs", "owners", "reps"), r, strict=True)) for r in rows[a : a + 500]], schema=_BLOB)


_BLOB = pa.schema([("bucket", pa.int64()), ("sigs", pa.binary()), ("owners", pa.binary()), ("reps", pa.binary())])


def star(sigs: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct entries, whether each is the first of its list, and that first owner."""
    order = np.lexsort((owners, sigs))
    sigs, owners = sigs[order], owners[order]
    new = np.ones(len(sigs), dtype=bool)
    new[1:] = (sigs[1:] != sigs[:-1]) | (owners[1:] != owners[:-1])
    sigs, owners = sigs[new], owners[new]
    first = np.ones(len(sigs), dtype=bool)
    first[1:] = sigs[1:] != sigs[:-1]
    rep = owners[first][np.cumsum(first) - 1]
    return sigs, owners, first, rep


def list_links(docs: DataFrame, rule: Rule, boundary: int, buckets: int) -> DataFrame:
    """(sig, id, rep): every list with two members or more, as a star on ``rep``."""
    classes = size_classes(rule, rule.lowest(boundary), 1 << 31)
    stops = np.array([c.stop for c in classes])
    reach = rule.lowest(boundary)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, lists = WordHashes(), _Lists(buckets)
        for b in batches:
            for doc, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if doc is None or not body:
                    continue
                s = shingle_set(cache.array(rule.words(body)), rule.n)
                if not len(s):
                    continue
                owner = set_id(s)
                if len(s) < boundary:
                    lists.add(subset_signatures(rule, s, boundary), owner)
                if len(s) >= reach:
                    lists.add(part_signatures(rule, s, classes, stops), owner)
                if lists.n >= FLUSH_ROWS:
                    yield from lists.flush()
        yield from lists.flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, owners = [], []
        for b in batches:
            for r in b.to_pylist():
                if r["reps"]:
                    yield pa.RecordBatch.from_arrays([np.frombuffer(r[k], dtype=np.int64) for k in ("sigs", "owners", "reps")], ["sig", "id", "rep"])
                else:
                    sigs.append(np.frombuffer(r["sigs"], dtype=np.uint32).astype(U64) | (U64(r["bucket"]) << U64(32)))
                    owners.append(np.frombuffer(r["owners"], dtype=np.int64))
        if sigs:
            s, o, first, rep = star(np.concatenate(sigs), np.concatenate(owners))
            s, o, rep = s[~first], o[~first], rep[~first]
            for a in range(0, len(s), 50_000):
                yield pa.RecordBatch.from_arrays([s[a : a + 50_000].astype(np.int64), o[a : a + 50_000], rep[a : a + 50_000]], ["sig", "id", "rep"])

    blobs = _texts(docs).mapInArrow(entries, "bucket long, sigs binary, owners binary, reps binary")
    return blobs.repartition(buckets, "bucket").mapInArrow(meet, "sig long, id long, rep long")


def sets_of(docs: DataFrame, owners: DataFrame, rule: Rule) -> DataFrame:
    """(id, n, sketch, shingles) for ``owners`` (doc_id, id): the whole sets, read from the texts again.

    A set may come twice where a row is repeated; links are made distinct later.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batches:
            ids, sets, held = [], [], 0
            for body, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingle_set(cache.array(rule.words(body)), rule.n)
                if set_id(s) == want:
                    ids.append(want)
                    sets.append(s)
                    held += len(s)
                if held > 4_000_000:
                    yield _sets_batch(ids, sets)
                    ids, sets, held = [], [], 0
            yield _sets_batch(ids, sets)

    rows = _texts(docs).where("body is not null").join(small(owners), "doc_id").select("body", "id")
    return rows.mapInArrow(run, "id long, n long, sketch array<long>, shingles array<long>")


def parity_sketch(s: np.ndarray) -> np.ndarray:
    """SKETCH_WORDS longs: per hash bucket, whether the set has an odd number of shingles there.

    Sketches of two sets differ in at most as many bits as the sets in shingles.
    """
    odd = np.bincount((s & U64(64 * SKETCH_WORDS - 1)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets_batch(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    flat = np.concatenate(sets).astype(np.int64) if sets else np.empty(0, dtype=np.int64)
    sketches = np.concatenate([parity_sketch(s) for s in sets]) if sets else np.empty(0, dtype=np.int64)
    at = np.arange(0, len(sketches) + 1, SKETCH_WORDS, dtype=np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(e), pa.array(v, pa.int64())) for e, v in ((at, sketches), (ends, flat))]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(map(len, sets)), pa.int64()), *lists], ["id", "n", "sketch", "shingles"])


def verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) of set ids whose whole sets link.

    Sizes and sketches rule most pairs out before any set is moved.
    """
    side = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"k{x}"))
    least = F.ceil(rule.num * (F.col("na") + F.col("nb")) / (rule.num + rule.den) - 1e-9)
    apart = F.aggregate(F.zip_with("ka", "kb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(rule.den * F.least("na", "nb") >= rule.num * F.greatest("na", "nb"))
    near = near.where(apart <= F.col("na") + F.col("nb") - 2 * least).select("a", "b", "na", "nb")
    held = hold(near)
    near = written(held, held.count(), "near")  # a short plan from here on
    held.unpersist()
    asked = small(near.select(F.col("a").alias("id")).unionAll(near.select(F.col("b").alias("id"))).distinct())
    asked_sets = sets.select("id", "shingles").join(asked, "id", "left_semi")
    whole = lambda x: asked_sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}"))
    both = F.size(F.array_intersect("sa", "sb"))
    linked = near.join(whole("a"), "a").join(whole("b"), "b").where(rule.den * both >= rule.num * (F.col("na") + F.col("nb") - both))
    return linked.select(F.col("a").alias("u"), F.col("b").alias("v"))


def _may_link(rule: Rule) -> Callable[[pa.Table], pa.Table]:
    """Members of a block pair that sizes and sketches let link with a member of another component."""
    columns = ["sig", "i", "j", "block", "id", "component"]

    def run(table: pa.Table) -> pa.Table:
        n, comp, block = (table.column(k).to_numpy() for k in ("n", "component", "block"))
        sketch = table.column("sketch").combine_chunks().flatten().to_numpy().view(U64).reshape(len(n), -1)  # of signed numbers numpy counts the absolute value
        keep = np.zeros(len(n), dtype=bool)
        one_block = block.min() == block.max()
        for k in range(len(n)):
            least = -(-rule.num * (n[k] + n) // (rule.num + rule.den))
            other = comp != comp[k]
            if not one_block:
                other &= block != block[k]
            other[other] = np.bitwise_count(sketch[other] ^ sketch[k]).sum(axis=1, dtype=np.int64) <= (n[k] + n - 2 * least)[other]
            keep[k] = (other & (np.minimum(n[k], n) >= least)).any()
        return table.filter(pa.array(keep)).select(columns)

    return run


def _block_links(rule: Rule) -> Callable:
    """Spanning links of one block pair of a long list (a matrix product over shared shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        ids = table.column("id").to_numpy()
        if len(ids) < 2:
            return
        block = table.column("block").to_numpy()
        comp = table.column("component").to_numpy()
        lists = table.column("shingles").combine_chunks()
        lens = lists.value_lengths().to_numpy()
        owner = np.repeat(np.arange(len(ids)), lens)
        values, token, df = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        shared = df[token] > 1
        owner, token = owner[shared], np.unique(token[shared], return_inverse=True)[1]
        both = np.zeros((len(ids), len(ids)), dtype=np.float32)
        width = 4096
        order = np.argsort(token, kind="stable")
        owner, token = owner[order], token[order]
        for lo in range(0, int(token[-1]) + 1 if len(token) else 0, width):
            a, e = np.searchsorted(token, [lo, lo + width])
            x = np.zeros((len(ids), width), dtype=np.float32)
            x[owner[a:e], token[a:e] - lo] = 1
            both += x @ x.T
        union = lens[:, None] + lens[None, :] - both
        link = rule.den * both.astype(np.float64) >= rule.num * union
        one_block = block.min() == block.max()
        if not one_block:
            link &= block[:, None] != block[None, :]
        link &= comp[:, None] != comp[None, :]
        label = np.arange(len(ids))
        while True:
            near = np.where(link, label[None, :], len(ids)).min(axis=1)
            after = np.minimum(label, near)
            after = after[after]
            if (after == label).all():
                break
            label = after
        moved = np.flatnonzero(label != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[moved], pa.int64()), pa.array(ids[label[moved]], pa.int64())], ["u", "v"])

    return run


def jaccard_components(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(doc_id, n_shingles, set_id, component_id), one row per row of ``docs``.

    ``component_id`` is the smallest doc_id that links reach, itself included.
    Empty or null texts have no shingles and stand alone; rows with a null
    doc_id are returned with a null component and link with nothing; repeated
    rows and equal texts are copies of one set.  Other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    sizes = hold(set_sizes(docs, rule))
    named = sizes.where("doc_id is not null and set_id is not null")
    counts = {r[0]: r[1] for r in named.where(F.col("n_shingles") <= MAX_LIGHT).groupBy("n_shingles").count().collect()}
    boundary = choose_boundary(rule, counts)
    total = named.agg(F.sum("n_shingles")).first()[0] or 0
    entries = 2 * total * (rule.den - rule.num) // rule.num
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), entries // ROWS_PER_BUCKET + 1)

    found = hold(list_links(docs, rule, boundary, int(buckets)))
    n_lists = found.count()
    lists = written(found, n_lists, "lists")
    found.unpersist()
    pairs = lists.select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct()
    met = lists.select("id").unionAll(lists.select(F.col("rep").alias("id"))).distinct()
    owners = named.select("doc_id", F.col("set_id").alias("id")).join(met, "id").groupBy("id").agg(F.min("doc_id").alias("doc_id"))
    owners = written(owners, n_lists, "owners")
    sets = hold(sets_of(docs, owners, rule))
    stars = written(verified(pairs, sets, rule), n_lists, "links")
    first = components(stars)

    # lists whose members are still apart
    members = lists.select("sig", "id").unionAll(lists.select("sig", F.col("rep").alias("id"))).distinct()
    comp = first.select(F.col("node").alias("id"), "component")
    placed = members.join(comp, "id", "left").select("sig", "id", F.coalesce("component", "id").alias("component"))
    placed = written(placed, 2 * n_lists, "placed")
    spread = placed.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("k")).where("lo < hi").select("sig", "k")
    apart = written(placed.join(spread, "sig"), 2 * n_lists, "apart")

    short = apart.where(F.col("k") <= SHORT_LIST)
    left = short.select("sig", F.col("id").alias("a"), F.col("component").alias("ca"))
    right = short.select("sig", F.col("id").alias("b"), F.col("component").alias("cb"))
    crossed = left.join(right, "sig").where("a > b and ca <> cb").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
    extra = verified(crossed, sets, rule)

    n_blocks = F.ceil(F.col("k") / BLOCK).cast("int")
    long = apart.where(F.col("k") > SHORT_LIST).select("sig", "id", "component", F.pmod(F.xxhash64("id"), n_blocks).cast("int").alias("block"), n_blocks.alias("n"))
    long = long.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    long = long.select("sig", "id", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    sketched = long.join(sets.select("id", "n", "sketch"), "id").groupBy("sig", "i", "j")
    long = sketched.applyInArrow(_may_link(rule), "sig long, i int, j int, block int, id long, component long")
    blocks = sets.select("id", "shingles").join(small(long), "id").groupBy("sig", "i", "j").applyInArrow(_block_links_grouped(rule), "u long, v long")

    links = stars.unionAll(extra).unionAll(blocks)
    final = components(links).select(F.col("node").alias("set_id"), "component")
    keyed = sizes.join(final, "set_id", "left").select("doc_id", "n_shingles", "set_id", F.coalesce("component", "set_id").alias("component"))
    lowest = keyed.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("lowest"))
    return keyed.join(lowest, "component", "left").select("doc_id", "n_shingles", "set_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("lowest", "doc_id")).alias("component_id"))


def _block_links_grouped(rule: Rule) -> Callable[[pa.Table], pa.Table]:
    run = _block_links(rule)
    empty = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def grouped(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(run(table.to_batches())), schema=empty)

    return grouped


def keep_one(docs: DataFrame, rule: Rule) -> DataFrame:
    """One document of each linked group (the smallest doc_id), all columns of ``docs``.

    Rows with a null doc_id stay; of repeated rows with one doc_id and text one stays.
    """
    found = hold(jaccard_components(docs, rule))
    dropped = small(found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct())
    kept = docs.join(dropped, docs["doc_id"] == dropped["__gone"], "left_anti")
    again = small(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__again")))  # no texts move when few ids repeat
    single = kept.join(again, kept["doc_id"] == again["__again"], "left_anti")
    repeated = kept.join(again, kept["doc_id"] == again["__again"], "left_semi").dropDuplicates(["doc_id", "text"])
    return single.unionByName(repeated)
