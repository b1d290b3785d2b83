"""Near-duplicate documents by SetSketch registers, banded, jointly estimated, then verified.

A document's set holds its distinct word shingles; a ``Rule`` says of how many words, and how similar linked
sets are. Each register is the minimum of exponentials over
the set, kept as its exponent in base ``BASE``, so that registers of a union are the larger ones. Equal
word sequences form one class first; the work that follows is on classes.

1. ``rows`` registers a band, ``bands`` bands: classes that agree on a band share a bucket. At its
   threshold a pair misses all bands with a probability of 4e-6 under ``CONTRACT`` (at 0.9 of 5e-10), of
   1.3e-5 under ``FIVE_WORDS``.
2. Each class is paired with its buckets' smallest member. Pairs whose sizes can't reach the threshold go;
   for the rest the likelihood of the registers' three-way comparison, given both sizes, decides: a pair
   stays if the best similarity isn't below ``floor``, over four standard deviations under the threshold.
3. The pairs are verified on full sets, and links joined to components by alternating star steps.
4. A bucket that still holds two or more components may hide links between members. They are compared in
   bounded blocks inside the tasks, by the same two filters and only in the first band a pair shares, then
   by ``DEEP`` further registers of four bits, whose estimate stays over ``deep_floor``, again over four
   standard deviations under the threshold. Pairs that stay are verified like the others. So no bucket is
   ever expanded into all its pairs, and none is cut short.

Defined results: null text counts as empty; empty texts and texts of white space have an empty set and
are linked with nothing; texts of fewer words than a shingle have one; a null doc_id is no candidate for
component_id unless its whole component has none; repeated rows are copies, which all carry the kept
doc_id in ``link``, and one of which stays in ``keep_one``; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import id_and_text, materialise, one_row_each, partitions, prefilter, table

REGISTERS = 224
BASE = 1.001
DEEP = 2048
#: Rows of a bucket in one block; pairs verified in one group and bytes of their sets, about.
BLOCK = 512
PAIRS = 2000
CELL_BYTES = 64 << 20


@dataclass(frozen=True)
class Rule:
    """Which sets are linked: ``per_cent`` * union <= 100 * intersection; and the filters that go with it."""

    shingle: int
    per_cent: int
    rows: int
    bands: int
    floor: float
    deep_floor: float


#: The contract of op5: three words, 0.85.
CONTRACT = Rule(3, 85, 7, 32, 0.75, 0.815)
#: What stages without a contract of their own take: five words, 0.8.
FIVE_WORDS = Rule(5, 80, 6, 37, 0.69, 0.762)

_RNG = np.random.default_rng(85_20240229)
_MUL = _RNG.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)
_DEEP_MUL = _RNG.integers(0, 1 << 63, DEEP, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_DEEP_ADD = _RNG.integers(0, 1 << 63, DEEP, dtype=np.uint64)
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_ODD = _RNG.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The largest exponential a 64-bit minimum can stand for; exponents count down from it.
_LARGEST = 64 * np.log(2)


class _WordHash(dict):
    """Remembered 64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:  # so a bound on entries is one on bytes
            if len(self) > 500_000:
                self.clear()
            self[word] = h
        return h


_WORDS = _WordHash()


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A to Z) words between ASCII white space."""
    return text.encode().translate(_LOWER).split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    k = min(size, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mixed(out + h[i : len(h) - k + 1 + i] * _ODD[i])
    return np.unique(out)


def sketch(s: np.ndarray) -> np.ndarray:
    """The registers of a non-empty set."""
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(s), 512):
        np.minimum(low, (s[lo : lo + 512, None] * _MUL + _ADD).min(0), out=low)
    x = -np.log1p(-(low.astype(np.float64) + 1) / 2.0**64 * (1 - 1e-16))  # an exponential of rate len(s)
    return np.clip(np.floor(1 - np.log(x / _LARGEST) / np.log(BASE)), 0, 65535).astype("<u2")


def deep_sketch(s: np.ndarray) -> np.ndarray:
    """Four bits of the minimum of each further register, two a byte."""
    low = np.full(DEEP, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(s), 64):
        np.minimum(low, (s[lo : lo + 64, None] * _DEEP_MUL + _DEEP_ADD).min(0), out=low)
    four = (_mixed(low) >> np.uint64(60)).astype(np.uint8)
    return four[::2] << 4 | four[1::2]


def deep_similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The similarities that rows of deep sketches stand for: one in sixteen registers agrees by chance."""
    x = a ^ b
    same = ((x & 15 == 0).sum(1) + (x >> 4 == 0).sum(1)) / DEEP
    return (same - 1 / 16) / (15 / 16)


def _p(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chance that one register exceeds the other where a share x of the union is on its side, and its slope."""
    c = (BASE - 1) / BASE
    inner = 1 - x * c
    return -np.log(inner) / np.log(BASE), c / (inner * np.log(BASE))


def may_link(rule: Rule, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether pairs of sketches (rows) can be of linked sets: by size, then by the likelihood's slope at the floor.

    The log-likelihood is concave in the similarity, so its maximum lies at the floor or above exactly when the
    slope there isn't negative.
    """
    n_a, n_b = n_a.astype(np.float64), n_b.astype(np.float64)
    out = 100 * np.minimum(n_a, n_b) >= rule.per_cent * np.maximum(n_a, n_b)
    at = np.flatnonzero(out)
    a, b, u = a[at], b[at], (n_a / (n_a + n_b))[at]
    v = 1 - u
    more, less = (a > b).sum(1), (a < b).sum(1)
    (p, dp), (q, dq) = _p(u - v * rule.floor), _p(v - u * rule.floor)
    slope = -more * v * dp / p - less * u * dq / q + (REGISTERS - more - less) * (v * dp + u * dq) / (1 - p - q)
    out[at] = slope >= 0
    return out


FEATURES = "doc_id long, text_hash long, key binary, n long, sketch binary"


def _features(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for b in batches:
            for lo in range(0, len(b), 512):
                some, keys, n, sketches = b.slice(lo, 512), [], [], []
                for t in some.column(2):
                    words = words_of(t.as_py())
                    s = shingles(words, rule.shingle)
                    keys.append(xxh3_128_digest(b" ".join(words)) if words else None)
                    n.append(len(s))
                    sketches.append(sketch(s).tobytes() if words else None)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(sketches, pa.binary())], ["doc_id", "text_hash", "key", "n", "sketch"])

    return run


def _sets(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for b in batches:
            for lo in range(0, len(b), 64):
                words = [words_of(t.as_py()) for t in b.slice(lo, 64).column(0)]
                sets = [shingles(w, rule.shingle) for w in words]
                cells = [xxh3_128_digest(b" ".join(w)) for w in words], [s.tobytes() for s in sets], [deep_sketch(s).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in cells], ["key", "members", "deep"])

    return run


def bands(classes: DataFrame, rule: Rule) -> DataFrame:
    """(bucket, band, key) of each class and band."""
    each = [F.struct(F.xxhash64(F.substring("sketch", 1 + 2 * rule.rows * i, 2 * rule.rows), F.lit(i)).alias("bucket"), F.lit(i).alias("band")) for i in range(rule.bands)]
    return classes.select("key", F.explode(F.array(*each)).alias("x")).select("x.bucket", "x.band", "key")


def verify(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The linked ones of distinct ``pairs`` (a, b, size: members of both sets), by their full sets.

    Pairs are dealt by a grid of the hashes of both sides, crowded cells further by the pair, so that the sets
    of a cell hold about ``CELL_BYTES`` at most; each cell gets each set it needs once.
    """
    n = pairs.count()
    side = max(1, int((n / PAIRS) ** 0.5))
    cell = F.struct(F.pmod(F.xxhash64("a"), F.lit(side)).alias("i"), F.pmod(F.xxhash64("b"), F.lit(side)).alias("j"))
    by_count, by_bytes = F.ceil(F.count("*") / (2 * PAIRS)), F.ceil(F.sum("size") * 8 / CELL_BYTES)
    counts = pairs.groupBy(cell.alias("c")).agg(F.greatest(by_count, by_bytes).alias("parts"))  # a row a cell
    dealt = pairs.withColumn("c", cell).join(counts, "c").select("a", "b", F.xxhash64("c", F.pmod(F.xxhash64("a", "b"), F.col("parts"))).alias("cell"))
    dealt = materialise(dealt, "mh-dealt")
    need = dealt.select("cell", F.explode(F.array("a", "b")).alias("key")).distinct()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        of = dict(zip(right.column("key").to_pylist(), (np.frombuffer(x.as_buffer(), np.uint64) for c in right.column("members").chunks for x in c), strict=True))
        keep = []
        for a, b in zip(left.column("a").to_pylist(), left.column("b").to_pylist(), strict=True):
            x, y = of[a], of[b]
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            keep.append(100 * both >= rule.per_cent * (len(x) + len(y) - both))
        return left.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    full = need.join(sets.select("key", "members"), "key").select(F.col("cell").alias("at"), "key", "members")
    return dealt.groupBy("cell").cogroup(full.groupBy("at")).applyInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(key, root) of all keys in ``links`` (a, b) but the roots: root is the smallest key reachable.

    Alternating large-star and small-star steps: each is an aggregate and a join on distributed tables,
    and the number of steps grows with the logarithm of the graph's size.
    """
    def ordered(u, v) -> DataFrame:
        return F.struct(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))

    edges = materialise(links.where("a <> b").select(ordered(F.col("a"), F.col("b")).alias("e")).select("e.u", "e.v").distinct(), "cc-edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m")), "cc-low").select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(large.distinct(), "cc-large")
        low = materialise(edges.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
        small = edges.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v")
        edges = materialise(small.distinct(), "cc-small")
        seen = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == mark:
            return edges.select(F.col("u").alias("key"), F.col("v").alias("root"))
        mark = seen


def _cross(members: DataFrame, sketches: DataFrame, rule: Rule) -> DataFrame:
    """Candidate pairs (a, b, size) of different components inside the buckets of ``members`` (bucket, band, key, root).

    The members of a bucket outside its largest component are met by all members, in blocks of ``BLOCK``.
    ``sketches`` (key, n, sketch, deep) joins the members of mixed buckets only.
    """
    spark = members.sparkSession
    sizes = members.groupBy("bucket", "root").agg(F.count("*").alias("n_root"))
    whole = sizes.groupBy("bucket").agg(F.sum("n_root").alias("size"), F.max(F.struct("n_root", "root")).alias("most"), F.count("*").alias("roots"))
    whole = materialise(whole.where("roots > 1").select("bucket", "size", F.col("most.root").alias("most_root"), (F.col("size") - F.col("most.n_root")).alias("rest")), "mh-mixed")
    rows = members.join(whole, "bucket").join(sketches, "key")
    tall, wide = F.ceil(F.col("size") / BLOCK), F.ceil(F.col("rest") / BLOCK)
    at = F.xxhash64("key")
    # small buckets go together, a large one has a cell for each pair of blocks
    n_groups = max(partitions(spark), -(-int(whole.agg(F.sum("size")).first()[0] or 0) // (4 * BLOCK)))
    cells = F.when(tall == 1, F.array(F.pmod("bucket", F.lit(n_groups))))
    down = F.transform(F.sequence(F.lit(0).cast("long"), wide - 1), lambda j: F.xxhash64(F.col("bucket"), F.pmod(at, tall), j))
    across = F.transform(F.sequence(F.lit(0).cast("long"), tall - 1), lambda i: F.xxhash64(F.col("bucket"), i, F.pmod(at, wide)))
    both = F.transform(F.coalesce(cells, down), lambda c: F.struct(c.alias("cell"), F.lit(False).alias("asks")))
    asks = F.transform(F.coalesce(cells, across), lambda c: F.struct(c.alias("cell"), F.lit(True).alias("asks")))
    both = F.when(F.col("root") == F.col("most_root"), both).otherwise(F.concat(both, asks))
    dealt = rows.select("*", F.explode(both).alias("c")).select("c.cell", "c.asks", "bucket", "band", "key", "root", "n", "sketch", "deep")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("bucket", "ascending"), ("asks", "ascending")])
        key, root = (np.array(t.column(c).to_pylist(), object) for c in ("key", "root"))
        bucket, band, n, asks = (t.column(c).to_numpy() for c in ("bucket", "band", "n", "asks"))
        sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), "<u2").reshape(len(t), REGISTERS)
        deep = np.frombuffer(b"".join(t.column("deep").to_pylist()), np.uint8).reshape(len(t), DEEP // 2)
        ends = np.append(np.flatnonzero(np.diff(bucket)) + 1, len(t))
        out: list[tuple[bytes, bytes, int]] = []
        for lo, hi in zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist(), strict=True):
            mid = lo + int((~asks[lo:hi]).sum())
            for i in range(mid, hi):
                # each pair of two that ask is met once
                other = lo + np.flatnonzero(root[lo:mid] != root[i])
                j = other[may_link(rule, np.broadcast_to(sk[i], (len(other), REGISTERS)), sk[other], np.full(len(other), n[i]), n[other])]
                if len(j):
                    same = (sk[j] == sk[i])[:, : rule.bands * rule.rows].reshape(len(j), rule.bands, rule.rows).all(2)
                    j = j[same.argmax(1) == band[i]]
                    j = j[deep_similarity(deep[j], deep[i]) >= rule.deep_floor]
                    out += [(min(key[i], key[x]), max(key[i], key[x]), int(n[i] + n[x])) for x in j]
        a, b, size = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "size": pa.array(size, pa.int64())})

    return dealt.groupBy("cell").applyInArrow(run, "a binary, b binary, size long").distinct()


def _linked(df: DataFrame, rule: Rule, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, key, n, sketch), written, and classes (key, best, root): ``best`` is the first
    (is null, doc_id, text_hash) of a class, ``root`` the same for all classes of a component."""
    docs = id_and_text(df, id_col, text_col)
    rows = materialise(docs.select("doc_id", F.xxhash64("text"), "text").mapInArrow(_features(rule), FEATURES), "mh-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    classes = materialise(rows.where("key is not null").groupBy("key").agg(first.alias("best"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "mh-classes")
    all_bands = bands(classes, rule)
    reps = materialise(all_bands.groupBy("bucket").agg(F.min("key").alias("rep"), F.max("key").alias("end")).where("rep < end").select("bucket", "rep"), "mh-reps")
    shared = materialise(all_bands.join(reps, "bucket"), "mh-shared")
    star = materialise(shared.where("key <> rep").select(F.col("rep").alias("a"), F.col("key").alias("b")).distinct(), "mh-star")
    members = materialise(shared.select("key").distinct().join(classes, "key"), "mh-members")
    need = members.select(F.col("best.doc_id").alias("_low"), F.col("key").alias("_key"))
    ids = need.select("_low").distinct()
    sets = prefilter(docs, "doc_id", ids, "_low").join(ids, F.col("doc_id").eqNullSafe(F.col("_low")), "left_semi").select("text").mapInArrow(_sets(rule), "key binary, members binary, deep binary")
    sets = materialise(sets.join(need.select(F.col("_key").alias("key")), "key", "left_semi").dropDuplicates(["key"]), "mh-sets")

    side = members.select("key", "n", "sketch")
    wide = star.join(side.toDF("a", "n_a", "sk_a"), "a").join(side.toDF("b", "n_b", "sk_b"), "b")

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if len(x):
                sk = [np.frombuffer(b"".join(x.column(c).to_pylist()), "<u2").reshape(len(x), REGISTERS) for c in ("sk_a", "sk_b")]
                n = [x.column(c).to_numpy() for c in ("n_a", "n_b")]
                keep = pa.array(may_link(rule, *sk, *n))
                yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b"), pa.array(n[0] + n[1])], ["a", "b", "size"]).filter(keep)

    links = materialise(verify(materialise(wide.mapInArrow(likely, "a binary, b binary, size long"), "mh-likely"), sets, rule), "mh-links")
    # whole components: members that are already linked in a chain needn't be compared again
    roots = materialise(components(links), "mh-roots")
    rooted = members.select("key").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    sketches = side.join(sets.select("key", "deep"), "key")
    mixed = materialise(_cross(shared.select("bucket", "band", "key").join(rooted, "key"), sketches, rule).join(star, ["a", "b"], "left_anti"), "mh-cross")
    more = verify(mixed, sets, rule)
    roots = materialise(components(roots.toDF("a", "b").unionByName(more)), "mh-roots")
    named = classes.select("key", "best").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    return rows, materialise(named, "mh-named")


def link(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = CONTRACT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``df``."""
    rows, named = _linked(df, rule, id_col, text_col)
    lows = materialise(named.groupBy("root").agg(F.min("best.doc_id").alias("component_id")), "mh-lows")
    of_class = materialise(named.join(lows, "root").select("key", "component_id"), "mh-components")
    out = rows.select("doc_id", "n", "key").join(of_class, "key", "left")
    own = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = FIVE_WORDS) -> DataFrame:
    """``df`` with one row of each component, its smallest doc_id's (null last), and all rows with an empty set."""
    rows, named = _linked(df, rule, id_col, text_col)
    best = named.groupBy("root").agg(F.min("best").alias("best")).select("best.doc_id", "best.text_hash")
    held = rows.where("key is not null").groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows"))
    mine = held.doc_id.eqNullSafe(best.doc_id) & (held.text_hash == best.text_hash)
    empty = rows.where("key is null").select("doc_id", "text_hash", F.lit(1).cast("long").alias("rows")).distinct()
    won = materialise(held.join(best, mine, "left_semi").unionByName(empty), "mh-won")
    return one_row_each(df, won, id_col, text_col)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))
