"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Rotations are learned on a bounded sample (principal axes, then alternating sign and Procrustes steps),
and a vector's code is the signs of its parts under all of them, ``CODE_BITS`` or a little more. Rows are
dealt into blocks by hash; a block cuts its codes into substrings of 16 bits and indexes each. A query
probes, substring by substring, the occupied values within floor(radius / substrings) bits: by the
pigeonhole principle this meets every code within the radius. Once it has met most of a block, which it
does on vectors without structure, the rest of the block counts as met. Met codes are compared whole, and
those within the radius are reranked by the exact distance on the original vectors in double precision:
3 % of the rows on vectors without structure. The radius is learned on the sample so that it covers
``COVER`` of true neighbours; a block that finds fewer than k rows widens it, up to all bits, so each query
gets min(k, candidates) rows.

Each query meets every block once; blocks return their k best, and the best of these are the answer.
Blocks are bounded (``BLOCK_ROWS``, ``QUERY_ROWS``), so no vector, however often repeated, makes a large
task. Defined results: vectors that are null, empty, zero or hold null or non-finite components, and
those of another length than most of the sample, take no part; rows with a null id are no candidates;
rows with the query's id are its own; a query row repeated whole is one query; ties go to the smaller
id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialise, partitions, table

SAMPLE_ROWS = 20_000
BLOCK_ROWS = 65_536
QUERY_ROWS = 8_192
SUB_BITS = 16
#: Long codes tell near from far better, so fewer rows are reranked for the same recall.
CODE_BITS = 512
COVER = 0.97
OUT = "query_id long, query_hash long, vec_id long, score double"


class Codes:
    """Rotations (as many as give ``min_bits`` bits) and the radius for their codes."""

    def __init__(self, sample: np.ndarray, k: int, seed: int = 5, min_bits: int = CODE_BITS):
        rng = np.random.default_rng(seed)
        d = sample.shape[1]
        self.mean = sample.mean(0)
        x = sample - self.mean
        _, axes = np.linalg.eigh(x.T @ x)
        self.rotations = []
        y = x @ axes
        for _ in range(max(1, -(-min_bits // d))):
            r = np.linalg.qr(rng.normal(size=(d, d)))[0]
            for _ in range(30):
                u, _, vt = np.linalg.svd(np.where(y @ r >= 0, 1.0, -1.0).T @ y)
                r = (u @ vt).T
            self.rotations.append(axes @ r)
        self.bits = d * len(self.rotations)
        self.words = 4 * -(-self.bits // 64)
        self.radius = self._learn_radius(sample, k)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Rows of 16-bit substrings; bits beyond the code are 0 in all of them."""
        out = np.empty((len(x), self.words), np.uint16)
        for lo in range(0, len(x), 4096):
            signs = np.concatenate([(x[lo : lo + 4096] - self.mean) @ r >= 0 for r in self.rotations], 1)
            signs = np.pad(signs, ((0, 0), (0, self.words * SUB_BITS - self.bits)))
            out[lo : lo + 4096] = np.packbits(signs, axis=1).view(np.uint16)
        return out

    def _learn_radius(self, sample: np.ndarray, k: int) -> int:
        q = sample[:: max(1, len(sample) // 200)]
        codes, own = self.encode(sample), self.encode(q)
        met = []
        for v, c in zip(q, own, strict=True):
            near = np.argpartition(((sample - v) ** 2).sum(1), min(k, len(sample) - 1))[: k + 1]
            met.append(np.bitwise_count(codes[near] ^ c).sum(1))
        return int(np.quantile(np.concatenate(met), COVER)) if met else self.bits


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), bad.alias("bad"), F.exists(v, lambda x: x != 0).alias("some"))
    return rows.where("vec_id is not null and v is not null and not bad and some").select("vec_id", F.col("v").cast("array<double>").alias("v"))


def _matrix(t: pa.Table, column: str, d: int) -> np.ndarray:
    return t.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def fit(rows: DataFrame, k: int, sample_rows: int = SAMPLE_ROWS) -> Codes | None:
    """Codes from ``sample_rows`` vectors at most, chosen by hash."""
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("v").collect()]
    if not sample:
        return None
    sizes = [len(v) for v in sample]
    d = max(set(sizes), key=lambda s: (sizes.count(s), s))
    return Codes(np.array([v for v in sample if len(v) == d], np.float64), k)


class BlockIndex:
    """Multi-index tables over the codes of one block."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.tables = codes, []
        self.wide = np.ascontiguousarray(codes).view(np.uint64)  # whole codes, compared 64 bits at a time

    def _table(self, s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows by the value of a substring, the values, where each one's rows begin; made when first probed."""
        while len(self.tables) <= s:
            column = self.codes[:, len(self.tables)]
            order = np.argsort(column, kind="stable")
            values, starts = np.unique(column[order], return_index=True)
            self.tables.append((order, values, np.append(starts, len(order))))
        return self.tables[s]

    def met(self, code: np.ndarray, radius: int) -> np.ndarray:
        """The rows that probing meets: all within the radius and some more."""
        n, words = self.codes.shape
        part, found = radius // words, np.zeros(n, bool)
        for s in range(words):
            order, values, starts = self._table(s)
            near = np.flatnonzero(np.bitwise_count(values ^ code[s]) <= part)
            sizes = starts[near + 1] - starts[near]
            at = np.repeat(starts[near] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            found[order[at]] = True
            if 2 * np.count_nonzero(found) > n:
                return np.arange(n)
        return np.flatnonzero(found)

    def within(self, code: np.ndarray, radius: int, near: np.ndarray | None = None) -> np.ndarray:
        """The rows whose code differs in at most ``radius`` bits."""
        rows = self.met(code, radius) if near is None else near
        wide = self.wide if len(rows) == len(self.wide) else self.wide[rows]
        return rows[np.bitwise_count(wide ^ code.view(np.uint64)).sum(1, dtype=np.int32) <= radius]


def nearest(df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", codes: Codes | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of ``df`` found for each row of ``queries``."""
    spark = df.sparkSession
    rows = materialise(usable(df, id_col, vector_col), "ann-rows")
    asked = usable(queries, id_col, vector_col).dropDuplicates()
    codes = codes or fit(rows, k)
    if codes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = len(codes.mean)
    rows, asked = rows.where(F.size("v") == d), asked.where(F.size("v") == d)
    n_blocks = max(partitions(spark), -(-rows.count() // BLOCK_ROWS))
    n_asked = max(1, -(-asked.count() // QUERY_ROWS))
    shared = spark.sparkContext.broadcast(codes)  # a few square matrices of d columns, whatever the rows

    def search(block: pa.Table, ask: pa.Table) -> pa.Table:
        c, out = shared.value, []
        if len(block) and len(ask):
            ids, x = block.column("vec_id").to_numpy(), _matrix(block, "v", d)
            index = BlockIndex(c.encode(x))
            q = _matrix(ask, "v", d)
            for i, h, v, code in zip(ask.column("vec_id").to_pylist(), ask.column("hash").to_pylist(), q, c.encode(q), strict=True):
                radius = c.radius
                while True:
                    at = index.within(code, radius)
                    at = at[ids[at] != i]
                    if len(at) >= k or radius >= c.bits:
                        break
                    radius = min(c.bits, radius + c.words)
                far = np.sqrt(((x[at] - v) ** 2).sum(1))
                best = np.lexsort((ids[at], far))[:k]
                out += [(i, h, int(ids[at[j]]), float(far[j])) for j in best]
        a, b, e, f = zip(*out, strict=True) if out else ((),) * 4
        return pa.table({"query_id": pa.array(a, pa.int64()), "query_hash": pa.array(b, pa.int64()), "vec_id": pa.array(e, pa.int64()), "score": pa.array(f, pa.float64())})

    block = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n_blocks)).cast("int")
    dealt = rows.withColumn("block", block).withColumn("ask", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))
    asked = asked.withColumn("hash", F.xxhash64("v")).withColumn("ask", F.pmod(F.col("hash"), F.lit(n_asked)).cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    found = dealt.groupBy("block", "ask").cogroup(asked.groupBy("block", "ask")).applyInArrow(search, OUT)
    best = Window.partitionBy("query_id", "query_hash").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))
