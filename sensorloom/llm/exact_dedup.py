"""Exact dedup by a minimal perfect hash over the distinct digests of a history.

``build_index`` groups the history's texts (equal after deleting ASCII white space) by SHA-256,
deals the distinct digests into buckets and builds one minimal perfect hash a bucket; each slot holds
the full digest and the locator of the group's best row. ``assign`` sends the distinct digests of a
batch through the slots: a digest whose slot holds the same bytes is a repeat, all others are new and
group among themselves. Only distinct digests, after map-side combining, are dealt by key; what goes
back to the single rows is a plain join, whose hot keys AQE splits.

Defined results: null text counts as empty and empty texts are equal to each other; of equal texts
the row with most code points, then the smallest doc_id (null last), then the first read stays; a row
repeated with the same doc_id is a copy like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WHITE_SPACE, id_and_text, materialise, one_row_each, partitions, table
from .mph import MinimalPerfectHash

#: About as many distinct digests a bucket; bounds the memory of a build or lookup task.
BUCKET_KEYS = 200_000
BEST = "struct<n_chars:int,not_id:bigint,not_row:bigint>"
_BEST = pa.struct([("n_chars", pa.int32()), ("not_id", pa.int64()), ("not_row", pa.int64())])


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, digest, n_chars, text_hash) of each row; ``row`` tells repeated rows apart once this is written."""
    bare = F.translate(F.col("text"), WHITE_SPACE, "")
    return id_and_text(df, id_col, text_col).select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        F.unhex(F.sha2(bare.cast("binary"), 256)).alias("digest"), F.char_length("text").alias("n_chars"), F.xxhash64("text").alias("text_hash"),
    )


def groups(rows: DataFrame) -> DataFrame:
    """(digest, best, n) of each distinct digest; map-side combined, so a hot digest costs a row a task.

    ``best`` is the largest of (code points, ~doc_id, ~row), bits inverted so that small ones come first
    whatever their sign; a null doc_id comes last.
    """
    best = F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("not_id"), F.bitwise_not("row").alias("not_row")))
    return rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("n"))


def bucket(n: int):
    return F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int")


def _fingerprints(digest: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(digest.to_pylist()), "<u8").reshape(-1, 4)[:, 0].copy()


def build_index(history: DataFrame, n_buckets: int) -> DataFrame:
    """Slots (bucket, slot, digest, best, n) and, in slot -1 of each bucket, its pickled hash function."""

    def build(t: pa.Table) -> pa.Table:
        b = t.column("bucket")[0].as_py()
        f = MinimalPerfectHash(_fingerprints(t.column("digest").combine_chunks()))
        slots = f.lookup(_fingerprints(t.column("digest").combine_chunks()))
        out = pa.table({"bucket": t.column("bucket"), "slot": pa.array(slots), "digest": t.column("digest"), "best": t.column("best").cast(_BEST), "n": t.column("n"), "hash": pa.nulls(len(t), pa.binary())})
        head = pa.table({"bucket": pa.array([b], pa.int32()), "slot": pa.array([-1], pa.int64()), "digest": pa.nulls(1, pa.binary()), "best": pa.nulls(1, _BEST), "n": pa.nulls(1, pa.int64()), "hash": pa.array([pickle.dumps(f)], pa.binary())})
        return pa.concat_tables([head, out.cast(head.schema)])

    schema = f"bucket int, slot long, digest binary, best {BEST}, n long, hash binary"
    return history.withColumn("bucket", bucket(n_buckets)).groupBy("bucket").applyInArrow(build, schema)


def assign(batch: DataFrame, index: DataFrame, n_buckets: int) -> DataFrame:
    """(digest, member, best, n) of the batch's distinct digests: byte-checked members carry the slot's
    locator and count together with their own, nonmembers only their own."""

    def probe(new: pa.Table, slots: pa.Table) -> pa.Table:
        ours = list(zip(new.column("best").to_pylist(), new.column("n").to_pylist(), strict=True))
        keys = new.column("digest").to_pylist()
        member = [False] * len(keys)
        if len(slots) and len(keys):
            slots = slots.sort_by("slot")
            f = pickle.loads(slots.column("hash")[0].as_py())
            held, best, n = (slots.column(c).slice(1).combine_chunks() for c in ("digest", "best", "n"))
            at = f.lookup(_fingerprints(new.column("digest").combine_chunks()))
            for i in np.flatnonzero(at >= 0).tolist():
                s = int(at[i])
                if held[s].as_py() == keys[i]:  # the bytes decide, not the hash
                    member[i] = True
                    ours[i] = (max(ours[i][0], best[s].as_py(), key=_rank), ours[i][1] + n[s].as_py())
        return pa.table({"digest": pa.array(keys, pa.binary()), "member": pa.array(member, pa.bool_()), "best": pa.array([x for x, _ in ours], _BEST), "n": pa.array([n for _, n in ours], pa.int64())})

    left, right = batch.withColumn("bucket", bucket(n_buckets)).groupBy("bucket"), index.groupBy("bucket")
    return left.cogroup(right).applyInArrow(probe, f"digest binary, member boolean, best {BEST}, n long")


def _rank(best: dict) -> tuple:
    low = -(2**63) - 1
    return best["n_chars"], *(low if best[k] is None else best[k] for k in ("not_id", "not_row"))


def resolve(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", history_share: int = 2) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256, in_history.

    The table is taken as a stream of two batches: the rows whose digest-independent row hash falls in
    one of ``history_share`` classes are the history that the index is built on, all others come later
    and are looked up. The result doesn't depend on that split.
    """
    spark = df.sparkSession
    rows = materialise(digests(df, id_col, text_col).withColumn("late", F.pmod(F.xxhash64("doc_id", "row"), F.lit(history_share)) != 0), "exact-rows")
    past, late = materialise(groups(rows.where(~F.col("late"))), "exact-past"), groups(rows.where("late"))
    n_buckets = max(partitions(spark), -(-past.count() // BUCKET_KEYS))
    index = materialise(build_index(past, n_buckets), "exact-index")
    seen = assign(late, index, n_buckets)
    # digests that only the history holds are in no batch; slots of the others are superseded by their entry
    entries = index.where("slot >= 0").select("digest", F.lit(False).alias("member"), "best", "n").unionByName(seen)
    repeats = materialise(entries.groupBy("digest").agg(F.max_by(F.struct("best", "n", "member"), "n").alias("e")).where("e.n > 1").select("digest", "e.*"), "exact-groups")
    out = rows.join(repeats, "digest", "left")
    alone = F.col("best").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.bitwise_not("best.not_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.bitwise_not("best.not_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), F.coalesce("member", F.lit(False)).alias("in_history"), "row", "text_hash",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they are."""
    rows = materialise(resolve(docs, id_col, text_col).select("doc_id", "text_hash", "kept"), "exact-resolved")
    won = rows.groupBy("doc_id", "text_hash").agg(F.max("kept").alias("kept"), F.count("*").alias("rows")).where("kept").drop("kept")
    return one_row_each(docs, materialise(won, "exact-won"), id_col, text_col)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve(table(spark, sf_dir, "documents")).drop("row", "in_history", "text_hash")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
h AS (SELECT doc_id, length(t) AS n, sha256(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS s FROM d)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, s AS text_sha256
FROM h WINDOW w AS (PARTITION BY s ORDER BY n DESC, doc_id)
"""
