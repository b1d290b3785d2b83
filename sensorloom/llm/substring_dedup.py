"""Substring dedup by content-defined chunks of a gear rolling hash.

The hash of a place covers the 16 bytes before it: h = (h << 1) + gear[byte] in 16 bits, so a byte is
shifted out after 16 steps. Texts are cut by winnowing: at the smallest hash, rightmost of equals, of every
``WINDOW`` places in a row. So a cut depends on nearby bytes only, none is further than ``WINDOW`` bytes
from the next, and a repeated passage shares all its cuts but those in its first ``WINDOW`` + 15 and last
``WINDOW`` bytes. Only a run of one byte is cut at its first such place, then at multiples of ``MAX_BYTES``.
Chunks are deduplicated by their 128-bit digests: the
first place of a digest, in the order of (doc_id, position), is kept, all later ones are repeats.
Neighbouring repeated chunks form a span if one earlier text holds ``MIN_CORE`` of its words, at its ends too,
in the same order and distance; spans of at least ``MIN_WORDS`` words are removed. Shorter ones, and rows of
chunks whose first places lie in different texts, are the chance repeats of ordinary prose.

Defined results: null text counts as empty and has no chunks; a null doc_id comes last; rows that repeat
doc_id and text are the same document; extra columns are kept by ``clean``; an empty table gives an
empty result. Whole texts are used, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import WHITE_SPACE, fresh, id_and_text, materialise, table

WINDOW = 96
MAX_BYTES = 128
#: A repeated passage loses its first and last partial chunk, 2 * WINDOW + 15 = 207 bytes at most and half of
#: it on average. Of 500 passages of 51 words each put into two texts 4 were missed, of 500 of 80 words none.
MIN_WORDS = 20
#: Words of a span, at least, whose chunks have their first places in one text, at one distance from the span.
#: Its other chunks lie between those: they are repeats too, but chance put their first places elsewhere.
MIN_CORE = 16
#: ``place`` packs a chunk's start, size and words, in this order, so that rows stay narrow in the shuffles.
CHUNKS = "doc_id long, doc_hash long, place long, d1 long, d2 long"

#: The gear: a 16-bit number for each byte, from a fixed seed.
GEAR = np.random.default_rng(20240229).integers(0, 1 << 16, 256, dtype=np.uint16)
_SPACE = np.isin(np.arange(256), [ord(c) for c in WHITE_SPACE])


def cuts(data: np.ndarray) -> np.ndarray:
    """The ends of the chunks of some bytes, the last one at their end."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    h = GEAR[data]
    step = 1
    while step < 16:  # the sum over the last 2 * step bytes from those over the last step bytes
        more = h.copy()
        more[step:] += h[:-step] << np.uint16(step)
        h, step = more, step * 2
    # hash and place in one number: the smallest of a window is the rightmost of its smallest hashes
    low = (h.astype(np.int64) << 40) - np.arange(n)
    step = 1
    while step < WINDOW:  # the smallest of step places in a row, from two that overlap or meet
        more = min(step, WINDOW - step)
        low = np.minimum(low[:-more], low[more:])
        step += more
    at = np.unique(-low & ((1 << 40) - 1))
    again = np.flatnonzero((np.diff(at) == 1) & (h[at[1:]] == h[at[:-1]])) + 1
    at = np.delete(at, again) + 1
    ends = np.append(at[at < n], n)
    starts = np.concatenate(([0], ends[:-1]))
    more = (ends - starts - 1) // MAX_BYTES  # further cuts of a long stretch
    if more.any():
        base, nth = np.repeat(starts, more), np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
        ends = np.sort(np.concatenate((ends, base + nth * MAX_BYTES)))
    return ends


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_128_digest as digest
    from xxhash import xxh3_64_intdigest

    for b in batches:
        for lo in range(0, len(b), 128):
            ids, hashes, counts, places, digests = [], [], [], [], []
            some = b.slice(lo, 128)
            for i in range(len(some)):
                raw = some.column(1)[i].as_py().encode()
                data = np.frombuffer(raw, np.uint8)
                ends = cuts(data)
                if not len(ends):
                    continue
                begins = np.concatenate(([0], ends[:-1]))
                view = memoryview(raw)
                digests += [digest(view[x:y]) for x, y in zip(begins.tolist(), ends.tolist(), strict=True)]
                space = _SPACE[data]
                word = np.concatenate((~space[:1], ~space[1:] & space[:-1]))  # where words begin
                words = np.add.reduceat(word, begins, dtype=np.int64)
                places.append(begins << 16 | (ends - begins) << 8 | words)
                counts.append(len(ends))
                ids.append(some.column(0)[i].as_py())
                hashes.append(xxh3_64_intdigest(raw))
            if not ids:
                continue
            n = np.array(counts)
            each = np.repeat(np.arange(len(n)), n)
            two = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()).take(pa.array(each)), pa.array(np.array(hashes, np.uint64).view(np.int64)[each]),
                pa.array(np.concatenate(places)), pa.array(two[:, 0]), pa.array(two[:, 1]),
            ], ["doc_id", "doc_hash", "place", "d1", "d2"])


def chunks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, doc_hash, place, d1, d2) of each chunk; start and size in UTF-8 bytes."""
    return id_and_text(df, id_col, text_col).mapInArrow(_chunks, CHUNKS)


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_core: int = MIN_CORE) -> DataFrame:
    """(doc_id, doc_hash, keep_doc_id, start, n_bytes, n_words) of each span to be removed; ``keep_doc_id``
    holds the first place of the span's first chunk."""
    all_chunks = materialise(chunks(df, id_col, text_col), "chunks")
    at = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "doc_hash", "place")
    firsts = materialise(all_chunks.groupBy("d1", "d2").agg(F.min(at).alias("at"), F.count("*").alias("places")).where("places > 1").select("d1", "d2", "at"), "chunk-firsts")
    # narrow rows for the shuffles: 24 bits of the first place's text beside its 40 bits of start
    first = F.shiftleft(F.xxhash64("at.doc_hash", "at.doc_id"), 40).bitwiseOR(F.shiftright("at.place", 16))
    later = all_chunks.join(firsts, ["d1", "d2"]).where(at > F.col("at")).select("doc_id", "doc_hash", "place", F.col("at.doc_id").alias("keep_doc_id"), first.alias("first")).distinct()
    # rows of one document; neighbours have the bytes before them that aren't repeats in common
    doc = ["doc_id", "doc_hash"]
    later = later.repartition(*doc).select(
        *doc, "keep_doc_id", F.shiftright("place", 16).alias("start"), F.shiftright("place", 8).bitwiseAND(255).alias("size"), F.col("place").bitwiseAND(255).alias("words"),
        F.shiftrightunsigned("first", 40).alias("text"), F.col("first").bitwiseAND((1 << 40) - 1).alias("from"))
    own = Window.partitionBy(*doc).orderBy("start")
    later = later.withColumn("run", F.col("start") + F.col("size") - F.sum("size").over(own))
    # of a run, what one other text holds at one distance counts; from its first chunk there to its last goes
    # a chunk that a text repeats counts by its own first place, so that periodic text has one distance too
    distance = F.min("start").over(Window.partitionBy(*doc, "text", "from")) - F.col("from")
    later = later.withColumn("distance", distance)
    same = Window.partitionBy(*doc, "run", "text", "distance")
    later = later.withColumns({"held": F.sum("words").over(same), "hi": F.max("start").over(same)})
    reach = F.max(F.when(F.col("held") >= min_core, F.col("hi"))).over(Window.partitionBy(*doc, "run").orderBy("start"))
    gone = later.withColumn("reach", reach).where(F.col("reach") >= F.col("start"))
    spans = gone.withColumn("run", F.col("start") + F.col("size") - F.sum("size").over(own)).groupBy(*doc, "run").agg(
        F.min_by("keep_doc_id", "start").alias("keep_doc_id"), F.min("start").alias("start"), F.sum("size").alias("n_bytes"), F.sum("words").alias("n_words"))
    return spans.where(F.col("n_words") >= min_words).drop("run")


def clean(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``df`` with the repeated spans removed from its text and a new column ``n_removed`` of bytes.

    Cuts may fall inside a character: its bytes stay with the kept side, so the text stays valid.
    """
    import xxhash

    key, own, theirs, found = fresh([*df.columns, "n_removed"], "_id", "_own", "_hash", "_spans")
    spans = repeated_spans(df, id_col, text_col, min_words)
    gone = materialise(spans.groupBy("doc_id", "doc_hash").agg(F.sort_array(F.collect_list(F.struct("start", "n_bytes"))).alias(found)).select(F.col("doc_id").alias(key), F.col("doc_hash").alias(theirs), found), "chunk-gone")

    @F.pandas_udf("long")
    def text_hash(texts):
        return texts.map(lambda t: int(np.uint64(xxhash.xxh3_64_intdigest(t.encode())).view(np.int64)))

    @F.pandas_udf("string")
    def cut(texts, spans):
        def one(t, found):
            if found is None or not len(found):
                return t
            raw, out, last = (t or "").encode(), [], 0
            for s in found:
                lo, hi = s["start"], s["start"] + s["n_bytes"]
                while lo < hi and raw[lo] & 0xC0 == 0x80:
                    lo += 1
                while hi < len(raw) and hi > lo and raw[hi] & 0xC0 == 0x80:
                    hi -= 1
                out.append(raw[last:lo])
                last = hi
            return b"".join([*out, raw[last:]]).decode()

        import pandas as pd

        return pd.Series([one(t, f) for t, f in zip(texts, spans, strict=True)])

    names = [c for c in df.columns if c != "n_removed"]
    keyed = df.withColumn(own, text_hash(F.coalesce(F.col(text_col), F.lit(""))))
    rows = keyed.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (F.col(own) == F.col(theirs)), "left")
    removed = F.coalesce(F.aggregate(found, F.lit(0).cast("long"), lambda s, x: s + x["n_bytes"]), F.lit(0).cast("long"))
    new = {text_col: cut(F.col(text_col), F.col(found)), "n_removed": removed}
    return rows.withColumns(new).select(*names, "n_removed")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents")).drop("doc_hash")
