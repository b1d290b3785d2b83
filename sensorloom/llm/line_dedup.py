"""Line dedup by winnowing over line hashes.

A document is the sequence of its lines, split at U+000A, trimmed of ASCII white space, blank ones left
out. Of every window of ``WINDOW`` consecutive lines the smallest hash, rightmost of equals, is the
window's fingerprint; so two places that share ``WINDOW`` lines in a row share a fingerprint, and a window
whose fingerprint is at one place only can't be repeated. That thins out most of a corpus before anything
wide is shuffled. Windows whose fingerprint lies at two places or more are joined on 128 bits of all their
lines with the first place that has the same lines, in the order of (doc_id, position). A later place is a
match, and matches that overlap or touch extend each other both ways to the ends of the repeated run.

A long line, of ``LONG_WORDS`` words or ``LONG_CHARS`` characters in scripts without spaces, is its own
fingerprint, for the windows of fewer lines that hold it. So what is deleted is exactly: every line in a run
of lines that an earlier place has too, where the run has ``WINDOW`` lines or holds a long line. Repeats of
over 50 words in whole lines always are such runs; a short line on its own never is.

Native: DataFrame functions only. A common line costs a row a place in map-side combined aggregates and
joins whose hot keys AQE splits. Defined results: null text counts as empty, with nothing to delete; a
null doc_id comes last; rows that repeat doc_id and text are the same document; extra columns are
kept by ``clean``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import WHITE_SPACE, fresh, id_and_text, materialise, table, text_hash

WINDOW = 3
LONG_WORDS = 25
LONG_CHARS = 160


def lines(text: Column) -> Column:
    """An array of (pos, a, b, long) of the lines that aren't blank: 128 bits of hash in ``a`` and ``b``."""
    bare = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("pos"), F.trim(x, F.lit(WHITE_SPACE)).alias("line")))
    words = rf"(?:[ \t\x0B\f\r]+[^ \t\x0B\f\r]+){{{LONG_WORDS - 1}}}"

    def one(s: Column) -> Column:
        line = s["line"]
        long = (F.length(line) >= LONG_CHARS) | line.rlike(words)
        return F.struct(s["pos"].alias("pos"), F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"), long.alias("long"))

    return F.transform(F.filter(bare, lambda s: s["line"] != ""), one)


def windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, doc_hash, print, at, lo, hi, k1, k2) of each window: its fingerprint's hash and place, its
    first and last line, 128 bits of its lines. ``docs`` has doc_id, doc_hash and ``lines``."""
    n = F.size("lines")

    def cell(i: Column, size: int, place: Column | None = None) -> Column:
        part = F.slice("lines", i + 1, size)
        if place is None:
            low = F.array_min(F.transform(part, lambda s, k: F.struct(s["a"].alias("a"), (-k - i).alias("neg"))))
            print_, place = low["a"], -low["neg"]
        else:
            print_ = F.get("lines", place)["a"]
        return F.struct(
            print_.alias("print"), place.alias("at"), F.get("lines", i)["pos"].alias("lo"), F.get("lines", i + (size - 1))["pos"].alias("hi"),
            F.xxhash64(F.transform(part, lambda s: s["a"])).alias("k1"), F.xxhash64(F.lit(size), F.transform(part, lambda s: s["b"])).alias("k2"),
        )

    full = F.when(n >= window, F.transform(F.sequence(F.lit(0), n - window), lambda i: cell(i, window)))
    # windows of fewer lines, for each long line in them
    held = F.array_compact(F.transform("lines", lambda s, i: F.when(s["long"], i)))

    def round_long(size: int, back: int) -> Column:
        return F.transform(held, lambda i: F.when((i >= back) & (i - back + size <= n), cell(i - back, size, i)))

    short = [round_long(size, back) for size in range(1, window) for back in range(size)]
    none = F.array().cast("array<struct<print:bigint,at:int,lo:int,hi:int,k1:bigint,k2:bigint>>")
    return docs.where(n > 0).select("doc_id", "doc_hash", F.explode(F.array_compact(F.concat(F.coalesce(full, none), *short))).alias("w")).select("doc_id", "doc_hash", "w.*")


def repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, doc_hash, first_line, n_lines, first_doc_id): each run of lines to be deleted, from 0, with the
    blank ones inside it. ``first_doc_id`` holds the first place of the run's first window.
    """
    docs = id_and_text(df, id_col, text_col).select("doc_id", F.xxhash64("text").alias("doc_hash"), lines(F.col("text")).alias("lines"))
    docs = materialise(docs, "line-docs")
    every = materialise(windows(docs, window), "line-windows")
    doc = [F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("doc_hash")]
    place = F.struct(*doc, "at")
    prints = every.groupBy("print").agg(F.min(place).alias("first"), F.max(place).alias("end")).where("first < end").select("print")
    # merged at every size: what is left of the fingerprints grows with the corpus
    matched = materialise(every.join(materialise(prints, "line-prints").hint("merge"), "print", "left_semi").drop("print", "at"), "line-places")
    start = F.struct(*doc, "lo")
    firsts = matched.groupBy("k1", "k2").agg(F.min(start).alias("first"), F.max(start).alias("end")).where("first < end").select("k1", "k2", "first")
    later = matched.join(materialise(firsts, "line-firsts").hint("merge"), ["k1", "k2"]).where(start > F.col("first")).select("doc_id", "doc_hash", "lo", "hi", F.col("first.doc_id").alias("first_doc_id")).distinct()
    # rows of one document: at most a few for each line of it
    by_doc = Window.partitionBy("doc_id", "doc_hash").orderBy("lo", "hi")
    reached = F.max("hi").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    runs = later.withColumn("new", F.coalesce((F.col("lo") > reached + 1).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("new").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "doc_hash", "run").agg(F.min("lo").alias("first_line"), (F.max("hi") - F.min("lo") + 1).alias("n_lines"), F.min_by("first_doc_id", F.struct("lo", "hi")).alias("first_doc_id")).drop("run")


def clean(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``df`` with the repeated runs of lines deleted from its text and a new column ``n_deleted``."""
    key, own, gone_col = fresh([*df.columns, "n_deleted"], "_id", "_hash", "_gone")
    runs = repeated_lines(df, id_col, text_col, window)
    before = Window.partitionBy("doc_id", "doc_hash").orderBy("first_line")
    gap = F.col("first_line") - F.lag(F.col("first_line") + F.col("n_lines"), 1, 0).over(before)
    of_doc = runs.withColumn("gap", gap).groupBy("doc_id", "doc_hash").agg(F.sort_array(F.collect_list(F.struct("first_line", "n_lines", "gap"))).alias("runs"))
    # a flag for each line up to the last that goes, read by position
    flags = F.flatten(F.transform("runs", lambda r: F.concat(F.array_repeat(F.lit(False), r["gap"]), F.array_repeat(F.lit(True), r["n_lines"]))))
    gone = materialise(of_doc.select(F.col("doc_id").alias(key), F.col("doc_hash").alias(own), flags.alias(gone_col)), "line-gone")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (text_hash(F.col(text_col)) == F.col(own)), "left")
    kept = F.filter(F.split(text, "\n"), lambda x, i: ~F.coalesce(F.get(gone_col, i), F.lit(False)))
    new = F.when(F.col(gone_col).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    n = F.coalesce(F.size(F.filter(gone_col, lambda x: x)), F.lit(0))
    return rows.withColumns({text_col: new, "n_deleted": n}).drop(key, own, gone_col)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(table(spark, sf_dir, "documents")).drop("doc_hash")
