"""What the operators share: the folder all executors see, written intermediates, tables of a data folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, [\x20\x09-\x0D]; a fixed value of the contracts.
WHITE_SPACE = " \t\n\x0b\x0c\r"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode alone, where it may be
    unset, a temporary one; on a cluster no other machine could see that."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sensorloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    It cuts the lineage in storage that outlives executors, and the new scan has no known
    partitioning, so that a later join exchanges both sides and AQE can split its skewed partitions.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path.startswith((shared_root(spark), shared_root(spark).replace("file://", "file:"))):
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(df: DataFrame, target_bytes: int = 256 << 20) -> int:
    """As many partitions as the session asks for, or more where a part of the input, as the planner sizes it, would be over ``target_bytes``."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 60 else 0  # the planner's way to say that it doesn't know
    return max(partitions(df.sparkSession), -(-known // target_bytes))


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, lengthened until none is among ``columns``, however they are spelt."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_hash(text: Column) -> Column:
    """64 bits of a text, null as empty; beside a doc_id it names a row's content."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def one_row_each(df: DataFrame, won: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``df``, all columns as they are, for each row of ``won`` (doc_id, text_hash, rows).

    ``won`` is a written table without repeats; ``rows`` counts the rows of ``df`` with that id and text. Where
    it is 1, which it is for all but repeated rows, a semi-join does; the others are ranked.
    """
    key, own, n, nth, salt = fresh(df.columns, "_key", "_own", "_rows", "_nth", "_salt")
    won = won.select(F.col("doc_id").alias(key), F.col("text_hash").alias(own), F.col("rows").alias(n))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (text_hash(F.col(text_col)) == F.col(own))
    out = df.join(won.where(F.col(n) == 1), same, "left_semi")
    if won.where(F.col(n) > 1).isEmpty():
        return out
    # a row repeated very often is one key: a row a task is left before the shuffle that ranks them
    again = df.join(won.where(F.col(n) > 1), same).withColumn(salt, F.spark_partition_id())
    for groups in ([key, own, salt], [key, own]):
        again = again.withColumn(nth, F.row_number().over(Window.partitionBy(*groups).orderBy(F.lit(0)))).where(F.col(nth) == 1)
    return out.unionByName(again.drop(key, own, n, nth, salt))


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), null text as empty: further columns, whatever their names, can't clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


#: Bits of the prefilter's bitmap (2^18 words, some 10 MB as a broadcast): a bound that holds for any number of ids.
PREFILTER_BITS = 1 << 24


def prefilter(df: DataFrame, column: str, ids: DataFrame, id_column: str) -> DataFrame:
    """``df`` without most of the rows whose ``column`` isn't among ``ids``; none that is gets lost.

    A bitmap of the ids' hashes, broadcast as at most ``PREFILTER_BITS`` / 64 words, thins out the input of a join,
    which stays exact; with very many ids it lets more rows through. Rows without an id stay.
    """
    w, b = fresh(df.columns, "_word", "_bits")
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(PREFILTER_BITS))
    each = ids.select(F.shiftright(place(id_column), 6).alias(w), (place(id_column) % 64).cast("int").alias("p"))
    words = each.groupBy(w).agg(F.bit_or(F.expr("shiftleft(1L, p)")).alias(b))
    out = df.join(F.broadcast(words), F.shiftright(place(column), 6) == F.col(w), "left")
    return out.where((F.getbit(F.col(b), (place(column) % 64).cast("int")) == 1) | F.col(column).isNull()).drop(w, b)
