"""Contiguous shards of near equal bytes, from prefix sums of sizes.

A row's size is the UTF-8 length of its text plus one. Rows are dealt by ranges of doc_id; the totals of
the ranges, one row each, give every range its base, a running sum inside the range the rest. The row
whose byte interval has its middle in the k-th of equal targets goes to shard k, so each shard is a
contiguous run in doc_id order and misses its target by half a row at either end at most.

Native: DataFrame functions only. Defined results: null and empty texts have size 1; null doc_ids come
first; rows that share a doc_id are ordered by checksum and size; with fewer bytes than shards some
shards stay empty; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import fresh, id_and_text, materialise, partitions_for, table

ORDER = ("doc_id", "text_crc32", "size")


def prefix_sums(df: DataFrame, order: tuple[str, ...], size: str, count: str) -> DataFrame:
    """``df`` with ``before`` and ``row``: the sum of sizes and the number of rows before each row in ``order``.

    A row stands for ``count`` rows of ``size`` bytes each.
    """
    ranged = materialise(df.repartitionByRange(partitions_for(df), *order).withColumn("range", F.spark_partition_id()), "shard-ranges")
    bytes_ = F.col(size) * F.col(count)
    totals = ranged.groupBy("range").agg(F.sum(bytes_).alias("bytes"), F.sum(count).alias("rows"))  # a row for each range
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("range", F.coalesce(F.sum("bytes").over(upto), F.lit(0)).alias("base_bytes"), F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("base_rows"))
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    running = ranged.withColumns({"in_bytes": F.coalesce(F.sum(bytes_).over(inside), F.lit(0)), "in_rows": F.coalesce(F.sum(count).over(inside), F.lit(0))})
    return running.join(bases, "range").withColumns({"before": F.col("base_bytes") + F.col("in_bytes"), "row": F.col("base_rows") + F.col("in_rows")}).drop("range", "base_bytes", "base_rows", "in_bytes", "in_rows")


def shard(df: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row; ``slot`` counts inside the shard."""
    sized = id_and_text(df, id_col, text_col).select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    # rows alike are counted before they are dealt: however many they are, they make one row of a range
    sized = materialise(sized.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies")), "shard-sizes")
    total = sized.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] or 1
    placed = prefix_sums(sized, ORDER, "size", "copies")
    placed = placed.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    placed = placed.withColumns({"before": F.col("before") + F.col("nth") * F.col("size"), "row": F.col("row") + F.col("nth")})
    # twice the middle of the interval, in whole numbers; decimals hold the product at any size
    middle = (2 * F.col("before") + F.col("size")).cast("decimal(38,0)")
    cut = F.floor(middle * n_shards / F.lit(2 * total).cast("decimal(38,0)")).cast("int")
    placed = materialise(placed.withColumn("shard", F.least(cut, F.lit(n_shards - 1))), "shard-placed")
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))  # n_shards rows
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(df: DataFrame, path: str, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``df``, all columns, as one folder a shard, named by a column ``shard`` (with underscores where the
    name is taken). Rows that share a doc_id and a text are in the shard of the first of them."""
    key, own, name, slot = fresh(df.columns, "_id", "_crc", "shard", "_slot")
    placed = shard(df, n_shards, id_col, text_col).groupBy("doc_id", "text_crc32").agg(F.min(F.struct("shard", "slot")).alias("at"))
    placed = placed.select(F.col("doc_id").alias(key), F.col("text_crc32").alias(own), F.col("at.shard").alias(name), F.col("at.slot").alias(slot))
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    rows = df.join(placed, F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (crc == F.col(own))).drop(key, own)
    rows = rows.repartitionByRange(max(n_shards, partitions_for(df)), name, slot).sortWithinPartitions(name, slot)
    rows.drop(slot).write.partitionBy(name).parquet(path)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


#: DuckDB has no crc32; its bitwise definition, eight steps a byte, is too slow on whole texts.
SQL = None
