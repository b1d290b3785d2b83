"""Records as rows: newest value of a key, batches of a log, gaps, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_write_wins(df: DataFrame, key: list[str], value: str, seq: str, deleted: Column) -> DataFrame:
    """(key, value) of the keys whose newest record isn't a delete."""
    newest = df.groupBy(*key).agg(F.max_by(F.struct(F.col(value).alias("value"), deleted.alias("gone")), seq).alias("e"))
    return newest.where(~F.col("e.gone")).select(*key, F.col("e.value").alias("value"))


def read_batch(log: DataFrame, device: str, seq: str, size: Column, after: Column, budget: int) -> DataFrame:
    """Of each device the records past ``after``, in order, as long as their sizes fit the budget.

    The first record always goes, or a device would never get past it.
    """
    w = Window.partitionBy(device).orderBy(seq)
    past = log.where(F.col(seq) > after).withColumns({"_size": F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_nth": F.row_number().over(w)})
    return past.where((F.col("_size") <= budget) | (F.col("_nth") == 1)).drop("_size", "_nth")


def gaps(df: DataFrame, device: str, seq: str) -> DataFrame:
    """(device, after, next): where a device's sequence leaves numbers out."""
    w = Window.partitionBy(device).orderBy(seq)
    out = df.select(device, F.lag(seq).over(w).alias("after"), F.col(seq).alias("next"))
    return out.where(F.col("next") > F.col("after") + 1)


def positions(df: DataFrame, device: str, seq: str) -> DataFrame:
    """(device, last_seq)."""
    return df.groupBy(device).agg(F.max(seq).alias("last_seq"))


def retain(log: DataFrame, seq: str, kind: Column, keep_rows: int, confirmed: int) -> DataFrame:
    """A log after compaction: newest PUT of each key, DELs not yet confirmed, and the newest ROWs.

    ``log`` has ``key`` (null for rows); ``kind`` is "PUT", "DEL" or "ROW".
    """
    rows = log.where(kind == "ROW").orderBy(F.desc(seq)).limit(keep_rows)
    state = log.where(kind != "ROW").withColumn("_kind", kind)
    last = state.groupBy("key").agg(F.max(seq).alias("_last"))
    live = state.join(last, "key").where((F.col(seq) == F.col("_last")) & ((F.col("_kind") == "PUT") | (F.col(seq) > confirmed)))
    return rows.unionByName(live.select(*log.columns))
