"""Readings over time: ranges, the newest row of a prefix, trailing statistics, tumbling summaries, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import bucket


def time_range(df: DataFrame, time: str, start: int, end: int) -> DataFrame:
    """Rows of [start, end], both ends included."""
    return df.where(F.col(time).between(start, end))


def last_of_prefix(df: DataFrame, prefix: list[str], key: list[str]) -> DataFrame:
    """The row with the largest ``key`` of each value of ``prefix``; combined on the map side."""
    rest = [c for c in df.columns if c not in prefix]
    best = df.groupBy(*prefix).agg(F.max_by(F.struct(*rest), F.struct(*key)).alias("_r"))
    return best.select(*[F.col(c) if c in prefix else F.col(f"_r.{c}").alias(c) for c in df.columns])


def trailing_stats(df: DataFrame, time: str, value: str, since: int, seq: str) -> DataFrame:
    """One row: n, min, max, sum, avg, first_time, last_time over time >= since; the average of nothing is 0.

    First and last follow arrival (``seq``), not time.
    """
    rows = df.where(F.col(time) >= since)
    v = F.col(value).cast("double")
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.sum(v).alias("sum"),
        F.coalesce(F.avg(v), F.lit(0.0)).alias("avg"), F.min_by(time, seq).alias("first_time"), F.max_by(time, seq).alias("last_time"),
    )


def trailing_rows(df: DataFrame, device: str, time: str, value: str, width: int) -> DataFrame:
    """Each row with n, min, max and sum of its device over the last ``width`` units of time, its own included."""
    w = Window.partitionBy(device).orderBy(time).rangeBetween(-(width - 1), 0)
    v = F.col(value)
    return df.withColumns({"n": F.count(v).over(w), "low": F.min(v).over(w), "high": F.max(v).over(w), "total": F.sum(v).over(w)})


def tumbling(df: DataFrame, time: str, value: str, width: int, by: tuple[str, ...] = ()) -> DataFrame:
    """min, max, n and sum of each interval of ``width`` units; the average is total / n."""
    v = F.col(value)
    return df.groupBy(*by, (bucket(F.col(time), width) * width).alias("start")).agg(F.min(v).alias("low"), F.max(v).alias("high"), F.count(v).alias("n"), F.sum(v).alias("total"))


def hysteresis(df: DataFrame, device: str, time: str, on: Column, off: Column) -> DataFrame:
    """Rows with ``active``: set by the last row at which ``on`` or ``off`` held, off before any."""
    w = Window.partitionBy(device).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    change = F.when(on, 1).when(off, 0)
    return df.withColumn("active", F.coalesce(F.last(change, ignorenulls=True).over(w), F.lit(0)))


def excursions(df: DataFrame, device: str, time: str, value: str, above: float, at_least: int, seq: str | None = None) -> DataFrame:
    """(device, start, end, peak) of each unbroken run of rows above a limit that lasts ``at_least``.

    Rows of one time follow in arrival (``seq``), then by value, so that the runs don't hang on how the rows are
    stored or shuffled. Rows without a time come last.
    """
    w = Window.partitionBy(device).orderBy(F.col(time).asc_nulls_last(), *([seq] if seq else []), value)
    high = F.col(value) > above
    runs = df.withColumn("_high", high).withColumn("_new", (F.col("_high") & ~F.coalesce(F.lag("_high").over(w), F.lit(False))).cast("int"))
    runs = runs.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_high")
    out = runs.groupBy(device, "_run").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.max(value).alias("peak"))
    return out.where(F.col("end") - F.col("start") >= at_least).drop("_run")


def newest(df: DataFrame, seq: str, n: int) -> DataFrame:
    """The ``n`` rows of the largest ``seq``."""
    return df.orderBy(F.desc(seq)).limit(n)
