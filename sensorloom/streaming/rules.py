"""Decision rules over readings as they arrive: thresholds with hysteresis, excursions, tumbling summaries.

State of a device is a few numbers, kept by Structured Streaming. Readings are (device, time, value) with
``time`` a whole number of seconds, in time order a device inside the stream; rows of one micro-batch are
sorted here.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RULE = "device long, time long, active int"
EXCURSION = "device long, start long, end long, peak double"


def threshold(readings: DataFrame, on_above: float, off_below: float, width: int) -> DataFrame:
    """A row at each change: on once all readings of the last ``width`` seconds exceed ``on_above`` and
    cover it, off once one falls under ``off_below``."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        active, since = state.get if state.exists else (0, None)
        out = []
        for time, value in pd.concat(batches).sort_values("time", kind="stable")[["time", "value"]].itertuples(index=False):
            # the time from which every reading has been above
            since = (time if since is None else since) if value > on_above else None
            if not active and since is not None and time - since >= width - 1:
                active = 1
                out.append((key[0], time, 1))
            elif active and value < off_below:
                active = 0
                out.append((key[0], time, 0))
        state.update((active, since))
        yield pd.DataFrame(out, columns=["device", "time", "active"])

    return readings.groupBy("device").applyInPandasWithState(run, RULE, "active int, since long", "append", GroupStateTimeout.NoTimeout)


def excursions(readings: DataFrame, above: float, at_least: int) -> DataFrame:
    """(device, start, end, peak) of runs above a limit, given when they close, if they lasted ``at_least``."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last, peak = state.get if state.exists else (None, None, None)
        out = []
        for time, value in pd.concat(batches).sort_values("time", kind="stable")[["time", "value"]].itertuples(index=False):
            if value > above:
                start, last, peak = time if start is None else start, time, value if peak is None else max(peak, value)
            elif start is not None:
                if last - start >= at_least:
                    out.append((key[0], start, last, float(peak)))
                start = last = peak = None
        state.update((start, last, peak))
        yield pd.DataFrame(out, columns=["device", "start", "end", "peak"])

    return readings.groupBy("device").applyInPandasWithState(run, EXCURSION, "start long, last long, peak double", "append", GroupStateTimeout.NoTimeout)


def summaries(readings: DataFrame, seconds: int, late: str = "0 seconds") -> DataFrame:
    """(device, start, low, mean, high) of tumbling intervals, each given once it is over."""
    timed = readings.withColumn("ts", F.timestamp_seconds("time")).withWatermark("ts", late)
    out = timed.groupBy("device", F.window("ts", f"{seconds} seconds")).agg(F.min("value").alias("low"), F.avg("value").alias("mean"), F.max("value").alias("high"))
    return out.select("device", F.unix_seconds("window.start").alias("start"), "low", "mean", "high")
