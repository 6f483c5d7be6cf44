"""Event streams: windowed counts, and the causal detrend as a stateful operator. An extension of the engine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """(start, event_type, n, total) of tumbling windows; events later than the watermark are dropped. ts is a
    timestamp without zone in the tables, which watermarks don't take, so it is cast."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = e.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def running_detrend(events: DataFrame, window: int = 60) -> DataFrame:
    """(key, event_id, detrended): each sample less the mean of the key's last ones in order of arrival, the batch
    form of which is traces.running_mean_detrend. State is the last window - 1 samples of a key."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for v in rows["value"]:
            last = [*last, v][-window:]
            out.append(v - sum(last) / len(last))
        state.update((last[-(window - 1) :] if window > 1 else [],))
        yield pd.DataFrame({"key": key[0], "event_id": rows["event_id"].to_numpy(), "detrended": out})

    keyed = events.select(F.col("user_id").alias("key"), "event_id", "ts", "value")
    return keyed.groupBy("key").applyInPandasWithState(step, "key long, event_id long, detrended double", "last array<double>", "append", GroupStateTimeout.NoTimeout)
