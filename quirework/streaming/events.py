"""Event logs: batch reductions and the same as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

OUT = "key long, event_id long, sequence long, total double, terminal boolean"
STATE = "last long, total double, terminal boolean"


def bounded_log(events: DataFrame, key: str, order: str, most: int, ts: str | None = None, ttl: int | None = None) -> DataFrame:
    """The last ``most`` events of each key. With ``ts`` and ``ttl`` (seconds) the log is gone once that long
    passes without an append: only what came after a key's last such gap is left."""
    if ts and ttl:
        w = Window.partitionBy(key).orderBy(order)
        at = F.col(ts).cast("timestamp")
        gap = F.unix_micros(at) - F.unix_micros(F.lag(at).over(w)) > ttl * 1_000_000
        later = w.rowsBetween(1, Window.unboundedFollowing)
        events = events.withColumn("_gap", gap).withColumn("_gone", F.coalesce(F.bool_or(F.coalesce("_gap", F.lit(False))).over(later), F.lit(False))).filter("NOT _gone").drop("_gap", "_gone")
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return events.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def resume(events: DataFrame, sequence: str, after_sequence: int, after_event: int) -> DataFrame:
    """Events after the later of two positions."""
    return events.filter(F.col(sequence) > max(after_sequence, after_event))


def reduce_batch(events: DataFrame, key: str, sequence: str, value: str) -> DataFrame:
    """Each key's accepted events: those that raise the sequence in arrival order, first copy only."""
    w = Window.partitionBy(key).orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max(sequence).over(w), F.lit(-1))
    return events.withColumn("_seen", seen).filter(F.col(sequence) > F.col("_seen")).groupBy(key).agg(F.count("*").alias("accepted"), F.max(sequence).alias("last"), F.round(F.sum(value), 6).alias("total"))


def chunked(df: DataFrame, text: str, size: int = 240) -> DataFrame:
    """Pieces of ``size`` characters with their offset."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    return df.withColumn("offset", F.explode(starts)).withColumn("delta", F.substring(F.col(text), F.col("offset") + 1, F.lit(size)))


def reduce_stream(events: DataFrame, terminal: str) -> DataFrame:
    """Streaming reducer: per key, drops events at or below the last sequence and all after a terminal
    one, in order of ``arrival`` within a batch, as the batch reducer does. ``events``: key, event_id,
    sequence, value, event_type, arrival (falls to event_id where there is none)."""
    by = "arrival" if "arrival" in events.columns else "event_id"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, total, ended = state.get if state.exists else (-1, 0.0, False)
        out = []
        for frame in frames:
            for row in frame.sort_values([by, "event_id"], kind="stable").itertuples():
                if ended or row.sequence <= last:
                    continue
                last, total, ended = int(row.sequence), total + float(row.value), row.event_type == terminal
                out.append((key[0], row.event_id, last, total, ended))
        state.update((last, total, ended))
        yield pd.DataFrame(out, columns=["key", "event_id", "sequence", "total", "terminal"])

    return events.groupBy("key").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
