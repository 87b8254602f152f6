"""Behaviour that hangs on what came before: the breaker and logging once, in batch and on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def paused_calls(key: str, ts: str, outage: str, seconds: float):
    """Rows sorted by key and time to the same rows with `paused`; one pass, one number of state."""
    gap = int(seconds * 1_000_000)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, until = object(), None
        for b in batches:
            keys, times, outages = b.column(b.schema.get_field_index(key)).to_pylist(), b.column(b.schema.get_field_index("micros")).to_pylist(), b.column(b.schema.get_field_index(outage)).to_pylist()
            out = []
            for k, t, o in zip(keys, times, outages, strict=True):
                if k != last:
                    last, until = k, None
                paused = until is not None and t is not None and t < until
                if o and not paused and t is not None:
                    until = t + gap
                out.append(paused)
            yield b.append_column("paused", pa.array(out, pa.bool_()))

    return f


def breaker(df: DataFrame, key: str, seconds: float, ts: str = "ts", outage: str = "outage", tie: str = "event_id") -> DataFrame:
    """df with `micros` and `paused`: whether a call falls in the pause after an outage of its key.

    Rows of a key are sorted by Spark (and spill if need be) and read once; nothing is held but the end
    of the pause.
    """
    rows = df.withColumn("micros", F.unix_micros(F.col(ts).cast("timestamp")))
    rows = rows.repartition(F.col(key)).sortWithinPartitions(key, "micros", tie)
    from pyspark.sql import types as T

    return rows.mapInArrow(paused_calls(key, ts, outage, seconds), T.StructType([*rows.schema.fields, T.StructField("paused", T.BooleanType())]))


def breaker_stream(stream: DataFrame, key: str, seconds: float) -> DataFrame:
    """The breaker on a stream of (key, event_id, ts timestamp, outage): the end of the pause is the
    state of a key. Rows of one micro-batch are taken in the order of time."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        until = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        paused = []
        for t, o in zip(rows["ts"], rows["outage"], strict=True):
            at = t.timestamp()
            hit = until is not None and at < until
            if o and not hit:
                until = at + seconds
            paused.append(hit)
        if until is not None:
            state.update((until,))
        yield pd.DataFrame({"key": k[0], "event_id": rows["event_id"], "paused": paused})

    return stream.groupBy(key).applyInPandasWithState(step, "key long, event_id long, paused boolean", "until double", "append", GroupStateTimeout.NoTimeout)


def log_once_stream(stream: DataFrame, body: str, action: str, delay: str = "1 hour", ts: str = "ts") -> DataFrame:
    """The first row of each body and action of a stream; state is dropped behind the watermark."""
    return stream.withWatermark(ts, delay).withColumn("digest", F.sha2(body, 256)).dropDuplicatesWithinWatermark(["digest", action])


def cached(rows: DataFrame, digest: str, complete: str, tie: str) -> DataFrame:
    """For each content: its uses, how often it is scored (once, if the verdict is complete; a verdict over part of it
    is not kept), and the row that is scored first, the least by `tie`."""
    n = F.count(F.lit(1))
    return rows.groupBy(digest).agg(n.alias("uses"), F.when(F.bool_and(complete), F.lit(1).cast("long")).otherwise(n).alias("scored"), F.min(tie).alias("scored_as"))


def cached_stream(stream: DataFrame, text: str, delay: str = "1 hour", ts: str = "ts") -> DataFrame:
    """One row for each content of a stream, to be scored once."""
    return stream.withWatermark(ts, delay).withColumn("digest", F.sha2(text, 256)).dropDuplicatesWithinWatermark(["digest"])
