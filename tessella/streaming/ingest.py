"""Incremental ingest: new files of a folder, or rows of a stream, go to the store once by key; keyed state with watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.operators.store import ChunkStore


def first_per_key(rows: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key that a stream brings: repeats are dropped until the watermark, late behind the newest time, has passed the
    first one's; a late row of a key that has none is a first one. On a table, the earliest row of each key by time."""
    if rows.isStreaming:
        return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.groupBy(F.col(key).alias("_key")).agg(F.min_by(whole, F.struct(F.col(time), F.xxhash64(whole))).alias("row")).select("row.*")


def last_value(rows: DataFrame, key: str, value: str, time: str, late: str = "1 hour") -> DataFrame:
    """(key, value, time) of a stream whenever a row is newer than what its key has had: the value of the greatest time, of equal times the
    greatest value. A key is remembered until the watermark passes its time by late again; rows before the watermark are dropped, so late
    rows never undo newer ones. Null times and keys are dropped. The result is for update mode."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, value, time)}
    held = rows.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("key"), F.col(value).cast("string").alias("value"), F.col(time).alias("time")).withWatermark("time", late)
    wait = _milliseconds(late)

    def run(found: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = state.get if state.exists else None
        best, watermark = before, state.getCurrentWatermarkMs()
        for pdf in batches:
            for v, t in zip(pdf["value"], pdf["time"], strict=True):
                own = (int(pd.Timestamp(t).value // 1000), v)
                if own[0] < watermark * 1000:
                    continue
                if best is None or (own[0], own[1] is not None, own[1] or "") > (best[0], best[1] is not None, best[1] or ""):
                    best = own
        if best is None:
            return
        state.update(best)
        state.setTimeoutTimestamp(max(best[0] // 1000, watermark) + wait + 1)
        if best != before:
            yield pd.DataFrame({"key": [found[0]], "value": [best[1]], "us": [best[0]]})

    made = held.groupBy("key").applyInPandasWithState(run, f"key {kinds[key]}, value string, us long", "us long, value string", "update", GroupStateTimeout.EventTimeTimeout)
    return made.select(F.col("key").alias(key), F.col("value").cast(kinds[value]).alias(value), F.timestamp_micros("us").alias(time))


def _milliseconds(duration: str) -> int:
    n, unit = duration.split()
    return int(float(n) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")])


def ingest(rows: DataFrame, store: ChunkStore, checkpoint: str, key: str = "id", time: str | None = None, late: str = "1 hour") -> StreamingQuery:
    """Each batch appends the rows whose key the store has not yet, so a batch that runs twice changes nothing. With a column time, repeats
    within the watermark never reach the store."""

    def add(batch: DataFrame, _: int) -> None:
        store.insert(batch, key)

    held = first_per_key(rows, key, time, late) if time else rows
    return held.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) by window and type; works on a stream and on a table."""
    held = events.withWatermark("ts", late) if events.isStreaming else events
    return held.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
