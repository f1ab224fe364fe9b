"""Structured Streaming: watched folders, incremental indexing and running counts.

The batch operators do the work of each micro-batch; a sink keyed by batch id makes a repeated batch
harmless. Watermarks are parameters, none by default, so a stream ends at what the batch gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from imprynt.sources.files import EXCLUDE, EXTENSIONS, relevant, upsert_catalog


def watch_source(spark: SparkSession, root: str, most: int = 1000, extensions=EXTENSIONS, exclude=EXCLUDE) -> DataFrame:
    """A stream of (path, modificationTime, length, content) of relevant files that come under root."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("maxFilesPerTrigger", most).load(root)
    return stream.where(relevant(F.col("path"), extensions, exclude))


def watch_table(spark: SparkSession, path: str, schema, most: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most).parquet(path)


def quiet_sessions(events: DataFrame, time: str, gap: str, key: str | None = None, watermark: str | None = None) -> DataFrame:
    """(start, end, count): runs of events without a pause of `gap`; the same on a batch and on a stream."""
    e = events.withWatermark(time, watermark) if watermark else events
    keys = [F.session_window(time, gap).alias("w"), *([F.col(key)] if key else [])]
    return e.groupBy(*keys).agg(F.count("*").alias("count")).select(*([key] if key else []), F.col("w.start").alias("start"), F.col("w.end").alias("end"), "count")


def live_counts(events: DataFrame, time: str, bucket: str, series: str, watermark: str | None = None) -> DataFrame:
    """(bucket, series, count), for update or complete mode."""
    e = events.withWatermark(time, watermark) if watermark else events
    return e.groupBy(F.date_trunc(bucket, time).alias("bucket"), F.col(series).alias("series")).agg(F.count("*").alias("count"))


def dedupe_stream(events: DataFrame, keys: list[str], time: str | None = None, horizon: str | None = None) -> DataFrame:
    """The first row of each key. On a stream give a time column and a horizon: state then holds the keys of that long
    and no more; a key that comes again within the horizon is always left out, one that comes after it may come out
    again, and rows later than the horizon behind the newest time are dropped as late. On a batch the horizon has no
    effect."""
    if time is None or horizon is None:
        return events.dropDuplicates(keys)
    if not events.isStreaming:
        return events.dropDuplicates(keys)
    return events.withWatermark(time, horizon).dropDuplicatesWithinWatermark(keys)


def index_stream(source: DataFrame, catalog: str, key: str, checkpoint: str):
    """A snapshot for each micro-batch, for small catalogs of which every version is wanted whole (see catalog for one
    that is written by its changes): a batch writes version `batch id + 1` from version `batch id`, so a batch that runs
    again writes the same version again. Of a key's rows the one of the largest seq stays, whatever the order in which
    they come."""

    def merge(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        new = batch.groupBy(key).agg(*(F.max_by(c, F.col("seq")).alias(c) for c in batch.columns if c != key))
        old = spark.read.parquet(f"{catalog}/v{batch_id}") if batch_id else spark.createDataFrame([], new.schema)
        newer = old.select(key, F.col("seq").alias("__seq"))
        new = new.join(newer, key, "left").where("__seq is null or seq >= __seq").drop("__seq")
        upsert_catalog(old, new, key).write.mode("overwrite").parquet(f"{catalog}/v{batch_id + 1}")

    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("update")


class QuietTimer(StatefulProcessor):
    """One row for each key once `quiet` ms have passed since its last event came: (key, count, first, last) in ms of
    processing time. Each event puts the timer off; nothing of a key is left once it has fired."""

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "count long, first long, last long, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, now = sum(len(f) for f in rows), timerValues.getCurrentProcessingTimeInMs()
        count, first, due = 0, now, None
        if self.state.exists():
            count, first, _, due = self.state.get()
        if due is not None:
            self.handle.deleteTimer(due)
        self.handle.registerTimer(now + self.quiet)
        self.state.update((count + n, first, now, now + self.quiet))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        count, first, last, _ = self.state.get()
        self.state.clear()
        yield pd.DataFrame({"key": [str(key[0])], "count": [count], "first_ms": [first], "last_ms": [last]})

    def close(self) -> None:
        pass


def quiet_runs(events: DataFrame, key: str, quiet_ms: int = 2000) -> DataFrame:
    """(key, count, first_ms, last_ms) of a live stream: a key's events since it was last quiet, once it has been quiet
    for quiet_ms. The stream needs a trigger that goes on without input (processing time), and RocksDB for its state:
    spark.sql.streaming.stateStore.providerClass."""
    out = "key string, count long, first_ms long, last_ms long"
    return events.groupBy(F.col(key).cast("string").alias(key)).transformWithStateInPandas(QuietTimer(quiet_ms), out, "Append", "ProcessingTime")


def replay_patches(base: DataFrame, log: DataFrame, key: str = "id") -> DataFrame:
    """base with the last patch of each row applied; log(id, seq, op, ...columns) with op set or delete. Replaying a
    log again changes nothing."""
    columns = [c for c in log.columns if c not in (key, "seq", "op")]
    last = log.groupBy(key).agg(F.max_by(F.struct("op", *columns), "seq").alias("__p"))
    out = base.join(last, key, "left").where("__p is null or __p.op <> 'delete'")
    return out.select(*[F.coalesce(F.col(f"__p.{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])
