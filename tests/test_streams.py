"""State of live streams: timers and expiry."""

import time

from pyspark.sql import functions as F

from imprynt.streaming import watch as ST

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_a_live_stream_tells_a_key_once_it_is_quiet(spark, tmp_path):
    add = lambda n, keys: spark.createDataFrame([(k,) for k in keys], "key string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    add(0, ["a", "a", "b"])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        stream = ST.quiet_runs(spark.readStream.schema("key string").parquet(f"{tmp_path}/in"), "key", 2000)
        seen = []
        run = stream.writeStream.foreachBatch(lambda b, _: seen.extend((time.time(), r) for r in b.collect())).option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(processingTime="300 milliseconds").start()
        until = time.time() + 90
        while len(seen) < 2 and time.time() < until:
            time.sleep(0.3)
        add(1, ["a"])
        while len(seen) < 3 and time.time() < until:
            time.sleep(0.3)
        time.sleep(3)
        run.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted((r["key"], r["count"]) for _, r in seen) == [("a", 1), ("a", 2), ("b", 1)]  # once each, and again for what came later
    assert all(at * 1000 - r["last_ms"] >= 2000 for at, r in seen)


def test_deduplication_forgets_what_is_behind_the_horizon(spark, tmp_path):
    """Twenty batches of new keys, an hour apart: the state does not grow with them, and nothing comes out twice."""
    for n in range(20):
        rows = spark.range(50).select(F.timestamp_seconds(F.lit((n + 1000) * 3600)).alias("ts"), (F.col("id") + n * 40).alias("k"))
        rows.coalesce(1).write.parquet(f"{tmp_path}/in/{n:02d}")
        time.sleep(0.01)
    events = spark.readStream.schema("ts timestamp, k long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = ST.dedupe_stream(events, ["k"], "ts", "3 hours")
    seen = []
    run = out.writeStream.foreachBatch(lambda b, _: seen.extend(r["k"] for r in b.collect())).option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    assert sorted(seen) == list(range(19 * 40 + 50)) and max(held) <= 6 * 50
    assert ST.dedupe_stream(spark.read.schema("ts timestamp, k long").parquet(f"{tmp_path}/in/*"), ["k"], "ts", "3 hours").count() == len(seen)
