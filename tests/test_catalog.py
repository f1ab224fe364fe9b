"""The catalog that is merged on read: against plain upserts, and what it writes."""

import random
import threading

import pytest
from pyspark.sql.types import LongType, StringType, StructType

from imprynt.streaming import catalog as K
from imprynt.streaming import watch as ST

SCHEMA = StructType().add("id", LongType()).add("seq", LongType()).add("value", StringType())


def rows(df):
    return {r["id"]: (r["seq"], r["value"]) for r in df.collect()}


def frame(spark, changes):
    return spark.createDataFrame(changes, "id long, seq long, value string, gone boolean")


def test_appends_compactions_and_tombstones_give_what_upserts_give(spark, tmp_path):
    c = K.Catalog(spark, f"file://{tmp_path}/c", SCHEMA, "id", buckets=4, most_deltas=3)
    rnd, want, seq = random.Random(1), {}, 0
    assert rows(c.read()) == {}
    for n in range(9):
        changes = []
        for _ in range(rnd.choice([1, 12])):
            seq += 1
            i, gone = rnd.randrange(15), rnd.random() < 0.3
            changes.append((i, seq, f"v{seq}", gone))
        late = [(i, s - 100, "late", False) for i, s, _, gone in changes if not gone]
        if n % 3 == 2:
            changes += late  # an earlier seq changes nothing
        for i, s, value, gone in sorted(changes, key=lambda x: x[1]):
            if s > 0:
                want[i] = (s, None if gone else value)
        assert c.append(frame(spark, changes), batch=n, deleted="gone")
        assert not c.append(frame(spark, [(1, 10**6, "again", False)]), batch=n)
        assert rows(c.read()) == {i: v for i, v in want.items() if v[1] is not None}
        if n % 2:
            c.compact(whole=n % 4 == 3)
            assert rows(c.read()) == {i: v for i, v in want.items() if v[1] is not None}
    c.compact(whole=True)
    state = c.version()
    gone = next(i for i, v in want.items() if v[1] is None)
    c.append(frame(spark, [(gone, want[gone][0] - 1, "late", False)]))
    assert gone not in rows(c.read())  # also after a compaction
    c.append(frame(spark, [(gone, seq + 1, "back", False), (99, seq + 2, "x", True)]), deleted="gone")
    want[gone] = (seq + 1, "back")
    assert c.compact(whole=True, forget=seq + 3) and c._merged(c.version()).where(K.DELETED).count() == 0
    assert not state["deltas"] and rows(c.read()) == {i: v for i, v in want.items() if v[1] is not None}


def test_an_append_writes_by_its_own_size_and_old_folders_go(spark, tmp_path):
    c = K.Catalog(spark, f"file://{tmp_path}/c", SCHEMA, "id", buckets=4, keep=2)
    c.append(spark.range(200_000).selectExpr("id", "id as seq", "md5(string(id)) as value"))
    c.compact(whole=True)
    large = sum(c.version()["bytes"].values())
    c.append(spark.range(5).selectExpr("id", "id + 1000000 as seq", "'x' as value"))
    assert 0 < c.bytes_of(c.version()["number"]) < large / 100
    assert c.compact() == []  # too little to rewrite a bucket for
    before = c.version()["number"]
    c.compact(whole=True)
    assert rows(c.read(before)) == rows(c.read())  # readers of the version before still have it
    c.append(spark.range(1).selectExpr("id", "9000000 as seq", "'y' as value"))
    assert c.clean() >= 1 and len(c.versions()) == 2
    assert c.read().count() == 200_000 and len(list((tmp_path / "c" / "base").iterdir())) == 1


def test_a_version_number_is_taken_once(spark, tmp_path):
    c = K.Catalog(spark, f"file://{tmp_path}/c", SCHEMA, "id")
    old = c.version()
    c.append(frame(spark, [(1, 1, "a", False)]))
    with pytest.raises(K.Conflict):
        c._commit(old)
    errors = []

    def write(i):
        try:
            K.Catalog(spark, f"file://{tmp_path}/c", SCHEMA, "id").append(frame(spark, [(i, 1, f"t{i}", False)]))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(10, 14)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and set(rows(c.read())) == {1, 10, 11, 12, 13}


def test_a_stream_gives_what_the_batch_gives_also_when_a_batch_runs_again(spark, tmp_path):
    source = spark.range(300).selectExpr("id % 40 as id", "id as seq", "concat('v', id) as value", "id % 7 = 0 as gone")
    source.repartition(6).write.parquet(f"{tmp_path}/in")
    c = K.Catalog(spark, f"file://{tmp_path}/c", SCHEMA, "id", buckets=2, most_deltas=2)
    stream = lambda: ST.watch_table(spark, f"{tmp_path}/in", source.schema, 1)
    K.index_stream(stream(), c, f"{tmp_path}/state", "gone").trigger(availableNow=True).start().awaitTermination()
    want = {i: (s, f"v{s}") for i in range(40) for s in [max(x for x in range(300) if x % 40 == i)] if s % 7}
    assert rows(c.read()) == want and len(c.version()["deltas"]) <= 3
    n = c.version()["number"]
    K.index_stream(stream(), c, f"{tmp_path}/state2", "gone").trigger(availableNow=True).start().awaitTermination()
    assert rows(c.read()) == want and c.version()["number"] == n  # the same batches, as after a lost checkpoint


def test_requests_during_a_run_are_one_more_run(spark, tmp_path):
    import os
    import time

    at, runs, ask = tmp_path / "asked", [], lambda i: spark.createDataFrame([(f"p{i}",)], "path string").coalesce(1).write.mode("append").parquet(str(tmp_path / "asked"))
    ask(0)

    def run(wanted):
        runs.append(sorted(r["path"] for r in wanted.collect()))
        if len(runs) == 1:
            for i in (1, 2, 1, 3):
                ask(i)

    stream = spark.readStream.schema("path string").parquet(str(at))
    q = K.on_request(stream, run, f"{tmp_path}/state").trigger(processingTime="200 milliseconds").start()
    until = time.time() + 60
    while len(runs) < 2 and time.time() < until:
        time.sleep(0.2)
    q.processAllAvailable()
    q.stop()
    assert os.path.isdir(at) and runs == [["p0"], ["p1", "p2", "p3"]]
