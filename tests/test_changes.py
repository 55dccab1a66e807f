"""The stream's changelog and its replica, wire records, gaps that end by the clock; the history by days."""

import random
import time

import pytest
from pyspark.sql import functions as F
from test_store import put, read, rows
from test_windows import frame, stream

from tidemill.config import SUMS, VIEW
from tidemill.operators import history, windows
from tidemill.sources import files, fixtures
from tidemill.sources.daytable import DAY_MS, DayTable
from tidemill.sources.manifest import Manifest
from tidemill.streaming.store import merged
from tidemill.sources.storage import shared_path
from tidemill.streaming import engine, replica, store

SF = "/root/testdata/sf0.001"
STATS = ("partition", "to_offset", "max_event_time_ms", "closed_until_ms", "late_dropped", "events")
BUCKET = ("partition", "zone", "start_ms", "count", "fare_cents", "distance_milli")


def same_state(kept, trips):
    return rows(kept.headers(), *STATS) == rows(windows.partition_stats(trips), *STATS) and rows(kept.buckets(), *BUCKET) == rows(windows.retained_buckets(trips), *BUCKET)


def test_replica_follows_restarts_and_redelivery(spark):
    r = random.Random(3)
    events = stream(31, n=240) + [(e[0], e[1] + 100, *e[2:]) for e in stream(32, n=240, partition=1)]  # an entity's events are in one partition
    log, root, state = (shared_path(spark, n) for n in ("log", "store", "state"))
    kept, copy = store.FeatureStore(spark, root), replica.Replica(spark, shared_path(spark, "replica"))
    batches = []

    def sink(batch, number):
        replica.change_sink(kept, copy)(batch, number)
        batches.append((number, batch.collect(), batch.schema))

    at = 0
    while at < 240:
        to = min(240, at + r.randrange(60, 140))
        put(spark, [e for e in events if max(0, at - 20) <= e[6] < to], log)  # some come again
        engine.start(read(spark, log), state, sink, changelog=True).awaitTermination()
        so_far = frame(spark, [e for e in events if e[6] < to])
        assert same_state(copy, so_far)
        at = to
    trips = frame(spark, events)
    assert rows(kept.history(), "zone", "window_end_ms", *SUMS) == rows(windows.zone_features(trips), "zone", "window_end_ms", *SUMS)
    number, first, schema = next(b for b in batches if b[1])
    old = spark.createDataFrame(first, schema)
    copy.sink(old, number)  # the same batch again
    wrong = old.withColumn("count", F.col("count") + 1000)
    copy.sink(wrong, 10_000)  # an old one as if it were new: its offsets are not above those applied
    assert same_state(copy, trips)
    copy.compact(number)
    assert same_state(copy, trips)
    copy.compact(10_000)
    copy.compact(10_000)
    assert same_state(copy, trips)


def test_failed_fold_changes_nothing(spark, monkeypatch):
    trips = frame(spark, stream(33, n=150))
    copy = replica.Replica(spark, shared_path(spark, "replica"))
    engine.replay_as_stream(spark, trips, files=3, replica=copy)

    def fail(*_):
        raise OSError("down")

    with monkeypatch.context() as m:
        m.setattr(Manifest, "publish", fail)
        with pytest.raises(OSError):
            copy.compact(1)
    assert same_state(copy, trips)
    copy.compact(1)
    assert same_state(copy, trips)


def damaged(spark, events):
    """Events as records, every seventh of them malformed, and the events that are left."""
    bad = F.when(F.col("offset") % 7 == 3, F.when(F.col("offset") % 2 == 0, F.expr("substring(value, 1, 20)")).otherwise(F.lit(None).cast("binary"))).otherwise(F.col("value"))
    return files.wire(frame(spark, events)).withColumn("value", bad), frame(spark, [e for e in events if e[6] % 7 != 3])


def test_malformed_records_take_their_offsets(spark):
    events = stream(34, n=300) + stream(35, n=300, partition=1)
    wire, left = damaged(spark, events)
    log, state, out = (shared_path(spark, n) for n in ("log", "state", "out"))
    engine.write_log(wire, log, 3)
    engine.start(engine.read_log_files(spark, log), state, engine.table_sink(out), gap_ms=3_600_000).awaitTermination()
    got = spark.read.parquet(out)
    assert rows(got, "zone", "window_end_ms", *SUMS) == rows(windows.zone_features(left), "zone", "window_end_ms", *SUMS)
    heads = engine.state_headers(spark, state).orderBy("partition")
    stats = {x["partition"]: x for x in windows.partition_stats(left).collect()}
    for h in heads.collect():
        want = stats[h["partition"]]
        assert [h[c] for c in STATS[1:]] == [want[c] for c in STATS[1:]]
        assert (h["malformed"], h["expected"], h["gaps_accepted"], h["gap_since_ms"], h["repeated"]) == (len([e for e in range(300) if e % 7 == 3]), 300, 0, 0, 0)


def test_malformed_records_behind_a_gap(spark):
    events = stream(36, n=200)
    wire, left = damaged(spark, events)
    log, state, out = (shared_path(spark, n) for n in ("log", "state", "out"))
    for some in ("offset < 60", "offset >= 100", "offset between 60 and 99"):
        engine.write_log(wire.where(some), log, 1)
        engine.start(engine.read_log_files(spark, log), state, engine.table_sink(out), gap_ms=3_600_000).awaitTermination()
    h = engine.state_headers(spark, state).first()
    assert (h["events"], h["malformed"], h["gaps_accepted"], h["expected"]) == (left.count(), 200 - left.count(), 0, 200)
    assert rows(spark.read.parquet(out), "zone", "window_end_ms", *SUMS) == rows(windows.zone_features(left), "zone", "window_end_ms", *SUMS)


def test_gap_of_a_silent_partition_ends_by_the_clock(spark):
    events = stream(37, n=200)
    log, state, out = (shared_path(spark, n) for n in ("log", "state", "out"))
    put(spark, events[:80], log)
    query = engine.start(read(spark, log, 100), state, engine.table_sink(out), available_now=False, gap_ms=4_000, every="500 milliseconds")
    try:
        until = time.time() + 60
        while time.time() < until and not (query.lastProgress and query.lastProgress["batchId"] >= 1):
            time.sleep(0.5)  # such a stream never has nothing to do, so there is no waiting for its end
        put(spark, events[100:150], log)
        seen = []
        while time.time() < until and (not seen or seen[-1]["gaps_accepted"] == 0):
            time.sleep(1)
            seen.append(engine.state_headers(spark, state).first())  # no more events come
    finally:
        query.stop()
    assert any(h["events"] == 80 and h["gap_since_ms"] > 0 for h in seen)  # held at first
    assert (seen[-1]["events"], seen[-1]["gaps_accepted"], seen[-1]["gap_since_ms"], seen[-1]["to_offset"]) == (130, 1, 0, 149)
    want = windows.zone_features(frame(spark, events[:80] + events[100:150]))
    assert rows(spark.read.parquet(out), "zone", "window_end_ms", *SUMS) == rows(want, "zone", "window_end_ms", *SUMS)


# the history by days


def days_of(spark, first, last, extra=0):
    """History rows of every hour from one day to another."""
    hours = spark.range(first * 24, last * 24).select(F.lit(VIEW).alias("feature_view"), (F.col("id") % 5 + 1).cast("int").alias("zone"), (F.col("id") * 3_600_000).alias("window_end_ms"))
    sums = {c: F.col("window_end_ms") % 97 + extra for c in SUMS}
    return hours.withColumns({**sums, "source_partition": F.lit(0), "source_offset": F.lit(1).cast("long"), "conflicting_rewrites": F.lit(0)})


def everything(table):
    r = table.rows()
    return rows(r, *r.columns)


def test_a_write_touches_its_days_only(spark):
    t = DayTable(spark, shared_path(spark, "days"))
    assert everything(t) == []
    t.upsert(days_of(spark, 100, 110))
    before = {f for f in t.rows().inputFiles()}
    assert t.upsert(days_of(spark, 104, 105, extra=1)) == [(VIEW, 104)]
    after = {f for f in t.rows().inputFiles()}
    assert all("/day=104/" in f for f in before ^ after) and before ^ after
    want = history.upsert(days_of(spark, 100, 110), days_of(spark, 104, 105, extra=1))
    assert everything(t) == rows(want, *t.rows().columns)
    assert t.rows().agg(F.sum("conflicting_rewrites")).first()[0] == 24
    day = t.rows(VIEW, 104 * DAY_MS + 3_600_000, 106 * DAY_MS)
    assert {f.split("/day=")[1].split("/")[0] for f in day.inputFiles()} == {"104", "105"} and day.count() == 47
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "day" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert t.rows("other").count() == 0
    t.delete_view(VIEW)
    assert everything(t) == []
    with pytest.raises(ValueError):
        t.upsert(days_of(spark, 1, 2).withColumn("feature_view", F.lit("a/b")))


@pytest.mark.parametrize("step", ["before writing", "half written", "before publishing", "while publishing"])
def test_a_failed_write_changes_nothing(spark, monkeypatch, step):
    t = DayTable(spark, shared_path(spark, "days"))
    t.upsert(days_of(spark, 7, 9))
    before = everything(t)
    write = DayTable._write

    def fail(*_):
        raise OSError("down")

    with monkeypatch.context() as m:
        if step == "before writing":
            m.setattr(DayTable, "_write", fail)
        elif step == "half written":
            m.setattr(DayTable, "_write", lambda self, r: (write(self, r.where("zone < 3")), fail()))
        elif step == "before publishing":
            m.setattr(Manifest, "publish", fail)
        else:
            real = Manifest._fs

            class Refuses:
                def __init__(self, fs):
                    self.fs = fs

                def rename(self, *_):
                    raise OSError("down")

                def __getattr__(self, name):
                    return getattr(self.fs, name)

            m.setattr(Manifest, "_fs", lambda self: Refuses(real(self)))
        with pytest.raises(OSError):
            t.upsert(days_of(spark, 8, 10, extra=1))
        assert everything(t) == before
    t.upsert(days_of(spark, 8, 10, extra=1))
    want = history.upsert(days_of(spark, 7, 9), days_of(spark, 8, 10, extra=1))
    assert everything(t) == rows(want, *t.rows().columns)
    named = {f.rsplit("/", 1)[0] for f in t.rows().inputFiles()}
    t.upsert(days_of(spark, 20, 21))  # nothing but named versions is left after the next write
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(t.root)
    left = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(jvm.org.apache.hadoop.fs.Path(root, "feature_view=*/day=[789]/version=*"))
    assert {f.getPath().toString().split(":")[-1] for f in left} == {n.split(":")[-1].replace("///", "/") for n in named}


@pytest.mark.parametrize("step", ["before publishing", "before deleting"])
def test_compaction_that_fails_loses_no_conflict(spark, monkeypatch, step):
    """Three batches with one conflict; whatever happens, it counts once."""
    kept = store.FeatureStore(spark, shared_path(spark, "store"))
    base = windows.zone_features(frame(spark, stream(38, n=150))).withColumn("batch_offset", F.lit(1).cast("long")).withColumn("trigger_publish_ms", F.lit(0).cast("long"))
    kept.sink(base, 0)
    kept.sink(base.where("zone <= 2"), 1)
    kept.sink(base.orderBy("zone", "window_end_ms").limit(1).withColumn("trips_5m", F.col("trips_5m") + 1), 2)
    h = kept.history()
    before = rows(h, *h.columns)
    assert h.agg(F.sum("conflicting_rewrites")).first()[0] == 1

    def fail(*_):
        raise OSError("down")

    with monkeypatch.context() as m:
        if step == "before publishing":
            m.setattr(Manifest, "publish", fail)
            with pytest.raises(OSError):
                kept.compact(2)
        else:
            kept.compact(1)
            m.setattr(store, "delete", fail)
            with pytest.raises(OSError):
                kept.compact(2)
        assert rows(kept.history(), *h.columns) == before
    kept.compact(2)
    assert rows(kept.history(), *h.columns) == before
    kept.sink(base.where("zone <= 2"), 1)  # delivered again after it was moved
    kept.compact(2)
    assert rows(kept.history(), *h.columns) == before
    low, high = (base.agg(f("window_end_ms")).first()[0] for f in (F.min, F.max))
    some = kept.history(VIEW, low, (low + high) // 2)
    assert rows(some, *h.columns) == [x for x in before if low <= x[h.columns.index("window_end_ms")] < (low + high) // 2]


def test_rows_of_an_upsert_travel_once(spark):
    """However often a key is written, its rows meet in a sort and in no one value."""
    stored, batch = days_of(spark, 1, 3), days_of(spark, 2, 4, extra=1)
    often = batch.unionByName(batch.withColumn("trips_5m", F.col("trips_5m") + F.lit(2))).unionByName(batch)
    for made in (history.upsert(stored, often), merged(stored.withColumn("batch", F.lit(0)).unionByName(often.withColumn("batch", F.lit(1))))):
        plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert plan.count("Exchange hashpartitioning") == 1 and "collect_list" not in plan and "Aggregate" not in plan
        found = {r["window_end_ms"] // DAY_MS: (r["n"], r["c"]) for r in made.groupBy((F.floor(F.col("window_end_ms") / DAY_MS) * DAY_MS).alias("window_end_ms")).agg(F.count("*").alias("n"), F.sum("conflicting_rewrites").alias("c")).collect()}
        assert found == {1: (24, 0), 2: (24, 72), 3: (24, 24)}  # of a new key's three rows two are equal and taken


def test_a_large_day_becomes_many_files(spark):
    rows_ = spark.range(40_000).select(F.lit(VIEW).alias("feature_view"), F.lit(1).alias("zone"), F.col("id").alias("window_end_ms"), *[F.xxhash64("id", F.lit(c)).alias(c) for c in SUMS], F.lit(0).alias("source_partition"), F.lit(1).cast("long").alias("source_offset"), F.lit(0).alias("conflicting_rewrites"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        t = DayTable(spark, shared_path(spark, "days"))
        t.upsert(rows_)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(t.rows().inputFiles()) > 1 and t.rows().count() == 40_000
