"""The closed form and the stream against a sequential statement of the window semantics."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill import schemas
from tidemill.config import BUCKET_MS, LATENESS_MS, SUMS
from tidemill.operators import windows
from tidemill.sources.storage import shared_path
from tidemill.streaming import engine

T0 = 1_700_000_000_000


def stream(seed, n=600, zones=12, partition=0):
    """Events with small steps, idle gaps, slightly and badly late ones."""
    r = random.Random(seed)
    t, out = T0, []
    for k in range(n):
        t += r.randrange(4000) if r.random() > 1 / 150 else r.randrange(10_800_000)
        late = r.random()
        et = t - (r.randrange(30_000) if late < 0.1 else r.randrange(30_000, 330_000) if late < 0.13 else 0)
        out.append((et, 1 + int(zones * r.random() ** 3), r.randrange(500, 5500), r.randrange(20_000), 0, partition, k))
    return out


def sequential(events):
    """One event after the other, one window after the other."""
    closed = most = None
    late, buckets, active, out = 0, {}, set(), []
    for et, zone, fare, miles, *_ in events:
        if closed is None:
            closed = et - et % BUCKET_MS
        if et < closed:
            late += 1
            continue
        b = buckets.setdefault((zone, et - et % BUCKET_MS), [0, 0, 0])
        b[0] += 1
        b[1] += fare
        b[2] += miles
        most = et if most is None else max(most, et)
        while closed + BUCKET_MS <= most - LATENESS_MS:
            end = closed + BUCKET_MS
            was, active = active, set()
            sums = {}
            for (z, s), (n, f, m) in buckets.items():
                age = (end - s) // BUCKET_MS
                if 1 <= age <= 60:
                    x = sums.setdefault(z, [0] * 6)
                    for i, k in enumerate((5, 30, 60)):
                        x[i] += n if age <= k else 0
                    if age <= 15:
                        x[3] += n
                        x[4] += f
                        x[5] += m
            for z in set(sums) | was:
                out.append((z, end, *sums.get(z, [0] * 6)))
            active = set(sums)
            closed = end
            for k in [k for k in buckets if k[1] < closed - 60 * BUCKET_MS]:
                del buckets[k]
    return sorted(out), late, closed, buckets


def frame(spark, events):
    return spark.createDataFrame(events, schemas.TRIPS)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_closed_form(spark, seed):
    events = stream(seed)
    want, late, closed, buckets = sequential(events)
    assert late > 0
    trips = frame(spark, events)
    got = windows.zone_features(trips).select("zone", "window_end_ms", *SUMS)
    assert sorted(map(tuple, got.collect())) == want
    stats = windows.partition_stats(trips).first()
    assert (stats["late_dropped"], stats["closed_until_ms"], stats["events"]) == (late, closed, len(events))
    kept = windows.retained_buckets(trips).select("zone", "start_ms", "count", "fare_cents", "distance_milli").collect()
    assert {(r[0], r[1]): list(r[2:]) for r in kept} == buckets


def test_chunks_do_not_change_lateness(spark):
    trips = frame(spark, stream(4) + stream(5, partition=1))
    for chunk in (7, 1 << 20):
        marks = windows.mark_late(trips, chunk=chunk).select("partition", "offset", "closed_before", "late").collect()
        if chunk == 7:
            small = sorted(map(tuple, marks))
    assert small == sorted(map(tuple, marks))


def test_derived_values(spark):
    row = spark.createDataFrame([(1, 0, 10, 20, 60, 4, 4000, 8000), (2, 0, 0, 0, 0, 0, 0, 0)], schemas.FEATURES)
    got = windows.derive(row).orderBy("zone").select("demand_spike_ratio", "fare_mean_15m", "distance_mean_15m").collect()
    assert [tuple(r) for r in got] == [(2.0, 10.0, 2.0), (0.0, 0.0, 0.0)]


def test_stream_with_restart_and_redelivery_equals_batch(spark):
    events = stream(6) + stream(7, partition=1)
    trips = frame(spark, events)
    log, out, state = (shared_path(spark, n) for n in ("log", "out", "state"))

    def run():
        rows = spark.readStream.schema(schemas.TRIPS).option("maxFilesPerTrigger", 1).parquet(log)
        engine.start(rows, state, engine.table_sink(out)).awaitTermination()

    engine.write_log(trips.where("offset < 200"), log, 2)
    run()
    engine.write_log(trips.where("offset between 150 and 400"), log, 1)  # 150 to 199 come again
    run()
    engine.write_log(trips.where("offset > 400"), log, 2)
    run()
    got = spark.read.parquet(out).select("zone", "window_end_ms", *SUMS)
    want = windows.zone_features(trips).select("zone", "window_end_ms", *SUMS)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    heads = engine.state_headers(spark, state).select("partition", "to_offset", "max_event_time_ms", "closed_until_ms", "late_dropped", "events")
    assert sorted(map(tuple, heads.collect())) == sorted(map(tuple, windows.partition_stats(trips).collect()))


def test_empty_log(spark):
    none = frame(spark, [])
    assert windows.zone_features(none).count() == 0
    assert windows.partition_state(none).count() == 0


@pytest.mark.parametrize("mutant", ["lateness", "reach"])
def test_mutants_are_caught(spark, mutant):
    events = stream(1)
    want = sequential(events)[0]
    trips = frame(spark, events)
    if mutant == "lateness":
        got = windows.zone_features(trips, lateness=0)
    else:
        got = windows.slide(windows.bucket_agg(trips), windows.partition_stats(trips), reach=59)
    assert sorted(map(tuple, got.select("zone", "window_end_ms", *SUMS).collect())) != want


def test_late_counts_as_event(spark):
    events = [(T0, 1, 1, 1, 0, 0, 0), (T0 + 600_000, 1, 1, 1, 0, 0, 1), (T0, 1, 1, 1, 0, 0, 2)]
    s = windows.partition_stats(frame(spark, events)).first()
    assert (s["to_offset"], s["events"], s["late_dropped"]) == (2, 3, 1)
    assert windows.bucket_agg(frame(spark, events)).agg(F.sum("count")).first()[0] == 2


def test_buckets_are_not_dealt_before_a_shuffle(spark):
    """What is shuffled and sorted is a few changes a bucket, not a row for each of its 61 window ends; these are written out last."""
    trips = frame(spark, stream(41, n=200))
    got = windows.zone_features(trips)
    steps = [line.strip(" :+-") for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    dealt = next(i for i, step in enumerate(steps) if step.startswith("Generate explode(sequence"))
    assert not any(step.startswith(("Aggregate", "Window", "Sort", "Repartition")) for step in steps[:dealt])
    buckets = windows.bucket_agg(trips)
    ends = windows.closings(trips)
    want = buckets.join(ends, "partition").withColumn("age", F.explode(F.sequence(F.lit(1), F.lit(61)))).withColumn("window_end_ms", F.col("start_ms") + F.col("age") * 60_000).where("window_end_ms <= closed_until_ms")
    want = want.groupBy("partition", "zone", "window_end_ms").agg(*[F.sum(F.when(F.col("age") <= t.minutes, F.col(t.field)).otherwise(0)).alias(t.name) for t in windows.ZONE_DEMAND.totals])
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_stream_deals_buckets_in_blocks():
    """One entity with many buckets and many entities with few: each block is bounded, and together they are what one deal of all makes."""
    r = np.random.default_rng(5)
    zone = np.concatenate([np.full(20_000, 7), r.integers(10, 4_000, 30_000)])
    start = np.concatenate([np.arange(20_000), r.integers(-3_000, 9_000, 30_000)]) * BUCKET_MS
    sums = r.integers(0, 100, (50_000, 3))
    zone, start, sums = engine._summed(zone, start, sums)
    after, until = 100 * BUCKET_MS, 15_000 * BUCKET_MS
    blocks = list(engine.slide(zone, start, sums, after, until))
    assert len(blocks) > 5 and max(map(len, blocks)) <= 2 * engine.BLOCK * 61
    ends = {}
    for z, s, (n, _, d) in zip(zone.tolist(), start.tolist(), sums.tolist(), strict=True):
        for age in range(1, 62):
            if after < s + age * BUCKET_MS <= until:
                row = ends.setdefault((z, s + age * BUCKET_MS), [0, 0, 0])
                row[0], row[1], row[2] = row[0] + n * (age <= 5), row[1] + n * (age <= 60), row[2] + d * (age <= 15)
    got = pd.concat(blocks)[["zone", "window_end_ms", "trips_5m", "trips_60m", "distance_milli_15m"]]
    assert sorted(got.itertuples(index=False, name=None)) == sorted((*k, *v) for k, v in ends.items())
    assert list(engine.slide(zone[:0], start[:0], sums[:0], after, until)) == []


def test_processor_asks_the_state_once_a_bucket_that_it_keeps():
    """Buckets that a micro-batch opens and leaves behind are no calls of the state, and repeated, unordered and missing numbers change nothing."""

    class State(dict):
        calls = 0

        def iterator(self):
            return iter(list(self.items()))

        def updateValue(self, key, value):
            self.calls, self[key] = self.calls + 1, value

        def removeKey(self, key):
            self.calls += 1
            del self[key]

        def containsKey(self, key):
            self.calls += 1
            return key in self

    p = engine.WindowProcessor()
    p.buckets, p.header = State(), State()
    events = pd.DataFrame({"offset": range(5_000), "event_time_ms": [T0 + 60_000 * k for k in range(5_000)], "zone": 1, "fare_cents": [None, 3] * 2_500, "distance_milli": 2, "publish_ms": 1, "ok": True})
    head, p.header.exists = engine.Header(), lambda: False
    taken = p._accepted(pd.concat([events.iloc[::-1], events.iloc[10:20]]), head, 0)
    rows = pd.concat([rows for _, rows in p._windows(taken, head)])
    assert (head.repeated, head.events, head.late_dropped) == (10, 5_000, 0) and p.buckets.calls <= 62
    last = rows[rows["window_end_ms"] == head.closed_until_ms].iloc[0]
    assert (last["trips_60m"], last["count_15m"], last["fare_cents_15m"] in (21, 24)) == (60, 15, True)


def test_recent_points_pick_the_last_ones_before_any_row_travels(spark):
    points = [(z, None if t == 0 else t // 2 * 60_000, t // 2) for z in (1, 2, None) for t in range(40 * (z or 3))]  # all but the null one twice
    df = spark.createDataFrame(points, "zone int, window_end_ms long, trips_5m long").repartition(3)
    made = windows.recent_points(df, 7)
    plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].splitlines()
    shuffles = [k for k, line in enumerate(plan) if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 1 and "WindowGroupLimit" in "".join(plan[shuffles[0] :])
    want = {(z, w, v) for z in (1, 2, None) for w, v in sorted({(w, v) for y, w, v in points if y == z}, key=lambda x: -1 if x[0] is None else x[0])[-7:]}
    got = [tuple(r) for r in made.select("zone", "as_of_ms", "trips_5m").collect()]
    assert len(got) == len(set(got)) == 21 and set(got) == want
