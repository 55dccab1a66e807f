"""Declared views: batch equals stream and a plain version; what follows from a declaration; joins and ranges cut by time."""

import bisect
import random

import pytest
from pyspark.sql import Row

from tidemill.operators import history, windows
from tidemill.plans import offline
from tidemill.sources.storage import shared_path
from tidemill.streaming import engine, store
from tidemill.streaming.replica import Replica
from tidemill.views import ZONE_DEMAND, ZONE_TREND, FeatureView, Mean, Share, Total

SMALL = FeatureView("small", (Total("fares_6m", "fare_cents", 6), Total("n_3m", "count", 3)), (Mean("mean", "fares_6m", "n_3m", 10.0),), lateness_ms=5_000, bucket_ms=3 * 60_000)


def log(spark, seed, n=400, partitions=2):
    r, t, out, nth = random.Random(seed), 1_700_000_000_000, [], [0] * partitions
    for _ in range(n):
        t += r.randrange(20_000) if r.random() > 0.01 else 5 * 3_600_000
        p, late = r.randrange(partitions), r.choice([0] * 8 + [40_000, 400_000])
        out.append(Row(event_time_ms=t - late, zone=p + partitions * r.randrange(3), fare_cents=r.randrange(1000), distance_milli=r.randrange(5000), publish_ms=t, partition=p, offset=nth[p]))
        nth[p] += 1
    return out


def plain(events, view):
    """Event after event and end after end."""
    out, width = [], view.bucket_ms
    for p in {e.partition for e in events}:
        mine = sorted((e for e in events if e.partition == p), key=lambda e: e.offset)
        closed, reached, sums = mine[0].event_time_ms // width * width, 0, {}
        for e in mine:
            if e.event_time_ms >= closed:
                b = sums.setdefault((e.zone, e.event_time_ms // width * width), {"count": 0, "fare_cents": 0, "distance_milli": 0})
                for f, x in (("count", 1), ("fare_cents", e.fare_cents), ("distance_milli", e.distance_milli)):
                    b[f] += x
            reached = max(reached, e.event_time_ms)
            closed = max(closed, (reached - view.lateness_ms) // width * width)
        ends = {(z, s + k * width) for z, s in sums for k in range(1, view.reach + 2) if s + k * width <= closed}
        for z, end in ends:
            of = lambda t: sum(b[t.field] for (y, s), b in sums.items() if y == z and end - t.minutes * 60_000 <= s < end)  # noqa: E731, B023
            out.append((z, end, *map(of, view.totals)))
    return sorted(out)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


@pytest.mark.parametrize("view", [ZONE_DEMAND, ZONE_TREND, SMALL], ids=lambda v: v.name)
def test_batch_stream_and_plain_version_agree(spark, view):
    events = log(spark, 3)
    trips = spark.createDataFrame(events).selectExpr("event_time_ms", "int(zone) zone", "fare_cents", "distance_milli", "publish_ms", "int(partition) partition", "offset")
    want, names = plain(events, view), ("zone", "window_end_ms", *view.sums)
    assert rows(windows.zone_features(trips, view=view), *names) == want
    copy = Replica(spark, shared_path(spark, "replica"), view)
    assert rows(engine.replay_as_stream(spark, trips, replica=copy, repeat=20, view=view), *names) == want
    assert rows(copy.buckets(), "zone", "start_ms", "count") == rows(windows.retained_buckets(trips, view=view), "zone", "start_ms", "count")
    last = {}
    for z, *row in want:
        last[z] = (z, *row)
    assert rows(windows.latest_rows(trips, view=view), *names) == sorted(last.values())


def test_history_of_a_second_view(spark):
    trips = spark.createDataFrame(log(spark, 5)).selectExpr("event_time_ms", "int(zone) zone", "fare_cents", "distance_milli", "publish_ms", "int(partition) partition", "offset")
    want, names = windows.zone_features(trips, view=SMALL), ("zone", "window_end_ms", *SMALL.sums)
    kept = store.FeatureStore(spark, shared_path(spark, "store"), definition=SMALL)
    batch = want.selectExpr("*", "0L batch_offset", "0L trigger_publish_ms")
    kept.sink(batch, 0)
    kept.sink(batch.selectExpr("partition", "zone", "window_end_ms", "fares_6m + 1 fares_6m", "n_3m", "batch_offset", "trigger_publish_ms"), 1)
    kept.compact(1)
    found = kept.history("small")
    assert rows(found, *names) == rows(want, *names) and found.where("conflicting_rewrites <> 1").isEmpty()
    assert rows(kept.latest(), *names) == rows(windows.latest(want.select(*names)), *names)
    back = offline.backfill(trips, windows.partition_stats(trips, view=SMALL), definition=SMALL)
    cut = windows.F.lit(1 << 60)
    told = history.parity(found.select("feature_view", *names).unionByName(back.select("feature_view", *names)), "small", "small__backfill", cut, SMALL).first()
    assert (told["matched"], told["mismatched"], told["missing_left"], told["missing_right"]) == (want.count(), 0, 0, 0)
    one = windows.derive(want, SMALL).where("n_3m > 0").first()
    assert one["mean"] == one["fares_6m"] / 10.0 / one["n_3m"]


@pytest.mark.parametrize("slot", [60_000, 1_000_000, 1 << 50])
def test_point_in_time_over_slots(spark, slot):
    r = random.Random(slot)
    facts = {(z, r.randrange(-5_000_000, 5_000_000)): r.randrange(9) for z in (1, 2, 3) for _ in range(40)}
    asked = [(r.choice([1, 2, 3, 4]), r.randrange(-6_000_000, 20_000_000), float(k)) for k in range(200)] + [(z, t, 7.0) for z, t in list(facts)[:20]] + [(1, 0, 1.0), (1, 0, 1.0)]
    past = spark.createDataFrame([("small", z, t, v, v + 1) for (z, t), v in facts.items()] + [("other", 1, 0, 99, 99)], "feature_view string, zone int, window_end_ms long, fares_6m long, n_3m long")
    got = history.point_in_time(spark.createDataFrame(asked, "zone int, label_time_ms long, label double"), past, "small", SMALL, slot)
    want = []
    for z, t, label in asked:
        times = sorted(u for y, u in facts if y == z)
        k = bisect.bisect_right(times, t)
        want.append((z, t, label, *((times[k - 1], facts[z, times[k - 1]], facts[z, times[k - 1]] + 1) if k else (None, None, None))))
    text = lambda x: sorted(map(str, x))
    assert text(map(tuple, got.collect())) == text(want)
    assert history.point_in_time(spark.createDataFrame([], "zone int, label_time_ms long, label double"), past, "small", SMALL).count() == 0
    assert history.point_in_time(got.select("zone", "label_time_ms", "label"), past.where("false"), "small", SMALL).where("window_end_ms is null").count() == len(asked)


@pytest.mark.parametrize("slot", [180_000, 600_000, 86_400_000])
def test_trailing_range_over_slots(spark, slot):
    trips = spark.createDataFrame(log(spark, 8, n=300)).selectExpr("event_time_ms", "int(zone) zone", "fare_cents", "distance_milli", "publish_ms", "int(partition) partition", "offset")
    buckets = windows.bucket_agg(trips, view=SMALL)
    held = {(b.zone, b.start_ms): b for b in buckets.collect()}
    want = sorted((z, s + 180_000, sum(b.fare_cents for (y, u), b in held.items() if y == z and s - 180_000 <= u <= s), held[z, s]["count"]) for z, s in held)
    assert rows(windows.trailing_range(buckets, SMALL, slot), "zone", "window_end_ms", "fares_6m", "n_3m") == want


def test_declarations_are_checked():
    assert (ZONE_DEMAND.reach, ZONE_TREND.reach, SMALL.reach) == (60, 60, 2)
    good = Total("a", "count", 2)
    for totals, derived, more in (
        ((), (), {}), ((good, good), (), {}), ((Total("a", "speed", 2),), (), {}), ((Total("a", "count", 0),), (), {}), ((Total("a", "count", 3),), (), {"bucket_ms": 120_000}),
        ((good,), (Share("s", "a", "b", 2.0),), {}), ((good,), (Mean("a", "a", "a", 1.0),), {}), ((Total("zone", "count", 1),), (), {}), ((good,), (), {"lateness_ms": -1}),
    ):
        with pytest.raises(ValueError):
            FeatureView("v", totals, derived, **more)
