"""Paced replay with a clock of its own: what is due, changes of pace, failures, and results that don't depend on the pace."""

import math

import pytest
from pyspark.sql import functions as F

from tests.test_monitor import frame
from tests.test_views import log, rows
from tidemill.config import SUMS
from tidemill.operators import windows
from tidemill.sources.storage import shared_path
from tidemill.streaming import engine, store
from tidemill.streaming.paced import FASTEST, Pace, PacedReplay


def test_pace():
    p = Pace(60.0, 1_000.0, 10.0)
    assert (p.due(10.0), p.due(11.0), p.due(9.0)) == (1_000.0, 61_000.0, 1_000.0)
    faster = p.changed(600.0, 11.0, 0.0)
    assert faster.due(11.0) == 61_000.0 and faster.due(12.0) == 661_000.0  # neither a burst nor a pause
    assert Pace(0.0, 5.0, 0.0).due(0.0) == math.inf and Pace(0.0, 5.0, 0.0).changed(1.0, 3.0, 70.0).due(4.0) == 1070.0
    assert Pace(50.0, 0.0, 0.0, True).due(2.0) == 100.0
    for bad in (-1.0, FASTEST + 1, math.nan):
        with pytest.raises(ValueError):
            Pace(bad, 0.0, 0.0)


def published(spark, path):
    return spark.read.option("recursiveFileLookup", "true").parquet(path)


def test_steps_follow_the_clock_and_survive_failures(spark):
    trips, now = frame(spark, log(spark, 31)), [100.0]
    path = shared_path(spark, "paced")
    replay = PacedReplay(trips, path, 600.0, clock=lambda: now[0])
    marked = windows.prefix_max(trips).withColumn("release", F.greatest("event_time_ms", "before_ms"))
    first = marked.agg(F.min("release")).first()[0]
    assert replay.step() and published(spark, path).count() >= 1
    now[0] += 1.0
    assert replay.step()
    got = published(spark, path)
    released = marked.where(F.col("release") <= first + 600_000)
    assert rows(got, "partition", "offset") == rows(released, "partition", "offset")
    kept = replay.manifest.publish

    def failing(content):
        if content["going"] is None:
            raise OSError("lost after the events went out")
        kept(content)

    now[0] += 2.0
    replay.manifest.publish = failing
    with pytest.raises(OSError):
        replay.step()
    again = PacedReplay(trips, path, 1.0, clock=lambda: now[0])  # goes on with the pace that was set
    now[0] += 5.0
    again.step()
    assert published(spark, path).groupBy("partition", "offset").count().where("count > 1").isEmpty()
    again.change(0.0)
    while again.step():
        pass
    assert rows(published(spark, path), "partition", "offset", "event_time_ms") == rows(trips, "partition", "offset", "event_time_ms")
    assert not again.step()  # all is published


@pytest.mark.parametrize("speed, by_rate, more", [(0.0, False, None), (3_000.0, False, 50_000.0), (60.0, True, 200.0)])
def test_results_do_not_depend_on_the_pace(spark, speed, by_rate, more):
    trips, now = frame(spark, log(spark, 32, n=300)), [0.0]
    path, state, root = (shared_path(spark, n) for n in ("paced", "state", "store"))
    replay, kept = PacedReplay(trips, path, speed, by_rate, clock=lambda: now[0]), store.FeatureStore(spark, root)
    sizes = []

    def sleep(seconds):
        now[0] += seconds
        sizes.append(published(spark, path).count())
        engine.start(engine.read_log_files(spark, path, 100), state, kept.sink).awaitTermination()
        if len(sizes) == 2 and more:
            replay.change(more)

    replay.run(1.0, sleep)
    engine.start(engine.read_log_files(spark, path, 100), state, kept.sink).awaitTermination()
    assert rows(kept.history(), "zone", "window_end_ms", *SUMS) == rows(windows.zone_features(trips), "zone", "window_end_ms", *SUMS)
    if by_rate:
        assert sizes[:3] == [1, 61, 121] and sizes[3:] == []  # then 200 a second
    headers = engine.state_headers(spark, state).agg(F.sum("repeated"), F.sum("events")).first()
    assert tuple(headers) == (0, 300)


def test_empty_log(spark):
    replay = PacedReplay(frame(spark, log(spark, 33, n=5)).where("false"), shared_path(spark, "paced"), 1.0)
    assert not replay.step()
