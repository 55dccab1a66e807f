"""Metrics of streams as a table, and the check that a shadow makes by itself."""

from pyspark.sql import functions as F

from tests.test_views import log, rows
from tidemill.config import SUMS
from tidemill.operators import windows
from tidemill.sources.storage import shared_path
from tidemill.streaming import engine
from tidemill.streaming.monitor import MetricsListener, ShadowSink, metrics_row


def frame(spark, events):
    return spark.createDataFrame(events).selectExpr("event_time_ms", "int(zone) zone", "fare_cents", "distance_milli", "publish_ms", "int(partition) partition", "offset")


def test_row_of_a_progress_entry():
    entry = {"timestamp": "2024-01-01T00:00:10.000Z", "runId": "r", "batchId": 3, "numInputRows": 7, "durationMs": {"triggerExecution": 500}, "sources": [], "observedMetrics": {"features": {"feature_rows": 2, "published_ms": 1704067208000}}}
    assert metrics_row(entry)["freshness_s"] == 2.5 and metrics_row(entry)["input_rows"] == 7
    for nothing in ({}, {"features": {"feature_rows": 0, "published_ms": None}}, {"features": {"feature_rows": 2, "published_ms": 0}}, {"features": None}):
        assert metrics_row(entry | {"observedMetrics": nothing})["freshness_s"] is None


def test_progress_of_streams_is_a_table(spark):
    trips = frame(spark, log(spark, 21))
    for each in (1, 60):
        listener = MetricsListener(spark, shared_path(spark, "metrics"), each)
        made = engine.replay_as_stream(spark, trips, files=4, listener=listener)
        found = listener.table().orderBy("batch").collect()
        assert [r["batch"] for r in found] == [0, 1, 2, 3] and len({r["run"] for r in found}) == 1
        assert sum(r["input_rows"] for r in found) == trips.count() and sum(r["feature_rows"] for r in found) == made.count()
        assert all(r["freshness_s"] > 0 and r["lag"] == 0 for r in found)


def test_shadow_reports_a_planted_row(spark):
    events = log(spark, 22)
    trips = frame(spark, events)
    want = windows.latest(windows.zone_features(trips).select("zone", "window_end_ms", *SUMS))
    planted = {"on": False}
    wrong = lambda: want.withColumn("trips_5m", F.col("trips_5m") + (F.lit(planted["on"]) & (F.col("zone") == 2)).cast("int"))
    path, state, root = (shared_path(spark, n) for n in ("log", "state", "shadow"))
    shadow = ShadowSink(spark, root, wrong)
    seen = []

    def sink(batch, number):
        if number == 1:  # a failure after the check; the micro-batch comes again
            shadow.sink(batch, number)
        planted["on"] = number == 3
        shadow.sink(batch, number)
        seen.append(number)

    engine.write_log(trips, path, 3)
    engine.start(engine.read_log_files(spark, path), state, sink, changelog=True).awaitTermination()
    engine.write_log(trips.where("offset > 150"), path, 1)  # comes again, changes nothing
    engine.start(engine.read_log_files(spark, path), state, sink, changelog=True).awaitTermination()
    found = shadow.checks().orderBy("batch").collect()
    assert seen == [0, 1, 2, 3] and [r["bad"] for r in found] == [0, 0, 0, 1]
    assert found[0]["pending"] > 0 and (found[2]["checked"], found[2]["pending"], found[2]["events"]) == (want.count(), 0, len(events))
    total = shadow.totals().first()
    assert total["total_bad"] == 1 and total["last_bad_ms"] == found[3]["at_ms"]
    kept = shadow._part(shadow.manifest.read()["now"], "rows")
    assert rows(windows.latest(kept.select("zone", "window_end_ms", *SUMS)), "zone", "window_end_ms", *SUMS) == rows(want, "zone", "window_end_ms", *SUMS)


def test_shadow_that_begins_late_warms_up(spark):
    short = [e for e in log(spark, 23, n=100) if e.offset >= 20][:40]
    short = [e for e in short if e.event_time_ms - short[0].event_time_ms < 3_000_000]
    path = shared_path(spark, "log")
    engine.write_log(frame(spark, short), path, 1)
    nothing_like_it = spark.createDataFrame([(0, 60_000, *[1] * 6)], "zone int, window_end_ms long, " + ", ".join(f"{c} long" for c in SUMS))
    shadow = ShadowSink(spark, shared_path(spark, "shadow"), lambda: nothing_like_it, first_offset=20)
    engine.start(engine.read_log_files(spark, path), shared_path(spark, "state"), shadow.sink, changelog=True).awaitTermination()
    found = shadow.checks().first()
    assert found["warming_up"] and (found["bad"], found["checked"], found["pending"]) == (0, 0, 1)
    assert shadow.totals().first()["total_checked"] == 0


def test_rows_that_spark_computes_twice_count_once(spark, monkeypatch):
    """As when an executor is lost: the micro-batch's rows are computed again."""
    trips, sink = frame(spark, log(spark, 22)), engine.FeatureStore.sink

    def twice(self, batch, number):
        batch.write.format("noop").mode("overwrite").save()
        sink(self, batch, number)

    monkeypatch.setattr(engine.FeatureStore, "sink", twice)
    listener = MetricsListener(spark, shared_path(spark, "metrics"))
    made = engine.replay_as_stream(spark, trips, files=3, listener=listener)
    found = listener.table().collect()
    assert sum(r["feature_rows"] for r in found) == made.count() > 0 and sum(r["input_rows"] for r in found) == trips.count() and len(found) == 3
    told = spark.read.json(listener.root).agg(F.sum("feature_rows")).first()[0]
    assert told == 2 * made.count()  # what Spark's own count says
