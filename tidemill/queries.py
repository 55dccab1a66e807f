"""The registered queries: each applies one operator to an input of ``sources.fixtures``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import BACKFILL_VIEW, BUCKET_MS, REACH, SUMS, VIEW
from .functions import columns
from .functions.columns import epoch_ms, floor_to
from .operators import cleaning, history, kv, measure, model, replay, report, series, serving, verify, windows
from .plans import offline
from .sources import codec, files, fixtures, synthetic
from .sources.storage import shared_path
from .views import ZONE_TREND

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_HOUR = 3_600_000


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# scans, cleaning, replay


@query
def scan_trips(spark, d):
    r = files.read_raw_trips(spark, fixtures.raw_file(spark, d))
    return r.select(epoch_ms("tpep_pickup_datetime").alias("pickup_ms"), "PULocationID", "fare_amount", "trip_distance")


@query
def clean_trips(spark, d):
    return cleaning.clean(fixtures.raw_trips(spark, d), fixtures.MONTH, "event_id")


@query
def clean_stats(spark, d):
    return cleaning.clean_stats(fixtures.raw_trips(spark, d), fixtures.MONTH)


def _middle(trips: DataFrame, hours: int) -> Column:
    return trips.select(F.min("event_time_ms")).scalar() + hours * _HOUR


@query
def replay_slice(spark, d):
    t = fixtures.trips(spark, d)
    return replay.replay_slice(t, _middle(t, 2), _middle(t, 5)).select("event_id", "event_time_ms", "zone")


@query
def replay_loop(spark, d):
    return replay.replay_loop(fixtures.trips(spark, d).select("event_id", "event_time_ms", "zone"), 3, 31 * 24 * _HOUR)


@query
def replay_resume(spark, d):
    t = fixtures.trips(spark, d).select("event_id", "event_time_ms", "zone")
    return replay.replay_resume(t, _middle(t, 12 * 24 + 7), 12 * 24 * _HOUR)


@query
def late_injection(spark, d):
    t = replay.late_injection(fixtures.ordered_trips(spark, d), fixtures.delay(), "event_id")
    return t.select("partition", "offset", "event_id", "event_time_ms")


@query
def offset_dedup(spark, d):
    return replay.offset_dedup(fixtures.dup_trips(spark, d)).select("partition", "offset", "event_id", "arrival")


@query
def offset_gaps(spark, d):
    return replay.offset_gaps(fixtures.gap_trips(spark, d))


@query
def last_event_time(spark, d):
    return replay.last_event_time(fixtures.trips(spark, d))


@query
def oracle_replay(spark, d):
    t = fixtures.trips(spark, d)
    up_to = t.groupBy("partition").agg((F.max("offset") / 2).cast("long").alias("to_offset"))
    return windows.zone_features(replay.bounded(t, up_to)).select("zone", "window_end_ms", *SUMS)


@query
def codec_roundtrip(spark, d):
    t = fixtures.trips(spark, d)
    wire = t.withColumn("value", codec.encode("event_time_ms", "zone", "fare_cents", "distance_milli", "publish_ms")).withColumn("trip", codec.decode("value"))
    return wire.select("event_id", "trip.event_time_ms", "trip.zone", "trip.fare_cents", "trip.distance_milli", "trip.publish_ms", codec.key("zone").cast("string").alias("key"), F.length("value").alias("bytes"))


@query
def malformed_count(spark, d):
    t = fixtures.trips(spark, d)
    value = codec.encode("event_time_ms", "zone", "fare_cents", "distance_milli", "publish_ms")
    wire = t.withColumn("value", value)
    wire = wire.withColumn("value", F.when(F.col("event_id") % 41 == 0, F.expr("substring(value, 1, 36)")).when(F.col("event_id") % 43 == 0, F.expr("concat(X'02', substring(value, 2))")).otherwise(F.col("value")))
    return wire.groupBy("partition").agg(F.count("*").alias("records"), F.count_if(codec.decode("value").isNull()).alias("malformed"))


@query
def synth_trips(spark, d):
    synthetic.register(spark)
    many = fixtures.events(spark, d).count()  # as many as the data folder has
    return spark.read.format("tidemill_synthetic").option("events", many).option("seed", 7).option("partitions", 4).load()


# windows


@query
def bucket_floor(spark, d):
    t = fixtures.trips(spark, d)
    shifted = F.col("event_time_ms") - _middle(t, 1)
    return t.select("event_id", shifted.alias("t_ms"), floor_to(shifted).alias("bucket_ms"))


@query
def bucket_agg(spark, d):
    return windows.bucket_agg(fixtures.trips(spark, d))


@query
def zone_features(spark, d):
    return windows.zone_features(fixtures.trips(spark, d)).select("zone", "window_end_ms", *SUMS)


@query
def quiet_rows(spark, d):
    return windows.zone_features(fixtures.trips(spark, d)).where("trips_60m = 0").select("zone", "window_end_ms")


@query
def watermark(spark, d):
    t = windows.mark_late(fixtures.trips(spark, d))
    return t.select("partition", "offset", (F.greatest("before_ms", "event_time_ms") - 30_000).alias("watermark_ms"), "closed_before")


@query
def late_events(spark, d):
    return windows.mark_late(fixtures.trips(spark, d)).where("late").select("partition", "offset", "event_id", "event_time_ms", "closed_before")


@query
def partition_stats(spark, d):
    return windows.partition_stats(fixtures.trips(spark, d))


@query
def partition_state(spark, d):
    s = windows.partition_state(fixtures.trips(spark, d))
    return s.select("partition", "to_offset", "max_event_time_ms", "closed_until_ms", "late_dropped", "events", F.posexplode_outer("buckets").alias("nth", "b")).select("*", "b.*").drop("b")


@query
def retained_buckets(spark, d):
    return windows.retained_buckets(fixtures.trips(spark, d))


@query
def derive_features(spark, d):
    return windows.derive(fixtures.features(spark, d)).select("zone", "window_end_ms", "fare_mean_15m", "distance_mean_15m", "demand_spike_ratio")


@query
def model_vector(spark, d):
    v = windows.model_vector(fixtures.features(spark, d))
    return v.select("zone", "window_end_ms", "trips_5m", "trips_30m", "trips_60m", "fare_mean_15m", "distance_mean_15m", "demand_spike_ratio", F.round("hour_sin", 9).alias("hour_sin"), F.round("hour_cos", 9).alias("hour_cos"))


@query
def zone_card(spark, d):
    return windows.zone_card(fixtures.features(spark, d))


@query
def trailing_range(spark, d):
    return windows.trailing_range(windows.bucket_agg(fixtures.trips(spark, d)))


@query
def latest_features(spark, d):
    return windows.latest_rows(fixtures.trips(spark, d)).select("zone", "window_end_ms", *SUMS)


@query
def last_n_per_zone(spark, d):
    return windows.last_n(fixtures.features(spark, d).select("zone", "window_end_ms", "trips_5m"), 5)


@query
def stream_features(spark, d):
    from .streaming.engine import replay_as_stream

    return replay_as_stream(spark, fixtures.trips(spark, d).drop("event_id"), files=3).select("zone", "window_end_ms", *SUMS)


def _wire(spark, d):
    """The log as records, some of them cut short or of another version."""
    t = fixtures.trips(spark, d)
    bad = F.when(F.col("event_id") % 41 == 0, F.expr("substring(value, 1, 36)")).when(F.col("event_id") % 43 == 0, F.expr("concat(X'02', substring(value, 2))")).otherwise(F.col("value"))
    return t.withColumn("value", codec.encode("event_time_ms", "zone", "fare_cents", "distance_milli", "publish_ms")).select("partition", "offset", bad.alias("value"))


@query
def stream_wire(spark, d):
    from .streaming.engine import replay_as_stream

    return replay_as_stream(spark, _wire(spark, d)).select("zone", "window_end_ms", *SUMS)


@query
def stream_wire_counts(spark, d):
    from .streaming.engine import HEADER, replay_as_stream

    headers: list = []
    replay_as_stream(spark, _wire(spark, d), headers=headers)
    return spark.createDataFrame(headers, f"partition int, {HEADER}").select("partition", "to_offset", "events", "late_dropped", "malformed", "repeated", "gaps_accepted")


@query
def replica_state(spark, d):
    from .streaming.engine import replay_as_stream
    from .streaming.replica import Replica

    replica = Replica(spark, shared_path(spark, "replica"))
    replay_as_stream(spark, fixtures.trips(spark, d).drop("event_id"), replica=replica, repeat=50)
    replica.compact(0)
    return replica.headers().join(replica.buckets(), "partition")


@query
def stream_metrics(spark, d):
    from .streaming.engine import replay_as_stream
    from .streaming.monitor import MetricsListener

    listener = MetricsListener(spark, shared_path(spark, "metrics"))
    replay_as_stream(spark, fixtures.trips(spark, d).drop("event_id").withColumn("publish_ms", F.col("event_time_ms")), listener=listener)
    return listener.table().agg(F.count("*").alias("batches"), F.sum("input_rows").alias("events"), F.sum("feature_rows").alias("feature_rows"), F.max("lag").alias("lag"), (F.min("freshness_s") > 0).alias("measured"))


@query
def shadow_report(spark, d):
    from .streaming.engine import read_log_files, start, write_log
    from .streaming.monitor import ShadowSink

    log, trips = shared_path(spark, "log"), fixtures.trips(spark, d)
    wrong = windows.latest(fixtures.features(spark, d).select("zone", "window_end_ms", *SUMS)).withColumn("trips_5m", F.col("trips_5m") + (F.col("zone") % 11 == 3).cast("int"))
    shadow = ShadowSink(spark, shared_path(spark, "shadow"), lambda: wrong)
    write_log(trips, log, 2)
    start(read_log_files(spark, log), shared_path(spark, "state"), shadow.sink, changelog=True).awaitTermination()
    return shadow.checks().where(F.col("batch") == 1).select("checked", "bad", "pending", "warming_up", "events")


@query
def paced_features(spark, d):
    from .sources.storage import delete
    from .streaming.engine import read_log_files, start
    from .streaming.paced import PacedReplay
    from .streaming.store import FeatureStore

    path, root, state, now = shared_path(spark, "paced"), shared_path(spark, "store"), shared_path(spark, "state"), [0.0]
    replay_ = PacedReplay(fixtures.trips(spark, d).drop("event_id", "event_type"), path, 5000.0, clock=lambda: now[0])
    going = replay_.step()
    while going:  # three seconds a step; faster after the second one
        now[0] += 3.0
        if now[0] == 6.0:
            replay_.change(20_000.0)
        going = replay_.step()
    store = FeatureStore(spark, root)
    start(read_log_files(spark, path, 8), state, store.sink, gap_ms=60_000).awaitTermination()
    replay_.clean()
    for done in (path, state):
        delete(spark, done)
    return store.history().select("zone", "window_end_ms", *SUMS)


# a second declared view


@query
def trend_features(spark, d):
    return windows.zone_features(fixtures.trips(spark, d), view=ZONE_TREND).select("zone", "window_end_ms", *ZONE_TREND.sums)


@query
def trend_stream(spark, d):
    from .streaming.engine import replay_as_stream

    return replay_as_stream(spark, fixtures.trips(spark, d).drop("event_id"), view=ZONE_TREND).select("zone", "window_end_ms", *ZONE_TREND.sums)


@query
def trend_serving(spark, d):
    latest = windows.latest_rows(fixtures.trips(spark, d), view=ZONE_TREND)
    return serving.serve(fixtures.requests(spark, d), latest, ZONE_TREND).select("request_id", "pos", "zone", "found", "window_end_ms", *ZONE_TREND.sums, *(x.name for x in ZONE_TREND.derived))


@query
def trend_pit(spark, d):
    rows = windows.zone_features(fixtures.trips(spark, d), view=ZONE_TREND).withColumn("feature_view", F.lit(ZONE_TREND.name))
    return history.point_in_time(fixtures.labels(spark, d), rows, ZONE_TREND.name, ZONE_TREND)


# history and verification


@query
def day_table(spark, d):
    from .sources.daytable import DayTable

    t = DayTable(spark, shared_path(spark, "history"))
    t.upsert(fixtures.history(spark, d).where(fixtures.minute() % 2 == 0))
    t.upsert(fixtures.history_bad(spark, d, VIEW))
    return t.rows(VIEW)


@query
def history_rows(spark, d):
    h = fixtures.history(spark, d)
    first = fixtures.trips(spark, d).select(F.min("event_time_ms")).scalar()
    return history.history_rows(h, VIEW, first + 3 * _HOUR, first + 4 * _HOUR).drop("source_offset")


@query
def history_upsert(spark, d):
    return fixtures.upserted(spark, d)


@query
def conflicting_rewrites(spark, d):
    return history.conflicting_rewrites(fixtures.upserted(spark, d))


@query
def insert_ignore(spark, d):
    h = fixtures.history(spark, d).select("zone", "window_end_ms", "trips_5m")
    stored = h.where(fixtures.minute() % 2 == 0)
    return history.insert_ignore(stored, h.withColumn("trips_5m", F.col("trips_5m") + 100), ["zone", "window_end_ms"])


@query
def unnest_rows(spark, d):
    f = fixtures.features(spark, d).withColumnRenamed("partition", "source_partition")
    packed = f.groupBy("source_partition", "zone").agg(F.collect_list(F.struct("window_end_ms", *SUMS)).alias("r"))
    arrays = packed.select("source_partition", F.transform("r", lambda x: F.col("zone")).alias("zone"), *[F.col("r")[c].alias(c) for c in ("window_end_ms", *SUMS)])
    return history.unnest_rows(arrays)


@query
def pit_join(spark, d):
    return history.point_in_time(fixtures.labels(spark, d), fixtures.history(spark, d), VIEW)


@query
def pit_training(spark, d):
    return history.point_in_time(fixtures.labels(spark, d), fixtures.history(spark, d), VIEW).where("window_end_ms is not null").orderBy("label_time_ms", "zone")


@query
def pit_leaks(spark, d):
    return history.pit_leaks(history.point_in_time(fixtures.labels(spark, d), fixtures.history(spark, d), VIEW))


@query
def parity_cut(spark, d):
    return windows.partition_stats(fixtures.trips(spark, d)).where("to_offset >= 0").agg(F.min("closed_until_ms").alias("cut_ms"))


@query
def parity(spark, d):
    cut = F.lit(parity_cut(spark, d).first()[0])
    both = fixtures.history(spark, d).unionByName(fixtures.history_bad(spark, d))
    return history.parity(both, VIEW, BACKFILL_VIEW, cut)


@query
def backfill(spark, d):
    t = fixtures.trips(spark, d)
    return offline.backfill(t, windows.partition_stats(t)).select("feature_view", "zone", "window_end_ms", *SUMS)


@query
def oracle_diff(spark, d):
    extra = fixtures.history_bad(spark, d)
    missing = fixtures.history(spark, d).where((F.col("zone") + fixtures.minute()) % 1019 != 0)
    return verify.oracle_diff(missing, extra)


@query
def state_diff(spark, d):
    t = fixtures.trips(spark, d)
    cut = t.where((F.col("partition") % 2 == 0) | (F.col("offset") % 40 != 3))
    return verify.state_diff(windows.partition_state(t), windows.partition_state(cut))


@query
def skew_check(spark, d):
    samples = fixtures.features(spark, d).where((F.col("zone") * 17 + fixtures.minute()) % 301 == 0)
    return verify.skew_check(samples, fixtures.history_bad(spark, d, VIEW), VIEW)


@query
def fingerprint(spark, d):
    return verify.fingerprint(fixtures.features(spark, d), ["zone", "window_end_ms", *SUMS])


@query
def shadow_check(spark, d):
    stored = windows.latest(fixtures.history_bad(spark, d).select("zone", "window_end_ms", *SUMS))
    shadow = fixtures.features(spark, d).where((F.col("zone") % 11 != 3) | (fixtures.minute() % 2 == 0)).select("zone", "window_end_ms", *SUMS)
    return verify.shadow_check(stored, shadow)


# serving and registers


@query
def serve_features(spark, d):
    latest = windows.latest(fixtures.features(spark, d).select("zone", "window_end_ms", *SUMS))
    return serving.serve(fixtures.requests(spark, d), latest).select("request_id", "pos", "zone", "found", "window_end_ms", "trips_5m", "fare_mean_15m", "demand_spike_ratio")


@query
def cache_split(spark, d):
    cached = windows.latest(fixtures.features(spark, d).select("zone", "window_end_ms")).where("zone % 3 = 0")
    return serving.cache_split(fixtures.requests(spark, d), cached)


@query
def client_dedup(spark, d):
    return kv.client_dedup(fixtures.kv_log(spark, d)).select("index", "client", "seq", "applied")


@query
def kv_fold(spark, d):
    return kv.kv_fold(fixtures.kv_log(spark, d))


@query
def idempotent_apply(spark, d):
    t = fixtures.dup_trips(spark, d)
    batches = t.withColumn("arrival", F.floor(F.col("arrival") / 1000)).groupBy("partition", "arrival").agg(F.max("offset").alias("to_offset"))
    late = batches.where("arrival % 3 = 0").withColumn("arrival", F.col("arrival") + 1_000_000)
    return kv.idempotent_apply(batches.unionByName(late))


@query
def linearizability(spark, d):
    from .operators.linearizability import check, example_history

    return check(example_history(spark, d))


# measurement


@query
def nearest_rank(spark, d):
    return measure.nearest_rank(fixtures.latency(spark, d), "ms", ["event_type"], {"p50": 0.5, "p99": 0.99})


@query
def upper_median(spark, d):
    return measure.upper_median(fixtures.latency(spark, d), "ms", ["event_type"])


@query
def probe_counts(spark, d):
    return measure.probe_counts(fixtures.ops(spark, d))


@query
def write_gaps(spark, d):
    return measure.write_gaps(fixtures.ops(spark, d))


@query
def gap_summary(spark, d):
    return measure.gap_summary(fixtures.ops(spark, d))


@query
def unavailability(spark, d):
    return measure.unavailability(fixtures.faults(spark, d), measure.write_gaps(fixtures.ops(spark, d)))


@query
def lag_slope(spark, d):
    rows = fixtures.counters(spark, d)
    r = measure.lag_slope(rows.withColumn("x", (F.col("hour") % 1000).cast("double")).withColumn("y", F.col("total").cast("double")), "x", "y", ["event_type"])
    return r.select("event_type", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query
def counter_rate(spark, d):
    return measure.counter_rate(fixtures.counters(spark, d), ["event_type"], "t_s", "total")


@query
def role_changes(spark, d):
    rows = fixtures.events(spark, d).select((F.col("user_id") % 5).alias("node"), F.col("event_id").alias("t"), F.when(F.col("event_type") == "click", "leader").otherwise("follower").alias("role"))
    return measure.role_changes(rows, "node", "t", "role")


@query
def histogram_quantile(spark, d):
    return measure.histogram_quantile(fixtures.histogram(spark, d), ["event_type"], 0.9).select("event_type", F.round("value", 9).alias("value"))


@query
def latency_summary(spark, d):
    return measure.latency_summary(fixtures.latency(spark, d), ["event_type"], "ms").withColumn("mean_ms", F.round("mean_ms", 9))


@query
def latency_histogram(spark, d):
    """All requests together, failed ones included, and the good ones by type."""
    rows = fixtures.latency(spark, d).select("event_type", "code", columns.scaled("ms", 1000).alias("us"))
    by = series.latency_histogram(rows.where("code = 'ok'").withColumn("of", F.col("event_type")), ["of"], "us")
    failed = series.latency_histogram(rows.where("code <> 'ok'").withColumn("of", F.lit("all")), ["of"], "us")
    every = series.merge_histograms(by.withColumn("of", F.lit("all")), failed, ["of"])
    r = series.histogram_summary(by.unionByName(every), ["of"], {"p50_ms": 0.5, "p90_ms": 0.9, "p99_ms": 0.99, "p999_ms": 0.999})
    return r.withColumn("mean_ms", F.round("mean_ms", 9))


@query
def range_rates(spark, d):
    return series.range_rate(fixtures.scrapes(spark, d), ["event_type", "le"], "t_ms", "total", 60_000, 30_000).withColumn("rate", F.round("rate", 9))


@query
def rate_quantiles(spark, d):
    r = series.rate_quantile(fixtures.scrapes(spark, d), ["event_type", "le"], ["event_type"], "t_ms", "total", 0.9, 300_000, 60_000)
    return r.withColumn("value", F.round("value", 6))


# model


@query
def make_labels(spark, d):
    return model.make_labels(fixtures.history(spark, d), VIEW)


@query
def time_split(spark, d):
    return model.time_split(model.make_labels(fixtures.history(spark, d), VIEW))


@query
def roc_auc(spark, d):
    scored = windows.derive(fixtures.features(spark, d)).select(F.col("demand_spike_ratio").alias("score"), (F.col("count_15m") > 1).cast("int").alias("label"))
    r = model.roc_auc(scored, "score", "label")
    return r.select(*[F.round(c, 9).alias(c) for c in ("auc", "average_precision", "positive_rate")], "examples")


@query
def top_zones(spark, d):
    latest = windows.derive(windows.latest(fixtures.features(spark, d).select("zone", "window_end_ms", *SUMS)))
    return model.top_zones(latest, F.col("demand_spike_ratio") + F.col("trips_60m")).select("zone", "score")


# what completes the groups above


@query
def partition_list(spark, d):
    return replay.partitions(fixtures.trips(spark, d))


@query
def replay_skipped(spark, d):
    t = fixtures.trips(spark, d).select("event_id", "event_time_ms", "zone")
    return replay.replay_skipped(t, _middle(t, 12 * 24 + 7), 12 * 24 * _HOUR)


@query
def first_events(spark, d):
    return replay.first_events(fixtures.trips(spark, d), 500).select("event_id", "event_time_ms", "partition", "offset")


@query
def compact_roundtrip(spark, d):
    t = fixtures.trips(spark, d).select("event_time_ms", "zone", "fare_cents", "distance_milli")
    path = shared_path(spark, "compact")
    files.write_compact(t, 0, 1 << 50, path)
    return files.read_compact(spark, path).select("event_time_ms", "zone", "fare_cents", "distance_milli")


@query
def ops_roundtrip(spark, d):
    path = shared_path(spark, "ops")
    files.write_ops(fixtures.ops(spark, d), path)
    return files.read_ops(spark, path)


@query
def log_roundtrip(spark, d):
    path = shared_path(spark, "log")
    files.write_log_files(fixtures.trips(spark, d), path)
    return files.read_log(spark, path).select("partition", "offset", "event_time_ms", "zone", "fare_cents", "distance_milli")


@query
def moments(spark, d):
    ms = epoch_ms("ts")
    text = F.when(F.col("event_id") % 3 == 0, F.date_format(F.to_timestamp(F.col("ts")), "yyyy-MM")).when(F.col("event_id") % 3 == 1, F.concat(F.date_format(F.to_timestamp(F.col("ts")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).otherwise("soon")
    rows = fixtures.events(spark, d).select("event_id", ms.alias("ms"), text.alias("text"))
    return rows.select("event_id", columns.parse_moment("text").alias("parsed_ms"), epoch_ms(columns.from_epoch_ms("ms")).alias("again_ms"))


@query
def recent_points(spark, d):
    f = fixtures.features(spark, d).select("zone", "window_end_ms", "trips_5m")
    return windows.recent_points(f.unionByName(f))


@query
def newest_window(spark, d):
    return windows.newest(fixtures.features(spark, d))


@query
def busiest_zone(spark, d):
    return model.busiest(fixtures.features(spark, d))


@query
def sample_rows(spark, d):
    return verify.sample_rows(fixtures.features(spark, d).select("zone", "window_end_ms", "trips_5m"), 60)


@query
def state_fingerprint(spark, d):
    t = fixtures.trips(spark, d)
    return verify.state_fingerprint(windows.partition_stats(t), windows.retained_buckets(t), fixtures.features(spark, d))


@query
def converged(spark, d):
    t = fixtures.trips(spark, d)
    prints = verify.fingerprints(fixtures.features(spark, d), ["zone", "window_end_ms", *SUMS], [F.col("zone") % 7 != k for k in (7, 8, 3)])
    applied = t.agg(F.max("offset").alias("applied"))
    nodes = prints.select("node", F.col("sha256").alias("fingerprint"), "row_count").join(F.broadcast(applied))
    two = verify.converged(nodes.where("node < 2")).withColumn("case", F.lit("equal"))
    three = verify.converged(nodes).withColumn("case", F.lit("one differs"))
    return two.unionByName(three)


@query
def delete_view(spark, d):
    both = fixtures.history(spark, d).unionByName(fixtures.history_bad(spark, d))
    return history.delete_view(both, BACKFILL_VIEW).select("feature_view", "zone", "window_end_ms", *SUMS)


@query
def label_table(spark, d):
    from .streaming.store import write_labels

    return write_labels(model.make_labels(fixtures.history(spark, d), VIEW), shared_path(spark, "labels"))


@query
def merged_history(spark, d):
    from .streaming.store import merged

    first = fixtures.history(spark, d).withColumn("batch", F.floor(F.col("window_end_ms") / _HOUR))
    again = fixtures.history_bad(spark, d, VIEW).withColumn("batch", F.floor(F.col("window_end_ms") / _HOUR) + 1_000_000)
    return merged(first.unionByName(again))


@query
def touched_zones(spark, d):
    from .streaming.store import touched

    f = fixtures.features(spark, d)
    return touched(f.where(F.col("window_end_ms") >= F.lit(f.select(F.max("window_end_ms")).scalar()) - _HOUR))


@query
def training_examples(spark, d):
    return offline.training_examples(fixtures.history(spark, d)).select("zone", "label_time_ms", "label", "window_end_ms", "trips_5m", "trips_60m", "demand_spike_ratio")


@query
def merge_buckets(spark, d):
    t = fixtures.trips(spark, d)
    size = 500
    all_buckets = windows.bucket_agg(t)
    batches = t.groupBy("partition", F.floor(F.col("offset") / size).alias("arrival")).agg(F.max("offset").alias("to_offset"), F.max("event_time_ms").alias("closed_until_ms"))
    again = batches.where("arrival % 4 = 1").withColumn("arrival", F.col("arrival") + 1_000_000)
    # each batch tells the buckets that it changed, as they are then; a repeated one tells wrong numbers, which must not be applied
    seen = t.select("partition", F.floor(F.col("offset") / size).alias("arrival"), "zone", floor_to("event_time_ms").alias("start_ms")).distinct()
    rows = seen.join(all_buckets, ["partition", "zone", "start_ms"]).withColumn("count", F.col("count") * 1000 + F.col("arrival"))
    wrong = rows.where("arrival % 4 = 1").withColumn("arrival", F.col("arrival") + 1_000_000).withColumn("count", F.lit(-1).cast("long"))
    return kv.merge_buckets(batches.unionByName(again), rows.unionByName(wrong), REACH * BUCKET_MS)


@query
def purge_counts(spark, d):
    return kv.purge_counts(fixtures.kv_log(spark, d))


@query
def register_lookup(spark, d):
    return kv.lookup(kv.kv_fold(fixtures.kv_log(spark, d)), "click-3").unionByName(kv.lookup(kv.kv_fold(fixtures.kv_log(spark, d)), "none"))


@query
def rate_by(spark, d):
    rows = fixtures.counters(spark, d).withColumn("label", F.substring("event_type", 1, 1))
    return measure.rate_by(rows, ["label", "event_type"], "label", "t_s", "total").withColumn("rate", F.round("rate", 9))


@query
def hit_ratio(spark, d):
    return measure.hit_ratio(fixtures.counters(spark, d), ["event_type"], "t_s", "total", F.col("event_type") == "click")


@query
def gauge_max(spark, d):
    return measure.gauge_max(fixtures.counters(spark, d), "total")


@query
def sustained(spark, d):
    rows = measure.lag_slope(fixtures.counters(spark, d).withColumn("x", F.col("hour").cast("double")).withColumn("y", (F.col("total") % 97).cast("double")), "x", "y", ["event_type"])
    return rows.select("event_type", measure.sustained(F.lit(5.0), F.col("slope")).alias("sustained"))


@query
def counts_by_code(spark, d):
    return measure.counts_by(fixtures.latency(spark, d), F.col("code"), "code")


@query
def failover(spark, d):
    e = fixtures.events(spark, d).select(epoch_ms("ts").alias("t_ms"), (F.floor(F.col("event_id") / 500) % 5).cast("string").alias("leader"))
    fault = e.select((F.min("t_ms") + 3 * _HOUR).alias("t")).first()["t"]
    old = e.where(F.col("t_ms") <= fault).agg(F.max_by("leader", "t_ms")).first()[0]
    return measure.failover(e, fault, old)


@query
def fault_lines(spark, d):
    rows = fixtures.fault_log(spark, d)
    first = fixtures.events(spark, d).select(F.min(epoch_ms("ts"))).scalar()
    return report.fault_lines(rows, first)


@query
def check_totals(spark, d):
    return report.check_totals(fixtures.check_windows(spark, d))


@query
def cpu_cores(spark, d):
    side = lambda k: fixtures.cpu_samples(spark, d, k).groupBy("name").agg(F.sum("cpu_s").alias("cpu_s"))
    return report.cpu_cores(side(0), side(1), F.lit(90.0)).withColumn("cores", F.round("cores", 9))


@query
def cpu_total(spark, d):
    side = lambda k: fixtures.cpu_samples(spark, d, k).groupBy("name").agg(F.sum("cpu_s").alias("cpu_s"))
    return report.cpu_total(report.cpu_cores(side(0), side(1), F.lit(90.0))).withColumn("cores_total", F.round("cores_total", 6))


@query
def top_cpu(spark, d):
    rows = fixtures.cpu_samples(spark, d, 1)
    return report.top_cpu(rows.select("run", "name", F.col("cpu_s").alias("cores")))


@query
def before_after(spark, d):
    return report.before_after(fixtures.bench_files(spark, d, False), fixtures.bench_files(spark, d, True), ["requests", "max_ms"])


@query
def report_order(spark, d):
    rows = fixtures.bench_files(spark, d, True).select("file", F.col("requests").cast("double").alias("offered_rate_eps"))
    return report.by_rate(rows)


@query
def zone_names(spark, d):
    zones = spark.read.parquet(f"{d}/nation.parquet").select((F.col("n_nationkey") + 1).cast("int").alias("LocationID"), F.col("n_name").alias("Zone"), F.lit("b").alias("Borough"))
    return files.with_zone_names(windows.latest_rows(fixtures.trips(spark, d)).select("zone", "window_end_ms"), zones)
