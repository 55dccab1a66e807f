"""The stream's tables, gap policy, restored state, metrics; serving in its modes; reports; order in two levels."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F
from test_windows import T0, frame, stream

from tidemill import schemas
from tidemill.config import SUMS, VIEW
from tidemill.functions import columns
from tidemill.operators import history, kv, ordering, replay, report, serving, windows
from tidemill.sources import files, fixtures
from tidemill.sources.storage import shared_path
from tidemill.streaming import engine, store

SF = "/root/testdata/sf0.001"


def rows(df, *names):
    return sorted(map(tuple, df.select(*names).collect()))


def read(spark, log, files_each=1):
    return spark.readStream.schema(schemas.TRIPS).option("maxFilesPerTrigger", files_each).parquet(log)


def put(spark, events, log):
    frame(spark, events).coalesce(1).write.mode("append").parquet(log)


def test_sink_upserts_and_tells_caches(spark):
    events = [(*e[:4], int(time.time() * 1000), *e[5:]) for e in stream(8, n=400)]
    log, root, state = (shared_path(spark, n) for n in ("log", "store", "state"))
    told = []
    kept = store.FeatureStore(spark, root, invalidate=told.extend)
    engine.write_log(frame(spark, events), log, 3)
    engine.start(read(spark, log), state, kept.sink).awaitTermination()
    want = windows.zone_features(frame(spark, events))
    assert rows(kept.history(), "zone", "window_end_ms", *SUMS) == rows(want, "zone", "window_end_ms", *SUMS)
    assert kept.history().agg(F.sum("conflicting_rewrites")).first()[0] == 0
    newest = windows.latest(want.select("zone", "window_end_ms", *SUMS))
    assert rows(kept.latest(), "zone", "window_end_ms", *SUMS) == rows(newest, "zone", "window_end_ms", *SUMS)
    assert set(told) == {r[0] for r in want.select("zone").distinct().collect()}
    assert kept.freshness and all(0 <= f["freshness_s"] < 600 for f in kept.freshness)
    # a batch that comes again overwrites itself; one that differs counts as conflicting
    batch = want.withColumn("batch_offset", F.lit(1).cast("long")).withColumn("trigger_publish_ms", F.lit(0).cast("long"))
    kept.sink(batch.withColumn("trips_5m", F.col("trips_5m") + (F.col("zone") == 1).cast("long")), 10_000)
    kept.sink(batch.withColumn("trips_5m", F.col("trips_5m") + (F.col("zone") == 1).cast("long")), 10_000)
    again = kept.history()
    assert rows(again, "zone", "window_end_ms", *SUMS) == rows(want, "zone", "window_end_ms", *SUMS)
    ones = want.where("zone = 1").count()
    assert ones > 0 and again.agg(F.sum("conflicting_rewrites")).first()[0] == ones
    before = rows(again, *again.columns)
    kept.compact(10_000)
    assert rows(kept.history(), *again.columns) == before
    kept.delete_view(VIEW)


def test_failing_cache_does_not_stop_the_sink(spark):
    def broken(zones):
        raise OSError("down")

    kept = store.FeatureStore(spark, shared_path(spark, "store"), invalidate=broken)
    want = windows.zone_features(frame(spark, stream(9, n=200)))
    kept.sink(want.withColumn("batch_offset", F.lit(1).cast("long")).withColumn("trigger_publish_ms", F.lit(5).cast("long")), 0)
    assert kept.history().count() == want.count()


def test_merged_equals_upserts(spark):
    h = fixtures.history(spark, SF)
    bad = fixtures.history_bad(spark, SF, VIEW)
    both = h.where(fixtures.minute() % 2 == 0).withColumn("batch", F.lit(0).cast("long")).unionByName(bad.withColumn("batch", F.lit(1).cast("long")))
    want = history.upsert(h.where(fixtures.minute() % 2 == 0), bad.drop("conflicting_rewrites"))
    got = store.merged(both)
    assert rows(got, *want.columns) == rows(want, *want.columns)


def test_gap_is_held_then_accepted(spark):
    events = stream(10, n=300)
    log, state = shared_path(spark, "log"), shared_path(spark, "state")
    out = shared_path(spark, "out")

    def run(gap_ms):
        engine.start(read(spark, log, 100), state, engine.table_sink(out), gap_ms=gap_ms).awaitTermination()

    put(spark, events[:100], log)
    run(3_600_000)
    put(spark, events[150:], log)  # 100 to 149 are not there yet
    run(3_600_000)
    head = engine.state_headers(spark, state).first()
    assert (head["to_offset"], head["events"]) == (99, 100)
    put(spark, events[90:150], log)
    run(3_600_000)
    head = engine.state_headers(spark, state).first()
    assert (head["to_offset"], head["events"], head["repeated"], head["gaps_accepted"]) == (299, 300, 10, 0)
    got = spark.read.parquet(out)
    assert rows(got, "zone", "window_end_ms", *SUMS) == rows(windows.zone_features(frame(spark, events)), "zone", "window_end_ms", *SUMS)


def test_gap_that_lasts_is_accepted(spark):
    events = stream(11, n=200)
    log, state, out = (shared_path(spark, n) for n in ("log", "state", "out"))

    def run():
        engine.start(read(spark, log, 100), state, engine.table_sink(out), gap_ms=1).awaitTermination()

    put(spark, events[:80], log)
    run()
    put(spark, events[100:150], log)
    run()
    time.sleep(0.1)
    put(spark, events[150:], log)
    run()
    head = engine.state_headers(spark, state).first()
    assert (head["to_offset"], head["events"], head["gaps_accepted"], head["gap_since_ms"]) == (199, 180, 1, 0)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_restarts_equal_batch(spark, seed):
    """The stream is stopped and started again at random points of the log, some of it delivered again."""
    r = random.Random(seed)
    events = stream(20 + seed, n=240)
    log, root, state = (shared_path(spark, n) for n in ("log", "store", "state"))
    kept = store.FeatureStore(spark, root)
    at = 0
    while at < len(events):
        to = min(len(events), at + r.randrange(30, 120))
        put(spark, events[max(0, at - r.randrange(20)) : to], log)
        engine.start(read(spark, log), state, kept.sink).awaitTermination()
        at = to
    assert rows(kept.history(), "zone", "window_end_ms", *SUMS) == rows(windows.zone_features(frame(spark, events)), "zone", "window_end_ms", *SUMS)


def test_restored_state_goes_on(spark):
    events = stream(12, n=300)
    head, tail = frame(spark, events[:180]), events[180:]
    log, state, out = (shared_path(spark, n) for n in ("log", "state", "out"))
    put(spark, tail, log)
    snapshot = engine.initial_state(windows.partition_stats(head), windows.retained_buckets(head))
    engine.start(read(spark, log), state, engine.table_sink(out), snapshot=snapshot).awaitTermination()
    first = windows.zone_features(head).select("zone", "window_end_ms", *SUMS)
    got = spark.read.parquet(out).select("zone", "window_end_ms", *SUMS).unionByName(first)
    whole = frame(spark, events)
    assert rows(got, "zone", "window_end_ms", *SUMS) == rows(windows.zone_features(whole), "zone", "window_end_ms", *SUMS)
    kept = engine.state_buckets(spark, state)
    assert rows(kept, "zone", "start_ms", "count") == rows(windows.retained_buckets(whole), "zone", "start_ms", "count")


def test_metrics():
    entry = {"sources": [{"endOffset": '{"t":{"0":5,"1":7}}', "latestOffset": '{"t":{"0":9,"1":7,"2":3}}'}, {"endOffset": None, "latestOffset": {"logOffset": 3}}]}
    assert engine.lag(entry) == 4
    assert engine.instant([{"x": 1}, {"x": 2.5}], "x") == 2.5
    assert [engine.instant(e, "x") for e in ([], [{}], [{"x": float("nan")}], [{"x": float("inf")}], [{"x": "y"}])] == [0.0] * 5


def test_shadow_of_a_stream(spark):
    events = stream(13, n=250)
    log = shared_path(spark, "log")
    engine.write_log(frame(spark, events), log, 2)
    want = windows.zone_features(frame(spark, events)).select("zone", "window_end_ms", *SUMS)
    newest = windows.latest(want)
    check = engine.shadow(spark, read(spark, log), shared_path(spark, "state"), lambda: newest, shared_path(spark, "shadow"))
    found = check()
    assert found["bad"] == 0 and found["checked"] == newest.count() and not found["warming_up"] and found["events"] == 250
    wrong = newest.withColumn("trips_5m", F.col("trips_5m") + 1)
    check = engine.shadow(spark, read(spark, log), shared_path(spark, "state"), lambda: wrong, shared_path(spark, "shadow"))
    assert check()["bad"] == newest.count()


# serving


def latest(spark, n=10):
    return spark.createDataFrame([(1, 60_000, n, 20, 60, 4, 4000, 8000)], schemas.FEATURES)


def test_fresh_reads_bypass_the_cache(spark):
    tables = [latest(spark, 10), latest(spark, 11)]
    reads = []

    def current():
        reads.append(1)
        return tables[len(reads) > 1]

    s = serving.FeatureService(current, ttl_s=600)
    assert s.get(["1"])["rows"][0]["trips_5m"] == 10 and len(reads) == 1
    assert s.get(["1"])["rows"][0]["trips_5m"] == 10 and len(reads) == 1  # stale, within its bound
    got = s.get(["1"], fresh=True)
    assert got["rows"][0]["trips_5m"] == 11 and got["served_from"] == "leader" and got["staleness_bound_s"] == 0 and len(reads) == 2
    assert s.get(["1"])["rows"][0]["trips_5m"] == 10  # a fresh read leaves the cache alone
    s.invalidate([1])
    assert s.get(["1"])["rows"][0]["trips_5m"] == 11


def test_deadlines_and_failures(spark):
    def slow():
        time.sleep(1.0)
        return latest(spark)

    with pytest.raises(serving.DeadlineExceeded):
        serving.FeatureService(slow).get(["1"], deadline_s=0.1)
    with pytest.raises(serving.DeadlineExceeded):
        serving.FeatureService(slow, longest_s=0.1).get(["1"], fresh=True, deadline_s=100)

    def failing():
        raise OSError("no store")

    with pytest.raises(serving.Unavailable):
        serving.FeatureService(failing).get(["1"])
    status, text = serving.FeatureService(failing).get_json("1")
    assert status == 503 and json.loads(text) == {"error": "no store", "code": "Unavailable"}
    s = serving.FeatureService(lambda: latest(spark))
    status, text = s.get_json("1,2", "linearizable")
    assert status == 200 and [r["found"] for r in json.loads(text)["rows"]] == [True, False]
    assert s.get_json("")[0] == 503


def test_breaker_leaves_a_failing_cache_alone(spark):
    class Cache(serving.DictCache):
        calls = 0

        def get(self, zones):
            Cache.calls += 1
            raise OSError("cache down")

    s = serving.FeatureService(lambda: latest(spark), cache=Cache(), breaker_s=60)
    for _ in range(3):
        assert s.get(["1"])["served_from"] == "leader"
    assert Cache.calls == 1


def test_requests_are_typed(spark):
    s = serving.FeatureService(lambda: latest(spark))
    assert s.get(["+1", "01"])["rows"][0]["found"]
    for bad in (["²"], ["+-5"], ["1.0"], [""], ["0"], ["9" * 30]):
        with pytest.raises(serving.InvalidRequest):
            s.get(bad)
    with pytest.raises(serving.NotFound):
        s.get(["1"], view="other")


def test_table_store(spark):
    batches = "partition int, arrival long, to_offset long, closed_until_ms long"
    features = f"partition int, arrival long, {schemas.FEATURES}"
    b = spark.createDataFrame([(0, 0, 10, 7_200_000)], batches)
    k = spark.createDataFrame([(0, 0, 1, 7_140_000, 3, 5, 7), (0, 0, 2, 0, 1, 1, 1)], "partition int, arrival long, zone int, start_ms long, count long, fare_cents long, distance_milli long")
    f = spark.createDataFrame([(0, 0, 1, 60_000, 1, 1, 1, 1, 1, 1)], features)
    s = serving.TableStore(b, k, f)
    s = s.propose(spark.createDataFrame([(0, 1, 10, 7_200_000)], batches), k.withColumn("arrival", F.lit(1).cast("long")).withColumn("count", F.lit(99).cast("long")), f.withColumn("arrival", F.lit(1).cast("long")).withColumn("trips_5m", F.lit(99).cast("long")))
    head, kept = s.partition_state(0)
    assert tuple(head.first()) == (0, 10, 7_200_000) and [tuple(r)[1:4] for r in kept.collect()] == [(1, 7_140_000, 3)]
    assert s.zone_features([1]).first()["trips_5m"] == 1
    assert tuple(s.status().first()) == (0, 1, 1, 10)


# registers, reports, order


def test_purges_of_many_lengths(spark):
    """Prefixes of over 4,096 lengths all purge."""
    n = 4_300
    log = [(1, "c", 1, "put", "k" * n, "v")] + [(2 + i, None, 0, "purge", "k" * (n - i) if i else "x", None) for i in range(n)] + [(9_000, "c", 2, "put", "k" * 7, "w")]
    df = spark.createDataFrame(log[-50:] + log[:5], schemas.KV_LOG)
    assert sorted((r["key"], r["value"]) for r in kv.kv_fold(df).collect()) == [("k" * 7, "w")]
    lengths = spark.createDataFrame([(i, None, 0, "purge", "p" * (i + 1), None) for i in range(1, 5_000)] + [(6_000, "c", 2, "put", "q", "a"), (0, "c", 1, "put", "p" * 4_999, "b")], schemas.KV_LOG)
    assert [(r["key"], r["value"]) for r in kv.kv_fold(lengths).collect()] == [("q", "a")]


def test_order_in_two_levels(spark):
    r = random.Random(3)
    data = [("a" if r.random() < 0.8 else "b", k, r.randrange(50)) for k in range(400)]
    df = spark.createDataFrame(data, "g string, t long, v long")
    for width in (1, 7, 1000):
        got = {(x["g"], x["t"]): x["m"] for x in ordering.earlier(df, ["g"], "t", width, F.max, "v", "m").collect()}
        assert got == {(g, t): max((v2 for g2, t2, v2 in data if g2 == g and t2 < t), default=None) for g, t, _ in data}
        got = {(x["g"], x["t"]): x["nth"] for x in ordering.numbered(df, ["g"], "t", width, "nth").collect()}
        assert got == {(g, t): sum(g2 == g and t2 < t for g2, t2, _ in data) for g, t, _ in data}


def test_ranks_of_many_equal_values(spark):
    r = random.Random(4)
    data = [("a", 5.0) if r.random() < 0.4 else ("a", float(r.randrange(3000))) for _ in range(5_000)] + [("b", 1.0)] * 7 + [("c", None)]
    df = spark.createDataFrame(data, "g string, v double")
    ranks = {"low": F.lit(0), "mid": F.floor(F.col("n") / 2), "p999": F.floor(0.999 * (F.col("n") - 1)), "high": F.col("n") - 1}
    got = {x["g"]: tuple(x)[1:] for x in ordering.at_ranks(df, "v", ["g"], ranks, parts=16).collect()}
    for g in "ab":
        v = sorted(x for h, x in data if h == g)
        assert got[g] == (len(v), v[0], v[len(v) // 2], v[int(0.999 * (len(v) - 1))], v[-1])
    assert "c" not in got


def test_reports(spark):
    lines = spark.createDataFrame([("1500 FAULT leader  crash",), ("1600 INFO x y",), ("1700 FAULT",), ("",), (None,)], "line string")
    assert [tuple(r) for r in report.fault_lines(lines, 1000).collect()] == [("leader crash", 0.5)]
    runs = spark.createDataFrame([("a-1node", 5.0, "x", 2), ("b", 9.0, "w", 1), ("c", 5.0, "w", 1)], "file string, offered_rate_eps double, mode string, batch int").withColumn("rate_rps", F.col("offered_rate_eps"))
    assert [r["file"] for r in report.by_rate(runs).collect()] == ["a-1node", "c", "b"]
    assert [r["file"] for r in report.by_store(runs).collect()] == ["c", "b", "a-1node"]
    assert [r["file"] for r in report.by_mode(runs).collect()] == ["c", "b", "a-1node"]
    path = shared_path(spark, "report")
    text = report.markdown(report.by_rate(runs).select("file", "offered_rate_eps"), path, "Runs")
    assert text.split("\n")[:5] == ["# Runs", "", "| file | offered_rate_eps |", "|---|---|", "| a-1node | 5.00 |"]
    assert "\n".join(r[0] for r in spark.read.text(path).collect()) == text
    none = spark.createDataFrame([], "ops long, result string")
    assert tuple(report.check_totals(none).first()) == (0, False)
    assert tuple(report.check_totals(spark.createDataFrame([(3, "ok"), (4, "illegal")], "ops long, result string")).first()) == (3, True)


def test_small_readers(spark, tmp_path):
    (tmp_path / "zones.csv").write_text("LocationID,Borough,Zone,service_zone\n1,Q,Airport,x\n2,M,Park,y\n")
    zones = files.read_zones(spark, str(tmp_path / "zones.csv"))
    named = files.with_zone_names(spark.createDataFrame([(1,), (3,)], "zone int"), zones)
    assert rows(named, "zone", "zone_name", "borough") == [(1, "Airport", "Q"), (3, "", "")]
    (tmp_path / "r.json").write_text('{"a": 1}\n{"b": 2.5}\n')
    assert rows(files.read_results(spark, str(tmp_path / "r.json"), "a long, b double"), "a", "b") == [(0, 2.5), (1, 0.0)]
    heads = spark.createDataFrame([(0, 41), (1, 7)], "partition int, to_offset long")
    assert json.loads(files.starting_offsets("t", heads)) == {"t": {"0": 42, "1": 8}}
    assert replay.first_events(frame(spark, stream(1, n=50)), 5).count() == 5
    assert rows(replay.partitions(frame(spark, stream(1, n=20) + stream(1, n=20, partition=3))), "partition") == [(0,), (3,)]


def test_moments(spark):
    got = spark.createDataFrame([("2024-02",), ("2024-02-03T04:05:06Z",), ("2024-02-03T04:05:06.5+01:00",), ("2024-13",), ("x",), (None,)], "t string").select(columns.parse_moment("t")).collect()
    assert [r[0] for r in got] == [1706745600000, 1706933106000, 1706929506500, None, None, None]


def test_kafka_plans_need_the_connector(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        files.read_kafka(spark, "localhost:1", "trips")


def test_latest_from_last_buckets(spark):
    events = stream(14, n=500) + [(T0 + 50_000_000, 99, 1, 1, 0, 0, 500)]
    trips = frame(spark, events)
    want = windows.latest(windows.zone_features(trips).select("zone", "window_end_ms", *SUMS))
    assert rows(windows.latest_rows(trips), "zone", "window_end_ms", *SUMS) == rows(want, "zone", "window_end_ms", *SUMS)
