"""Cleaning, codec, sources, history, serving, registers, linearizability, model."""

import pytest
from pyspark.sql import functions as F

from tidemill import schemas
from tidemill.config import CHUNK_EVENTS, SUMS, VIEW
from tidemill.functions import columns
from tidemill.operators import cleaning, history, kv, linearizability, measure, model, replay, serving, verify, windows
from tidemill.plans import offline
from tidemill.sources import codec, files, fixtures, synthetic
from tidemill.sources.storage import shared_path

SF = "/root/testdata/sf0.001"


def test_first_rule_wins_and_bounds_are_inclusive(spark):
    rows = [("2023-12-31 23:59:59.999", 264, -1.0, 101.0), ("2024-01-01 00:00:00", 264, -1.0, 0.0), ("2024-01-31 23:59:59", 263, -0.01, 0.0), ("2024-02-01 00:00:00", 1, 1.0, 1.0),
            ("2024-01-02 00:00:00", 1, 500.0, 100.0), ("2024-01-02 00:00:00", 1, 500.0, 100.01), ("2024-01-02 00:00:00", 1, float("nan"), 1.0), ("2024-01-02 00:00:00", None, 1.0, 1.0), ("2024-01-02 00:00:00", 3, None, None)]
    raw = spark.createDataFrame(rows, "t string, PULocationID int, fare_amount double, trip_distance double").withColumn("tpep_pickup_datetime", F.to_timestamp_ntz("t"))
    s = cleaning.clean_stats(raw, "2024-01").first()
    assert (s["rows_read"], s["bad_time"], s["bad_zone"], s["bad_fare"], s["bad_distance"], s["kept"]) == (9, 2, 2, 1, 1, 3)


def test_scaled_truncates(spark):
    got = spark.createDataFrame([(0.015,), (-0.019,), (2.675,)], "x double").select(columns.scaled("x", 100)).collect()
    assert [r[0] for r in got] == [int(0.015 * 100 + 0.5), int(-0.019 * 100 + 0.5), int(2.675 * 100 + 0.5)]


def test_floor_of_negatives(spark):
    got = spark.createDataFrame([(-1,), (0,), (-60_000,), (61_000,)], "t long").select(columns.floor_to("t")).collect()
    assert [r[0] for r in got] == [-60_000, 0, -60_000, 60_000]


def test_small_functions(spark):
    r = spark.createDataFrame([("1=a:1,2=b:2", "3, 4,x", 1.005, -2.345, 1234567.0)], "a string, z string, x double, y double, n double")
    got = r.select(columns.address_map("a"), columns.id_list("z"), columns.round2("x"), columns.round2("y"), columns.thousands("n")).first()
    assert (got[0], got[1], got[2], got[3], got[4]) == ({"1": "a:1", "2": "b:2"}, [3, 4, None], 1.0, -2.35, "1,234,567")


def test_codec_rejects(spark):
    rows = spark.createDataFrame([(b"\x01" + b"\0" * 36,), (b"\x02" + b"\0" * 36,), (b"\x01" * 36,), (None,)], "value binary")
    assert [r[0] is not None for r in rows.select(codec.decode("value")).collect()] == [True, False, False, False]


def test_synthetic_batch_equals_stream(spark):
    synthetic.register(spark)
    options = {"events": 3000, "seed": 5, "partitions": 3, "batch": 400}
    batch = spark.read.format("tidemill_synthetic").options(**options).load()
    out, state = shared_path(spark, "synthetic"), shared_path(spark, "state")
    s = spark.readStream.format("tidemill_synthetic").options(**options).load()
    q = s.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).start()
    q.processAllAvailable()
    for _ in range(6):
        q.processAllAvailable()
    q.stop()
    got = spark.read.schema(synthetic.SCHEMA).parquet(out)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    assert batch.count() == 3000 and batch.agg(F.max("zone")).first()[0] <= 263


def test_compact_files_round_trip(spark, tmp_path):
    trips = fixtures.trips(spark, SF).select((F.floor(F.col("event_time_ms") / 1000) * 1000).alias("event_time_ms"), "zone", "fare_cents", "distance_milli")
    for r in files.compact(trips, 0, 1 << 50).collect():
        (tmp_path / f"{r['day']}.bin.gz").write_bytes(r["content"])
    back = files.read_compact(spark, str(tmp_path)).drop("file", "seq")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, trips.collect()))


def test_compact_files_of_a_large_day_are_cut(spark, monkeypatch):
    monkeypatch.setattr(files, "FILE_TRIPS", 100)
    trips = fixtures.trips(spark, SF).select((F.floor(F.col("event_time_ms") / 1000) * 1000).alias("event_time_ms"), "zone", "fare_cents", "distance_milli")
    path = shared_path(spark, "compact")
    files.write_compact(trips, 0, 1 << 50, path)
    back = files.read_compact(spark, path)
    sizes = [r["count"] for r in back.groupBy("file").count().collect()]
    assert max(sizes) == 100 and len(sizes) >= trips.count() // 100
    assert sorted(map(tuple, back.drop("file", "seq").collect())) == sorted(map(tuple, trips.collect()))


def test_operation_history_files(spark):
    ops = fixtures.ops(spark, SF)
    path = shared_path(spark, "ops")
    files.write_ops(ops, path)
    assert sorted(map(str, files.read_ops(spark, path).collect())) == sorted(map(str, ops.collect()))


def test_upsert_keeps_first_and_counts(spark):
    row = lambda z, x: (VIEW, z, 60_000, x, 0, 0, 0, 0, 0, 0, 1)
    schema = f"feature_view string, {schemas.FEATURES}, source_partition int, source_offset long"
    stored = spark.createDataFrame([row(1, 5), row(2, 5)], schema).withColumn("conflicting_rewrites", F.lit(0))
    got = history.upsert(stored, spark.createDataFrame([row(1, 5), row(2, 6), row(3, 7)], schema))
    assert sorted((r["zone"], r["trips_5m"], r["conflicting_rewrites"]) for r in got.collect()) == [(1, 5, 0), (2, 5, 1), (3, 7, 0)]
    again = history.upsert(got, spark.createDataFrame([row(3, 7)], schema))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))
    assert history.delete_view(got, VIEW).count() == 0


def test_point_in_time_is_inclusive_and_leak_free(spark):
    facts = spark.createDataFrame([(VIEW, 1, t, t, 0, 0, 0, 0, 0) for t in (100, 200)], f"feature_view string, {schemas.FEATURES}")
    asked = spark.createDataFrame([(1, 99, 0.0), (1, 100, 0.0), (1, 199, 1.0), (1, 500, None), (2, 500, 1.0)], schemas.LABELS)
    got = history.point_in_time(asked, facts, VIEW)
    assert sorted((r["zone"], r["label_time_ms"], r["window_end_ms"]) for r in got.collect() if r["window_end_ms"]) == [(1, 100, 100), (1, 199, 100), (1, 500, 200)]
    assert got.count() == 5 and history.pit_leaks(got).first()["leaks"] == 0


def test_corrupt_row_breaks_parity(spark):
    rows = fixtures.history(spark, SF)
    good = rows.unionByName(rows.withColumn("feature_view", F.lit("b")))
    bad = rows.unionByName(rows.withColumn("feature_view", F.lit("b")).withColumn("count_15m", F.col("count_15m") + F.when((F.col("zone") == 3) & (F.col("window_end_ms") % 600_000 == 0), 1).otherwise(0)))
    cut = F.lit(1 << 60)
    assert history.parity(good, VIEW, "b", cut).first()["mismatched"] == 0
    assert history.parity(bad, VIEW, "b", cut).first()["mismatched"] > 0
    assert verify.oracle_diff(rows, rows).isEmpty()


def test_service(spark):
    latest = spark.createDataFrame([(1, 60_000, 10, 20, 60, 4, 4000, 8000)], schemas.FEATURES)
    s = serving.FeatureService(lambda: latest)
    first = s.get(["1", "2", "1"])
    assert [r["found"] for r in first["rows"]] == [True, False, True] and first["served_from"] == "leader" and first["staleness_bound_s"] == 0
    assert first["rows"][0]["demand_spike_ratio"] == 2.0 and first["rows"][0]["as_of_ms"] == 60_000
    assert s.get(["1"])["served_from"] == "cache" and s.get(["1", "2"])["served_from"] == "both" and s.get(["1"], fresh=True)["served_from"] == "leader"
    s.invalidate([1])
    assert s.get(["1"])["served_from"] == "leader"
    for bad in ([], ["x"], ["0"], ["264"], ["1"] * 301):
        with pytest.raises(serving.InvalidRequest):
            s.get(bad)
    with pytest.raises(serving.InvalidRequest):
        s.get(["1"], view="other")
    assert serving.zone_features(latest, []).count() == 1 and serving.zone_features(latest, [9]).count() == 0


def test_register_fold(spark):
    log = [(1, "c1", 1, "put", "a1", "x"), (2, "c1", 1, "put", "a1", "y"), (3, "c1", 2, "put", "a2", "z"), (4, None, 0, "purge", "a1", None), (5, "", 1, "put", "b", "u"), (6, "", 1, "put", "b", "v"), (7, None, 0, "purge", "c", None), (8, "c1", 1, "put", "a3", "w"), (9, None, 0, "purge", "", None)]
    df = spark.createDataFrame(log, schemas.KV_LOG)
    assert [r["applied"] for r in kv.client_dedup(df).orderBy("index").collect()] == [True, False, True, True, True, True]
    assert sorted((r["key"], r["value"]) for r in kv.kv_fold(df).collect()) == [("a2", "z"), ("a3", "w"), ("b", "v")]


def test_linearizability():
    never = linearizability.NEVER
    good = [(0, 10, True, "a"), (5, 15, False, "a"), (20, 30, True, "b"), (25, 40, False, "a"), (50, 60, False, "b")]
    stale = [(0, 10, True, "a"), (20, 30, True, "b"), (40, 50, False, "a")]
    unknown = [(0, never, True, "a"), (10, 20, False, None), (30, 40, False, "a"), (50, 60, False, "a")]
    back = [(0, never, True, "a"), (10, 20, False, "a"), (30, 40, False, None)]
    assert [linearizability.linearizable(x) for x in (good, stale, unknown, back, [])] == [True, False, True, False, True]


def test_stale_key_is_found(spark):
    got = {r["key"]: r["linearizable"] for r in linearizability.check(linearizability.example_history(spark, SF)).collect()}
    assert not got["k3"] and all(v for k, v in got.items() if k != "k3")


def test_ranks(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in (5, 1, 3, 2)] + [("b", 7.0), ("c", None)], "k string, v double")
    assert sorted(map(tuple, measure.nearest_rank(rows, "v", ["k"], {"q": 0.5}).collect())) == [("a", 4, 2.0), ("b", 1, 7.0)]
    assert sorted(map(tuple, measure.upper_median(rows, "v", ["k"]).collect())) == [("a", 4, 3.0, 1.0, 5.0), ("b", 1, 7.0, 7.0, 7.0)]


def test_slope_guards(spark):
    rows = spark.createDataFrame([("one", 1.0, 5.0), ("same", 2.0, 4.0), ("same", 2.0, 6.0), ("line", 0.0, 1.0), ("line", 2.0, 5.0)], "k string, x double, y double")
    assert sorted(map(tuple, measure.lag_slope(rows, "x", "y", ["k"]).collect())) == [("line", 2.0, 1.0), ("one", 0.0, 0.0), ("same", 0.0, 5.0)]


def test_offsets(spark):
    a = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (0, 1, 2), (0, 0, 3), (0, 2, 4), (1, 0, 0)], "partition int, offset long, arrival long")
    assert sorted(tuple(r) for r in replay.offset_dedup(a).collect()) == [(0, 0, 0), (0, 1, 1), (0, 2, 4), (1, 0, 0)]


def test_training_plan(spark):
    rows = fixtures.history(spark, "/root/testdata/sf0.01")
    examples = offline.training_examples(rows)
    assert examples.where("window_end_ms > label_time_ms").count() == 0
    fitted, metrics, baseline = offline.train(rows)
    m = metrics.first()
    assert 0 < m["auc"] < 1 and m["examples"] > 0 and baseline.first()["examples"] == m["examples"]
    from tidemill.operators.windows import latest

    assert offline.score_online(fitted, latest(rows.select("zone", "window_end_ms", *SUMS)), 5).count() == 5


def test_verification_job_and_snapshot(spark):
    from tidemill.operators import windows

    t = fixtures.trips(spark, SF)
    stats = windows.partition_stats(t)
    r = offline.verification(t, fixtures.history(spark, SF), offline.backfill(t, stats)).first()
    assert r["matched"] > 0 and r["mismatched"] == r["missing_left"] == r["missing_right"] == 0
    doc = offline.snapshot(windows.latest(fixtures.features(spark, SF).select("zone", "window_end_ms", *SUMS)), stats).first()[0]
    assert '"partitions"' in doc and '"zones"' in doc


def test_fingerprints_of_sets_travel_once(spark):
    import hashlib

    rows = spark.range(400).selectExpr("id a", "id % 7 b").unionByName(spark.createDataFrame([(5, None), (5, None)], "a long, b long"))
    sets = [F.lit(True), F.col("b") != 3, F.lit(False)]
    got = verify.fingerprints(rows, ["a", "b"], sets)
    want = {}
    for k, keep in enumerate((lambda b: True, lambda b: b is not None and b != 3)):
        level = sorted((h, h) for a, b in rows.collect() if keep(b) for h in [hashlib.sha256(f"{a}|{'' if b is None else b}".encode()).hexdigest()])
        n = len(level)
        for digits in (6, 4, 2, 0):
            names = sorted({name[:digits] for name, _ in level})
            level = [(m, hashlib.sha256("\n".join(h for name, h in level if name[:digits] == m).encode()).hexdigest()) for m in names]
        want[k] = (level[0][1], n)
    assert {r["node"]: (r["sha256"], r["row_count"]) for r in got.collect()} == want
    assert tuple(verify.fingerprint(rows, ["a", "b"]).first()) == want[0] and verify.fingerprint(rows.where("false"), ["a", "b"]).isEmpty()


def test_sample_and_model_helpers(spark):
    f = fixtures.features(spark, SF)
    assert verify.sample_rows(f, 4).count() == 20
    assert model.busiest(f).count() == 1
    nodes = spark.createDataFrame([("x", 1), ("x", 1)], "fingerprint string, applied long")
    assert verify.converged(nodes).first()["converged"]


def test_roc_auc_looks_up_the_part_of_each_distinct_score_only(spark):
    scores = [(None, 1), (None, 0), *((float(k * 7919 % 401) / 3, k % 3 == 0 and k % 401 > 90) for k in range(1200))]
    df = spark.createDataFrame([(s, int(y)) for s, y in scores], "score double, label int")
    r = model.roc_auc(df, "score", "label")
    plan = r._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "scalar-subquery" in line]
    value = [-1.0 if s is None else s for s, _ in scores]  # nulls come first
    good, bad = ([v for v, (_, y) in zip(value, scores, strict=True) if bool(y) is kind] for kind in (True, False))
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    steps = sum(good.count(v) * sum(g >= v for g in good) / sum(x >= v for x in value) for v in set(good)) / len(good)
    for parts in (2, 3, 64, 256):
        got = model.roc_auc(df, "score", "label", parts).first()
        assert abs(got["auc"] - auc) < 1e-9 and abs(got["average_precision"] - steps) < 1e-9 and got["examples"] == len(scores)


def test_chunks_are_small(spark):
    """A log partition of 2^19 events is ordered in four tasks' shares or more: the most that is ordered at once is a chunk."""
    trips = spark.range(1 << 19).select(F.lit(0).alias("partition"), F.col("id").alias("offset"), F.lit(1).alias("zone"), F.col("id").alias("event_time_ms"))
    ordered = windows.prefix_max(trips)
    assert ordered.where("before_ms is distinct from if(offset = 0, null, offset - 1)").count() == 0
    assert CHUNK_EVENTS <= 1 << 17
