"""Mergeable latency histograms and rates over sliding windows, against plain loops."""

import itertools
import math
import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.operators import measure, ordering, series


def bucket(us):
    width = 1 << max(0, us.bit_length() - 11)
    return us - us % width, width


def test_histogram_equals_a_plain_one(spark):
    r = random.Random(1)
    us = [0, 1, 2047, 2048, 2049, 4095, 4096, 59_999_999, 60_000_000, 60_000_001, -1] + [int(10 ** r.uniform(0, 7.7)) for _ in range(3000)]
    rows = spark.createDataFrame([(k % 3, x) for k, x in enumerate(us)], "g int, us long")
    got = {x["g"]: x for x in series.histogram_summary(series.latency_histogram(rows, ["g"], "us"), ["g"], {"p0": 0.0, "p50": 0.5, "p999": 0.999, "p100": 1.0}).collect()}
    for g in range(3):
        mine = sorted(x for k, x in enumerate(us) if k % 3 == g and 0 <= x <= 60_000_000)
        tops = [sum(bucket(x)) - 1 for x in mine]
        at = lambda q: tops[max(0, math.floor(q * len(mine) + 0.5) - 1)] / 1000  # noqa: B023, E731
        assert (got[g]["requests"], got[g]["p0"], got[g]["p50"], got[g]["p999"], got[g]["p100"], got[g]["max_ms"]) == (len(mine), at(0), at(0.5), at(0.999), at(1), tops[-1] / 1000)
        assert math.isclose(got[g]["mean_ms"], sum(bucket(x)[0] + bucket(x)[1] // 2 for x in mine) / len(mine) / 1000)
        assert all(abs(t - x) <= max(1, x / 1000) for t, x in zip(tops, mine, strict=True))


def test_histograms_merge(spark):
    rows = spark.range(5000).select(F.lit("a").alias("g"), (F.col("id") * 37 % 9001).alias("us"), "id")
    parts = [series.latency_histogram(rows.where(F.col("id") % 3 == k), ["g"], "us") for k in range(3)]
    both = series.merge_histograms(series.merge_histograms(parts[0], parts[1], ["g"]), parts[2], ["g"])
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, series.latency_histogram(rows, ["g"], "us").collect()))
    assert series.histogram_summary(series.latency_histogram(rows.limit(0), ["g"], "us"), ["g"], {"p50": 0.5}).count() == 0


def plain_rate(samples, at, window):
    inside = [(t, v) for t, v in samples if at - window < t <= at]
    if len(inside) < 2:
        return None
    (t0, v0), (t1, v1) = inside[0], inside[-1]
    grown = v1 - v0 + sum(a for (_, a), (_, b) in zip(inside, inside[1:], strict=False) if b < a)
    span = (t1 - t0) / 1000
    each = span / (len(inside) - 1)
    near = lambda gap: each / 2 if gap >= each * 1.1 else gap
    start = near((t0 - (at - window)) / 1000)
    if grown > 0 and v0 >= 0:
        start = min(start, span * (v0 / grown))
    return grown * ((span + start + near((at - t1) / 1000)) / span / (window / 1000))


def test_rates_equal_a_plain_version(spark):
    r = random.Random(2)
    series_of = {}
    for name in ("a", "b", None):
        t, v, out = 0, 0.0, []
        for _ in range(150):
            t += r.choice([1000, 5000, 5000, 15_000, 90_000])
            v = r.choice([0.0, 2.0]) if r.random() < 0.1 else v + r.randrange(9)  # resets
            out.append((t, v))
        series_of[name] = out
    df = spark.createDataFrame([(n, t, v) for n, s in series_of.items() for t, v in s], "name string, t long, v double").repartition(3)
    for window, step in ((60_000, 30_000), (20_000, 45_000), (200_000, 7000)):
        got = {(x["name"], x["at_ms"]): x["rate"] for x in series.range_rate(df, ["name"], "t", "v", window, step).collect()}
        want = {(n, at): plain_rate(s, at, window) for n, s in series_of.items() for at in range(0, s[-1][0] + window + step, step)}
        want = {k: v for k, v in want.items() if v is not None}
        assert set(got) == set(want) and all(math.isclose(got[k], want[k], rel_tol=1e-12, abs_tol=1e-12) for k in want)


def test_a_reset_inside_the_window(spark):
    """0, 60, 120 and after a reset 30: 150 in three quarters of the minute, and what lies before the first sample and after the last."""
    df = spark.createDataFrame([("x", 15_000, 0.0), ("x", 30_000, 60.0), ("x", 45_000, 120.0), ("x", 60_000, 30.0)], "n string, t long, v double")
    assert [(x["at_ms"], x["rate"]) for x in series.range_rate(df, ["n"], "t", "v", 60_000, 60_000).collect()] == [(60_000, 150 * (45 + 0 + 0) / 45 / 60)]


def test_quantile_over_time(spark):
    rows = [(le, t, float(t // 1000 * n)) for le, n in ((1.0, 1), (2.0, 3), (None, 4)) for t in range(0, 300_000, 10_000)]
    got = series.rate_quantile(spark.createDataFrame(rows, "le double, t long, v double"), ["le"], [], "t", "v", 0.5, 60_000, 60_000).where("at_ms = 120000")
    assert math.isclose(got.first()["value"], 1.5)


def test_the_row_before_in_two_levels(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * F.col("id") % 10_007).alias("t"), "id")
    want = df.withColumn("b", F.lag(F.struct("t", "id")).over(W.partitionBy("g").orderBy("t")))
    for width in (1, 100, 10**6):
        got = ordering.previous(df, ["g"], "t", width, ["t", "id"], "b")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_counters_and_roles_over_slots(spark):
    """A slot's width has no effect: resets, first samples and changes at a slot's edge are found."""
    r = random.Random(4)
    samples = [(c, t, r.randrange(100)) for c in ("a", "b") for t in sorted(r.sample(range(5_000), 60))] + [("one", 5, 3)]
    frame = spark.createDataFrame(samples, "name string, t_s long, total long")
    want = {}
    for c in ("a", "b"):
        mine = [(t, v) for n, t, v in samples if n == c]
        grown = sum(w - v if w >= v else w for (_, v), (_, w) in itertools.pairwise(mine))
        want[c] = (grown, grown / (mine[-1][0] - mine[0][0]))
    roles = [(c, t, "leader" if v > 50 else "follower") for c, t, v in samples]
    changed = sorted((c, t, a, b) for c in ("a", "b") for (_, a), (t, b) in itertools.pairwise([(t, x) for n, t, x in roles if n == c]) if a != b)
    for slot in (1, 100, 1 << 40):
        got = {x["name"]: (x["increase"], x["rate"]) for x in measure.counter_rate(frame, ["name"], "t_s", "total", slot).collect()}
        assert got == want
        found = measure.role_changes(spark.createDataFrame(roles, "name string, t long, role string"), "name", "t", "role", slot)
        assert sorted(map(tuple, found.select("name", "t", "was", "now").collect())) == changed
