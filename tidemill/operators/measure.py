"""Measurement analytics: exact ranks, gaps, trends, rates and histogram quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordering import at_ranks, earlier, previous

#: Seconds of a series that a single task orders at once.
SLOT_S = 86_400


def nearest_rank(rows: DataFrame, value: str, by: list[str], quantiles: dict[str, float]) -> DataFrame:
    """The value at position floor(q (n - 1)): no interpolation."""
    return at_ranks(rows, value, by, {k: F.floor(F.lit(q) * (F.col("n") - 1)) for k, q in quantiles.items()})


def upper_median(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The value at position n div 2, the least and the largest."""
    return at_ranks(rows, value, by, {"median": F.floor(F.col("n") / 2), "low": F.lit(0), "high": F.col("n") - 1})


def probe_counts(ops: DataFrame) -> DataFrame:
    """Operations by outcome, and rates over the last return."""
    put, get, known = F.col("kind") == "put", F.col("kind") != "put", ~F.col("unknown")
    last = F.max("ret_ns") / 1e9
    rate = lambda c: F.when(F.max("ret_ns") > 0, F.count_if(c) / last).otherwise(0.0)
    return ops.agg(
        F.count("*").alias("ops"), F.count_if(put & known).alias("puts_ok"), F.count_if(put & ~known).alias("puts_unknown"), F.count_if(get).alias("gets_ok"),
        rate(put & known).alias("puts_per_sec"), rate(get).alias("gets_per_sec"),
    )


def write_gaps(ops: DataFrame, slot_ns: int = 60_000_000_000) -> DataFrame:
    """Gaps between successive successful writes, in the order of their returns: start and length. Writes that return at once have gaps of 0."""
    rows = ops.where("kind = 'put' and not unknown").select("ret_ns", F.lit(0).alias("run"))
    rows = earlier(rows, ["run"], "ret_ns", slot_ns, F.max, "ret_ns", "before")
    return rows.where("before is not null").select((F.col("before") / 1e9).alias("at_s"), ((F.col("ret_ns") - F.col("before")) / 1e6).alias("gap_ms"))


def gap_summary(ops: DataFrame) -> DataFrame:
    """The longest write gap, where it began, and how many exceed a second."""
    return write_gaps(ops).agg(
        F.coalesce(F.max("gap_ms"), F.lit(0.0)).alias("max_gap_ms"), F.coalesce(F.max_by("at_s", F.struct("gap_ms", -F.col("at_s"))), F.lit(0.0)).alias("max_gap_at_s"), F.count_if(F.col("gap_ms") > 1000).alias("gaps_over_1s")
    )


def unavailability(faults: DataFrame, gaps: DataFrame, within_s: float = 20.0) -> DataFrame:
    """Of each fault the longest write gap that overlaps the time up to ``within_s`` after it. The overlap join is bucketed: gaps and
    faults meet in the ``within_s`` wide slots that they touch."""
    slot = lambda x: F.floor(x / within_s).cast("long")
    f = faults.withColumn("slot", F.explode(F.sequence(slot(F.col("at_s")), slot(F.col("at_s") + within_s))))
    g = gaps.select("at_s", "gap_ms").withColumnRenamed("at_s", "begin_s").withColumn("end_s", F.col("begin_s") + F.col("gap_ms") / 1000)
    g = g.withColumn("slot", F.explode(F.sequence(slot(F.col("begin_s")), slot(F.col("end_s")))))
    met = f.join(g, "slot").where((F.col("begin_s") <= F.col("at_s") + within_s) & (F.col("end_s") >= F.col("at_s")))
    best = met.groupBy("fault_id").agg(F.max("gap_ms").alias("gap_ms"))
    return faults.join(best, "fault_id", "left").select("fault_id", "at_s", F.coalesce("gap_ms", F.lit(0.0)).alias("unavailable_ms"))


def lag_slope(samples: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Least squares line: fewer than two points give (0, 0), equal x give (0, mean)."""
    rows = samples.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("s"), F.regr_intercept(y, x).alias("i"), F.avg(y).alias("m"))
    few = F.col("n") < 2
    return rows.select(*by, F.when(few, 0.0).otherwise(F.coalesce("s", F.lit(0.0))).alias("slope"), F.when(few, 0.0).otherwise(F.coalesce("i", "m")).alias("intercept"))


def sustained(rate: Column, slope: Column) -> Column:
    """Whether a backlog grows by one hundredth of the rate at most."""
    return (rate > 0) & (slope <= 0.01 * rate)


def counter_rate(samples: DataFrame, by: list[str], time_s: str, value: str, slot_s: int = SLOT_S) -> DataFrame:
    """Increase and rate of each counter; a smaller value than before is a reset, which counts from zero. A counter's samples are cut into slots of time."""
    named = samples.select(*by, F.col(time_s).alias("_t"), F.col(value).alias("_v"))
    rows = previous(named, by, "_t", slot_s, ["_v", "_t"], "_p").where("_p is not null and _p._v is not null")
    grown = F.when(F.col("_v") >= F.col("_p._v"), F.col("_v") - F.col("_p._v")).otherwise(F.col("_v"))
    return rows.groupBy(*by).agg(F.sum(grown).alias("increase"), (F.sum(grown) / (F.max("_t") - F.min("_p._t"))).alias("rate"))


def rate_by(samples: DataFrame, by: list[str], label: str, time_s: str, value: str) -> DataFrame:
    """Increases and rates of counters, summed by a label."""
    return counter_rate(samples, by, time_s, value).groupBy(label).agg(F.sum("increase").alias("increase"), F.sum("rate").alias("rate"))


def hit_ratio(samples: DataFrame, by: list[str], time_s: str, value: str, hit: Column) -> DataFrame:
    """The increase of the counters that ``hit`` names, against all; 0 where nothing grew."""
    rows = counter_rate(samples, by, time_s, value)
    both = rows.agg(F.sum(F.when(hit, F.col("increase"))).alias("h"), F.sum("increase").alias("n"))
    return both.select(F.when(F.coalesce("n", F.lit(0)) == 0, 0.0).otherwise(F.coalesce("h", F.lit(0)) / F.when(F.col("n") != 0, F.col("n"))).alias("ratio"))


def gauge_max(samples: DataFrame, value: str) -> DataFrame:
    """The largest value of a gauge; 0 without samples."""
    return samples.agg(F.coalesce(F.max(value).cast("double"), F.lit(0.0)).alias("largest"))


def role_changes(samples: DataFrame, by: str, time: str, role: str, slot: int = SLOT_S * 1000) -> DataFrame:
    """Rows whose role differs from the one before. A node's samples are cut into slots of time (in the unit of ``time``)."""
    rows = previous(samples.select(by, time, F.col(role).alias("now")), [by], time, slot, ["now"], "_p")
    return rows.select(by, time, F.col("_p.now").alias("was"), "now").where("was is not null and was <> now")


def failover(samples: DataFrame, fault_ms: int, old: str) -> DataFrame:
    """Milliseconds from a fault to the first other leader."""
    return samples.where((F.col("t_ms") > fault_ms) & (F.col("leader") != old)).agg((F.min("t_ms") - fault_ms).alias("failover_ms"))


def histogram_quantile(buckets: DataFrame, by: list[str], q: float) -> DataFrame:
    """Quantile by linear interpolation inside cumulative buckets (le, n); in the last, unbounded one its lower end."""
    along = W.partitionBy(*by).orderBy(F.col("le").asc_nulls_last())
    rows = buckets.withColumn("under", F.coalesce(F.lag("le").over(along), F.lit(0.0))).withColumn("below", F.coalesce(F.lag("n").over(along), F.lit(0)))
    rows = rows.withColumn("total", F.max("n").over(W.partitionBy(*by))).where((F.col("n") >= F.col("total") * q) & (F.col("total") > 0))
    first = rows.groupBy(*by).agg(F.min_by(F.struct("le", "n", "under", "below", "total"), F.coalesce("le", F.lit(float("inf")))).alias("b"))
    inside = F.col("b.under") + (F.col("b.le") - F.col("b.under")) * (F.col("b.total") * q - F.col("b.below")) / (F.col("b.n") - F.col("b.below"))
    return first.select(*by, F.when(F.col("b.le").isNull(), F.col("b.under")).otherwise(inside).alias("value"))


def latency_summary(rows: DataFrame, by: list[str], ms: str) -> DataFrame:
    """Count, exact quantiles, largest and mean."""
    q = nearest_rank(rows, ms, by, {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999})
    return q.join(rows.groupBy(*by).agg(F.max(ms).alias("max_ms"), F.avg(ms).alias("mean_ms")), by).withColumnRenamed("n", "requests")


def counts_by(rows: DataFrame, column: Column, name: str) -> DataFrame:
    return rows.groupBy(column.alias(name)).agg(F.count("*").alias("n"))
