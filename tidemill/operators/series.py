"""Time series as monitoring reads them: mergeable latency histograms, and rates of counters over sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import LATENCY_BITS, LATENCY_MOST_US
from .measure import histogram_quantile
from .ordering import previous


def latency_bucket(us: Column) -> tuple[Column, Column]:
    """The lowest latency and the width of a latency's bucket: the width doubles with each power of two from 2^LATENCY_BITS on, so the relative error stays below a thousandth."""
    doublings = sum((us >= F.lit(1 << k)).cast("int") for k in range(LATENCY_BITS, LATENCY_MOST_US.bit_length()))
    width = F.call_function("shiftleft", F.lit(1).cast("long"), doublings)
    return us - us % width, width


def latency_histogram(rows: DataFrame, by: list[str], us: str) -> DataFrame:
    """low, width and n of the buckets of each group: one map-side aggregation to at most some thousand rows a group. Latencies beyond the largest are left out, as are negative ones."""
    low, width = latency_bucket(F.col(us))
    return rows.where(F.col(us).between(0, LATENCY_MOST_US)).groupBy(*by, low.alias("low"), width.alias("width")).agg(F.count("*").alias("n"))


def merge_histograms(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """The histogram of both sides' latencies."""
    return a.unionByName(b).groupBy(*by, "low", "width").agg(F.sum("n").alias("n"))


def histogram_summary(histogram: DataFrame, by: list[str], quantiles: dict[str, float]) -> DataFrame:
    """Number, quantiles, largest and mean in milliseconds. A quantile is the highest latency of the first bucket up to which round(q n) of them lie; the mean takes buckets at their middle."""
    along = W.partitionBy(*by).orderBy("low")
    rows = histogram.withColumns({"upto": F.sum("n").over(along), "total": F.sum("n").over(W.partitionBy(*by)), "top": F.col("low") + F.col("width") - 1})
    at = lambda q: F.min(F.when(F.col("upto") >= F.floor(F.lit(q) * F.col("total") + 0.5), F.col("top"))) / 1000
    middle = F.col("low") + F.shiftright("width", 1)
    return rows.groupBy(*by).agg(
        F.sum("n").alias("requests"), *[at(q).alias(name) for name, q in quantiles.items()], (F.max("top") / 1000).alias("max_ms"), (F.sum(F.col("n") * middle) / F.sum("n") / 1000).alias("mean_ms")
    )


def range_rate(samples: DataFrame, by: list[str], time_ms: str, value: str, window_ms: int, step_ms: int) -> DataFrame:
    """The rate a second of each counter at every multiple of ``step_ms``, over its samples of the last ``window_ms`` (two at least; a sample exactly that old is out).

    A value below the one before it in the window is a reset, which counts from zero. The increase is extrapolated to the window's ends where the first or last sample lies within 1.1 average
    distances of them (else by half a distance), but not back to where the counter would have been below zero. Each sample is dealt to the steps whose window holds it,
    and summed there map-side; the sample before is found in slots of the window's width, so no series is one task's."""
    rows = previous(samples.select(*by, F.col(time_ms).alias("_t"), F.col(value).cast("double").alias("_v")), by, "_t", window_ms, ["_t", "_v"], "_before")
    step = F.lit(step_ms)
    first = F.ceil(F.col("_t") / step) * step
    last = F.ceil((F.col("_t") + window_ms) / step) * step - step  # the largest step below t + window
    dealt = rows.where(first <= last).withColumn("at_ms", F.explode(F.sequence(first, last, step.cast("long"))))
    fell = (F.col("_before._t") > F.col("at_ms") - window_ms) & (F.col("_v") < F.col("_before._v"))
    point = F.struct("_t", "_v")
    sums = dealt.groupBy(*by, "at_ms").agg(F.count("*").alias("_n"), F.min_by(point, "_t").alias("_a"), F.max_by(point, "_t").alias("_b"), F.sum(F.when(fell, F.col("_before._v")).otherwise(0.0)).alias("_resets"))
    sums = sums.where("_n > 1 and _b._t > _a._t")
    s = lambda ms: ms / F.lit(1000.0)
    sums = sums.withColumns({"_grown": F.col("_b._v") - F.col("_a._v") + F.col("_resets"), "_span": s(F.col("_b._t") - F.col("_a._t"))})
    sums = sums.withColumn("_each", F.col("_span") / (F.col("_n") - 1))
    near = lambda gap: F.when(gap >= F.col("_each") * 1.1, F.col("_each") / 2).otherwise(gap)
    start = near(s(F.col("_a._t") - (F.col("at_ms") - window_ms)))
    zero = F.when((F.col("_grown") > 0) & (F.col("_a._v") >= 0), F.col("_span") * (F.col("_a._v") / F.col("_grown")))
    start = F.least(start, F.coalesce(zero, start))
    whole = F.col("_span") + start + near(s(F.col("at_ms") - F.col("_b._t")))
    return sums.select(*by, "at_ms", (F.col("_grown") * (whole / F.col("_span") / F.lit(window_ms / 1000))).alias("rate"))


def summed_rate(rates: DataFrame, by: list[str]) -> DataFrame:
    """Rates of counters summed by labels, at each step."""
    return rates.groupBy(*by, "at_ms").agg(F.sum("rate").alias("rate"))


def rate_quantile(samples: DataFrame, by: list[str], labels: list[str], time_ms: str, value: str, q: float, window_ms: int, step_ms: int) -> DataFrame:
    """A quantile over time of what cumulative buckets (column ``le``, null: unbounded) count: the buckets' rates over the window are summed by ``labels`` and ``le``, then interpolated."""
    rates = summed_rate(range_rate(samples, by, time_ms, value, window_ms, step_ms), [*labels, "le"])
    return histogram_quantile(rates.withColumnRenamed("rate", "n"), [*labels, "at_ms"], q)
