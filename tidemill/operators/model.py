"""Labels, the time split, the model, and its metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import LABEL_AHEAD_MS, LABEL_FACTOR, MIN_TRIPS_FOR_LABEL, VECTOR


def make_labels(history: DataFrame, view: str) -> DataFrame:
    """1.0 where the next 15 minutes hold over 1.5 times the hour's quarter, else 0.0, for every fifth minute with trips enough."""
    rows = history.where(F.col("feature_view") == view)
    now = rows.where((F.col("trips_60m") >= MIN_TRIPS_FOR_LABEL) & (F.pmod(F.floor(F.col("window_end_ms") / 60_000), F.lit(60)) % 5 == 0))
    later = rows.select("zone", (F.col("window_end_ms") - LABEL_AHEAD_MS).alias("window_end_ms"), F.col("count_15m").alias("next_15m"))
    label = F.when(F.col("next_15m") > F.lit(LABEL_FACTOR) * (F.col("trips_60m") / F.lit(4.0)), 1.0).otherwise(0.0)
    return now.join(later, ["zone", "window_end_ms"]).select("zone", F.col("window_end_ms").alias("label_time_ms"), label.alias("label"))


def time_split(examples: DataFrame, q: float = 0.7) -> DataFrame:
    """The cut of a split by time, interpolated, and how many examples lie on each side (training: up to the cut)."""
    cut = examples.agg(F.percentile("label_time_ms", q).alias("cut_ms"))
    return examples.join(F.broadcast(cut)).groupBy("cut_ms").agg(F.count_if(F.col("label_time_ms") <= F.col("cut_ms")).alias("train"), F.count_if(F.col("label_time_ms") > F.col("cut_ms")).alias("test"))


def roc_auc(scored: DataFrame, score: str, label: str, parts: int = 256) -> DataFrame:
    """Area under the ROC curve by ranks (ties share), average precision by steps of recall, and the positive rate.

    Work is done on one row per distinct score. These are cut at approximate quantiles, and the running sums go over the parts,
    and within each. A score's part is found by halving, and is never null: else the join's test for nulls would be pushed below the grouping,
    and every example would be searched for, not every distinct score."""
    groups = scored.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(label)).cast("double").alias("p"))
    cuts = groups.agg(F.percentile_approx("s", [k / parts for k in range(1, parts)], 4 * parts)).scalar()
    halves = F.array(*[F.lit(1 << k) for k in reversed(range((parts - 1).bit_length()))])
    part = F.aggregate(halves, F.lit(0), lambda low, k: F.when(F.get("cuts", low + k - 1) <= F.col("s"), low + k).otherwise(low))
    groups = groups.withColumn("cuts", cuts).withColumn("part", F.coalesce(part, F.lit(0))).drop("cuts")
    heads = groups.groupBy("part").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    along = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    heads = heads.select("part", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("n0"), F.coalesce(F.sum("p").over(along), F.lit(0.0)).alias("p0"), F.sum("n").over(W.partitionBy()).alias("all"), F.sum("p").over(W.partitionBy()).alias("all_p"))
    inside = W.partitionBy("part").orderBy("s")
    rows = groups.withColumn("n1", F.sum("n").over(inside) - F.col("n")).withColumn("p1", F.sum("p").over(inside) - F.col("p")).join(heads, "part")
    below, below_p = F.col("n0") + F.col("n1"), F.col("p0") + F.col("p1")
    rows = rows.select("n", "p", (below + (F.col("n") + 1) / 2).alias("rank"), (F.col("all_p") - below_p).alias("hits"), (F.col("all") - below).alias("seen"))
    total = rows.agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").alias("pos"), F.sum("n").alias("n"), F.sum(F.col("p") * F.col("hits") / F.col("seen")).alias("ap"))
    auc = (F.col("r") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * (F.col("n") - F.col("pos")))
    return total.select(auc.alias("auc"), (F.col("ap") / F.col("pos")).alias("average_precision"), (F.col("pos") / F.col("n")).alias("positive_rate"), F.col("n").alias("examples"))


def top_zones(scored: DataFrame, score: Column, n: int = 5) -> DataFrame:
    return scored.withColumn("score", score).orderBy(F.desc("score"), "zone").limit(n)


def fit(examples: DataFrame):
    """A logistic regression, on features scaled by the deviation over all examples, with an L2 penalty of strength 1 on the summed loss."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler
    from pyspark.ml.linalg import Vectors

    n = max(1, examples.count())
    stages = [
        VectorAssembler(inputCols=list(VECTOR), outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True),
        # the scaler divides by the deviation of a sample: this much less than by that of all examples
        ElementwiseProduct(scalingVec=Vectors.dense([math.sqrt(n / max(1, n - 1))] * len(VECTOR)), inputCol="scaled", outputCol="x"),
        LogisticRegression(featuresCol="x", labelCol="label", maxIter=1000, regParam=1.0 / n, standardization=False),
    ]
    return Pipeline(stages=stages).fit(examples)


def busiest(features: DataFrame) -> DataFrame:
    return features.agg(F.max_by("zone", F.struct("trips_5m", -F.col("zone"))).alias("zone"), F.max("trips_5m").alias("trips_5m"))
