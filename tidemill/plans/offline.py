"""Offline plans: backfill, training examples, the verification job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BACKFILL_VIEW, VIEW
from ..operators import history, model, replay, verify, windows
from ..views import ZONE_DEMAND, FeatureView


def backfill(trips: DataFrame, committed: DataFrame, view: str | None = None, definition: FeatureView = ZONE_DEMAND) -> DataFrame:
    """History rows recomputed from the log through the committed offsets; ``view`` names them (else the definition's name, marked as a backfill)."""
    rows = windows.zone_features(replay.bounded(trips, committed), view=definition)
    return rows.select(F.lit(view or f"{definition.name}__backfill").alias("feature_view"), "zone", "window_end_ms", *definition.sums, F.col("partition").alias("source_partition"))


def training_examples(rows: DataFrame, view: str = VIEW) -> DataFrame:
    """Labels with the features known at their time, as model vectors; examples without a row are left out."""
    labels = model.make_labels(rows, view)
    joined = history.point_in_time(labels, rows, view).where("window_end_ms is not null")
    return windows.model_vector(joined)


def train(rows: DataFrame, view: str = VIEW):
    """The fitted model and its metrics on the later part of the examples."""
    from pyspark.ml.functions import vector_to_array

    examples = training_examples(rows, view)
    cut = model.time_split(examples).first()["cut_ms"]
    fitted = model.fit(examples.where(F.col("label_time_ms") <= cut))
    scored = fitted.transform(examples.where(F.col("label_time_ms") > cut)).select(vector_to_array("probability")[1].alias("score"), "label", "demand_spike_ratio")
    return fitted, model.roc_auc(scored, "score", "label"), model.roc_auc(scored, "demand_spike_ratio", "label")


def score_online(fitted, latest: DataFrame, n: int = 5) -> DataFrame:
    """The entities with the highest predicted probability."""
    from pyspark.ml.functions import vector_to_array

    return model.top_zones(fitted.transform(windows.model_vector(latest)), vector_to_array("probability")[1], n)


def verification(trips: DataFrame, stored: DataFrame, backfilled: DataFrame) -> DataFrame:
    """Parity of the stored and backfilled views up to the last window that all partitions have closed."""
    cut = windows.partition_stats(trips).where("to_offset >= 0").agg(F.min("closed_until_ms")).scalar()
    return history.parity(stored.unionByName(backfilled, allowMissingColumns=True), VIEW, BACKFILL_VIEW, cut)


def snapshot(latest: DataFrame, stats: DataFrame) -> DataFrame:
    """The dashboard's document: partitions and entities as one JSON text."""
    cards = windows.zone_card(latest).agg(F.array_sort(F.collect_list(F.struct("zone", "window_end_ms", "trips_5m", "trips_60m", "fare_mean_15m", "distance_mean_15m", "demand_spike_ratio"))).alias("zones"))
    parts = stats.agg(F.array_sort(F.collect_list(F.struct("partition", "to_offset", "closed_until_ms", "late_dropped", "events"))).alias("partitions"))
    return cards.join(F.broadcast(parts)).select(F.to_json(F.struct("zones", "partitions")).alias("document"))


def diff_is_clean(expected: DataFrame, actual: DataFrame) -> bool:
    return verify.oracle_diff(expected, actual).isEmpty()
