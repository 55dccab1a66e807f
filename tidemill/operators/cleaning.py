"""Cleaning of raw trips: first matching rule wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DISTANCE_MAX, ENTITY_MAX, ENTITY_MIN, FARE_MAX
from ..functions.columns import epoch_ms, scaled

REASONS = ("bad_time", "bad_zone", "bad_fare", "bad_distance")


def outside(x: str, low: float, high: float) -> Column:
    """Outside the inclusive bounds. NaN is not outside, as no comparison with it holds; null counts as 0."""
    value = F.coalesce(F.col(x), F.lit(0.0))
    return ~F.isnan(value) & ((value < low) | (value > high))


def reject_reason(month: str) -> Column:
    """Why a raw row is rejected; null if it is kept. month: YYYY-MM."""
    first = F.to_timestamp_ntz(F.lit(f"{month}-01 00:00:00"))
    after = first + F.expr("INTERVAL '1' MONTH")
    time = F.col("tpep_pickup_datetime")
    zone = F.coalesce(F.col("PULocationID"), F.lit(0))
    return (
        F.when(time.isNull() | (time < first) | (time >= after), "bad_time")
        .when((zone < ENTITY_MIN) | (zone > ENTITY_MAX), "bad_zone")
        .when(outside("fare_amount", 0, FARE_MAX), "bad_fare")
        .when(outside("trip_distance", 0, DISTANCE_MAX), "bad_distance")
    )


def clean(raw: DataFrame, month: str, position: str | None = None) -> DataFrame:
    """Kept trips in scaled units. position: a column whose order breaks ties of the event time (stable order)."""
    rows = raw.where(reject_reason(month).isNull()).select(
        epoch_ms("tpep_pickup_datetime").alias("event_time_ms"), F.col("PULocationID").alias("zone"),
        scaled(F.coalesce("fare_amount", F.lit(0.0)), 100).alias("fare_cents"), scaled(F.coalesce("trip_distance", F.lit(0.0)), 1000).alias("distance_milli"), *([position] if position else []),
    )
    return rows.orderBy("event_time_ms", *([position] if position else []))


def clean_stats(raw: DataFrame, month: str) -> DataFrame:
    """Rows, rejects by reason, and kept rows."""
    reason = reject_reason(month)
    rows = raw.select(reason.alias("reason"))
    return rows.agg(F.count("*").alias("rows_read"), *[F.count_if(F.col("reason") == r).alias(r) for r in REASONS], F.count_if(F.col("reason").isNull()).alias("kept"))
