"""Replay of an event log: slices, loops, resume points, late injection, and the guards of a consumer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import BUCKET_MS, CHUNK_EVENTS
from .ordering import earlier, numbered


def route(zone: Column | str, partitions: int) -> Column:
    """The log partition of an entity. Watermarks are kept by partition, so this affects results."""
    return F.pmod(F.col(zone) if isinstance(zone, str) else zone, F.lit(partitions))


def replay_slice(trips: DataFrame, start: int | None, stop: int | None) -> DataFrame:
    """Event times in [start, stop), taken before any loop shift."""
    if start is not None:
        trips = trips.where(F.col("event_time_ms") >= start)
    return trips if stop is None else trips.where(F.col("event_time_ms") < stop)


def replay_loop(trips: DataFrame, loops: int, shift_ms: int) -> DataFrame:
    """The trips ``loops`` times over, each round shifted further in event time."""
    rows = trips.withColumn("loop", F.explode(F.sequence(F.lit(0), F.lit(loops - 1))))
    return rows.withColumn("event_time_ms", F.col("event_time_ms") + F.col("loop") * F.lit(shift_ms).cast("long"))


def replay_resume(trips: DataFrame, after: Column, shift_ms: int | None = None) -> DataFrame:
    """What is left after event time ``after``: the loop to go on with and the events in it later than that."""
    rows = _resumed(trips, shift_ms, after)
    return rows.where(F.col("event_time_ms") > after)


def replay_skipped(trips: DataFrame, after: Column, shift_ms: int | None = None) -> DataFrame:
    """How many events of the loop to go on with are skipped."""
    rows = _resumed(trips, shift_ms, after)
    return rows.agg(F.count_if(F.col("event_time_ms") <= after).alias("skipped"), F.max("loop").alias("loop"))


def _resumed(trips: DataFrame, shift_ms: int | None, after: Column) -> DataFrame:
    base = trips.select(F.min("event_time_ms")).scalar()
    loop = F.lit(0).cast("long")
    if shift_ms:
        loop = F.when(after >= base, F.floor((after - base) / shift_ms)).otherwise(0)
    return trips.withColumn("loop", loop).withColumn("event_time_ms", F.col("event_time_ms") + F.col("loop") * F.lit(shift_ms or 0).cast("long"))


def late_injection(trips: DataFrame, delay: Column, tie: str, slot_ms: int = BUCKET_MS) -> DataFrame:
    """New offsets in release order: each event comes ``delay`` ms later in its partition than its time says."""
    rows = trips.withColumn("_release", F.col("event_time_ms") + delay)
    return numbered(rows, ["partition"], "_release", slot_ms, "offset", tie).drop("_release")


def first_events(trips: DataFrame, n: int) -> DataFrame:
    """The n first events of a replay."""
    return trips.orderBy("event_time_ms", "partition", "offset").limit(n)


def offset_dedup(arrivals: DataFrame, arrival: str = "arrival", chunk: int = CHUNK_EVENTS) -> DataFrame:
    """Arrivals with an offset above all earlier ones of their partition; redelivered ones are ignored."""
    rows = earlier(arrivals, ["partition"], arrival, chunk, F.max, "offset", "_seen")
    return rows.where(F.col("_seen").isNull() | (F.col("offset") > F.col("_seen"))).drop("_seen")


def offset_gaps(trips: DataFrame, chunk: int = CHUNK_EVENTS) -> DataFrame:
    """Missing runs of offsets."""
    rows = earlier(trips.select("partition", "offset"), ["partition"], "offset", chunk, F.max, "offset", "previous")
    return rows.where(F.col("offset") - F.col("previous") > 1).select("partition", F.col("previous").alias("after_offset"), "offset", (F.col("offset") - F.col("previous") - 1).alias("missing"))


def partitions(trips: DataFrame) -> DataFrame:
    """The partitions that a log has."""
    return trips.select("partition").distinct()


def bounded(trips: DataFrame, up_to: DataFrame) -> DataFrame:
    """Each partition from its first offset through ``to_offset`` inclusive; a negative or missing one leaves nothing."""
    return trips.join(up_to.select("partition", "to_offset"), "partition").where(F.col("offset") <= F.col("to_offset")).drop("to_offset")


def last_event_time(trips: DataFrame) -> DataFrame:
    """The largest event time among the partitions' last records."""
    return trips.groupBy("partition").agg(F.max_by("event_time_ms", "offset").alias("t")).agg(F.max("t").alias("last_event_time_ms"))
