"""Sliding-window features in closed form.

The log of each partition is ordered by offset. An event is late if its time lies before the windows that earlier events of
its partition have closed; what is closed is a running maximum, so lateness is a prefix scan. The scan is done in two levels
(within chunks of offsets, and over one row a chunk), so that a log partition of any length spreads over many tasks.
Accepted events are summed into buckets of a view's width (a minute in the first view); each bucket reaches 60 window ends,
and one more, which makes the single zero row of an entity that went quiet. ``lateness`` stands in for the view's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import CHUNK_EVENTS
from ..functions.columns import floor_to, hour_angle, round2
from ..views import FIELDS, ZONE_DEMAND, FeatureView

DAY_MS = 86_400_000


def prefix_max(trips: DataFrame, chunk: int = CHUNK_EVENTS, width: int = ZONE_DEMAND.bucket_ms) -> DataFrame:
    """Adds ``before_ms``, the largest event time of all earlier offsets of the partition, and ``s0``, its first event's bucket."""
    rows = trips.withColumn("chunk", F.floor(F.col("offset") / chunk))
    heads = rows.groupBy("partition", "chunk").agg(F.max("event_time_ms").alias("most"), F.min_by("event_time_ms", "offset").alias("first"))
    along = W.partitionBy("partition").orderBy("chunk")
    heads = heads.select("partition", "chunk", F.max("most").over(along.rowsBetween(W.unboundedPreceding, -1)).alias("earlier"), floor_to(F.first("first").over(along), width).alias("s0"))
    rows = rows.join(heads, ["partition", "chunk"])
    within = W.partitionBy("partition", "chunk").orderBy("offset").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("before_ms", F.greatest("earlier", F.max("event_time_ms").over(within))).drop("earlier", "chunk")


def _last_closed(reached: Column, lateness: int | None, view: FeatureView) -> Column:
    """Up to where windows are closed when event time has reached so far."""
    return floor_to(reached - (view.lateness_ms if lateness is None else lateness), view.bucket_ms)


def mark_late(trips: DataFrame, lateness: int | None = None, chunk: int = CHUNK_EVENTS, view: FeatureView = ZONE_DEMAND) -> DataFrame:
    """Adds ``closed_before``, up to where windows were closed when the event came, and ``late``."""
    rows = prefix_max(trips, chunk, view.bucket_ms)
    rows = rows.withColumn("closed_before", F.greatest("s0", _last_closed(F.col("before_ms"), lateness, view)))
    return rows.withColumn("late", F.col("event_time_ms") < F.col("closed_before"))


def partition_stats(trips: DataFrame, lateness: int | None = None, view: FeatureView = ZONE_DEMAND) -> DataFrame:
    """One row a partition: last offset, largest event time, closed_until, late and all events."""
    return (
        mark_late(trips, lateness, view=view)
        .groupBy("partition")
        .agg(
            F.max("offset").alias("to_offset"), F.max("event_time_ms").alias("max_event_time_ms"),
            F.greatest(F.min("s0"), _last_closed(F.max("event_time_ms"), lateness, view)).alias("closed_until_ms"),
            F.count_if("late").alias("late_dropped"), F.count("*").alias("events"),
        )
    )


def bucket_agg(trips: DataFrame, lateness: int | None = None, view: FeatureView = ZONE_DEMAND) -> DataFrame:
    """Counts and sums of the accepted events of each entity and bucket of time."""
    return (
        mark_late(trips, lateness, view=view)
        .where(~F.col("late"))
        .groupBy("partition", "zone", floor_to("event_time_ms", view.bucket_ms).alias("start_ms"))
        .agg(F.count("*").alias("count"), F.sum("fare_cents").alias("fare_cents"), F.sum("distance_milli").alias("distance_milli"))
    )


def closings(trips: DataFrame, lateness: int | None = None, view: FeatureView = ZONE_DEMAND) -> DataFrame:
    """closed_until of each log partition. It follows from the first and the largest event time, so no event need be marked."""
    last = _last_closed(F.max("event_time_ms"), lateness, view)
    return trips.groupBy("partition").agg(F.greatest(floor_to(F.min_by("event_time_ms", "offset"), view.bucket_ms), last).alias("closed_until_ms"))


def _closed(buckets: DataFrame, stats: DataFrame, view: FeatureView) -> DataFrame:
    """Buckets that a closed window reaches, each entity's in one place. Of ``stats`` one row a log partition is broadcast, which a log has few of."""
    ends = F.broadcast(stats.select("partition", "closed_until_ms"))
    rows = buckets.join(ends, "partition").where(F.col("start_ms") + view.bucket_ms <= F.col("closed_until_ms"))
    return rows.repartition("partition", "zone")


def _within(k: int, c: str) -> Column:
    return F.sum(F.when(F.col("age") <= k, F.col(c)).otherwise(F.lit(0)))


def _sums(view: FeatureView) -> list[Column]:
    """The view's totals over buckets with ages."""
    return [_within(view.span(t), t.field).alias(t.name) for t in view.totals]


def slide(buckets: DataFrame, stats: DataFrame, reach: int | None = None, view: FeatureView = ZONE_DEMAND) -> DataFrame:
    """Rows of every entity and closed window end that a bucket reaches. A bucket is not dealt to all of them: it tells the few ends at which it enters or leaves a total. Totals
    are running sums of these changes, and what holds from a change to the next one is written out last, after the only shuffle and sort. Of ``stats`` one row a log partition is
    broadcast, which a log has few of."""
    most, width = (view.reach if reach is None else reach) + 1, view.bucket_ms
    leaves = {t.name: min(view.span(t), most) + 1 for t in view.totals}  # the age at which a bucket is no longer in the total
    ages = sorted({1, most + 1, *leaves.values()})
    closed = F.broadcast(stats.select("partition", "closed_until_ms"))
    rows = buckets.join(closed, "partition").withColumn("age", F.explode(F.array(*map(F.lit, ages)))).withColumn("at_ms", F.col("start_ms") + F.col("age") * width)
    rows = rows.where(F.col("at_ms") <= F.col("closed_until_ms")).select("partition", "zone", "at_ms", "age", *FIELDS, "closed_until_ms")
    along = W.partitionBy("partition", "zone").orderBy("at_ms")
    sofar = along.rowsBetween(W.unboundedPreceding, W.currentRow)

    def now(leave: int, c: Column) -> Column:
        return F.sum(F.when(F.col("age") == 1, c).when(F.col("age") == leave, -c).otherwise(F.lit(0).cast("long"))).over(sofar)

    sums = [now(leaves[t.name], F.coalesce(t.field, F.lit(0).cast("long"))).alias(t.name) for t in view.totals]
    until = F.coalesce(F.lead("at_ms").over(along) - width, "closed_until_ms").alias("until_ms")  # of changes at one end the last one has all of them; the others hold for no end
    rows = rows.select("partition", "zone", "at_ms", until, now(most + 1, F.lit(1).cast("long")).alias("alive"), *sums).where((F.col("alive") > 0) & (F.col("until_ms") >= F.col("at_ms")))
    return rows.select("partition", "zone", F.explode(F.sequence("at_ms", "until_ms", F.lit(width).cast("long"))).alias("window_end_ms"), *view.sums)


def zone_features(trips: DataFrame, lateness: int | None = None, view: FeatureView = ZONE_DEMAND) -> DataFrame:
    """All feature rows of a log."""
    return slide(bucket_agg(trips, lateness, view), closings(trips, lateness, view), view=view)


def latest_rows(trips: DataFrame, lateness: int | None = None, reach: int | None = None, view: FeatureView = ZONE_DEMAND) -> DataFrame:
    """The latest feature row of each entity, from its last buckets alone: its window ends where all is closed, or when the entity's last bucket leaves it."""
    most, width = (view.reach if reach is None else reach) + 1, view.bucket_ms
    rows = _closed(bucket_agg(trips, lateness, view), closings(trips, lateness, view), view)
    ends = rows.groupBy("partition", "zone").agg((F.max("start_ms") + most * width).alias("left_ms"))
    rows = rows.join(ends.hint("shuffle_hash"), ["partition", "zone"]).withColumn("window_end_ms", F.least("left_ms", "closed_until_ms"))
    rows = rows.withColumn("age", F.floor((F.col("window_end_ms") - F.col("start_ms")) / width)).where(F.col("age") <= most)
    return latest(rows.groupBy("partition", "zone", "window_end_ms").agg(*_sums(view)))


def derive(features: DataFrame, view: FeatureView = ZONE_DEMAND) -> DataFrame:
    """Adds the view's derived values (in the first: the means of 15 minutes and the demand spike)."""
    return features.withColumns({d.name: d.column() for d in view.derived})


def model_vector(features: DataFrame) -> DataFrame:
    """Adds the cyclic hour of day to the derived features."""
    angle = hour_angle("window_end_ms")
    return derive(features).withColumns({"hour_sin": F.sin(angle), "hour_cos": F.cos(angle)})


def zone_card(features: DataFrame) -> DataFrame:
    """What a dashboard shows of an entity: derived values with two decimals."""
    return derive(features).select("zone", "window_end_ms", "trips_5m", "trips_60m", *[round2(c).alias(c) for c in ("fare_mean_15m", "distance_mean_15m", "demand_spike_ratio")])


def retained_buckets(trips: DataFrame, lateness: int | None = None, view: FeatureView = ZONE_DEMAND) -> DataFrame:
    """The buckets that a snapshot keeps: those that a window to come can reach."""
    ends = F.broadcast(closings(trips, lateness, view))
    return bucket_agg(trips, lateness, view).join(ends, "partition").where(F.col("start_ms") >= F.col("closed_until_ms") - view.reach * view.bucket_ms).drop("closed_until_ms")


def partition_state(trips: DataFrame, lateness: int | None = None, view: FeatureView = ZONE_DEMAND) -> DataFrame:
    """Snapshot of each partition: its numbers and its retained buckets in order."""
    kept = retained_buckets(trips, lateness, view).groupBy("partition").agg(F.array_sort(F.collect_list(F.struct("zone", "start_ms", *FIELDS))).alias("buckets"))
    return partition_stats(trips, lateness, view).join(kept, "partition", "left").withColumn("buckets", F.coalesce("buckets", F.array().cast("array<struct<zone: int, start_ms: bigint, count: bigint, fare_cents: bigint, distance_milli: bigint>>")))


def trailing_range(buckets: DataFrame, view: FeatureView = ZONE_DEMAND, slot_ms: int = DAY_MS) -> DataFrame:
    """Trailing sums at each bucket's own end, as range windows. Time is cut into slots; a slot also gets the buckets before it that its first ends reach back to, so no
    task holds all of an entity's time."""
    back_ms = (view.reach - 1) * view.bucket_ms
    slot = lambda t: F.floor(t / slot_ms)
    dealt = buckets.withColumn("slot", F.explode(F.sequence(slot(F.col("start_ms")), slot(F.col("start_ms") + back_ms))))

    def back(k: int, c: str):
        return F.sum(c).over(W.partitionBy("partition", "zone", "slot").orderBy("start_ms").rangeBetween(-(k - 1) * view.bucket_ms, 0))

    sums = [back(view.span(t), t.field).alias(t.name) for t in view.totals]
    rows = dealt.select("partition", "zone", "start_ms", "slot", *sums).where(F.col("slot") == slot(F.col("start_ms")))
    return rows.select("partition", "zone", (F.col("start_ms") + view.bucket_ms).alias("window_end_ms"), *view.sums)


def latest(features: DataFrame, order: str | None = None) -> DataFrame:
    """The latest row of each entity; of equal window ends the one applied later."""
    columns = [c for c in features.columns if c != "zone"]
    by = F.struct("window_end_ms", *([order] if order else []))
    return features.groupBy("zone").agg(F.max_by(F.struct(*columns), by).alias("row")).select("zone", *[F.col("row")[c].alias(c) for c in columns])


def recent_points(features: DataFrame, n: int = 120) -> DataFrame:
    """Each entity's last n points, one for every new as_of, as a chart keeps them. The last n are found first, repeated ones and all, so that only they travel and are compared."""
    by = W.partitionBy("zone").orderBy(F.desc("window_end_ms"))
    last = features.withColumn("nth", F.dense_rank().over(by)).where(F.col("nth") <= n)
    last = last.withColumn("new", F.lag("nth", 1, 0).over(by) < F.col("nth")).where("new")
    return last.drop("nth", "new").withColumnRenamed("window_end_ms", "as_of_ms")


def newest(features: DataFrame) -> DataFrame:
    """The largest window end over all entities."""
    return features.agg(F.max("window_end_ms").alias("as_of_ms"))


def last_n(features: DataFrame, n: int) -> DataFrame:
    """The n latest rows of each entity."""
    by = W.partitionBy("zone").orderBy(F.desc("window_end_ms"))
    return features.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= n)
