"""The history of feature rows: upserts that count conflicts, range scans, point-in-time joins, parity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..views import ZONE_DEMAND, FeatureView

DAY_MS = 86_400_000
KEY = ("feature_view", "zone", "window_end_ms")


def differs(left: str, right: str, definition: FeatureView = ZONE_DEMAND) -> Column:
    """Any of the view's sums IS DISTINCT FROM the other side's."""
    return reduce(lambda a, b: a | b, [~F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in definition.sums])


def equals(left: str, right: str, definition: FeatureView = ZONE_DEMAND) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}") == F.col(f"{right}.{c}") for c in definition.sums])


def earliest(rows: DataFrame, batch: Column, definition: FeatureView = ZONE_DEMAND) -> DataFrame:
    """One row a key: the earliest batch's (of equal ones the smallest), with its own conflicting rewrites and those of all the others, and one more for each that differs. Rows
    travel and are sorted once, and a task holds no key's rows in one value."""
    sums = definition.sums
    along = W.partitionBy(*KEY).orderBy("batch", *sums, "source_partition", "source_offset")
    whole = along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.select(*KEY, *sums, "source_partition", "source_offset", "conflicting_rewrites", batch.alias("batch"))
    rows = rows.withColumns({"nth": F.row_number().over(along), "taken": F.first(F.struct(*sums)).over(whole)})
    conflicts = F.sum("conflicting_rewrites").over(whole) + F.sum((~F.struct(*sums).eqNullSafe(F.col("taken"))).cast("long")).over(whole)
    return rows.withColumn("conflicting_rewrites", conflicts.cast("int")).where("nth = 1").select(*KEY, *sums, "source_partition", "source_offset", "conflicting_rewrites")


def upsert(stored: DataFrame, batch: DataFrame, definition: FeatureView = ZONE_DEMAND) -> DataFrame:
    """The table after a batch: new keys are inserted; where a key exists, the first write wins and a differing row only counts as a
    conflicting rewrite. Keys are unique in the stored table; of a batch's rows with one key the smallest is taken first, and the others are compared with it."""
    columns = [*KEY, *definition.sums, "source_partition", "source_offset"]
    old = stored.select(*columns, F.coalesce("conflicting_rewrites", F.lit(0)).alias("conflicting_rewrites"), F.lit(0).alias("batch"))
    new = batch.select(*columns, F.lit(0).alias("conflicting_rewrites"), F.lit(1).alias("batch"))
    return earliest(old.unionByName(new), F.col("batch"), definition)


def insert_ignore(stored: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new keys are added; existing ones stay as they are."""
    return stored.unionByName(batch.join(stored.select(*key), key, "left_anti"))


def history_rows(history: DataFrame, view: str, start_ms: int, stop_ms: int) -> DataFrame:
    """The rows of one view with window ends in [start, stop), in order."""
    return history.where((F.col("feature_view") == view) & (F.col("window_end_ms") >= start_ms) & (F.col("window_end_ms") < stop_ms)).orderBy("window_end_ms", "zone")


def conflicting_rewrites(history: DataFrame) -> DataFrame:
    """Conflicting rewrites over all views."""
    return history.agg(F.coalesce(F.sum("conflicting_rewrites"), F.lit(0)).cast("long").alias("rewrites"))


def point_in_time(labels: DataFrame, history: DataFrame, view: str, definition: FeatureView = ZONE_DEMAND, slot_ms: int = DAY_MS) -> DataFrame:
    """Each label with its entity's latest row at or before label_time (none: nulls). Both sides are put in one stream, in which the last row seen is carried forward, in two
    levels: inside slots of time, and above them one row a slot. No task orders all of an entity's time, and rows are shuffled once."""
    values = ("window_end_ms", *definition.sums)
    row = F.struct(*values)
    facts = history.where(F.col("feature_view") == view).select("zone", F.col("window_end_ms").alias("at"), F.lit(0).alias("side"), row.alias("row"), F.lit(None).cast("double").alias("label"))
    asked = labels.select("zone", F.col("label_time_ms").alias("at"), F.lit(1).alias("side"), F.lit(None).cast(facts.schema["row"].dataType).alias("row"), "label")
    slot = F.floor(F.col("at") / slot_ms).alias("slot")
    heads = facts.groupBy("zone", slot).agg(F.max_by("row", "at").alias("head")).unionByName(asked.select("zone", slot).distinct(), allowMissingColumns=True)
    heads = heads.groupBy("zone", "slot").agg(F.max("head").alias("head"))
    along = W.partitionBy("zone").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    heads = heads.select(F.col("zone").alias("of"), F.col("slot").alias("in"), F.last("head", ignorenulls=True).over(along).alias("before"))
    inside = F.last("row", ignorenulls=True).over(W.partitionBy("zone", "slot").orderBy("at", "side").rowsBetween(W.unboundedPreceding, 0))
    rows = facts.unionByName(asked).withColumn("slot", slot).withColumn("inside", inside).where("side = 1")
    rows = rows.join(heads, F.col("zone").eqNullSafe(F.col("of")) & F.col("slot").eqNullSafe(F.col("in")), "left").withColumn("seen", F.coalesce("inside", "before"))
    return rows.select("zone", F.col("at").alias("label_time_ms"), "label", *[F.col(f"seen.{c}").alias(c) for c in values])


def pit_leaks(joined: DataFrame) -> DataFrame:
    """Labels joined with a row from after their time: there must be none."""
    return joined.agg(F.count("*").alias("examples"), F.count_if(F.col("window_end_ms") > F.col("label_time_ms")).alias("leaks"))


def parity(history: DataFrame, left_view: str, right_view: str, cut: Column, definition: FeatureView = ZONE_DEMAND) -> DataFrame:
    """Matched, mismatched and one-sided rows of two views up to a window end."""
    side = lambda v, name: history.where((F.col("feature_view") == v) & (F.col("window_end_ms") <= cut)).select("zone", "window_end_ms", F.struct(*definition.sums).alias(name))
    rows = side(left_view, "a").join(side(right_view, "b"), ["zone", "window_end_ms"], "full_outer")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return rows.agg(
        F.count_if(both & equals("a", "b", definition)).alias("matched"), F.count_if(both & ~equals("a", "b", definition)).alias("mismatched"),
        F.count_if(F.col("b").isNull()).alias("missing_right"), F.count_if(F.col("a").isNull()).alias("missing_left"),
    )


def unnest_rows(batches: DataFrame, definition: FeatureView = ZONE_DEMAND) -> DataFrame:
    """Rows from parallel arrays."""
    columns = ("zone", "window_end_ms", *definition.sums)
    return batches.select("source_partition", F.inline(F.arrays_zip(*[F.col(c) for c in columns])))


def delete_view(history: DataFrame, view: str | None) -> DataFrame:
    """The table without a view's rows (None: without any)."""
    return history.limit(0) if view is None else history.where(~F.col("feature_view").eqNullSafe(F.lit(view)))
