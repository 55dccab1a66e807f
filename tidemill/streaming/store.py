"""The tables that a stream writes: the history, the latest rows, and word to caches.

Each micro-batch is a folder of its own, so writing costs what the batch holds however long the history is, and a repeated
delivery overwrites itself. Readers merge: of a key's rows the earliest batch's stays, and rows of later batches that differ are counted as
conflicting rewrites. ``compact`` moves batches into a table laid out by day (``sources.daytable``) once in a while; which batches that table holds is
published with its days, so at no moment does a row count twice or not at all.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from itertools import batched

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.history import earliest
from ..operators.windows import latest
from ..sources.daytable import DayTable
from ..sources.storage import delete
from ..views import ZONE_DEMAND, FeatureView


class FeatureStore:
    """History and latest rows under a folder, of the views of one definition (``view`` names this one, if not as the definition does). ``invalidate`` gets the entities that a
    commit touched, some thousand at a time."""

    def __init__(self, spark: SparkSession, root: str, view: str | None = None, invalidate: Callable[[list[int]], None] | None = None, definition: FeatureView = ZONE_DEMAND):
        self.spark, self.root, self.view, self.invalidate, self.definition = spark, root.rstrip("/"), view or definition.name, invalidate, definition
        self.freshness: list[dict] = []
        self.days = DayTable(spark, f"{self.root}/days", definition)
        self._rows = definition.history_schema.split(", ", 1)[1]

    def sink(self, batch: DataFrame, number: int) -> None:
        """One micro-batch: first its history rows, then the latest rows, then the caches are told. A failure before the end repeats all, to the same result."""
        rows = batch.select("zone", "window_end_ms", *self.definition.sums, F.col("partition").alias("source_partition"), F.col("batch_offset").alias("source_offset"), F.lit(0).alias("conflicting_rewrites"), "trigger_publish_ms").persist()
        try:
            rows.drop("trigger_publish_ms").write.mode("overwrite").parquet(f"{self.root}/history/feature_view={self.view}/batch={number}")
            latest(rows.select("zone", "window_end_ms", *self.definition.sums)).write.mode("overwrite").parquet(f"{self.root}/latest/batch={number}")
            told = rows.agg(F.count("*").alias("rows"), F.max("trigger_publish_ms").alias("published_ms")).first()
            if told["rows"] and (told["published_ms"] or 0) > 0:
                self.freshness.append({"batch": number, "rows": told["rows"], "freshness_s": time.time() - told["published_ms"] / 1000})
            if self.invalidate is not None and told["rows"]:
                for some in batched((r["zone"] for r in touched(rows).toLocalIterator()), 4096):
                    try:  # a lost word is bounded by the cache's time to live
                        self.invalidate(list(some))
                    except Exception:
                        break
        finally:
            rows.unpersist()

    def _batches(self) -> DataFrame:
        """The rows of batches that the table of days doesn't hold."""
        held = self.days.manifest.read().get("through", {})
        rows = self.spark.read.schema(f"{self._rows}, feature_view string, batch long").parquet(f"{self.root}/history")
        for view, through in held.items():
            rows = rows.where((F.col("feature_view") != view) | (F.col("batch") > through))
        return rows

    def made(self) -> DataFrame:
        """batch and feature_rows: the rows of the view that each micro-batch wrote, of those that the table of days doesn't hold."""
        return self._batches().where(F.col("feature_view") == self.view).groupBy("batch").agg(F.count("*").alias("feature_rows"))

    def history(self, view: str | None = None, start_ms: int | None = None, stop_ms: int | None = None) -> DataFrame:
        """The merged history of all views, or of one, with window ends in [start, stop); of compacted batches only the range's days are read."""
        rows = self._batches()
        for wanted, condition in ((view, F.col("feature_view") == view), (start_ms, F.col("window_end_ms") >= start_ms), (stop_ms, F.col("window_end_ms") < stop_ms)):
            rows = rows if wanted is None else rows.where(condition)
        return merged(_compacted(self.days.rows(view, start_ms, stop_ms)).unionByName(rows), self.definition)

    def latest(self) -> DataFrame:
        """Each entity's latest row; of equal window ends the earliest batch's."""
        rows = self.spark.read.schema(f"{self.definition.schema}, batch long").parquet(f"{self.root}/latest")
        return latest(rows.withColumn("order", -F.col("batch")), "order").drop("batch", "order")

    def compact(self, through: int) -> None:
        """Moves the view's batches up to ``through`` into the table of days; days that they don't touch are neither read nor written. The stream must not be writing one of them.
        A failure at any point leaves rows and conflicts as they were; what it left behind goes with the next call."""
        held = self.days.manifest.read().get("through", {})
        folder = f"{self.root}/history/feature_view={self.view}"
        old = self.spark.read.schema(f"{self._rows}, batch long").parquet(folder).where(F.col("batch") <= held.get(self.view, -1)).select("batch").distinct()
        for r in old.collect():  # folders that the call before has moved, and that no reader looks for since
            delete(self.spark, f"{folder}/batch={r['batch']}")
        rows = self._batches().where((F.col("feature_view") == self.view) & (F.col("batch") <= through))
        self.days.upsert(rows, lambda old, new: merged(_compacted(old).unionByName(new), self.definition), through={**held, self.view: max(through, held.get(self.view, -1))})

    def delete_view(self, view: str) -> None:
        """A view's rows go."""
        delete(self.spark, f"{self.root}/history/feature_view={view}")
        self.days.delete_view(view)


def _compacted(rows: DataFrame) -> DataFrame:
    """Rows of the table of days, which come before those of all batches that it doesn't hold."""
    return rows.withColumn("batch", F.lit(-1).cast("long"))


def touched(rows: DataFrame) -> DataFrame:
    """The entities of a batch, once each: what caches must forget."""
    return rows.select("zone").distinct()


def merged(rows: DataFrame, definition: FeatureView = ZONE_DEMAND) -> DataFrame:
    """One row a key of rows with a batch number: the earliest batch's (of equal ones the smallest), with the conflicting rewrites of all the others."""
    return earliest(rows, F.col("batch"), definition)


def write_labels(labels: DataFrame, path: str) -> DataFrame:
    """The label table, replaced as a whole, as readers see it."""
    labels.select("zone", "label_time_ms", "label").write.mode("overwrite").parquet(path)
    return labels.sparkSession.read.schema(schemas.LABELS).parquet(path)
