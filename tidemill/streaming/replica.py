"""A replica of the stream's state, kept from its changelog.

Each micro-batch tells the buckets that it changed as absolute values and each partition's numbers (``engine.changes``). They are kept as a folder a micro-batch, so
telling costs what a batch changed. Readers apply them in order: a partition's batch counts only if its offset lies above all applied before it, so a batch that is delivered
again has no effect; of each bucket the last applied value stays, and buckets that no window to come can reach are evicted by the same rule as in the stream, so evictions
are never told. ``compact`` folds batches into one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.kv import idempotent_apply, merge_buckets
from ..sources.manifest import Manifest
from ..sources.storage import delete
from ..views import ZONE_DEMAND, FeatureView

_NUMBERS = ("to_offset", "max_event_time_ms", "closed_until_ms", "late_dropped", "events")
_ROWS = "kind string, partition int, to_offset long, max_event_time_ms long, closed_until_ms long, late_dropped long, events long, zone int, start_ms long, count long, fare_cents long, distance_milli long"
_NAMES = [c.split()[0] for c in _ROWS.split(", ")]


class Replica:
    """The replicated state of all log partitions under a folder."""

    def __init__(self, spark: SparkSession, root: str, definition: FeatureView = ZONE_DEMAND):
        self.spark, self.root, self.definition = spark, root.rstrip("/"), definition
        self.manifest = Manifest(spark, f"{self.root}/base")

    def sink(self, batch: DataFrame, number: int) -> None:
        """Keeps a micro-batch of changes; the same one again replaces itself."""
        rows = batch.where("kind <> 'feature'").withColumnRenamed("batch_offset", "to_offset")
        rows.select(*_NAMES).write.mode("overwrite").parquet(f"{self.root}/changes/batch={number}")

    def _changes(self, through: int | None = None) -> DataFrame:
        """The changes by arrival: the folded ones first, then the batches after them."""
        base = self.manifest.read()
        rows = self.spark.read.schema(f"{_ROWS}, batch long").parquet(f"{self.root}/changes").withColumnRenamed("batch", "arrival")
        if base:
            folded = self.spark.read.schema(_ROWS).parquet(f"{self.root}/base/{base['folder']}").withColumn("arrival", F.lit(base["through"]).cast("long"))
            rows = rows.where(F.col("arrival") > base["through"]).unionByName(folded)
        return rows if through is None else rows.where(F.col("arrival") <= through)

    def headers(self, through: int | None = None) -> DataFrame:
        """The numbers of each partition: its last applied batch's."""
        applied = idempotent_apply(self._changes(through).where("kind = 'state'").select("partition", "arrival", *_NUMBERS)).where("applied")
        last = applied.groupBy("partition").agg(F.max_by(F.struct(*_NUMBERS), "arrival").alias("h"))
        return last.select("partition", "h.*")

    def buckets(self, through: int | None = None) -> DataFrame:
        """The retained buckets of each partition."""
        rows = self._changes(through)
        batches = rows.where("kind = 'state'").select("partition", "arrival", "to_offset", "closed_until_ms")
        values = rows.where("kind = 'bucket'").select("partition", "arrival", "zone", "start_ms", "count", "fare_cents", "distance_milli")
        return merge_buckets(batches, values, self.definition.reach * self.definition.bucket_ms)

    def compact(self, through: int) -> None:
        """Folds the batches up to ``through`` into one that takes their place at once; a failure at any point changes nothing that readers see."""
        before = self.manifest.read()
        if before:  # what the call before has folded, and no reader looks for since
            held = self.spark.read.schema(f"{_ROWS}, batch long").parquet(f"{self.root}/changes").where(F.col("batch") <= before["through"]).select("batch").distinct()
            for path in [f"changes/batch={r['batch']}" for r in held.collect()] + ([f"base/{before['old']}"] if before["old"] else []):
                delete(self.spark, f"{self.root}/{path}")
        rows = self.headers(through).withColumn("kind", F.lit("state")).unionByName(self.buckets(through).withColumn("kind", F.lit("bucket")), allowMissingColumns=True)
        folder = uuid.uuid4().hex
        rows.select(*_NAMES).write.parquet(f"{self.root}/base/{folder}")
        self.manifest.publish({"folder": folder, "through": through, "old": before.get("folder")})


def change_sink(store, replica: Replica):
    """A sink for a stream of changes: features go to a store, the state to a replica. The store comes first, as its rows follow from a state that must not seem older."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            store.sink(batch.where("kind = 'feature'"), number)
            replica.sink(batch, number)
        finally:
            batch.unpersist()

    return write
