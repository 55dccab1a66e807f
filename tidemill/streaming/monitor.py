"""What is known of running streams: a listener that keeps their progress as a table, and a shadow of a stream that checks the store at every micro-batch of its own."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..config import WARM_UP_MS
from ..operators.verify import shadow_check
from ..operators.windows import last_n
from ..sources.manifest import Manifest
from ..sources.storage import delete, exists
from .engine import OBSERVED, lag

METRICS = "query string, run string, batch long, started_ms long, trigger_ms long, input_rows long, rows_per_s double, lag long, feature_rows long, freshness_s double"
CHECKS = "at_ms long, checked long, bad long, pending long, warming_up boolean, events long"
#: What ``MetricsListener.settle`` corrects.
_SETTLED = ("input_rows", "feature_rows")
#: Rows of each entity that a shadow keeps.
SHADOW_ROWS = 240


def metrics_row(progress: dict) -> dict:
    """A progress entry as a row of METRICS. Freshness is the time from when the last event that closed a window was published to the micro-batch's end; null without rows or such a time."""
    started = int(datetime.fromisoformat(progress["timestamp"]).timestamp() * 1000)
    took = progress.get("durationMs", {}).get("triggerExecution", 0)
    seen = progress.get("observedMetrics", {}).get(OBSERVED) or {}
    rows, published = seen.get("feature_rows") or 0, seen.get("published_ms") or 0
    return {
        "query": progress.get("name"), "run": progress["runId"], "batch": progress["batchId"], "started_ms": started, "trigger_ms": took, "input_rows": progress["numInputRows"],
        "rows_per_s": progress.get("processedRowsPerSecond"), "lag": lag(progress), "feature_rows": rows, "freshness_s": (started + took - published) / 1000 if rows and published > 0 else None,
    }


class MetricsListener(StreamingQueryListener):
    """Keeps the progress of a session's streams as a table under ``root``. Rows are written ``each`` at a time and when a stream ends, as one small file by way of Hadoop's
    file system: a listener starts no job. Spark counts a progress entry's rows as tasks compute them, so twice where an executor is lost and its part computed again;
    ``settle`` puts what was committed in their place."""

    def __init__(self, spark: SparkSession, root: str, each: int = 60):
        self.spark, self.root, self.each = spark, root.rstrip("/"), each
        self._rows: list[dict] = []
        self._lock, self._ended = threading.Lock(), {}

    def onQueryStarted(self, event) -> None:
        self._end(str(event.runId))

    def onQueryProgress(self, event) -> None:
        with self._lock:
            self._rows.append(metrics_row(json.loads(event.progress.json)))
            if len(self._rows) >= self.each:
                self._write()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self._write()
        self._end(str(event.runId)).set()

    def _end(self, run: str) -> threading.Event:
        return self._ended.setdefault(run, threading.Event())

    def _write(self) -> None:
        if self._rows:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{uuid.uuid4().hex}.json")
            out = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(path, False)
            try:
                out.write(bytearray("\n".join(map(json.dumps, self._rows)).encode()))
            finally:
                out.close()
            self._rows = []

    def wait(self, query, seconds: float = 60.0) -> bool:
        """Whether the ended stream's last rows are in the table; listeners are told after a stream's end."""
        return self._end(str(query.runId)).wait(seconds)

    def settle(self, query, committed: DataFrame) -> None:
        """committed: batch, input_rows and feature_rows of the ended stream's micro-batches, from what they left (``engine.taken``, ``FeatureStore.made``)."""
        rows = committed.select("batch", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _SETTLED])
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.root}-settled/run={query.runId}")  # one row a micro-batch

    def table(self) -> DataFrame:
        """One row a micro-batch; a stream's micro-batch that was told twice counts once. Rows are those committed, where the stream was settled."""
        told = self.spark.read.schema(METRICS).json(self.root).dropDuplicates(["run", "batch"])
        if not exists(self.spark, f"{self.root}-settled"):
            return told
        right = self.spark.read.schema(f"batch long, {', '.join(f'{c} long' for c in _SETTLED)}, run string").parquet(f"{self.root}-settled")
        right = right.withColumnsRenamed({c: f"right_{c}" for c in _SETTLED})
        rows = told.join(right, ["run", "batch"], "left").withColumns({c: F.coalesce(f"right_{c}", c) for c in _SETTLED})
        none = F.col("right_feature_rows").eqNullSafe(F.lit(0))  # then there is no freshness, whatever was computed
        return rows.withColumn("freshness_s", F.when(~none, F.col("freshness_s"))).select(*told.columns)


class ShadowSink:
    """The sink of a second computation of a log (a stream of changes, ``engine.start(..., changelog=True)``). At each of its micro-batches the rows that the store serves are
    compared with its own, and what was found is kept as a table; nobody has to call. It keeps the last rows of each entity, one row a partition, and no more.

    first_offset: where the shadow's log begins; after offset 0, results count when each partition has seen enough event time."""

    def __init__(self, spark: SparkSession, root: str, stored_latest: Callable[[], DataFrame], first_offset: int = 0):
        self.spark, self.root, self.stored_latest, self.first_offset = spark, root.rstrip("/"), stored_latest, first_offset
        self.manifest = Manifest(spark, self.root)

    def sink(self, batch: DataFrame, number: int) -> None:
        """A repeated micro-batch begins from the state before it again."""
        state = self.manifest.read()
        before = state.get("before") if state.get("batch") == number else state.get("now")
        batch, now = batch.persist(), uuid.uuid4().hex
        try:
            rows = batch.where("kind = 'feature'").drop("kind", "batch_offset", "trigger_publish_ms", "start_ms", "count", "fare_cents", "distance_milli", "max_event_time_ms", "closed_until_ms", "late_dropped", "events")
            marks = batch.where("kind = 'state'").select("partition", F.col("closed_until_ms").alias("first_ms"), "closed_until_ms", "events")
            if before:
                rows = self._part(before, "rows").unionByName(rows)
                marks = self._part(before, "marks").unionByName(marks)
            last_n(rows, SHADOW_ROWS).drop("nth").write.parquet(f"{self.root}/rows-{now}")
            marks = marks.groupBy("partition").agg(F.min("first_ms").alias("first_ms"), F.max("closed_until_ms").alias("closed_until_ms"), F.max("events").alias("events"))
            marks.coalesce(1).write.parquet(f"{self.root}/marks-{now}")  # one row a log partition
        finally:
            batch.unpersist()
        self._check(now, number)
        self.manifest.publish({"batch": number, "before": before, "now": now})
        for old in {state.get("before"), state.get("now")} - {before, None}:  # no step can begin from it any more
            for part in ("rows", "marks"):
                delete(self.spark, f"{self.root}/{part}-{old}")

    def _part(self, name: str, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{part}-{name}")

    def _check(self, now: str, number: int) -> None:
        early = F.col("closed_until_ms") - F.col("first_ms") < WARM_UP_MS if self.first_offset > 0 else F.lit(False)
        seen = self._part(now, "marks").agg(F.coalesce(F.max(early), F.lit(False)).alias("warming_up"), F.coalesce(F.sum("events"), F.lit(0)).alias("events")).first()
        found = shadow_check(self.stored_latest(), self._part(now, "rows"), SHADOW_ROWS).first()
        pending, bad, checked = found["pending"], found["bad"], found["checked"]
        if seen["warming_up"]:  # a row that is not there is still to come; nothing counts
            pending, bad, checked = pending + checked, 0, 0  # the bad ones are among the checked
        row = (int(time.time() * 1000), checked, bad, pending, seen["warming_up"], seen["events"])
        self.spark.createDataFrame([row], CHECKS).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/checks/batch={number}")

    def checks(self) -> DataFrame:
        """One row a micro-batch of the shadow: rows checked, bad ones, and those it has not reached."""
        return self.spark.read.schema(f"{CHECKS}, batch long").parquet(f"{self.root}/checks")

    def totals(self) -> DataFrame:
        """Over all micro-batches, without those of the warm-up."""
        return self.checks().where("not warming_up").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}") for c in ("checked", "bad")], F.max(F.when(F.col("bad") > 0, F.col("at_ms"))).alias("last_bad_ms"))
