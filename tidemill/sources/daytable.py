"""The history laid out by time: a folder for each view and day of window ends.

A write touches the days that its rows lie in and no others: their folders are written anew beside the old ones (copy on write) and take effect together, by a manifest.
A range scan reads the folders of the days that the range meets. Versions that no kept manifest names are removed by the next write.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import DAY_MS, upsert
from ..views import ZONE_DEMAND, FeatureView
from .manifest import Manifest
from .storage import delete


def day(window_end: str = "window_end_ms") -> Column:
    return F.floor(F.col(window_end) / DAY_MS).cast("int")


class DayTable:
    """History rows of views of one definition under ``root``/feature_view=V/day=D/version=U."""

    def __init__(self, spark: SparkSession, root: str, definition: FeatureView = ZONE_DEMAND):
        self.spark, self.root, self.manifest, self.definition = spark, root.rstrip("/"), Manifest(spark, root), definition
        self.columns = [c.split()[0] for c in definition.history_schema.split(", ")]

    def _folder(self, view: str, number: int | str, version: str) -> str:
        return f"{self.root}/feature_view={view}/day={number}/version={version}"

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], f"{self.definition.history_schema}, day int, version string")
        own = ", ".join(c for c in self.definition.history_schema.split(", ") if not c.startswith("feature_view "))
        return self.spark.read.schema(f"{own}, feature_view string, day int, version string").option("basePath", self.root).parquet(*paths)

    def rows(self, view: str | None = None, start_ms: int | None = None, stop_ms: int | None = None) -> DataFrame:
        """The rows of a view (None: all) with window ends in [start, stop); only the folders of those days are opened."""
        days = self.manifest.read().get("days", {})
        low = start_ms // DAY_MS if start_ms is not None else None
        high = (stop_ms - 1) // DAY_MS if stop_ms is not None else None
        wanted = lambda d: (low is None or int(d) >= low) and (high is None or int(d) <= high)
        found = self._read([self._folder(v, d, u) for v, own in sorted(days.items()) if view in (None, v) for d, u in sorted(own.items()) if wanted(d)])
        if view is not None:
            found = found.where(F.col("feature_view") == view)
        if start_ms is not None:
            found = found.where((F.col("day") >= low) & (F.col("window_end_ms") >= start_ms))
        if stop_ms is not None:
            found = found.where((F.col("day") <= high) & (F.col("window_end_ms") < stop_ms))
        return found.select(*self.columns)

    def upsert(self, batch: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame] | None = None, **also) -> list[tuple[str, int]]:
        """Combines the batch with the stored rows of its days (by default as ``history.upsert``) and publishes the days' new versions; ``also`` goes into the manifest with them.
        The days that were written. A failure before the end leaves the table as it was."""
        content = self.manifest.read()
        days = content.get("days", {})
        self._clean(days)
        touched = sorted((r["feature_view"], r["day"]) for r in batch.select("feature_view", day().alias("day")).distinct().collect())  # days, not rows
        for view, _ in touched:
            if not re.fullmatch(r"[\w.-]+", view):
                raise ValueError(f"{view!r} can't name a folder")
        version = uuid.uuid4().hex
        if touched:
            old = self._read([self._folder(v, d, days[v][str(d)]) for v, d in touched if str(d) in days.get(v, {})]).select(*self.columns)
            rows = (combine(old, batch) if combine else upsert(old, batch, self.definition)).select(*self.columns).withColumns({"day": day(), "version": F.lit(version)})
            self._write(rows.hint("rebalance", "feature_view", "day"))  # a large day becomes many files, by its bytes
        days = {v: {**days.get(v, {}), **{str(d): version for w, d in touched if w == v}} for v in {*days, *(v for v, _ in touched)}}
        self.manifest.publish({**content, **also, "days": days})
        return touched

    def _write(self, rows: DataFrame) -> None:
        rows.write.mode("append").partitionBy("feature_view", "day", "version").parquet(self.root)

    def delete_view(self, view: str) -> None:
        content = self.manifest.read()
        content["days"] = {v: d for v, d in content.get("days", {}).items() if v != view}
        self.manifest.publish(content)
        delete(self.spark, f"{self.root}/feature_view={view}")

    def _clean(self, days: dict[str, dict[str, str]]) -> None:
        """Removes versions that the newest manifest doesn't name: what a failed write left, or a later one replaced. Readers that began before have had a whole write's time."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        named = {self._folder(v, d, u) for v, own in days.items() for d, u in own.items()}
        for found in fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, "feature_view=*/day=*/version=*")) or []:
            path = found.getPath()
            view, number, version = (p.split("=", 1)[1] for p in path.toString().rsplit("/", 3)[1:])
            if self._folder(view, number, version) not in named:
                fs.delete(path, True)
