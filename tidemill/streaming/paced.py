"""Paced replay: a stored log is published as if it happened now, event time running so many times faster than the clock, or so many events a second.

What is due at a moment follows from the clock alone, so a step that comes late publishes more and none is lost. The pace may change at any time: it is anchored anew where
the replay then stands, so that a change makes neither a burst nor a pause. The pace has no effect on results.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from ..operators.windows import prefix_max
from ..sources.manifest import Manifest
from ..sources.storage import delete

FASTEST = 100_000.0
_SLOT_MS = 3_600_000


@dataclass(frozen=True)
class Pace:
    """At ``wall_s`` the replay stood at ``at`` (event time in ms, or with ``by_rate`` a number of events); since then it moves ``speed`` times as fast as the clock, or
    ``speed`` events a second. 0: all is due at once."""

    speed: float
    at: float
    wall_s: float
    by_rate: bool = False

    def __post_init__(self):
        if not (0 <= self.speed and (self.by_rate or self.speed <= FASTEST) and math.isfinite(self.speed)):
            raise ValueError(f"a speed lies in 0..{FASTEST:.0f}, a rate is not negative")

    def due(self, now_s: float) -> float:
        """Up to where events are due; a clock that goes back takes nothing back."""
        return math.inf if self.speed == 0 else self.at + max(0.0, now_s - self.wall_s) * self.speed * (1 if self.by_rate else 1000)

    def changed(self, speed: float, now_s: float, done: float) -> Pace:
        """Another speed from now on. Anchored at what is due, or where all was due at once, at what was published."""
        at = self.due(now_s)
        return Pace(speed, done if math.isinf(at) else at, now_s, self.by_rate)


class PacedReplay:
    """Publishes ``log`` into the folder ``path``, which ``engine.read_log_files`` (with ``pattern``) reads as a stream, step by step.

    An event is released when its partition's event time reaches it: late events come with the events around them, so offsets grow within a partition from step to step. The
    log is written once by release time; a step reads its slice of it. Steps are numbered; one that failed is published again with the same bounds, over what it left."""

    def __init__(self, log: DataFrame, path: str, speed: float, by_rate: bool = False, clock: Callable[[], float] = time.time):
        self.spark: SparkSession = log.sparkSession
        self.path, self.clock = path.rstrip("/"), clock
        self.manifest = Manifest(self.spark, f"{self.path}-steps")
        if not self.manifest.read():
            rows = prefix_max(log).withColumn("release", F.greatest("event_time_ms", "before_ms")).select(*log.columns, "release")
            if by_rate:  # the release is the event's number instead
                rows = numbered(rows.withColumn("_all", F.lit(0)), ["_all"], "release", _SLOT_MS, "_nth", "partition", "offset").drop("_all").withColumn("release", F.col("_nth")).drop("_nth")
            rows.repartitionByRange("release").sortWithinPartitions("release").write.mode("overwrite").parquet(f"{self.path}-released")
            ends = self._released().agg(F.min("release").alias("first"), F.max("release").alias("last")).first()
            self.manifest.publish({"step": -1, "first": ends["first"], "last": ends["last"], "through": None, "speed": speed, "at": ends["first"] or 0, "wall_s": clock(), "by_rate": by_rate})

    def _released(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}-released")

    def _pace(self, state: dict) -> Pace:
        return Pace(state["speed"], state["at"], state["wall_s"], state["by_rate"])

    def change(self, speed: float) -> None:
        """Another speed (or rate) from now on."""
        state = self.manifest.read()
        done = state["at"] if state["through"] is None else state["through"]
        pace = self._pace(state).changed(speed, self.clock(), done)
        self.manifest.publish({**state, "speed": pace.speed, "at": pace.at, "wall_s": pace.wall_s})

    def step(self) -> bool:
        """Publishes what is due and was not published. Whether events are left."""
        state = self.manifest.read()
        number, last = state["step"] + 1, state["last"]
        if last is None:
            return False
        if state.get("going") is None:
            through = min(last, math.floor(min(self._pace(state).due(self.clock()), last)))
            state = {**state, "going": through}
            self.manifest.publish(state)  # the bounds are fixed before the events go out
        through, after = state["going"], state["through"]
        if after is None or through > after:
            due = self._released().where((F.col("release") <= through) & (F.col("release") > after if after is not None else F.lit(True))).drop("release")
            due = due.withColumn("publish_ms", F.lit(int(self.clock() * 1000)).cast("long")) if "publish_ms" in due.columns else due
            due.write.mode("overwrite").parquet(f"{self.path}/{number:012d}")
        self.manifest.publish({**state, "step": number, "through": through, "going": None})
        return through < last

    def run(self, every_s: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> None:
        """Steps until all is published."""
        while self.step():
            sleep(every_s)

    def clean(self) -> None:
        """What the replay needs for itself goes; what it published stays."""
        for part in ("released", "steps"):
            delete(self.spark, f"{self.path}-{part}")
