"""Declared feature views.

A view says which sums over which spans of event time an entity has, what follows from them, how wide buckets are and how long events may be late. The closed form
(``operators.windows``), the stream's processor (``streaming.engine``), the schemas of all tables, history, point-in-time joins and serving take everything from it. Events and
buckets are the same for all views, so that views share a log.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions.columns import mean_of, share_of

#: What buckets hold of their events.
FIELDS = ("count", "fare_cents", "distance_milli")
MINUTE_MS = 60_000


@dataclass(frozen=True)
class Total:
    """``field`` of the buckets in the last ``minutes`` before a window's end."""

    name: str
    field: str
    minutes: int


@dataclass(frozen=True)
class Mean:
    """A total in units of ``scale`` for each event that the total ``count`` counts (0 without events)."""

    name: str
    total: str
    count: str
    scale: float

    def column(self) -> Column:
        return mean_of(self.total, self.count, self.scale)


@dataclass(frozen=True)
class Share:
    """A total against a 1/``parts`` of a longer one (0 where that is 0)."""

    name: str
    part: str
    whole: str
    parts: float

    def column(self) -> Column:
        return share_of(self.part, self.whole, self.parts)


@dataclass(frozen=True)
class FeatureView:
    """A view's name, totals and derived values; ``lateness_ms`` and ``bucket_ms`` as its events need them."""

    name: str
    totals: tuple[Total, ...]
    derived: tuple[Mean | Share, ...] = ()
    lateness_ms: int = 30_000
    bucket_ms: int = MINUTE_MS
    sums: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "sums", tuple(t.name for t in self.totals))
        names = ["zone", "window_end_ms", *self.sums, *(d.name for d in self.derived)]
        if not self.totals or len(set(names)) < len(names):
            raise ValueError("a view needs totals, and all its names differ")
        if self.bucket_ms <= 0 or self.lateness_ms < 0:
            raise ValueError("buckets have a width, and lateness is not negative")
        for t in self.totals:
            if t.field not in FIELDS or t.minutes <= 0 or t.minutes * MINUTE_MS % self.bucket_ms:
                raise ValueError(f"{t.name}: buckets hold {FIELDS}, and a span is a number of whole buckets")
        for d in self.derived:
            used = (d.total, d.count) if isinstance(d, Mean) else (d.part, d.whole)
            if not set(used) <= set(self.sums):
                raise ValueError(f"{d.name}: {used} are no totals of the view")

    def span(self, total: Total) -> int:
        """A total's span in buckets."""
        return total.minutes * MINUTE_MS // self.bucket_ms

    @property
    def reach(self) -> int:
        """Buckets that any total reaches back; the age after it makes the one zero row when an entity goes quiet."""
        return max(map(self.span, self.totals))

    @property
    def schema(self) -> str:
        """Of feature rows."""
        return ", ".join(["zone int, window_end_ms long", *(f"{s} long" for s in self.sums)])

    @property
    def history_schema(self) -> str:
        return f"feature_view string, {self.schema}, source_partition int, source_offset long, conflicting_rewrites int"


ZONE_DEMAND = FeatureView(
    "zone_demand_v1",
    (
        Total("trips_5m", "count", 5), Total("trips_30m", "count", 30), Total("trips_60m", "count", 60),
        Total("count_15m", "count", 15), Total("fare_cents_15m", "fare_cents", 15), Total("distance_milli_15m", "distance_milli", 15),
    ),
    (Mean("fare_mean_15m", "fare_cents_15m", "count_15m", 100.0), Mean("distance_mean_15m", "distance_milli_15m", "count_15m", 1000.0), Share("demand_spike_ratio", "trips_5m", "trips_60m", 12.0)),
)
#: A slower view of the same log: wider buckets, longer spans, more patience.
ZONE_TREND = FeatureView(
    "zone_trend_v1",
    (Total("trips_10m", "count", 10), Total("trips_120m", "count", 120), Total("distance_milli_120m", "distance_milli", 120)),
    (Mean("distance_mean_120m", "distance_milli_120m", "trips_120m", 1000.0), Share("trend_ratio", "trips_10m", "trips_120m", 12.0)),
    lateness_ms=45_000, bucket_ms=2 * MINUTE_MS,
)
