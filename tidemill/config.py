"""Fixed values that results depend on; those of the first feature view follow from its declaration."""

from .views import ZONE_DEMAND

VIEW = ZONE_DEMAND.name
BACKFILL_VIEW = f"{VIEW}__backfill"
BUCKET_MS, LATENESS_MS, REACH, SUMS = ZONE_DEMAND.bucket_ms, ZONE_DEMAND.lateness_ms, ZONE_DEMAND.reach, ZONE_DEMAND.sums
ENTITY_MIN, ENTITY_MAX = 1, 263
FARE_MAX, DISTANCE_MAX = 500.0, 100.0
MIN_TRIPS_FOR_LABEL = 8
LABEL_FACTOR = 1.5
LABEL_AHEAD_MS = 15 * 60_000
MAX_ENTITIES = 300
CACHE_TTL_S = 2.0
#: Deadlines of reads by Spark jobs: where the caller names none, and the longest that a caller may name.
DEFAULT_DEADLINE_S, MAX_DEADLINE_S = 30.0, 120.0
#: How long the cache is left alone after it failed.
BREAKER_S = 1.0
#: How long an unexpected offset is held back for the offsets before it.
GAP_MS = 10_000
#: A recomputation that does not start at offset 0 counts after so much event time.
WARM_UP_MS = 62 * 60_000
#: Latencies are kept with three significant digits: buckets of equal width up to 2^11 microseconds, then twice as wide for each power of two.
LATENCY_BITS, LATENCY_MOST_US = 11, 60_000_000
#: Events of one log partition that a single task orders at once.
CHUNK_EVENTS = 1 << 17

VECTOR = ("trips_5m", "trips_30m", "trips_60m", "fare_mean_15m", "distance_mean_15m", "demand_spike_ratio", "hour_sin", "hour_cos")
