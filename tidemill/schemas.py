"""Explicit schemas; nothing is inferred."""

from .views import ZONE_DEMAND

RAW_TRIPS = "tpep_pickup_datetime timestamp_ntz, PULocationID int, fare_amount double, trip_distance double"
TRIPS = "event_time_ms long, zone int, fare_cents long, distance_milli long, publish_ms long, partition int, offset long"
WIRE = "partition int, offset long, value binary"
BUCKETS = "partition int, zone int, start_ms long, count long, fare_cents long, distance_milli long"
FEATURES = ZONE_DEMAND.schema
HISTORY = ZONE_DEMAND.history_schema
LABELS = "zone int, label_time_ms long, label double"
OPS = "client int, kind string, key string, value string, found boolean, unknown boolean, call_ns long, ret_ns long"
KV_LOG = "index long, client string, seq long, op string, key string, value string"
