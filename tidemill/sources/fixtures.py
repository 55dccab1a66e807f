"""Inputs of the registered queries, derived from the given tables by arithmetic that any engine repeats exactly.

The log and the feature rows are written once a session and then read, as an engine has them: a query then does its operator's work only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import BACKFILL_VIEW, SUMS, VIEW
from ..functions.columns import epoch_ms, scaled
from ..operators import windows
from ..operators.history import upsert
from ..operators.replay import late_injection, route
from .storage import shared_path, stored

PARTITIONS = 6
MONTH = "2024-01"
DAY_MS = 86_400_000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def ordered_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trips, time compressed 60 times, with the log partition of their zone."""
    rows = events(spark, sf_dir).withColumn("ms", epoch_ms("ts"))
    first = rows.select(F.min("ms")).scalar()
    rows = rows.withColumn("event_time_ms", first + F.floor((F.col("ms") - first) / 60)).withColumn("zone", (F.col("user_id") + 1).cast("int"))
    return rows.select(
        "event_id", "event_time_ms", "zone", scaled("value", 100).alias("fare_cents"), (F.get_json_object("props", "$.k").cast("long") * 100).alias("distance_milli"),
        F.lit(0).cast("long").alias("publish_ms"), route("zone", PARTITIONS).alias("partition"), "event_type",
    )


def delay() -> Column:
    """5 % of the events come up to 90 s late."""
    return F.when((F.col("event_id") * 7919) % 1000 < 50, (F.col("event_id") * 104729) % 90001).otherwise(0)


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log: offsets in the order of arrival."""
    return stored(spark, sf_dir, "trips", lambda: late_injection(ordered_trips(spark, sf_dir), delay(), "event_id").drop("event_type"))


def raw_file(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the source's monthly file, with a column that no reader needs."""
    path = shared_path(spark, "raw")
    raw_trips(spark, sf_dir).withColumn("vendor", F.lit("x")).write.parquet(path)
    return path


def raw_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips as the source has them, some of them to be rejected, a few by several rules."""
    rows = ordered_trips(spark, sf_dir)
    bad = lambda n: F.col("event_id") % n == 0
    time = F.timestamp_add("MILLISECOND", F.when(bad(97), F.col("event_time_ms") - 400 * DAY_MS).otherwise(F.col("event_time_ms")), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))
    return rows.select(
        "event_id", time.alias("tpep_pickup_datetime"), F.when(bad(89), 264).otherwise(F.col("zone")).alias("PULocationID"),
        F.when(bad(83), -1.0).otherwise(F.col("fare_cents") / 100.0).alias("fare_amount"), F.when(bad(79), 101.0).otherwise(F.col("distance_milli") / 1000.0).alias("trip_distance"),
    )


def dup_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth offset is delivered again, five arrivals later."""
    rows = trips(spark, sf_dir)
    again = rows.where(F.col("offset") % 10 == 0)
    return rows.withColumn("arrival", F.col("offset") * 10).unionByName(again.withColumn("arrival", F.col("offset") * 10 + 51))


def gap_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips(spark, sf_dir).where(F.col("offset") % 50 != 7)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All feature rows of the log."""
    return stored(spark, sf_dir, "features", lambda: windows.zone_features(trips(spark, sf_dir)))


def as_history(rows: DataFrame, view: str) -> DataFrame:
    """Feature rows as rows of the history table."""
    return rows.select(
        F.lit(view).alias("feature_view"), "zone", "window_end_ms", *SUMS, F.col("partition").alias("source_partition"), F.col("window_end_ms").alias("source_offset"), F.lit(0).alias("conflicting_rewrites")
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_history(features(spark, sf_dir), VIEW)


def minute() -> Column:
    return F.floor(F.col("window_end_ms") / 60_000)


def history_bad(spark: SparkSession, sf_dir: str, view: str = BACKFILL_VIEW) -> DataFrame:
    """History with some sums changed and some rows missing."""
    rows = history(spark, sf_dir).where((F.col("zone") + minute()) % 1013 != 0)
    return rows.withColumn("trips_5m", F.col("trips_5m") + F.when((F.col("zone") + minute()) % 1009 == 0, 1).otherwise(0)).withColumn("feature_view", F.lit(view))


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second minute stored, then the damaged rows written over it."""
    stored = history(spark, sf_dir).where(minute() % 2 == 0)
    return upsert(stored, history_bad(spark, sf_dir, VIEW).drop("conflicting_rewrites"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels for every fifth minute 90 s after the row, a seventh of them 200 minutes after, one before any row."""
    rows = features(spark, sf_dir).where(minute() % 5 == 0)
    late = F.when((F.col("zone") + minute()) % 7 == 0, 200 * 60_000).otherwise(90_000)
    early = rows.groupBy("zone").agg(F.min("window_end_ms").alias("w")).select("zone", (F.col("w") - 10 * DAY_MS).alias("label_time_ms"), F.lit(None).cast("double").alias("label"))
    return rows.select("zone", (F.col("window_end_ms") + late).alias("label_time_ms"), (F.col("trips_5m") % 2).cast("double").alias("label")).unionByName(early)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests, one for every 25 events, with repeats and an entity that does not exist."""
    rows = events(spark, sf_dir).select(F.floor(F.col("event_id") / 25).alias("request_id")).distinct()
    ids = F.transform(F.sequence(F.lit(0), (F.col("request_id") % 9).cast("int")), lambda i: ((F.col("request_id") * 7 + i * 13) % 41 + 1).cast("int"))
    return rows.select("request_id", F.concat(ids, F.array(F.lit(999_999), (F.col("request_id") % 40 + 1).cast("int"), (F.col("request_id") % 40 + 1).cast("int"))).alias("ids"))


def kv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as commands: every 13th sequence number is repeated; every 500th command purges a key's or a client's prefix."""
    rows = events(spark, sf_dir)
    purge = F.col("event_id") % 500 == 499
    client = F.concat(F.lit("c"), (F.col("user_id") % 7).cast("string"))
    nth = F.row_number().over(W.partitionBy("client").orderBy("index"))
    rows = rows.select(
        F.col("event_id").alias("index"), client.alias("client"), F.when(purge, "purge").otherwise("put").alias("op"),
        F.when(purge & (F.col("event_id") % 1000 == 999), F.concat(F.lit("c"), (F.col("event_id") % 7).cast("string"))).when(purge, F.substring("event_type", 1, 2)).otherwise(F.concat_ws("-", "event_type", (F.col("user_id") % 50).cast("string"))).alias("key"),
        F.col("event_id").cast("string").alias("value"),
    ).withColumn("nth", nth)
    return rows.select("index", "client", (F.col("nth") - F.when(F.col("nth") % 13 == 0, 1).otherwise(0)).cast("long").alias("seq"), "op", "key", "value")


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An operation history: puts and gets with latencies from ``value``."""
    rows = events(spark, sf_dir)
    first = rows.select(F.min(epoch_ms("ts"))).scalar()
    call = (epoch_ms("ts") - first) * 1000
    put = F.col("event_id") % 2 == 0
    unknown = put & (F.col("event_id") % 101 == 0)
    return rows.select(
        (F.col("user_id") % 32).cast("int").alias("client"), F.when(put, "put").otherwise("get").alias("kind"), F.col("event_type").alias("key"), F.col("event_id").cast("string").alias("value"),
        (F.col("event_id") % 3 != 0).alias("found"), unknown.alias("unknown"), call.alias("call_ns"), F.when(unknown, -1).otherwise(call + scaled("value", 1000)).cast("long").alias("ret_ns"),
    )


def faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults spread over the history's time, one for every 400 events."""
    rows = events(spark, sf_dir).select(F.floor(F.col("event_id") / 400).alias("fault_id")).distinct()
    return rows.select("fault_id", (F.col("fault_id") * 97.5 + 3.25).alias("at_s"))


def fault_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event log's lines: every third is a fault, every seventh of them too short."""
    rows = events(spark, sf_dir).select("event_id", epoch_ms("ts").alias("ms"), "event_type")
    word = F.when(F.col("event_id") % 3 == 0, "FAULT").otherwise("INFO")
    return rows.select(F.concat_ws(" ", F.col("ms").cast("string"), word, F.when(F.col("event_id") % 7 != 0, F.concat(F.col("event_type"), F.lit("  of "), (F.col("event_id") % 5).cast("string")))).alias("line"))


def cpu_samples(spark: SparkSession, sf_dir: str, moment: int) -> DataFrame:
    """Processor seconds of containers (users) by run (day); some containers are in one of the two samples only."""
    rows = events(spark, sf_dir).select(F.floor(epoch_ms("ts") / DAY_MS).cast("int").alias("run"), F.col("user_id").alias("u"), scaled("value", 100).alias("v"))
    rows = rows.groupBy("run", "u").agg(F.sum("v").alias("v"))
    return rows.select("run", F.concat(F.lit("c"), F.col("u") + 40 * moment).alias("name"), (F.col("v") * (moment + 1) / 100).alias("cpu_s"))


def bench_files(spark: SparkSession, sf_dir: str, after: bool) -> DataFrame:
    """Serving results by file name; the two sides share some of the names."""
    rows = events(spark, sf_dir)
    name = F.concat_ws("-", F.lit("serve"), "event_type", (F.col("user_id") % (23 if after else 20)).cast("string"))
    return rows.groupBy(name.alias("file")).agg(F.count("*").alias("requests"), F.max("value").alias("max_ms"))


def check_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of checks by user: their operations, and what was found."""
    rows = events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("ops"))
    return rows.select("ops", F.when(F.col("user_id") % 10 == 3, "unknown").otherwise("ok").alias("result"))


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events so far of each type by hour, reset after the tenth day."""
    rows = events(spark, sf_dir).select("event_type", F.floor(epoch_ms("ts") / 3_600_000).alias("hour"))
    rows = rows.groupBy("event_type", "hour").agg(F.count("*").alias("n"))
    epoch = F.floor(F.col("hour") / 240)
    total = F.sum("n").over(W.partitionBy("event_type", epoch).orderBy("hour"))
    return rows.select("event_type", "hour", (F.col("hour") * 3600).alias("t_s"), total.alias("total"))


def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_type", F.col("value").alias("ms"), F.when(F.col("event_id") % 50 == 0, "deadline").otherwise("ok").alias("code"), F.floor(epoch_ms("ts") / 1000).alias("sec"))


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative exponential buckets of ``value`` by type; the last has no bound."""
    edges = F.array(*[F.lit(float(1 << k)) for k in range(9)], F.lit(None).cast("double"))
    rows = events(spark, sf_dir).select("event_type", "value", F.explode(edges).alias("le"))
    return rows.groupBy("event_type", "le").agg(F.count_if(F.col("le").isNull() | (F.col("value") <= F.col("le"))).alias("n"))


def scrapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative buckets of ``value`` by type and scrape, every 15 s of compressed time in which an event came; all counters are reset every 37 scrapes."""
    rows = events(spark, sf_dir).withColumn("ms", epoch_ms("ts"))
    first = rows.select(F.min("ms")).scalar()
    edges = F.array(*[F.lit(float(4 << k)) for k in range(0, 7, 2)], F.lit(None).cast("double"))
    rows = rows.select("event_type", "value", F.floor((F.col("ms") - first) / 60 / 15_000).alias("nth"), F.explode(edges).alias("le"))
    rows = rows.groupBy("event_type", "le", "nth").agg(F.count_if(F.col("le").isNull() | (F.col("value") <= F.col("le"))).alias("n"))
    along = W.partitionBy("event_type", "le", F.floor(F.col("nth") / 37)).orderBy("nth")
    return rows.select("event_type", "le", (F.col("nth") * 15_000).alias("t_ms"), F.sum("n").over(along).alias("total"))
