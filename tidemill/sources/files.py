"""File sources and sinks: raw trips, operation histories, compact trip files, zone tables, result folders."""

from __future__ import annotations

import gzip
import json
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas
from ..operators.ordering import numbered

#: Trips of a compact file at most.
FILE_TRIPS = 1 << 17


def read_raw_trips(spark: SparkSession, path: str) -> DataFrame:
    """The four columns of a monthly trip file; Parquet reads no others."""
    return spark.read.schema(schemas.RAW_TRIPS).parquet(path).select("tpep_pickup_datetime", "PULocationID", "fare_amount", "trip_distance")


def write_ops(ops: DataFrame, path: str) -> None:
    """An operation history as compressed JSON lines."""
    ops.write.mode("overwrite").option("compression", "gzip").json(path)


def read_ops(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.OPS).json(path)


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """Zone id, borough and name; the table is a fixed, small dimension."""
    return spark.read.schema("LocationID int, Borough string, Zone string, service_zone string").csv(path, header=True)


def with_zone_names(rows: DataFrame, zones: DataFrame) -> DataFrame:
    names = zones.select(F.col("LocationID").alias("zone"), F.col("Zone").alias("zone_name"), F.col("Borough").alias("borough"))
    return rows.join(names, "zone", "left").fillna("", ["zone_name", "borough"])


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of JSON results; missing numbers are 0."""
    return spark.read.schema(schema).json(path).fillna(0)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A bounded log kept as Parquet files with partition and offset."""
    return spark.read.schema(schemas.TRIPS).parquet(path)


def write_log_files(trips: DataFrame, path: str) -> None:
    """A log as Parquet files, a folder a partition, where no broker is at hand; times of publishing are kept as they are."""
    trips.select("event_time_ms", "zone", "fare_cents", "distance_milli", "publish_ms", "partition", "offset").write.mode("overwrite").partitionBy("partition").parquet(path)


def starting_offsets(topic: str, headers: DataFrame) -> str:
    """Where to go on after a store's headers (partition, to_offset): the option of the Kafka source. One number a log partition."""
    return json.dumps({topic: {str(r["partition"]): r["to_offset"] + 1 for r in headers.select("partition", "to_offset").collect()}}, sort_keys=True)


def read_kafka(spark: SparkSession, servers: str, topic: str, max_per_trigger: int = 20_000, start: str = "earliest") -> DataFrame:
    """The log as a stream of wire records (needs Spark's Kafka connector on the class path), which the engine decodes where it keeps count of them. It begins at ``start`` (from
    ``starting_offsets``, or the log's beginning) if the query has no checkpoint yet; after that offsets live there."""
    rows = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    rows = rows.option("startingOffsets", start).option("maxOffsetsPerTrigger", max_per_trigger).load()
    return rows.select("partition", "offset", "value")


def wire(trips: DataFrame) -> DataFrame:
    """A log's events as wire records."""
    from .codec import encode

    return trips.select("partition", "offset", encode("event_time_ms", "zone", "fare_cents", "distance_milli", "publish_ms").alias("value"))


def write_kafka(trips: DataFrame, servers: str, topic: str, checkpoint: str):
    """Keyed records; each record's time is the time of publishing."""
    from .codec import encode, key

    rows = trips.select(key("zone").alias("key"), encode("event_time_ms", "zone", "fare_cents", "distance_milli", "publish_ms").alias("value"), F.current_timestamp().alias("timestamp"))
    return rows.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def _varints(data: bytes) -> np.ndarray:
    """All unsigned LEB128 numbers of a byte string."""
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 0x80)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else np.zeros(0, int)
    place = np.arange(int(last[-1]) + 1 if len(last) else 0) - np.repeat(first, last - first + 1)
    value = (raw[: len(place)] & 0x7F).astype(np.int64) << (7 * place)
    return np.add.reduceat(value, first) if len(first) else np.zeros(0, np.int64)


def read_compact(spark: SparkSession, path: str) -> DataFrame:
    """Compact trip files: gzip of an 8-byte little-endian base time (seconds) and, for each trip, four varints: seconds since the
    one before, zone, cents, hundredths of a mile. Files are the unit of work; times are running sums within a file."""

    def decode(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                name, data = name.as_py(), gzip.decompress(content.as_py())
                (base,) = struct.unpack_from("<q", data)
                v = _varints(data[8:]).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(v)), pa.array(np.arange(len(v))), pa.array((base + np.cumsum(v[:, 0])) * 1000), pa.array(v[:, 1].astype(np.int32)), pa.array(v[:, 2]), pa.array(v[:, 3] * 10)],
                    ["file", "seq", "event_time_ms", "zone", "fare_cents", "distance_milli"],
                )

    files = spark.read.parquet(path) if _is_table(spark, path) else spark.read.format("binaryFile").load(path)
    files = files.select("path", "content")
    return files.mapInArrow(decode, "file string, seq long, event_time_ms long, zone int, fare_cents long, distance_milli long")


def _encoded(values: np.ndarray) -> bytes:
    """Numbers (0 or more) as unsigned LEB128, one after the other."""
    size = np.maximum(1, -(-np.frompyfunc(int.bit_length, 1, 1)(values.astype(object)).astype(np.int64) // 7)) if len(values) else np.zeros(0, np.int64)
    which = np.repeat(np.arange(len(values)), size)
    place = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    more = place < size[which] - 1
    return ((values[which] >> (7 * place) & 0x7F) | np.where(more, 0x80, 0)).astype(np.uint8).tobytes()


def compact(trips: DataFrame, start_ms: int, stop_ms: int) -> DataFrame:
    """Compact files (column ``content``) of the trips of each day in [start, stop): one a day, or where a day has more than FILE_TRIPS trips, as many as it needs, in the order of time."""
    rows = trips.where((F.col("event_time_ms") >= start_ms) & (F.col("event_time_ms") < stop_ms)).withColumn("day", F.floor(F.col("event_time_ms") / 86_400_000))
    rows = numbered(rows, ["day"], "event_time_ms", 60_000, "nth", "zone").withColumn("part", F.floor(F.col("nth") / FILE_TRIPS))
    rows = rows.select("day", "part", "event_time_ms", "zone", F.floor(F.col("event_time_ms") / 1000).alias("s"), "fare_cents", F.floor(F.col("distance_milli") / 10).alias("d"))

    def encode(group: pa.Table) -> pa.Table:
        t = group.sort_by([("event_time_ms", "ascending"), ("zone", "ascending")])
        s, zone, cents, d = (t.column(c).to_numpy().astype(np.int64) for c in ("s", "zone", "fare_cents", "d"))
        numbers = np.stack([np.diff(s, prepend=s[0]), zone, cents, d], axis=1).ravel()
        content = struct.pack("<q", int(s[0])) + _encoded(numbers)
        key = {c: pa.array([t.column(c)[0].as_py()], pa.int64()) for c in ("day", "part")}
        return pa.table(key | {"content": pa.array([gzip.compress(content, mtime=0)], pa.binary())})

    return rows.groupBy("day", "part").applyInArrow(encode, "day long, part long, content binary")


def write_compact(trips: DataFrame, start_ms: int, stop_ms: int, path: str) -> None:
    """The compact files of ``compact`` in a table folder, one row a file, as ``read_compact`` takes them besides loose files."""
    compact(trips, start_ms, stop_ms).select(F.concat_ws("-", "day", "part").alias("path"), "content").write.mode("overwrite").parquet(path)


def _is_table(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
