"""A synthetic trip source for batch and streams: exponential gaps, Zipf or even zones, log-normal distances, linear fares.

Rows are a function of (seed, partition, row number), so a lost task makes the same rows again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "event_time_ms long, zone int, fare_cents long, distance_milli long, publish_ms long, partition int, offset long"
_STEP = 8192


def rows(seed: int, partition: int, start: int, stop: int, begin_ms: int, per_minute: float, zipf: float, zones: int) -> tuple[np.ndarray, ...]:
    """Rows [start, stop) of a partition, made in fixed blocks."""
    out: list[np.ndarray] = []
    weight = np.arange(1, zones + 1, dtype=float) ** -zipf if zipf > 1 else np.ones(zones)
    share = np.cumsum(weight / weight.sum())
    for block in range(start // _STEP, max(start, stop - 1) // _STEP + 1):
        r = np.random.default_rng([seed, partition, block])
        # a block begins where its expected time lies, so that any block can be made alone
        gaps = r.exponential(60_000 / per_minute, _STEP)
        t = begin_ms + block * _STEP * 60_000 / per_minute + np.cumsum(gaps) * (_STEP * 60_000 / per_minute) / gaps.sum()
        zone = np.minimum(np.searchsorted(share, r.random(_STEP)), zones - 1) + 1
        miles = np.exp(0.8 * r.normal(size=_STEP) + 0.6)
        fare = 3 + 2.8 * miles + 3 * r.random(_STEP)
        out.append(np.stack([np.trunc(t), zone, np.trunc(fare * 100), np.trunc(miles * 1000), np.arange(block * _STEP, (block + 1) * _STEP)]).astype(np.int64))
    got = np.concatenate(out, axis=1) if out else np.zeros((5, 0), np.int64)
    keep = (got[4] >= start) & (got[4] < stop)
    return tuple(got[:, keep])


class _Options:
    def __init__(self, options: dict):
        get = lambda k, d: type(d)(options.get(k, d))
        self.events, self.seed, self.partitions = get("events", 1000), get("seed", 1), get("partitions", 6)
        self.begin_ms, self.per_minute, self.zipf, self.zones = get("begin_ms", 1_704_067_200_000), get("per_minute", 6000.0), get("zipf", 1.1), get("zones", 263)
        self.batch = get("batch", 1000)

    def make(self, partition: int, start: int, stop: int) -> pa.RecordBatch:
        t, zone, fare, miles, n = rows(self.seed, partition, start, stop, self.begin_ms, self.per_minute / self.partitions, self.zipf, self.zones)
        return pa.RecordBatch.from_arrays(
            [pa.array(t), pa.array(zone.astype(np.int32)), pa.array(fare), pa.array(miles), pa.array(np.zeros_like(t)), pa.array(np.full(len(t), partition, np.int32)), pa.array(n)],
            ["event_time_ms", "zone", "fare_cents", "distance_milli", "publish_ms", "partition", "offset"],
        )

    def share(self, partition: int) -> int:
        return self.events // self.partitions + (partition < self.events % self.partitions)


class _Slice(InputPartition):
    def __init__(self, partition: int):
        self.partition = partition


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = _Options(options)

    def partitions(self) -> list[InputPartition]:
        return [_Slice(p) for p in range(self.o.partitions)]

    def read(self, part: _Slice) -> Iterator[pa.RecordBatch]:
        n = self.o.share(part.partition)
        for at in range(0, n, _STEP):
            yield self.o.make(part.partition, at, min(n, at + _STEP))


class _Range(InputPartition):
    def __init__(self, partition: int, start: int, stop: int):
        self.partition, self.start, self.stop = partition, start, stop


class _StreamReader(DataSourceStreamReader):
    """``batch`` rows of each partition a micro-batch, until ``events`` are made."""

    def __init__(self, options: dict):
        self.o = _Options(options)
        self.row = 0

    def initialOffset(self) -> dict:
        return {"row": 0}

    def latestOffset(self) -> dict:
        self.row = min(self.row + self.o.batch, max(self.o.share(p) for p in range(self.o.partitions)))
        return {"row": self.row}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.row = max(self.row, end["row"])  # after a restart, go on from the checkpoint
        return [_Range(p, start["row"], min(end["row"], self.o.share(p))) for p in range(self.o.partitions)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if part.start < part.stop:
            yield self.o.make(part.partition, part.start, part.stop)

    def commit(self, end: dict) -> None:
        pass


class Synthetic(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemill_synthetic"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Synthetic)
