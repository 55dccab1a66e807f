"""Serving of latest rows: batch requests, cache splits, and a small in-process service."""

from __future__ import annotations

import json
import re
import threading
import time
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BREAKER_S, BUCKET_MS, CACHE_TTL_S, DEFAULT_DEADLINE_S, ENTITY_MAX, ENTITY_MIN, MAX_DEADLINE_S, MAX_ENTITIES, REACH, VIEW
from ..views import ZONE_DEMAND, FeatureView
from .kv import idempotent_apply, merge_buckets
from .windows import derive
from .windows import latest as latest_row


class ServingError(Exception):
    """A request that gets no answer."""


class InvalidRequest(ServingError, ValueError):
    """A request that is not served."""


class NotFound(InvalidRequest):
    """A feature view that does not exist."""


class DeadlineExceeded(ServingError):
    """A read that took too long."""


class Unavailable(ServingError):
    """A read that failed."""


def serve(requests: DataFrame, latest: DataFrame, view: FeatureView = ZONE_DEMAND) -> DataFrame:
    """Each request's entities in request order, repeats included, with their derived features; found is false on a miss.

    requests: request_id, ids (array of entity ids)."""
    asked = requests.select("request_id", F.posexplode("ids").alias("pos", "zone"))
    rows = derive(latest, view).withColumn("found", F.lit(True))
    return asked.join(rows, "zone", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def cache_split(requests: DataFrame, cached: DataFrame) -> DataFrame:
    """Distinct entities of each request and whether the cache has them."""
    asked = requests.select("request_id", F.explode(F.array_distinct("ids")).alias("zone"))
    return asked.join(cached.select("zone", F.lit(True).alias("hit")).distinct(), "zone", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def zone_features(latest: DataFrame, zones: list[int]) -> DataFrame:
    """Latest rows of the named entities; an empty list means all, in order."""
    return latest.orderBy("zone") if not zones else latest.where(F.col("zone").isin(zones))


def parse_ids(ids: list[str], low: int = ENTITY_MIN, high: int = ENTITY_MAX) -> list[int]:
    """Entity ids of a request, in order and with repeats: optional sign and ASCII digits."""
    if not 1 <= len(ids) <= MAX_ENTITIES:
        raise InvalidRequest(f"1 to {MAX_ENTITIES} entities, got {len(ids)}")
    out = []
    for text in ids:
        if not re.fullmatch(r"[+-]?[0-9]{1,18}", str(text)) or not low <= int(text) <= high:
            raise InvalidRequest(f"entity id {text!r} is not in {low}..{high}")
        out.append(int(text))
    return out


class DictCache:
    """A cache in this process: rows by entity until their time is over."""

    def __init__(self) -> None:
        self._rows: dict[int, tuple[float, dict]] = {}
        self._lock = threading.Lock()

    def get(self, zones: list[int]) -> dict[int, dict]:
        now = time.monotonic()
        with self._lock:
            return {z: e[1] for z in zones if (e := self._rows.get(z)) and e[0] > now}

    def put(self, rows: dict[int, dict], ttl_s: dict[int, float]) -> None:
        now = time.monotonic()
        with self._lock:
            self._rows.update({z: (now + ttl_s[z], r) for z, r in rows.items()})

    def invalidate(self, zones: list[int]) -> None:
        with self._lock:
            for z in zones:
                self._rows.pop(z, None)


class FeatureService:
    """Reads latest rows: through a cache with bounded staleness, or, where a fresh read is asked for, from the table alone.

    ``latest`` returns the current table when called. Rows read for a cached request are cached for the time to live, less up to a
    fifth of it; equal misses at one time share one read. After a cache failure the cache is left alone for a while: only the latency
    changes. A read that is not done by the deadline raises ``DeadlineExceeded``, one that fails ``Unavailable``.
    """

    def __init__(self, latest: Callable[[], DataFrame], ttl_s: float = CACHE_TTL_S, high: int = ENTITY_MAX, cache: object | None = None, breaker_s: float = BREAKER_S, deadline_s: float = DEFAULT_DEADLINE_S, longest_s: float = MAX_DEADLINE_S):
        self.latest, self.ttl_s, self.high, self.breaker_s, self.deadline_s, self.longest_s = latest, ttl_s, high, breaker_s, deadline_s, longest_s
        self.cache = DictCache() if cache is None else cache
        self._reads: dict[tuple[int, ...], Future] = {}
        self._lock = threading.Lock()
        self._broken_until = 0.0
        self._pool = ThreadPoolExecutor(max_workers=16, thread_name_prefix="feature-reads")

    def get(self, ids: list[str], view: str = VIEW, fresh: bool = False, deadline_s: float | None = None) -> dict:
        until = time.monotonic() + min(self.deadline_s if deadline_s is None else deadline_s, self.longest_s)
        if view not in ("", VIEW):
            raise NotFound(f"unknown feature view {view!r}")
        asked = parse_ids(ids, high=self.high)
        distinct = list(dict.fromkeys(asked))
        cached = not fresh and time.monotonic() >= self._broken_until
        rows = self._guarded(lambda: self.cache.get(distinct)) if cached else None
        cached, rows = rows is not None, rows or {}
        hits = len(rows)
        if misses := [z for z in distinct if z not in rows]:
            rows = rows | (self._shared if cached else self._alone)(tuple(misses), until)
        source = "leader" if not hits else "cache" if hits == len(distinct) else "both"
        out = [{"entity_id": str(i), "found": z in rows} | rows.get(z, {}) for i, z in zip(ids, asked, strict=True)]
        return {"rows": out, "served_from": source, "staleness_bound_s": self.ttl_s if hits else 0.0}

    def get_json(self, zones: str, mode: str = "") -> tuple[int, str]:
        """A read as a web endpoint answers it: status and JSON text. zones: ids with commas between; mode: linearizable, or anything else."""
        try:
            return 200, json.dumps(self.get(zones.split(","), fresh=mode == "linearizable"))
        except ServingError as error:
            return 503, json.dumps({"error": str(error), "code": type(error).__name__})

    def invalidate(self, zones: list[int]) -> None:
        """Rows that a commit replaced go. A lost call is bounded by the time to live."""
        self._guarded(lambda: self.cache.invalidate(zones))

    def _guarded(self, call: Callable):
        """What a cache call returns; None if it fails, and the cache is left alone."""
        try:
            return call()
        except Exception:
            self._broken_until = time.monotonic() + self.breaker_s
            return None

    def _read(self, zones: tuple[int, ...]) -> dict[int, dict]:
        rows = derive(zone_features(self.latest(), list(zones))).toLocalIterator()  # as many rows as were asked for
        return {r["zone"]: {k: v for k, v in r.asDict().items() if k != "zone"} | {"as_of_ms": r["window_end_ms"]} for r in rows}

    def _alone(self, zones: tuple[int, ...], until: float) -> dict[int, dict]:
        return self._wait(self._pool.submit(self._read, zones), until)

    def _shared(self, zones: tuple[int, ...], until: float) -> dict[int, dict]:
        with self._lock:
            read = self._reads.get(zones)
            if read is None:
                read = self._reads[zones] = self._pool.submit(self._fill, zones)
        return self._wait(read, until)

    def _fill(self, zones: tuple[int, ...]) -> dict[int, dict]:
        try:
            rows = self._read(zones)
            if rows:
                self._guarded(lambda: self.cache.put(rows, {z: self.ttl_s * (1 - 0.2 * ((k * 37) % 100) / 100) for k, z in enumerate(rows)}))
            return rows
        finally:
            with self._lock:
                self._reads.pop(zones, None)

    @staticmethod
    def _wait(read: Future, until: float) -> dict[int, dict]:
        try:
            return read.result(timeout=max(0.0, until - time.monotonic()))
        except TimeoutError:
            raise DeadlineExceeded("the read did not finish before the deadline") from None
        except Exception as error:
            raise Unavailable(str(error)) from error


class TableStore:
    """The calls of a table service over frames: apply a batch, one partition's state, latest rows, totals."""

    def __init__(self, batches: DataFrame, buckets: DataFrame, features: DataFrame):
        self.batches, self.buckets, self.features = batches, buckets, features

    def propose(self, batch: DataFrame, buckets: DataFrame, features: DataFrame) -> TableStore:
        """The store after a batch. Whether it is applied is decided when the tables are read (idempotent by partition and to_offset)."""
        return TableStore(self.batches.unionByName(batch), self.buckets.unionByName(buckets), self.features.unionByName(features))

    def _applied(self) -> DataFrame:
        return idempotent_apply(self.batches).where("applied")

    def partition_state(self, partition: int) -> tuple[DataFrame, DataFrame]:
        """The header of the partition's last applied batch, and its buckets."""
        mine = self._applied().where(F.col("partition") == partition)
        head = mine.groupBy("partition").agg(F.max("to_offset").alias("to_offset"), F.max("closed_until_ms").alias("closed_until_ms"))
        kept = merge_buckets(self.batches, self.buckets, REACH * BUCKET_MS)
        return head, kept.where(F.col("partition") == partition)

    def zone_features(self, zones: list[int]) -> DataFrame:
        rows = self.features.join(self._applied().select("partition", "arrival"), ["partition", "arrival"], "left_semi").drop("partition", "arrival")
        return zone_features(latest_row(rows), zones)

    def status(self) -> DataFrame:
        """Applied and repeated batches, and the last offset, of each partition."""
        rows = idempotent_apply(self.batches)
        return rows.groupBy("partition").agg(F.count_if("applied").alias("applied"), F.count_if(~F.col("applied")).alias("repeated"), F.max("to_offset").alias("to_offset"))
