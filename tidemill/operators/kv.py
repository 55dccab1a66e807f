"""The register table: a log of puts and purges, folded; repeated client operations have no effect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CHUNK_EVENTS
from .ordering import earlier, previous


def _epochs(log: DataFrame, column: str) -> DataFrame:
    """Pairs every put with the last purge before it whose prefix its ``column`` has (epoch), and the last of all such purges (last_purge; null: none).

    A put is dealt to those of its prefixes that have a purge's length; puts and purges of one prefix then stand in one stream, in which the
    last purge is carried forward."""
    purges = log.where("op = 'purge' and coalesce(key, '') <> ''").select("index", F.col("key").alias("prefix"))
    puts = log.where("op = 'put'")
    sizes = purges.select(F.array_sort(F.collect_set(F.length("prefix")))).scalar()  # lengths, not purges: no more than the longest key has letters
    cut = puts.select("index", F.col(column).alias("name"), sizes.alias("sizes"))
    cut = cut.select("index", "name", F.explode(F.filter("sizes", lambda n: n <= F.length("name"))).alias("size"))
    cut = cut.select("index", F.expr("substring(name, 1, size)").alias("prefix"), F.lit(None).cast("long").alias("purge_index"))
    cut = cut.join(purges.select("prefix").distinct(), "prefix", "left_semi")
    both = cut.unionByName(purges.select("index", "prefix", F.col("index").cast("long").alias("purge_index")))
    seen = earlier(both, ["prefix"], "index", CHUNK_EVENTS, F.max, "purge_index", "epoch").where("purge_index is null")
    seen = seen.join(purges.groupBy("prefix").agg(F.max("index").alias("last_purge")), "prefix")
    seen = seen.groupBy("index").agg(F.max("epoch").alias("epoch"), F.max("last_purge").alias("last_purge"))
    return puts.join(seen, "index", "left")


def client_dedup(log: DataFrame) -> DataFrame:
    """Each put and whether it is applied: a named client's sequence number must exceed all its earlier ones since its last purge."""
    rows = _epochs(log, "client").withColumns({"_client": F.coalesce("client", F.lit("")), "_epoch": F.coalesce("epoch", F.lit(-1))})
    rows = earlier(rows, ["_client", "_epoch"], "index", CHUNK_EVENTS, F.max, "seq", "before")
    applied = (F.col("_client") == "") | F.col("before").isNull() | (F.col("seq") > F.col("before"))
    return rows.select("index", "client", "seq", "op", "key", "value", applied.alias("applied"))


def kv_fold(log: DataFrame) -> DataFrame:
    """The registers after the whole log: of each key the last applied put, unless a later purge took it."""
    applied = client_dedup(log).where("applied").select("index")
    rows = _epochs(log, "key").join(applied, "index", "left_semi")
    last = rows.groupBy("key").agg(F.max_by(F.struct("index", "value", "last_purge"), "index").alias("r"))
    return last.where(F.col("r.last_purge").isNull() | (F.col("r.last_purge") < F.col("r.index"))).select("key", "r.value", "r.index")


def lookup(registers: DataFrame, key: str) -> DataFrame:
    """One register's value and the index of its put; no row: not found."""
    return registers.where(F.col("key") == key)


def purge_counts(log: DataFrame) -> DataFrame:
    """How many registers each purge takes: those whose last applied put before it has its prefix and was not purged since."""
    applied = client_dedup(log).where("applied").select("index")
    puts = log.where("op = 'put'").join(applied, "index", "left_semi").select("index", "key", F.lit(True).alias("puts"))
    purges = log.where("op = 'purge' and coalesce(key, '') <> ''").select("index", F.col("key").alias("prefix"))
    sizes = purges.select(F.array_sort(F.collect_set(F.length("prefix")))).scalar()
    keys = puts.select("key").distinct().withColumn("sizes", sizes)
    keys = keys.select("key", F.explode(F.filter("sizes", lambda n: n <= F.length("key"))).alias("size"))
    taken = keys.select("key", F.expr("substring(key, 1, size)").alias("prefix")).join(purges, "prefix").select("index", "key", F.lit(False).alias("puts"))
    # along each key, a purge takes the register if a put is the last thing before it
    took = previous(puts.unionByName(taken), ["key"], "index", CHUNK_EVENTS, ["puts"], "before").withColumn("took", ~F.col("puts") & F.coalesce("before.puts", F.lit(False)))
    counts = took.where(~F.col("puts")).groupBy("index").agg(F.count_if("took").alias("purged"))
    return purges.join(counts, "index", "left").select("index", "prefix", F.coalesce("purged", F.lit(0)).alias("purged"))


def idempotent_apply(batches: DataFrame, chunk: int = CHUNK_EVENTS) -> DataFrame:
    """Batches in arrival order and whether each is applied: its to_offset must exceed the partition's."""
    rows = earlier(batches, ["partition"], "arrival", chunk, F.max, "to_offset", "_before")
    return rows.withColumn("applied", F.col("_before").isNull() | (F.col("to_offset") > F.col("_before"))).drop("_before")


def merge_buckets(batches: DataFrame, buckets: DataFrame, reach_ms: int) -> DataFrame:
    """A replica's buckets after all batches. Batches hold changed buckets as absolute values, so of each bucket the last applied one stays;
    buckets that no window to come can reach are evicted.

    batches: partition, arrival, to_offset, closed_until_ms; buckets: partition, arrival, zone, start_ms, count, fare_cents, distance_milli."""
    applied = idempotent_apply(batches).where("applied")
    until = applied.groupBy("partition").agg(F.max("closed_until_ms").alias("closed_until_ms"))
    rows = buckets.join(applied.select("partition", "arrival"), ["partition", "arrival"], "left_semi")
    last = rows.groupBy("partition", "zone", "start_ms").agg(F.max_by(F.struct("count", "fare_cents", "distance_milli"), "arrival").alias("b"))
    kept = last.join(F.broadcast(until), "partition").where(F.col("start_ms") >= F.col("closed_until_ms") - reach_ms)  # one row a log partition
    return kept.select("partition", "zone", "start_ms", "b.count", "b.fare_cents", "b.distance_milli")
