"""Verification: differences between expected and stored rows and states, skew, fingerprints, shadow checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SUMS
from .history import point_in_time
from .ordering import numbered

#: Entities that one task orders at once.
SLOT_ZONES = 16


def oracle_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows that differ, are missing or are extra: one row each with its kind."""
    side = lambda d, name: d.select("zone", "window_end_ms", F.struct(*SUMS).alias(name))
    rows = side(expected, "e").join(side(actual, "a"), ["zone", "window_end_ms"], "full_outer")
    kind = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "extra").when(~F.col("e").eqNullSafe(F.col("a")), "different")
    return rows.select("zone", "window_end_ms", kind.alias("kind")).where("kind is not null")


def state_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Partitions whose state (header and ordered buckets) differs; no buckets and an empty list are the same."""
    columns = ("to_offset", "max_event_time_ms", "closed_until_ms", "late_dropped", "events", "buckets")
    side = lambda d, name: d.select("partition", F.struct(*columns).alias(name))
    rows = side(expected, "e").join(side(actual, "a"), "partition", "full_outer")
    return rows.select("partition", F.col("e").eqNullSafe(F.col("a")).alias("same"), F.size("e.buckets").alias("expected_buckets"), F.size("a.buckets").alias("actual_buckets"))


def skew_check(samples: DataFrame, history: DataFrame, view: str) -> DataFrame:
    """Online samples against the point-in-time row at their own window end."""
    asked = samples.select("zone", F.col("window_end_ms").alias("label_time_ms"), F.lit(None).cast("double").alias("label")).distinct()
    found = point_in_time(asked, history, view).select("zone", F.col("label_time_ms"), F.struct("window_end_ms", *SUMS).alias("h"))
    rows = samples.select("zone", F.col("window_end_ms").alias("label_time_ms"), F.struct("window_end_ms", *SUMS).alias("s")).join(found, ["zone", "label_time_ms"], "left")
    return rows.agg(F.count("*").alias("samples"), F.count_if(F.col("s").eqNullSafe(F.col("h"))).alias("matched"), F.count_if(~F.col("s").eqNullSafe(F.col("h"))).alias("mismatched"))


def sample_rows(features: DataFrame, rounds: int, each: int = 5) -> DataFrame:
    """A repeatable sample of the rows in entity order: row (7 n + 31 i) modulo their number, i below ``each`` for round n."""
    rows = numbered(features, [], "zone", SLOT_ZONES, "nth", "window_end_ms")
    total = features.agg(F.greatest(F.count("*"), F.lit(1))).scalar()
    picks = features.sparkSession.range(rounds).withColumnRenamed("id", "n").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(each - 1))))
    picks = picks.select("n", "i", F.pmod(7 * F.col("n") + 31 * F.col("i"), total).cast("long").alias("nth"))
    return picks.join(rows, "nth").drop("nth")


def shadow_check(stored: DataFrame, shadow: DataFrame, last: int = 240) -> DataFrame:
    """Stored latest rows against a recomputation's last rows: checked, bad, and pending where the recomputation is not there yet."""
    from .windows import last_n

    recent = last_n(shadow, last)
    at = recent.groupBy("zone").agg(F.max("window_end_ms").alias("reached"))
    same = recent.select("zone", "window_end_ms", F.struct(*SUMS).alias("r"))
    rows = stored.select("zone", "window_end_ms", F.struct(*SUMS).alias("s")).join(same, ["zone", "window_end_ms"], "left").join(at, "zone", "left")
    pending = F.col("r").isNull() & (F.col("reached").isNull() | (F.col("reached") < F.col("window_end_ms")))
    bad = ~pending & (F.col("r").isNull() | ~F.col("r").eqNullSafe(F.col("s")))
    return rows.agg(F.count_if(~pending).alias("checked"), F.count_if(bad).alias("bad"), F.count_if(pending).alias("pending"))


def fingerprints(rows: DataFrame, columns: list[str], of: list[Column]) -> DataFrame:
    """SHA-256 over rows in a canonical order, for each set of rows that a condition of ``of`` names (``node``: its number). Each row is hashed where it is and travels once for all
    sets, as 32 bytes and whose it is. The hashes are the leaves of a tree by their first hex digits: six, then four, then two, then none, each node the hash of its children in
    order. Inner nodes have 256 children at most, and the lowest ones share the rows by 16 million, so that no task holds many."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    leaves = rows.select(F.unhex(F.sha2(text, 256)).alias("h"), F.array(*[F.coalesce(c, F.lit(False)) for c in of]).alias("of"))
    if len(of) == 1:
        leaves = leaves.where(F.col("of")[0]).select("h")
    leaves = leaves.withColumn("p", F.substring("h", 1, 3)).repartition("p").groupBy("p").agg(F.array_sort(F.collect_list(F.struct(*leaves.columns))).alias("all"))
    mine = lambda k: F.filter("all", lambda x: x["of"][k])
    own = [F.col("all")] if len(of) == 1 else [mine(k) for k in range(len(of))]
    node = lambda k, a: F.struct(F.lit(k).alias("node"), F.sha2(F.array_join(F.transform(a, lambda x: F.lower(F.hex(x["h"]))), "\n"), 256).alias("h"), F.size(a).cast("long").alias("n"))
    level = leaves.select(F.lower(F.hex("p")).alias("name"), F.inline(F.array(*[node(k, a) for k, a in enumerate(own)]))).where("n > 0")
    for digits in (4, 2, 0):
        children = F.transform(F.array_sort(F.collect_list(F.struct("name", "h"))), lambda x: x["h"])
        level = level.groupBy("node", F.substring("name", 1, digits).alias("name")).agg(F.sha2(F.array_join(children, "\n"), 256).alias("h"), F.sum("n").alias("n"))
    return level.select("node", F.col("h").alias("sha256"), F.col("n").alias("row_count"))


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The fingerprint of all rows."""
    return fingerprints(rows, columns, [F.lit(True)]).drop("node")


def state_fingerprint(stats: DataFrame, buckets: DataFrame, features: DataFrame) -> DataFrame:
    """The whole state as one short text to compare replicas by: the first 16 hex digits over headers, retained buckets and rows, and their numbers."""
    parts = [("p", stats, ["partition", "to_offset", "max_event_time_ms", "closed_until_ms", "late_dropped", "events"]), ("b", buckets, ["partition", "zone", "start_ms", "count", "fare_cents", "distance_milli"]), ("f", features, ["zone", "window_end_ms", *SUMS])]
    hashed = [fingerprint(rows, columns).select(F.lit(kind).alias("kind"), "sha256", "row_count") for kind, rows, columns in parts]
    every = hashed[0].unionByName(hashed[1]).unionByName(hashed[2])  # one row each
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "sha256"))), lambda x: x["sha256"]), "\n")
    total = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("row_count"))).alias({"p": "partitions", "b": "buckets", "f": "features"}[kind])
    return every.agg(F.substring(F.sha2(joined, 256), 1, 16).alias("fingerprint"), total("p"), total("b"), total("f"))


def converged(nodes: DataFrame) -> DataFrame:
    """Whether all replicas report one applied index and one fingerprint."""
    return nodes.agg(((F.count_distinct("fingerprint") == 1) & (F.count_distinct("applied") == 1)).alias("converged"), F.count("*").alias("nodes"))
