"""Sharding by sampled splitters, with DataFrame functions only.

Rows are ordered by a key, the hash of their text, so that equal texts stand together. A sample in which a row's chance grows with its size tells where
the key has to be cut for ``RANGES`` ranges of equal bytes; the ranges are then measured exactly. A range with more than ``OVERFULL``
times its share of bytes or rows is subdivided: a text that holds so much alone (a hot group) becomes ranges of its own, cut by the hash of doc_id, and the
others of the range are cut by the key. Consecutive ranges fill the shards, each going where its middle falls, so that a shard misses an equal share of the bytes
by less than the ranges at its two ends. A group of equal texts is cut only where a shard ends inside a hot one.

Law: ``bytes``. Nothing but tables of at most some ``RANGES`` rows (``MOST_RANGES``) is broadcast or ordered in one task; rows are ordered within their range,
so neither a shard nor a hot group is ever one task's.

Defined results. A null text is empty; its size is 1 like that of an empty text. Rows without doc_id are hashed by where they stand, so that many of them
spread. Repeated rows are rows of their own with slots of their own. Fewer rows than shards leave shards empty. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, cut, table

SHARDS = 16
#: Ranges that the splitters make, and the expected rows of their sample.
RANGES = 2048
SAMPLES = 8 * RANGES
OVERFULL = 1.5
#: Subdivided ranges: no more than two hot texts a share of bytes or rows, and a cut for each share.
MOST_RANGES = 8 * RANGES
#: Keys are so many bits of a hash; splitters are looked up by their first ones.
KEY_BITS, LOOKUP_BITS = 52, 12
_SLOT = 1 << (KEY_BITS - LOOKUP_BITS)


def hashed(text: Column) -> Column:
    """The first bits of a text's MD5, as a number that a double holds exactly."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def _records(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, key and tie of each row; no texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tie = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string")))
    return docs.select(
        "doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), hashed(text).alias("key"), hashed(tie).alias("tie")
    )


def splitters(rows: DataFrame, total: int, ranges: int = RANGES, samples: int = SAMPLES) -> DataFrame:
    """The lowest keys of the ranges but the first, from a sample of about ``samples`` rows. A row of ``size`` is drawn with probability
    size * samples / total and then stands for total / samples bytes; larger ones are always drawn and stand for themselves."""
    share = F.lit(float(total) / samples)
    drawn = rows.where(F.col("tie") / F.lit(float(1 << KEY_BITS)) < F.col("size") / share).select("key", "tie", F.greatest(F.col("size"), F.ceil(share)).alias("w"))
    by = W.orderBy("key", "tie", "w")  # the sample's size is bounded
    drawn = drawn.withColumns({"upto": F.sum("w").over(by.rowsBetween(W.unboundedPreceding, 0)), "all": F.sum("w").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    quantile = F.expr(f"(upto - w) * {ranges} div `all`")
    lowest = drawn.groupBy(quantile.alias("q")).agg(F.min("key").alias("low"))
    return lowest.where("q > 0").select("low").distinct()


def _lookup(cuts: DataFrame) -> DataFrame:
    """For each of the first bits of keys: how many splitters lie below them, and those that share them."""
    own = cuts.groupBy(F.expr(f"low div {_SLOT}").alias("prefix")).agg(F.sort_array(F.collect_list("low")).alias("cuts"))
    every = cuts.sparkSession.range(1 << LOOKUP_BITS).withColumnRenamed("id", "prefix").join(own, "prefix", "left")
    every = every.withColumn("cuts", F.coalesce("cuts", F.array().cast("array<bigint>")))
    below = F.sum(F.size("cuts")).over(W.orderBy("prefix").rowsBetween(W.unboundedPreceding, 0)) - F.size("cuts")
    return every.withColumn("below", below)


def _ranged(rows: DataFrame, lookup: DataFrame) -> DataFrame:
    """Adds ``range``: the number of splitters at or below the key."""
    rows = rows.withColumn("prefix", F.expr(f"key div {_SLOT}")).join(F.broadcast(lookup), "prefix")
    return rows.withColumn("range", (F.col("below") + F.size(F.filter("cuts", lambda c: c <= F.col("key")))).cast("int")).drop("prefix", "cuts", "below")


def _pieces(bytes_: str, n: str, total: int, count: int, ranges: int) -> Column:
    """How many ranges what holds so many bytes and rows makes."""
    share = F.greatest(F.col(bytes_) / F.lit(total / ranges), F.col(n) / F.lit(count / ranges))
    return F.when(share > OVERFULL, F.ceil(share)).otherwise(1).cast("long")


def shard(docs: DataFrame, shards: int = SHARDS, ranges: int = RANGES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document row; also range, hot (the key of a hot text, else -1) and slice, whose order the shards follow."""
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        rows = scratch.keep(_records(docs))
        sums = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"), F.count("*").alias("count")).first()
        total, count = max(1, sums["total"]), max(1, sums["count"])
        cuts = scratch.keep(splitters(rows, total, ranges))
        lookup = scratch.keep(_lookup(cuts))
        rows = _ranged(rows, lookup)

        by = W.orderBy("low")
        bounds = cuts.select(F.row_number().over(by).alias("range"), "low", F.coalesce(F.lead("low").over(by), F.lit(1 << KEY_BITS)).alias("high"))
        first = cuts.agg(F.lit(0).alias("range"), F.lit(0).cast("long").alias("low"), F.coalesce(F.min("low"), F.lit(1 << KEY_BITS)).alias("high"))
        sized = [F.sum("size").alias("bytes"), F.count("*").alias("n")]
        held = scratch.keep(first.unionByName(bounds).join(rows.groupBy("range").agg(*sized), "range"))
        over = held.where(_pieces("bytes", "n", total, count, ranges) > 1)
        hot = rows.join(F.broadcast(over.select("range")), "range", "left_semi").groupBy("range", "key").agg(*sized)
        hot = scratch.keep(hot.withColumn("parts", _pieces("bytes", "n", total, count, ranges)).where("parts > 1").select("range", "key", "bytes", "n", "parts"))
        rest = held.join(hot.groupBy("range").agg(F.sum("bytes").alias("hot_bytes"), F.sum("n").alias("hot_n")), "range", "left")
        rest = rest.withColumns({"bytes": F.col("bytes") - F.coalesce("hot_bytes", F.lit(0)), "n": F.col("n") - F.coalesce("hot_n", F.lit(0))})
        rest = scratch.keep(rest.select("range", "low", "high", _pieces("bytes", "n", total, count, ranges).alias("slices")))

        rows = rows.join(F.broadcast(rest), "range").join(F.broadcast(hot.select("key", "parts")), "key", "left")
        inside = lambda at, width, many: F.least(many - 1, F.floor(at / width.cast("double") * many))
        slice_ = F.when(F.col("parts").isNull(), inside(F.col("key") - F.col("low"), F.col("high") - F.col("low"), F.col("slices"))).otherwise(inside(F.col("tie"), F.lit(1 << KEY_BITS), F.col("parts")))
        rows = rows.withColumn("hot", F.when(F.col("parts").isNull(), F.lit(-1).cast("long")).otherwise(F.col("key"))).withColumn("slice", slice_.cast("long")).drop("low", "high", "slices", "parts")

        place = ["range", "hot", "slice"]
        order = W.orderBy(*place)
        filled = rows.groupBy(*place).agg(*sized).withColumn("before", F.sum("bytes").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("bytes"))
        filled = filled.withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"(2 * before + bytes) * {shards} div {2 * total}")).cast("int"))
        filled = filled.withColumn("start", F.sum("n").over(W.partitionBy("shard").orderBy(*place).rowsBetween(W.unboundedPreceding, 0)) - F.col("n"))
        filled = scratch.keep(filled.select(*place, "shard", "start"))
        rows = rows.join(F.broadcast(filled), place)
        nth = F.row_number().over(W.partitionBy(*place).orderBy("key", "tie", "size", "text_crc32")) - 1
        result = rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + nth).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *place)
        result = cut(result)
    return result


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: all documents in 16 shards of nearly equal bytes."""
    return shard(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
