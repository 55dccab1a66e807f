"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target of words. Within a source, a document's expected number of copies is
``min(cap, k * 8 / (8 + c))`` for its length class c = floor(log2(size)); k is chosen so that the expectations
meet the target (long documents are repeated a little less). Its whole part is allocated for certain; the
fraction is its inclusion probability. Documents are ranked by u/(1-u) over p/(1-p), their random odds (u from
an MD5 of doc_id) divided by their inclusion odds, and the lowest ranks are taken until the rest of the target
is used up; of the document at the edge only as many words are taken as still fit, so a source misses its
target by rounding alone.

Ranks are never sorted as a whole: word sums over ``RANK_BINS`` bins of the rank find the bin in which the
edge lies, and only that bin's rows of a source are ordered, so a hot source spreads over all tasks.

Defined results. A null or empty text has size 0 and is taken 0 times. Null is a source of its own, last.
Repeated rows are documents of their own. Reruns agree. Extra columns are ignored. With no words at all every
target is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, cut, table
from .textkit import SPACED, Words, blocks

WEIGHTS = (5, 2, 1)
CAP = 3
RANK_BINS = 4096
#: Rows of the table of sources and length classes up to which it is broadcast.
BROADCAST_ROWS = 50_000


def _sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size of each document row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in blocks(batch):
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(Words(data, offs, SPACED).counts.astype(np.int64))], ["doc_id", "source", "size"])

    rows = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), F.col("text"))
    return rows.mapInArrow(measure, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, source string, size long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size and target of each source; the windows run over one row a source."""
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_name = W.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(w) for w in weights])
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("nth", F.row_number().over(by_name))
    rows = rows.withColumn("w", F.element_at(cycle, (F.col("nth") - 1) % len(weights) + 1)).withColumn("room", cap * F.col("source_size"))
    by_room = W.orderBy(F.col("room") / F.col("w"), "nth")
    level = (F.sum("source_size").over(everything) - (F.sum("room").over(by_room.rowsBetween(W.unboundedPreceding, 0)) - F.col("room"))) / F.sum("w").over(by_room.rowsBetween(0, W.unboundedFollowing))
    rows = rows.withColumn("level", level).withColumn("fits", F.when(F.col("level") <= F.col("room") / F.col("w"), F.col("level")))
    # the first level that caps no further source; later ones that fit are not below it
    first = F.min(F.when(F.col("fits").isNotNull(), F.struct(F.col("room") / F.col("w"), "nth", "fits"))).over(everything)["fits"]
    return rows.select("source", "source_size", F.least(F.col("room").cast("double"), F.coalesce(first * F.col("w"), F.col("room").cast("double"))).alias("target"))


def _strata(sizes: DataFrame, targets: DataFrame, cap: int) -> DataFrame:
    """For each source and length class: whole copies, inclusion probability, and the words left for sampling in the source."""
    classes = sizes.where("size > 0").groupBy("source", _length_class().alias("c")).agg(F.sum("size").alias("words"))
    rows = classes.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    rows = rows.withColumn("tilt", F.lit(8.0) / (8 + F.col("c"))).withColumn("room", cap * F.col("words"))
    by = W.partitionBy("source").orderBy("c")
    rest = F.sum(F.col("tilt") * F.col("words")).over(W.partitionBy("source").orderBy(F.desc("c")))
    level = (F.col("target") - (F.sum("room").over(by) - F.col("room"))) / rest
    rows = rows.withColumn("fits", F.when(level <= cap / F.col("tilt"), level))
    first = F.min(F.when(F.col("fits").isNotNull(), F.struct("c", "fits"))).over(W.partitionBy("source"))["fits"]
    rows = rows.withColumn("copies", F.least(F.lit(float(cap)), F.coalesce(first * F.col("tilt"), F.lit(float(cap)))))
    rows = rows.withColumn("whole", F.floor("copies")).withColumn("p", F.col("copies") - F.col("whole"))
    left = F.floor(F.col("target") + 0.5) - F.sum(F.col("whole") * F.col("words")).over(W.partitionBy("source"))
    return rows.select("source", "c", "source_size", "target", "whole", "p", left.alias("left"))


def _length_class() -> Column:
    """floor(log2(size)), from the number of binary digits, which needs no rounding."""
    return F.length(F.bin("size")) - 1


def _uniform() -> Column:
    """A number in (0, 1) from the MD5 of doc_id's text."""
    digits = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def pareto_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """doc_id, size, source_size, target and taken (words) of every document row; also source, whole copies and inclusion probability."""
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        sizes = scratch.keep(_sizes(docs))
        targets = cut(source_targets(sizes, weights, cap))
        strata = cut(_strata(sizes, targets, cap))

        def beside(left: DataFrame, right: DataFrame, *same: str) -> DataFrame:
            right = right.withColumnsRenamed({k: f"_{k}" for k in same})
            small = F.broadcast(right) if right.count() <= BROADCAST_ROWS else right
            on = [left["source"].eqNullSafe(small["_source"]), *(left[k] == small[f"_{k}"] for k in same[1:])]
            return left.join(small, on, "left").drop(*(f"_{k}" for k in same))

        rows = beside(sizes.withColumn("c", _length_class()), strata.drop("source_size", "target"), "source", "c")
        rows = beside(rows, targets, "source")
        u = _uniform()
        rank = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
        rows = rows.withColumn("rank", F.when(F.col("p") > 0, rank)).withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * RANK_BINS))
        rows = scratch.keep(rows)
        bins = rows.where("bin is not null").groupBy("source", "bin", "left").agg(F.sum("size").alias("words"))
        before = F.sum("words").over(W.partitionBy("source").orderBy("bin")) - F.col("words")
        edge = bins.withColumn("before", before).where("before < left and before + words >= left").select("source", F.col("bin").alias("edge"), "before")
        rows = beside(rows, cut(edge), "source")
        extra = F.when(F.col("bin") < F.coalesce(F.col("edge"), F.when(F.col("left") > 0, RANK_BINS + 1).otherwise(-1)), F.col("size")).otherwise(0)
        sampled = rows.where("bin is null or edge is null or bin <> edge").withColumn("extra", F.when(F.col("bin").isNull(), 0).otherwise(extra))
        # only the rows of each source's edge bin are ordered
        order = W.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
        at_edge = rows.where("bin = edge").withColumn("prior", F.sum("size").over(order) - F.col("size") + F.col("before"))
        at_edge = at_edge.withColumn("extra", F.least(F.col("size"), F.greatest(F.lit(0), F.col("left") - F.col("prior")))).drop("prior")
        taken = (F.coalesce(F.col("whole"), F.lit(0)) * F.col("size") + F.col("extra")).cast("long")
        result = sampled.unionByName(at_edge).select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", F.coalesce("whole", F.lit(0)).cast("long").alias("whole"), F.coalesce("p", F.lit(0.0)).alias("p"))
        result = cut(result)
    return result


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the mix of all documents."""
    return pareto_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
with sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from sized group by source),
n as (select *, row_number() over (order by source is null, source) as nth from s),
w as (select *, case (nth - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as w, 3 * source_size as room from n),
l as (select *, room / w as ratio, (sum(source_size) over () - (sum(room) over (order by room / w, nth) - room))
        / sum(w) over (order by room / w, nth rows between current row and unbounded following) as level from w),
f as (select min_by(level, nth_by) as level from (select level, row_number() over (order by ratio, nth) as nth_by, ratio from l) where level <= ratio),
t as (select source, source_size, least(room::double, coalesce((select level from f) * w, room::double)) as target from w),
d as (select *, (floor(log2(size)))::int as c0 from sized where size > 0),
c as (select doc_id, source, size, case when (1::bigint << c0) > size then c0 - 1 when (1::bigint << (c0 + 1)) <= size then c0 + 1 else c0 end as c from d),
k as (select source, c, sum(size)::bigint as words from c group by source, c),
q as (select k.*, t.target, 8.0::double / (8 + c) as tilt, 3 * words as room from k join t on k.source is not distinct from t.source),
v as (select *, (target - (sum(room) over (partition by source order by c) - room))
        / sum(tilt * words) over (partition by source order by c desc) as level from q),
x as (select source, min_by(level, c) as level from v where level <= 3 / tilt group by source),
e as (select q.*, least(3.0::double, coalesce(x.level * tilt, 3.0::double)) as copies from q left join x on q.source is not distinct from x.source),
g as (select *, floor(copies)::bigint as whole, copies - floor(copies) as p from e),
h as (select *, floor(target + 0.5)::bigint - sum(whole * words) over (partition by source) as remaining from g),
r as (select c.doc_id, c.size, c.source, h.whole, h.p, h.remaining,
        (('0x' || substr(md5(coalesce(c.doc_id::varchar, '')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0::double as u
      from c join h on c.source is not distinct from h.source and c.c = h.c),
o as (select *, case when p > 0 then (u / (1 - u)) / (p / (1 - p)) end as rank from r),
m as (select *, sum(case when rank is not null then size else 0 end) over (partition by source order by rank nulls last, doc_id, size rows unbounded preceding) - size as prior from o),
y as (select doc_id, whole * size + case when rank is null then 0 else least(size, greatest(0, remaining - prior)) end as taken from m)
select z.doc_id, z.size, t.source_size, t.target, coalesce(y.taken, 0)::bigint as taken
from sized z join t on z.source is not distinct from t.source left join y on y.doc_id = z.doc_id
"""
