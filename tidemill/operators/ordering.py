"""Order within groups of any size, in two levels.

A group's rows are cut into slots along its order, and one row a slot is ordered above them, so that a group of any length
spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _slot(order: str, width: int) -> Column:
    return F.floor(F.col(order) / width)


def earlier(rows: DataFrame, by: list[str], order: str, width: int, f: Callable[[str], Column], value: str, name: str) -> DataFrame:
    """Adds ``name``: f (F.max or F.min) of ``value`` over all rows before this one in the order of its group."""
    rows = rows.withColumn("_o_slot", _slot(order, width))
    heads = rows.groupBy(*by, "_o_slot").agg(f(value).alias("_o_head"))
    before = f("_o_head").over(W.partitionBy(*by).orderBy("_o_slot").rowsBetween(W.unboundedPreceding, -1))
    heads = heads.select(*by, "_o_slot", before.alias("_o_before"))
    inside = f(value).over(W.partitionBy(*by, "_o_slot").orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_o_inside", inside).join(heads, [*by, "_o_slot"])
    both = F.greatest("_o_inside", "_o_before") if f is F.max else F.least("_o_inside", "_o_before")
    return rows.withColumn(name, both).drop("_o_slot", "_o_inside", "_o_before")


def previous(rows: DataFrame, by: list[str], order: str, width: int, values: list[str], name: str) -> DataFrame:
    """Adds ``name``: ``values`` of the row before this one in the order of its group, as a struct (null: there is none)."""
    rows = rows.withColumn("_o_slot", _slot(order, width))
    row = F.struct(*values)
    heads = rows.groupBy(*by, "_o_slot").agg(F.max_by(row, order).alias("_o_last"))
    heads = heads.select(*by, "_o_slot", F.lag("_o_last").over(W.partitionBy(*by).orderBy("_o_slot")).alias("_o_before"))
    rows = rows.withColumn("_o_inside", F.lag(row).over(W.partitionBy(*by, "_o_slot").orderBy(order)))
    same = [rows[c].eqNullSafe(heads[c]) for c in (*by, "_o_slot")]
    return rows.join(heads, same).select(*[rows[c] for c in rows.columns if c not in ("_o_slot", "_o_inside")], F.coalesce("_o_inside", "_o_before").alias(name))


def numbered(rows: DataFrame, by: list[str], order: str, width: int, name: str, *ties: str) -> DataFrame:
    """Adds ``name``: each row's number (from 0) in the order of its group."""
    rows = rows.withColumn("_o_slot", _slot(order, width))
    heads = rows.groupBy(*by, "_o_slot").agg(F.count("*").alias("_o_n"))
    heads = heads.select(*by, "_o_slot", F.coalesce(F.sum("_o_n").over(W.partitionBy(*by).orderBy("_o_slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o_first"))
    nth = F.row_number().over(W.partitionBy(*by, "_o_slot").orderBy(order, *ties)) - 1
    return rows.withColumn("_o_nth", nth).join(heads, [*by, "_o_slot"]).withColumn(name, (F.col("_o_first") + F.col("_o_nth")).cast("long")).drop("_o_slot", "_o_nth", "_o_first")


def at_ranks(rows: DataFrame, value: str, by: list[str], ranks: dict[str, Column], parts: int = 256) -> DataFrame:
    """Values at ranks (from 0, over the column ``n``, the group's size).

    Equal values are one row with their number. The distinct ones are cut at approximate quantiles into ``parts``, whose
    exact numbers are summed along the order; only the parts that hold a rank are ordered."""
    by = by or ["_all"]
    rows = rows if by != ["_all"] else rows.withColumn("_all", F.lit(0))
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_o_v")).agg(F.count("*").alias("_o_n"))
    cuts = F.percentile_approx("_o_v", [k / parts for k in range(1, parts)], 4 * parts)
    groups = counts.groupBy(*by).agg(cuts.alias("_o_cuts"), F.sum("_o_n").alias("n"))
    placed = counts.join(groups, by).withColumn("_o_part", F.size(F.filter("_o_cuts", lambda c: c <= F.col("_o_v")))).drop("_o_cuts")
    heads = placed.groupBy(*by, "_o_part").agg(F.sum("_o_n").alias("_o_m"), F.max("n").alias("n"))
    to = F.sum("_o_m").over(W.partitionBy(*by).orderBy("_o_part"))
    heads = heads.withColumn("_o_from", to - F.col("_o_m")).withColumn("_o_to", to)
    holds = [(r >= F.col("_o_from")) & (r < F.col("_o_to")) for r in ranks.values()]
    some = heads.where(F.greatest(*holds, F.lit(False))).select(*by, "_o_part", "_o_from")
    found = placed.join(some, [*by, "_o_part"])
    upto = F.col("_o_from") + F.sum("_o_n").over(W.partitionBy(*by, "_o_part").orderBy("_o_v"))
    found = found.withColumn("_o_upto", upto)
    at = lambda r: (r >= F.col("_o_upto") - F.col("_o_n")) & (r < F.col("_o_upto"))
    picked = found.groupBy(*by).agg(*[F.max(F.when(at(r), F.col("_o_v"))).alias(k) for k, r in ranks.items()])
    return groups.drop("_o_cuts").join(picked, by).select(*[c for c in by if c != "_all"], "n", *ranks)
