"""Cells, in which nodes meet that may be similar: dealing the pairs of a cell to blocks of bounded size, and reading sorted groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deal(placed: DataFrame, block: int) -> DataFrame:
    """Deals the pairs of different components in each cell to groups: g, node, comp, is_left and is_right.

    placed: cell, node, comp. Of a cell whose nodes are all of one component nothing comes. Of the others, the nodes outside the largest
    component (left) meet all nodes (right), in pairs of blocks of about ``block`` nodes, so that a node is copied once a block of
    the other side and no group is large."""
    shares = placed.groupBy("cell", "comp").agg(F.count("*").alias("m"))
    mixed = shares.groupBy("cell").agg(F.sum("m").alias("total"), F.max(F.struct("m", "comp")).alias("big"), F.count("*").alias("comps")).where("comps > 1")
    rows = placed.join(mixed, "cell").withColumn("outside", F.col("comp") != F.col("big.comp"))
    rows = rows.withColumn("rows", F.ceil(F.col("total") / block)).withColumn("lefts", F.ceil((F.col("total") - F.col("big.m")) / block))
    rows = rows.withColumn("j", F.pmod(F.xxhash64("node"), "rows")).withColumn("i", F.when(F.col("outside"), F.pmod(F.xxhash64("node", "cell"), "lefts")))
    right = rows.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lefts") - 1)))
    right = right.select("node", "comp", F.xxhash64("cell", "at", "j").alias("g"), (F.col("outside") & (F.col("i") == F.col("at"))).alias("is_left"), F.lit(True).alias("is_right"))
    left = rows.where("outside and rows > 1").withColumn("at", F.explode(F.expr("filter(sequence(0L, rows - 1), x -> x <> j)")))
    left = left.select("node", "comp", F.xxhash64("cell", "i", "at").alias("g"), F.lit(True).alias("is_left"), F.lit(False).alias("is_right"))
    return right.unionByName(left)


def whole_keys(batches: Iterator[pa.RecordBatch], column: int = 0, most: int | None = None) -> Iterator[pa.Table]:
    """The runs of equal keys of sorted batches, as many whole ones at a time as came together; a run of over ``most`` rows comes in pieces."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(column).to_numpy()
        if held and held[-1].column(column)[-1].as_py() == key[0] == key[-1]:
            held.append(batch)
            if most and sum(b.num_rows for b in held) > most:
                yield pa.Table.from_batches(held)
                held = []
            continue
        last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
        if last or held:
            done = [*held, batch.slice(0, last)] if last else held
            yield pa.Table.from_batches(done)
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def sides(t: pa.Table) -> Iterator[tuple[int, int, list[int], list[int]]]:
    """(from, to, left positions, right positions) of each group of a sorted table."""
    g = t.column("g").to_numpy()
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]]))
    is_left, is_right = t.column("is_left").to_numpy(), t.column("is_right").to_numpy()
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        left, right = np.flatnonzero(is_left[a:b]).tolist(), np.flatnonzero(is_right[a:b]).tolist()
        if left and right:
            yield a, b, left, right
