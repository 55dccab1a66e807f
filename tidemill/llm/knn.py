"""Exact top-k search: a Voronoi kNN join for the largest inner products.

Largest inner product becomes nearest neighbour by one more coordinate: a data vector s gets
sqrt(R^2 - |s|^2), R being the longest data vector, and a query gets 0. In that space
1. data and queries go to the cell of their nearest pivot (the data rows with the smallest hashes, as many as the square root of the rows,
   from ``PIVOTS`` to ``MOST_PIVOTS``, which bounds the driver's table of their distances);
2. each cell is summarised: its queries' largest distance U from the pivot, its data's k smallest distances;
3. from these follows, for each query cell i, a distance T that k candidates of every query keep: the k-th smallest
   of U_i + |p_i p_j| + |p_j s|;
4. by the triangle inequality a row s of cell j can matter to cell i only if
   |p_i p_j| - U_i - T_i <= |p_j s| <= |p_i p_j| + U_i + T_i; it is copied to the groups of cells where it can;
5. every group is solved against its copies in blocks of about ``BLOCK`` rows by exact integer products, and the blocks'
   best are merged.

No task holds more than a block of data and ``GROUP`` queries; cells of any size are split. Vectors with independent
coordinates leave nothing to prune, so that the join then is the full, blocked one; clustered ones leave few copies.

Defined results. Vectors that are null or hold null or non-finite components, and rows without vec_id, take no part.
A shorter vector counts as filled up with zeros. Equal vectors under one vec_id count once; different ones are candidates of their own, and as
queries share one list, in which no vector of that vec_id stands. Ties go to the smaller vec_id. Fewer candidates than k are all
returned. Finite components of any size take part with exact integers; a score beyond 64 bits is returned as the nearest number of
64 bits, ranked by its exact value. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, cut, table
from .runs import spans

K = 20
SCALE = 64
PIVOTS, MOST_PIVOTS = 96, 2048
GROUP = 1024
BLOCK = 16384


def _decode(dims: np.ndarray, packed: list[bytes], width: int) -> np.ndarray:
    """Packed vectors as rows of int64 (of Python's integers, if any needs them), filled up with zeros to ``width``."""
    size, wide = np.abs(dims), dims < 0
    out = np.zeros((len(packed), width), object if wide.any() else np.int64)
    short = np.array([len(b) == 2 * d for b, d in zip(packed, size, strict=True)], bool) & ~wide
    for which, kind in ((short, np.int16), (~short & ~wide, np.int64)):
        at = np.flatnonzero(which)
        for d in np.unique(size[at]):
            rows = at[size[at] == d]
            out[rows, :d] = np.frombuffer(b"".join(packed[i] for i in rows), kind).reshape(len(rows), d)
    for i in np.flatnonzero(wide):
        out[i, : size[i]] = [int(x) for x in packed[i].split()]
    return out


def quantise(vectors: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """id, dims, packed floor(scale * x) and the bits of its largest component, of every vector that takes part.

    Components are packed as 16- or 64-bit integers, or (dims is negative then) written out."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vecs = batch.column(0), batch.column(1)
            x, offs = vecs.values.to_numpy(zero_copy_only=False).astype(float), vecs.offsets.to_numpy().astype(np.int64)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])  # null components are NaN here
            takes = ids.is_valid().to_numpy(zero_copy_only=False) & vecs.is_valid().to_numpy(zero_copy_only=False) & (bad[offs[1:]] == bad[offs[:-1]])
            largest = np.zeros(len(ids))
            full = np.flatnonzero(takes & (offs[1:] > offs[:-1]))
            size = offs[full + 1] - offs[full]
            if len(full):
                largest[full] = np.maximum.reduceat(np.abs(x[spans(offs[full], size)]), np.cumsum(size) - size)
            limit = 2.0**62 / scale
            for kind, some in ((np.int16, largest < 2**14 / scale), (np.int64, (largest >= 2**14 / scale) & (largest < limit)), (None, largest >= limit)):
                at = np.flatnonzero(takes & some)
                size = offs[at + 1] - offs[at]
                if kind is None:
                    exact = [[math.floor(v * scale) if abs(v) < limit else int(v) * scale for v in x[offs[i] : offs[i + 1]].tolist()] for i in at]
                    packed = pa.array([" ".join(map(str, v)).encode() for v in exact], pa.binary())
                    bits = np.array([max(abs(c) for c in v).bit_length() for v in exact], np.int32)
                else:
                    whole = np.floor(x[spans(offs[at], size)] * scale).astype(kind)
                    ends = np.concatenate([[0], np.cumsum(size)]) * whole.itemsize
                    packed = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(whole.tobytes())])
                    bits = np.full(len(at), 8 * whole.itemsize, np.int32)
                dims = size if kind is not None else -size
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(dims, pa.int32()), packed, pa.array(bits)], ["id", "dims", "vec", "bits"])

    return vectors.select(F.col(id_col).cast("long"), F.col(vec_col).cast("array<double>")).mapInArrow(pack, "id long, dims int, vec binary, bits int")


def _floats(x: np.ndarray, shift: int) -> np.ndarray:
    """x / 2^shift; the bounds allow for the rounding."""
    if x.dtype == object:
        return np.array([[float(v >> shift) for v in row] for row in x]).reshape(x.shape)
    return x * 2.0**-shift


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of a and b: in floating point, or in 64 bits, where every partial sum is exact."""
    bound = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if bound < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if bound < 2**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return a.astype(object) @ b.astype(object).T


def _best(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, data id, score) of the k best data rows of every query, a slice of data at a time."""
    row, best, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at in range(0, len(ids), 4096):
        s = _product(queries, data[at : at + 4096])
        own = query_ids[:, None] == ids[None, at : at + 4096]
        if s.dtype == object:
            r, c = np.nonzero(~own)
        else:
            s[own] = np.iinfo(np.int64).min
            kth = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)]
            r, c = np.nonzero((s >= kth[:, None]) & ~own)
        row, best, score = np.concatenate([row, r]), np.concatenate([best, ids[at + c]]), np.concatenate([score, s[r, c]])
        rank = np.unique(score, return_inverse=True)[1] if score.dtype == object else score
        order = np.lexsort((best, -rank, row))
        row, best, score = row[order], best[order], score[order]
        first = np.searchsorted(row, np.arange(len(queries)))
        keep = np.arange(len(row)) - first[row] < k
        row, best, score = row[keep], best[keep], score[keep]
    return row, best, score


def _ranked(score: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Scores within 64 bits; whether they lie above (1) or below (-1) those; and for those that do, a text that sorts like them."""
    if score.dtype != object:
        return pa.array(score, pa.int64()), pa.array(np.zeros(len(score), np.int32)), pa.nulls(len(score), pa.string())
    low, high = -(1 << 63), (1 << 63) - 1
    side = [(s > high) - (s < low) for s in score]
    flip = str.maketrans("0123456789", "9876543210")
    texts = [f"{len(str(abs(s))):06}{abs(s)}" if b else None for s, b in zip(score, side, strict=True)]
    texts = [t.translate(flip) if b < 0 else t for t, b in zip(texts, side, strict=True)]
    return pa.array([min(max(s, low), high) for s in score], pa.int64()), pa.array(side, pa.int32()), pa.array(texts, pa.string())


class Cells:
    """The pivots, and what their summaries tell."""

    def __init__(self, pivots: np.ndarray, longest: float, shift: int):
        self.longest, self.shift = longest, shift
        self.pivots = self.lift(_floats(pivots, shift))
        self.between = np.stack([np.sqrt(((self.pivots - p) ** 2).sum(1)) for p in self.pivots])

    def lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.longest - (x**2).sum(1)))
        return np.hstack([x, more[:, None]])

    def assign(self, x: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each vector and its distance."""
        y = self.lift(_floats(x, self.shift), query)
        d = (y**2).sum(1)[:, None] - 2 * y @ self.pivots.T + (self.pivots**2).sum(1)[None]
        near = d.argmin(axis=1)
        return near, np.sqrt(np.maximum(0, ((y - self.pivots[near]) ** 2).sum(1)))

    def plan(self, queries: dict[int, tuple[int, float]], nearest: dict[int, list[float]], k: int) -> None:
        """Groups of query cells, and for each group and data cell the distances that can matter.

        queries: of each cell with any, their number and largest distance; nearest: of each data cell, its smallest distances.
        """
        slack = 1e-6 * (1 + float(self.between.max(initial=0)) + self.longest**0.5)  # beyond rounding
        left, groups, filled = set(queries), [], GROUP
        at = min(left, default=None)
        while left:  # neighbouring cells share a group
            at = min(left, key=lambda i: (self.between[at, i], i))
            left.discard(at)
            many = queries[at][0]
            if filled + many > GROUP:
                groups.append([])
                filled = 0
            groups[-1].append(at)
            filled += many
        self.group = {i: g for g, cells in enumerate(groups) for i in cells}
        self.parts = [max(1, -(-sum(queries[i][0] for i in cells) // GROUP)) for cells in groups]
        self.low = np.full((len(groups), len(self.pivots)), np.inf)
        self.high = np.full((len(groups), len(self.pivots)), -np.inf)
        for i, (_, far) in queries.items():
            bounds = sorted(far + self.between[i, j] + d for j, ds in nearest.items() for d in ds)
            keep = bounds[k] if len(bounds) > k else np.inf  # the k + 1st: one may be the query itself
            g = self.group[i]
            self.low[g] = np.minimum(self.low[g], self.between[i] - far - keep - slack)
            self.high[g] = np.maximum(self.high[g], self.between[i] + far + keep + slack)


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score: the k largest integer inner products of each query row with all other rows."""
    with Scratch(vectors.sparkSession) as scratch:
        return _top_k(quantise(vectors, id_col, vec_col), is_query, id_col, k, pivots, block, scratch)


def _top_k(rows: DataFrame, is_query: Column, id_col: str, k: int, pivots: int | None, block: int, scratch: Scratch) -> DataFrame:
    spark = rows.sparkSession
    rows = scratch.keep(rows)
    repeated = not rows.groupBy("id").count().where("count > 1").isEmpty()
    if repeated:
        rows = scratch.keep(rows.distinct())
    size = rows.agg(F.count("*"), F.max(F.abs("dims")), F.max("bits")).first()
    if not size[0]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n, width, shift = int(size[0]), int(size[1]), max(0, size[2] - 400)  # squares of 400 bits stay far within doubles
    pivots = pivots or min(MOST_PIVOTS, max(PIVOTS, math.isqrt(n)))
    sample = rows.orderBy(F.xxhash64("id"), "id", "vec").limit(pivots).toArrow()
    centre = _decode(sample.column("dims").to_numpy(), sample.column("vec").to_pylist(), width)

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _floats(_decode(batch.column(0).to_numpy(), batch.column(1).to_pylist(), width), shift)
            yield pa.RecordBatch.from_arrays([pa.array([float((x**2).sum(1).max(initial=0))])], ["r"])

    longest = rows.select("dims", "vec").mapInArrow(norms, "r double").agg(F.max("r")).first()[0]
    cells = Cells(centre, longest, shift)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _decode(batch.column(1).to_numpy(), batch.column(2).to_pylist(), width)
            cell, far = cells.assign(x, query=False)
            q_cell, q_far = cells.assign(x, query=True)
            none = ~batch.column(3).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cell, pa.int32()), pa.array(far), pa.array(q_cell, pa.int32(), mask=none), pa.array(q_far, mask=none)], ["id", "dims", "vec", "cell", "far", "q_cell", "q_far"])

    asked = F.coalesce(is_query, F.lit(False))
    placed = scratch.keep(rows.withColumn(id_col, F.col("id")).select("id", "dims", "vec", asked.alias("asks")).mapInArrow(assign, "id long, dims int, vec binary, cell int, far double, q_cell int, q_far double"))
    # k + 1 distances to different ids: at most one is the query's own
    near = placed.groupBy("cell", "id").agg(F.min("far").alias("far")) if repeated else placed.select("cell", "far")
    near = near.withColumn("nth", F.row_number().over(W.partitionBy("cell").orderBy("far"))).where(F.col("nth") <= k + 1)
    nearest: dict[int, list[float]] = {}
    for r in near.select("cell", "far").collect():  # k + 1 a pivot at most
        nearest.setdefault(r[0], []).append(r[1])
    asks = placed.where("q_cell is not null").groupBy("q_cell").agg(F.count("*"), F.max("q_far")).collect()
    cells.plan({r[0]: (r[1], r[2]) for r in asks}, nearest, k)
    if not asks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    many = max(1, -(-n // block))
    parts = cells.parts

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            piece = batch.column(0).to_numpy() // 3 * 2654435761 % 2**31 % many
            for g in range(len(parts)):
                need = np.flatnonzero((far >= cells.low[g][cell]) & (far <= cells.high[g][cell]))
                if len(need):
                    got = batch.take(pa.array(need))
                    for p in range(parts[g]):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(need), g, np.int32)), pa.array(np.full(len(need), p, np.int32)), pa.array(piece[need].astype(np.int32)), *got.columns[:3]], ["g", "part", "piece", "id", "dims", "vec"])

    data = placed.mapInArrow(copies, "g int, part int, piece int, id long, dims int, vec binary")
    group = F.create_map(*[F.lit(x) for pair in cells.group.items() for x in pair])
    size_of = F.array(*[F.lit(p) for p in parts])
    queries = placed.where("q_cell is not null").select(group[F.col("q_cell")].alias("g"), "id", "dims", "vec")
    queries = queries.withColumn("part", F.pmod(F.xxhash64("id"), F.get(size_of, F.col("g"))).cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        row, q_ids, best, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if left.num_rows and right.num_rows:
            q_ids, ids = left.column("id").to_numpy(), right.column("id").to_numpy()
            q = _decode(left.column("dims").to_numpy(), left.column("vec").to_pylist(), width)
            s = _decode(right.column("dims").to_numpy(), right.column("vec").to_pylist(), width)
            row, best, score = _best(q, q_ids, s, ids, k)
        return pa.table([pa.array(q_ids[row], pa.int64()), pa.array(best, pa.int64()), *_ranked(score)], ["query_id", "vec_id", "score", "side", "exact"])

    by = ("g", "part", "piece")
    found = queries.groupBy(*by).cogroup(data.groupBy(*by)).applyInArrow(solve, "query_id long, vec_id long, score long, side int, exact string")
    order = W.partitionBy("query_id").orderBy(F.desc("side"), F.desc("score"), F.desc("exact"), "vec_id")
    return cut(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the 20 best candidates of every row whose vec_id is divisible by 20."""
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


ORACLE_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as q from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::bigint as score
      from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""
