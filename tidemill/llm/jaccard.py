"""N-gram Jaccard join with count vectors in R-trees.

A document's set holds the hashes of its distinct word shingles. Equal sets are one node. Linked nodes are found in
four steps, none of which loses a link:

1. Cells. If two sets have Jaccard similarity t or more, they differ in at most d = (1-t)/(1+t) (|A|+|B|) shingles. Shingles
   are hashed into m > d groups (m fixed for a class of sizes; sets near a class's edge join both classes), so at most d groups
   differ, and among the d + 1 first of all groups in one common order (larger groups first, then by hash) at least one
   is the same in both: prefix filtering over whole groups. Nodes that hold the same group meet in its cell. No corpus
   statistics are needed, and a group of several shingles is far rarer than any one of them. Sets of up to 16 shingles, whose groups would often be
   empty, meet by triples of their first shingles in a common order instead. Cells with the same members are one, unless very large.
2. Stars. Each node is verified against one node, the one in most cells of those it shares a cell with (of a group of near copies that is
   the text the others were made from); this joins groups of near copies in linear work.
3. Rest. Cells whose nodes are still of several components are searched: their nodes outside the largest
   component against all, in pairs of blocks of ``BLOCK`` nodes. Each block is an R-tree over count vectors (how many shingles fall in each
   of G hash groups, G from the set's size to its double); a page's overlap with a query is bounded by the summed minima of the query's
   counts and the page's largest ones. Only the small vectors travel to the cells; the sets of nodes with a surviving pair follow, and
   their pairs are verified exactly, unless already connected. Each cell gives links enough to connect what is linked in it, not all of its pairs.
4. Components of all links.

The R-tree alone can't deal the work out: unrelated long texts have nearly equal counts, so that its pages overlap; hence the cells.

Defined results. Null or empty texts and texts without words have an empty set and are linked with nothing. Texts of fewer than k
words are one shingle. Repeated rows are documents of their own. Sets equal in size and in a 64-bit hash are taken as equal, and so
are shingles equal in a 64-bit hash. A null doc_id keeps itself as component unless linked to others. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cells import deal, sides, whole_keys
from .common import Scratch, cut, fresh, table
from .components import components
from .textkit import LOWER, SPACED, Words, blocks, hash_words, mix, shingles

SHINGLE, PERCENT = 4, 85
BLOCK = 128
RATIO = 1.6
#: Up to this class of sizes (16 members) groups would often be empty, and sets meet by triples.
SMALL = 5
#: Rows of one cell that are held at once to name it by its members.
HELD = 1 << 20
FILTER_BITS = 23
_U = np.uint64


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row of a block."""
    data = LOWER[data]
    w = Words(data, offs, SPACED)
    h = hash_words(data, w)
    runs = shingles(h, k)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        else:
            out.append(shingles(h[a:b], b - a) if b > a else np.zeros(0, _U))
    return out


def node_of(s: np.ndarray) -> int:
    """The 64-bit identity of a set, from its size and members."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s).sum(dtype=_U) + _U(len(s)) * _U(0x9E3779B97F4A7C15)], _U)).view(np.int64)[0])


class Scheme:
    """How sets of one class of sizes are divided into groups."""

    def __init__(self, c: int, percent: int):
        self.c, self.least, self.below = c, edge(c), edge(c + 1)
        small = self.below - 1
        self.differ = (100 - percent) * (small + small * 100 // percent) // (100 + percent)
        self.groups = 1 if not self.differ else -(-3 * (self.differ + 1) // 2)

    def keys(self, s: np.ndarray) -> np.ndarray:
        """The cells of a set: its first ``differ + 1`` groups."""
        g = (mix(s ^ _U(self.c + 1)) % _U(self.groups)).astype(np.int64)
        inner = mix(s + _U(0x632BE59BD9B4E019))
        half = _U(0xFFFFFFFF)
        low = np.bincount(g, (inner & half).astype(float), self.groups).astype(_U)
        high = np.bincount(g, (inner >> _U(32)).astype(float), self.groups).astype(_U)
        size = np.bincount(g, minlength=self.groups)
        content = mix(low * _U(0xD6E8FEB86659FD93) ^ mix(high + _U(0x2545F4914F6CDD1D)))
        content = mix(content ^ mix(np.arange(self.groups, dtype=_U) + _U(self.c << 32)))
        first = np.lexsort((content, -size))[: self.differ + 1]
        return content[first]


class Few:
    """How small sets meet: in triples of shingles. In one common order of all shingles, two sets that have what the similarity asks of them share
    three of their first n - least + 3, least being the fewest members that a set of n has in common with any partner (prefix filtering
    by three). Sets of one or two members only have equal partners."""

    def __init__(self, percent: int):
        self.percent = percent
        self.triples: dict[int, np.ndarray] = {}

    def keys(self, s: np.ndarray) -> np.ndarray:
        h = np.sort(mix(s ^ _U(0x8CB92BA72F3D8DD7)))
        if len(h) < 3:
            return mix(mix(h).sum(keepdims=True) + _U(len(h)))
        first = len(h) + self.percent * len(h) // -100 + 3
        if first not in self.triples:
            self.triples[first] = np.array(list(combinations(range(first), 3))).T
        a, b, c = h[self.triples[first]]
        return mix(mix(a + mix(b)) + mix(c + _U(3)))


def edge(c: int) -> int:
    """The smallest size of class c."""
    return int(np.ceil(RATIO**c)) if c else 1


def schemes_of(n: int, percent: int, known: dict[int, Scheme | Few]) -> list[Scheme | Few]:
    """The schemes of a set of n: its class's, and the one below if a smaller partner may be there."""
    c = int(np.log(n) / np.log(RATIO))
    while edge(c + 1) <= n:
        c += 1
    while edge(c) > n:
        c -= 1
    out = [c]
    if c and percent * n <= 100 * (edge(c) - 1):
        out.append(c - 1)
    if percent >= 75:  # then sets of three or more only have partners of three or more
        out = list(dict.fromkeys(x if x > SMALL else -1 for x in out))
    for x in out:
        if x not in known:
            known[x] = Few(percent) if x < 0 else Scheme(x, percent)
    return [known[x] for x in out]


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def counts(s: np.ndarray, groups: int) -> np.ndarray:
    """How many members fall in each group (a power of two of them)."""
    return np.bincount((s >> _U(7) & _U(groups - 1)).astype(np.int64), minlength=groups)


class RTree:
    """A packed R-tree over count vectors. Pages keep the largest counts and the smallest set size below them."""

    FAN = 8

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int):
        self.percent = percent
        half = points.shape[1] // 2
        self.order = np.lexsort((points[:, :half].sum(1), sizes))  # neighbours in size, then in the first half of the groups
        tops, least = points[self.order], sizes[self.order]
        self.levels = [(tops, least)]
        while len(tops) > 1:
            cut_at = np.arange(0, len(tops), self.FAN)
            tops, least = np.maximum.reduceat(tops, cut_at, axis=0), np.minimum.reduceat(least, cut_at)
            self.levels.append((tops, least))

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        """The points whose summed minima with ``point`` allow the similarity."""
        at = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            tops, least = self.levels[depth]
            if depth < len(self.levels) - 1:
                at = (at[:, None] * self.FAN + np.arange(self.FAN)).ravel()
                at = at[at < len(tops)]
            bound = np.minimum(tops[at], point).sum(axis=1, dtype=np.int64)
            # overlap i suffices only if (100 + percent) i >= percent (|A| + |B|)
            at = at[(100 + self.percent) * bound >= self.percent * (size + least[at])]
        return self.order[at]


def packed_counts(s: np.ndarray) -> bytes:
    """The count vector of a set with as many groups as fit its size, compressed."""
    c = counts(s, groups_of(len(s)))
    return zlib.compress(c.astype(np.uint8 if c.max(initial=0) < 256 else np.uint32).tobytes(), 1)


def groups_of(n: int) -> int:
    """A power of two from the size to its double: so many that what two sets don't share seldom meets in a group."""
    return max(16, 1 << max(n, 1).bit_length())


def unpacked(packed: bytes, n: int, groups: int) -> np.ndarray:
    """A packed vector, folded to fewer groups."""
    own = groups_of(n)
    raw = zlib.decompress(packed)
    c = np.frombuffer(raw, np.uint8 if len(raw) == own else np.uint32)
    return c if own == groups and c.dtype == np.uint8 else c.reshape(own // groups, groups).sum(axis=0, dtype=np.uint32)


def search(comps: list[int], sizes: list[int], vectors: list[bytes], left: list[int], right: list[int], percent: int) -> set[int]:
    """The positions that have a partner (one in ``left``, one in ``right``, of different components) whose counts allow the similarity."""
    groups = min(groups_of(n) for n in sizes)
    tree = RTree(np.array([unpacked(vectors[i], sizes[i], groups) for i in right]), np.array([sizes[i] for i in right]), percent)
    out: set[int] = set()
    for i in left:
        for j in tree.search(unpacked(vectors[i], sizes[i], groups), sizes[i]).tolist():
            j = right[j]
            if comps[i] != comps[j] and 100 * min(sizes[i], sizes[j]) >= percent * max(sizes[i], sizes[j]):
                out |= {i, j}
    return out


def solve(nodes: list[int], comps: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Verified links that connect what was not connected."""
    parent = {c: c for c in comps}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i in range(len(nodes)):
        for j in range(i):
            if (a := find(comps[i])) != (b := find(comps[j])) and similar(sets[i], sets[j], percent):
                parent[a] = b
                out.append((nodes[i], nodes[j]))
    return out


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, node) of every cell with two nodes or more; a cell's name is a hash of its members."""
    seen: set[int] = set()
    large = None
    for t in whole_keys(batches, most=HELD):
        key, node = t.column("key").to_numpy(), t.column("node").to_numpy()
        if key[0] == key[-1] and len(key) > HELD:
            large = key[0]
        head = int(np.searchsorted(key != large, True)) if large is not None else 0
        if head:  # a piece of a very large cell, named by its key
            yield pa.RecordBatch.from_arrays([pa.array(key[:head]), pa.array(node[:head])], ["cell", "node"])
            key, node = key[head:], node[head:]
            if not len(key):
                continue
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
        key, node = key[new], node[new]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        many = np.diff(np.append(first, len(key)))
        name = mix(np.add.reduceat(mix(node.view(_U)), first) + many.astype(_U)).view(np.int64)
        keep = np.zeros(len(first), bool)
        if len(seen) > 2_000_000:
            seen.clear()
        for i in np.flatnonzero(many > 1).tolist():
            if (x := int(name[i])) not in seen:
                seen.add(x)
                keep[i] = True
        rows = np.repeat(keep, many)
        if rows.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, many)[rows]), pa.array(node[rows])], ["cell", "node"])


def classes(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, key: str = "doc_id") -> DataFrame:
    """key, n_shingles, component_id (the smallest key reachable by links) and node (the set's identity) of every row."""
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        kind = docs.schema[key].dataType.simpleString()
        docs = docs.select(F.col(key).alias("id"), F.col("text"))

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows, data, offs in blocks(batch):
                    sets = shingle_sets(data, offs, k)
                    yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())], ["id", "n", "node"])

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[int, Scheme | Few] = {}
            for batch in batches:
                for _, data, offs in blocks(batch):
                    out = {node_of(s): s for s in shingle_sets(data, offs, k) if len(s)}
                    found = [(node, x) for node, s in out.items() for scheme in schemes_of(len(s), percent, known) for x in [scheme.keys(s)]]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x for _, x in found]).view(np.int64)), pa.array(np.repeat([n for n, _ in found], [len(x) for _, x in found]))], ["key", "node"])

        measured = scratch.keep(docs.mapInArrow(measure, f"id {kind}, n long, node long"))
        pairs = docs.select("text").mapInArrow(keys, "key long, node long")
        ordered = pairs.repartition(F.col("key")).sortWithinPartitions("key", "node")
        cells = scratch.keep(ordered.mapInArrow(_cells, "cell long, node long").distinct())

        sets = scratch.keep(_sets(docs, cells, k))
        vectors = scratch.keep(sets.mapInArrow(_vectors, "node long, n int, vector binary"))
        links = cut(_verified(_stars(cells), sets, percent))
        parts = components(links)
        rest = cut(_rest(cells, parts, vectors, sets, percent))
        if not rest.isEmpty():
            parts = components(links.unionByName(rest))

        named = measured.where("node is not null").groupBy("node").agg(F.min("id").alias("least")).join(parts, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        roots = named.groupBy("comp").agg(F.min("least").alias("root"))
        named = named.join(roots, "comp").select("node", "root")
        result = measured.join(named, "node", "left").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id"), "node")
        result = cut(result)
    return result


def _sets(docs: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """node and members (sorted 64-bit hashes) of the nodes of cells; a bitmap of fixed size leaves most others out."""
    mask = (1 << FILTER_BITS) - 1
    place = F.col("node").bitwiseAND(F.lit(mask))
    rows = cells.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    bitmap = np.zeros(1 << FILTER_BITS, bool)
    for r in rows:
        part = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little").astype(bool)
        at = (r["b"] - 1) * len(part) + 1 if r["b"] > 0 else 0  # Spark numbers buckets from 1, and has place 0 apart
        bitmap[(at + np.flatnonzero(part)) & mask] = True
    packed = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(packed.value).astype(bool)
        for batch in batches:
            for _, data, offs in blocks(batch):
                found = {node: s for s in shingle_sets(data, offs, k) if len(s) and wanted[(node := node_of(s)) & mask]}
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([s.tobytes() for s in found.values()], pa.binary())], ["node", "members"])

    return docs.select("text").mapInArrow(gather, "node long, members binary").groupBy("node").agg(F.min("members").alias("members"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that reach the similarity: bounded by their counts first."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
                bound = int(np.minimum(counts(x, 64), counts(y, 64)).sum())
                keep.append((100 + percent) * bound >= percent * (len(x) + len(y)) and similar(x, y, percent))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    rows = pairs.join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b").join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a")
    return rows.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(x, _U) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array([packed_counts(s) for s in sets], pa.binary())], ["node", "n", "vector"])


def _stars(cells: DataFrame) -> DataFrame:
    """(a, b): each node and the one in most cells among those that it shares a cell with."""
    ranked = cells.join(cells.groupBy("node").agg(F.count("*").alias("d")), "node")
    hubs = ranked.groupBy("cell").agg(F.max(F.struct("d", "node")).alias("hub"))
    best = cells.join(hubs, "cell").groupBy("node").agg(F.max("hub").alias("hub"))
    return cut(best.where("node <> hub.node").select(F.col("node").alias("a"), F.col("hub.node").alias("b")))


def _rest(cells: DataFrame, parts: DataFrame, vectors: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components that share a cell."""
    dealt = deal(cells.join(parts, "node", "left").withColumn("comp", F.coalesce("comp", "node")), BLOCK)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_keys(batches):
            node, comp, n, vector = (t.column(c).to_pylist() for c in ("node", "comp", "n", "vector"))
            out: dict[tuple[int, ...], list[int]] = {}
            for a, b, left_at, right_at in sides(t):
                at = {node[a + i]: a + i for i in search(comp[a:b], n[a:b], vector[a:b], left_at, right_at, percent)}
                if at:  # groups with the same nodes are solved once
                    out[tuple(sorted(at))] = [at[x] for x in sorted(at)]
            name = [int(mix(mix(np.array(k, np.int64).view(_U)).sum(keepdims=True)).view(np.int64)[0]) for k in out]
            rows = [i for k in out.values() for i in k]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(name, np.int64), [len(k) for k in out])), pa.array([node[i] for i in rows], pa.int64()), pa.array([comp[i] for i in rows], pa.int64())], ["g", "node", "comp"]
            )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_keys(batches):
            g = t.column("g").to_numpy()
            first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]])).tolist()
            node, comp, members = t.column("node").to_pylist(), t.column("comp").to_pylist(), t.column("members")
            found: list[tuple[int, int]] = []
            for a, b in zip(first[:-1], first[1:], strict=True):
                found += solve(node[a:b], comp[a:b], [np.frombuffer(x, _U) for x in members.slice(a, b - a).to_pylist()], percent)
            yield pa.RecordBatch.from_arrays([pa.array([max(x) for x in found], pa.int64()), pa.array([min(x) for x in found], pa.int64())], ["a", "b"])

    near = dealt.join(vectors, "node").select("g", "node", "comp", "is_left", "is_right", "n", "vector")
    near = cut(near.repartition("g").sortWithinPartitions("g").mapInArrow(look, "g long, node long, comp long").distinct())
    full = near.join(sets, "node").select("g", "node", "comp", "members")
    return full.repartition("g").sortWithinPartitions("g").mapInArrow(link, "a long, b long").distinct()


def one_of_each(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The documents, with all their columns, one of each class: the smallest doc_id. Rows equal in doc_id and text are one document."""
    same, h = F.xxhash64("doc_id", "text"), fresh(docs.columns, "_h")
    found = classes(docs.select(F.struct("doc_id", same.alias("h")).alias("key"), "text"), k, percent, "key")
    kept = found.where(F.col("key").eqNullSafe(F.col("component_id"))).select(F.col("key.h").alias(h)).distinct()
    return docs.withColumn(h, same).join(kept, h, "left_semi").dropDuplicates([h]).drop(h)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the near-duplicate class of every document."""
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def brute_force(docs: list[tuple[int, str | None]], k: int = SHINGLE, percent: int = PERCENT) -> list[tuple]:
    """The contract on Python lists, for tests."""
    import re

    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(docs)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(range(len(docs)), key=lambda i: len(sets[i]))
    for x, i in enumerate(order):
        for j in order[x + 1 :]:
            if sets[i] and percent * len(sets[j]) > 100 * len(sets[i]):
                break
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(docs)]
