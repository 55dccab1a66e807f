"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with documents.

A benchmark item is cut into windows of ``window`` consecutive words (a shorter, not empty item is one
window). Words are ordered by rarity, their document frequency over all documents; for exact containment
the necessary prefix of a window is its one rarest word. Every document word is looked up among the prefix
words; its position less the word's offset in the window is the only place where the window can stand
(positional bound), which must lie within the document (length bound); the words there are then compared.

The documents are never shuffled: they stream through two passes (word frequencies of the benchmark's
vocabulary; the join). The benchmark side is sent to the tasks in blocks of at most ``BLOCK_WORDS`` words,
one pass a block, so a benchmark of any size works in bounded memory. With several blocks the documents are first written
with a number for each row, by which the passes' results are put together.

Defined results. Null or empty texts have no words and no hits. Items without words, or whose item_id is null,
take no part. Several rows of one item_id are that item's windows together. Repeated document rows each get
a result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, cut, table
from .textkit import ALNUM, LOWER, Words, blocks, hash_words

WINDOW = 10
#: Benchmark words sent to the tasks at once: 16 bytes each, and each window's place.
BLOCK_WORDS = 500_000


def _lookup(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in h whose value is among the sorted keys, and the key's index; a bitmap screens first."""
    screen = np.zeros(1 << 20, bool)
    screen[(keys & np.uint64(0xFFFFF)).astype(np.int64)] = True
    at = np.flatnonzero(screen[(h & np.uint64(0xFFFFF)).astype(np.int64)])
    k = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
    ok = keys[k] == h[at]
    return at[ok], k[ok]


def _frequencies(docs: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """The number of documents that hold each word of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for _, data, offs in blocks(batch):
                data = LOWER[data]
                w = Words(data, offs, ALNUM)
                at, k = _lookup(vocabulary, hash_words(data, w))
                if len(at):
                    seen = np.unique(w.row()[at] * len(vocabulary) + k)
                    total += np.bincount(seen % len(vocabulary), minlength=len(vocabulary))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(vocabulary[some].view(np.int64)), pa.array(total[some])], ["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(rows.column("word").to_pylist(), rows.column("n").to_pylist(), strict=True))


class Windows:
    """A block of items: their words, and for each window its item, start, length and prefix word."""

    def __init__(self, items: list[tuple[int, np.ndarray]], window: int):
        self.ids = np.array([i for i, _ in items], object)
        self.words = np.concatenate([h for _, h in items])
        start, length, item, base = [], [], [], 0
        for k, (_, h) in enumerate(items):
            n = max(1, len(h) - window + 1)
            start.append(base + np.arange(n))
            length.append(np.full(n, min(window, len(h))))
            item.append(np.full(n, k))
            base += len(h)
        self.start, self.length, self.item = map(np.concatenate, (start, length, item))

    def order(self, frequency: dict[int, int]) -> Windows:
        """Choose each window's rarest word and sort the windows by it."""
        rarity = np.array([frequency.get(int(x), 0) for x in self.words.view(np.int64)], np.int64)
        longest = int(self.length.max())
        grid = np.minimum(np.arange(longest)[None, :], self.length[:, None] - 1)
        at = self.start[:, None] + grid
        # ties of rarity are broken by the word itself, so that equal windows choose alike
        order = np.lexsort((self.words, rarity))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.offset = np.argmin(rank[at], axis=1)
        prefix = self.words[self.start + self.offset]
        by = np.argsort(prefix, kind="stable")
        self.start, self.length, self.item, self.offset = (x[by] for x in (self.start, self.length, self.item, self.offset))
        self.keys, self.begin, self.many = np.unique(prefix[by], return_index=True, return_counts=True)
        return self

    def join(self, h: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, length, item) of each place in the block where a window stands."""
        at, k = _lookup(self.keys, h)
        many = self.many[k]
        pos = np.repeat(at, many)
        win = np.repeat(self.begin[k] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        row = np.searchsorted(w.first, pos, "right") - 1
        place = pos - self.offset[win]
        ok = (place >= w.first[row]) & (place + self.length[win] <= w.first[row + 1])
        place, win = place[ok], win[ok]
        for j in range(int(self.length.max()) if len(win) else 0):
            same = (j >= self.length[win]) | (h[np.minimum(place + j, len(h) - 1)] == self.words[np.minimum(self.start[win] + j, len(self.words) - 1)])
            place, win = place[same], win[same]
        return place, self.length[win], self.item[win]


_SPANS = "n_words long, spans array<struct<first: long, last: long>>, item_ids array<string>"


def _pass(docs: DataFrame, keys: list[str], windows: Windows | None) -> DataFrame:
    """One pass over the documents: their keys, words, merged hit spans and found items."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema) + ", " + _SPANS
    span = pa.struct([("first", pa.int64()), ("last", pa.int64())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in blocks(batch):
                data = LOWER[data]
                w = Words(data, offs, ALNUM)
                spans: list = [[] for _ in range(rows.num_rows)]
                items: list = [[] for _ in range(rows.num_rows)]
                if windows is not None and len(w.starts):
                    place, length, item = windows.join(hash_words(data, w), w)
                    change = np.zeros(len(w.starts) + 1, np.int64)
                    np.add.at(change, place, 1)
                    np.add.at(change, place + length, -1)
                    hit = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
                    edge = np.concatenate([w.first, np.flatnonzero(hit[1:] != hit[:-1])])
                    edge = np.unique(edge[edge < len(w.starts)])
                    edge = edge[hit[1:-1][edge]] if len(edge) else edge
                    stop = np.searchsorted(np.concatenate([np.flatnonzero(~hit[1:-1]), [len(w.starts)]]), edge)
                    stop = np.concatenate([np.flatnonzero(~hit[1:-1]), [len(w.starts)]])[stop]
                    row = np.searchsorted(w.first, edge, "right") - 1
                    stop = np.minimum(stop, w.first[row + 1])
                    for r, a, b in zip(row.tolist(), (edge - w.first[row]).tolist(), (stop - w.first[row]).tolist(), strict=True):
                        spans[r].append({"first": a, "last": b})
                    found = np.unique((np.searchsorted(w.first, place, "right") - 1) * len(windows.ids) + item)
                    for r, i in zip((found // len(windows.ids)).tolist(), windows.ids[found % len(windows.ids)].tolist(), strict=True):
                        items[r].append(i)
                cols = [rows.column(rows.schema.get_field_index(k)) for k in keys]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(w.counts.astype(np.int64)), pa.array(spans, pa.list_(span)), pa.array(items, pa.list_(pa.string()))], [*keys, "n_words", "spans", "item_ids"])

    return docs.select(*keys, "text").mapInArrow(join, schema)


def item_blocks(items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> list[Windows]:
    """The items in blocks of bounded size."""
    passes: list[Windows] = []
    pending: list[tuple[str, np.ndarray]] = []
    size = 0
    for row in items.where("item_id is not null and text is not null").select(F.col("item_id").cast("string"), "text").toLocalIterator():
        data = LOWER[np.frombuffer(row[1].encode(), np.uint8)]
        w = Words(data, np.array([0, len(data)]), ALNUM)
        h = hash_words(data, w)
        if not len(h):
            continue
        if pending and size + len(h) > block_words:
            passes.append(Windows(pending, window))
            pending, size = [], 0
        pending.append((row[0], h))
        size += len(h)
    return [*passes, Windows(pending, window)] if pending else passes


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents, with all their columns, in which no benchmark window stands; nothing is shuffled."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    for block in item_blocks(items, window, block_words):
        block.order(_frequencies(docs, np.unique(block.words)))

        def clean(batches: Iterator[pa.RecordBatch], block: Windows = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows, data, offs in blocks(batch):
                    data = LOWER[data]
                    w = Words(data, offs, ALNUM)
                    keep = np.ones(rows.num_rows, bool)
                    if len(w.starts):
                        place, _, _ = block.join(hash_words(data, w), w)
                        keep[np.searchsorted(w.first, place, "right") - 1] = False
                    yield rows.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, fields)
    return docs


def contaminated_spans(docs: DataFrame, items: DataFrame, keys: list[str] | None = None, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """For each document row: ``keys``, n_words, the merged spans [first, last) of words inside benchmark windows, and item_ids, in the type that items have."""
    keys = keys or ["doc_id"]
    docs = docs.select(*keys, "text")
    kind = items.schema["item_id"].dataType.simpleString()
    typed = lambda found: found.withColumn("item_ids", F.col("item_ids").cast(f"array<{kind}>"))
    passes = item_blocks(items, window, block_words)
    if len(passes) < 2:
        for block in passes:
            block.order(_frequencies(docs, np.unique(block.words)))
        return typed(_pass(docs, keys, passes[0] if passes else None))
    # several blocks: each row's spans and items are put together again, by a number that is written down as it may differ between runs
    with Scratch(docs.sparkSession) as scratch:
        docs = scratch.keep(docs.withColumn("_row", F.monotonically_increasing_id()))
        named = ["_row", *keys]
        found = None
        for block in passes:
            block.order(_frequencies(docs, np.unique(block.words)))
            part = scratch.keep(_pass(docs, named, block))
            found = part if found is None else found.unionByName(part)
        joined = found.groupBy(*named).agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"))
        merged = F.expr(
            "aggregate(s, cast(array() as array<struct<first: bigint, last: bigint>>), (acc, x) -> if(size(acc) > 0 and element_at(acc, -1).last >= x.first,"
            " concat(slice(acc, 1, size(acc) - 1), array(named_struct('first', element_at(acc, -1).first, 'last', greatest(element_at(acc, -1).last, x.last)))), concat(acc, array(x))))"
        )
        result = cut(typed(joined.select(*keys, "n_words", merged.alias("spans"), "item_ids")))
    return result


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``contaminated_spans``."""
    hits = F.expr("aggregate(spans, 0L, (n, x) -> n + x.last - x.first)")
    ids = F.array_distinct("item_ids")
    return found.select(
        "doc_id", "n_words", hits.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(F.transform(ids, lambda x: x.cast("string")))), 256).alias("items_sha256"), (hits > 0).alias("contaminated"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every document against every benchmark item."""
    return digest(contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple]:
    """The contract on Python lists, for tests."""
    import re

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins: dict[tuple, set] = {}
    for i, t in items:
        words = split(t)
        for a in range(max(1, len(words) - window + 1) if words and i is not None else 0):
            wins.setdefault(tuple(words[a : a + window]), set()).add(i)
    out = []
    for d, t in docs:
        words = split(t)
        hit, ids = set(), set()
        for n in {len(x) for x in wins}:
            for a in range(len(words) - n + 1):
                if got := wins.get(tuple(words[a : a + n])):
                    hit.update(range(a, a + n))
                    ids |= got
        out.append((d, len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit)))
    return out
