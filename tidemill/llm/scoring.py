"""LM scoring: prediction by partial matching over bytes, beside a word unigram base.

Training counts, over all whole training texts, every byte with the ``ORDER`` bytes before it (texts are
lower-cased; before the first byte stand start marks, after the last an end mark). Shorter contexts' counts are
sums of these, so the trie's level of order k is a table of (context, byte) counts. A byte is coded at the longest
known context with probability (n - 1/2) / total; one not seen there costs the escape
distinct / 2 / total and is looked for at the next shorter context, whose counts leave out the bytes
already excluded (symbol exclusion); below order 0 all bytes not yet seen are equally likely. A text's score is the
sum of the base-10 logarithms.

The trie grows with the number of different byte n-grams, and keeps its full order at every size. It is sent to the tasks in
parts of about ``MAX_NODES`` nodes, one pass over the documents a part. A part holds all contexts that end in a range of
two bytes, and, as all parts do, the counts of orders 0 and 1 (2^16 at most); so each byte is coded whole in one part.

The base score needs the training count of every word. Words with at least ``HOT`` of all training tokens (1 / HOT at
most) are sent to the tasks and added up there; only the other words are shuffled, so no hot word meets in one task.

Defined results. A null or empty text is one end token. Words equal in a 64-bit hash are taken for the same, and so are rows equal in one of
doc_id and text (each gets a result). Without training texts every byte costs log10(1/256). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, cut, table
from .textkit import LOWER, SPACED, Words, blocks, crc_mod, hash_words, mix

ORDER = 5
#: Nodes of the trie sent to the tasks at once, about 100 bytes each; contexts that end in the same two bytes stay together.
MAX_NODES = 1_000_000
HOT = 2e-6
START, STOP = 0xFE, 0xFF
#: The end token's place among the word hashes.
END = np.uint64(0x9B97F4A7C15F39CC)
_U = np.uint64


def windows(data: np.ndarray, offs: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Each byte (and the end mark) with the ``order`` bytes before it as one number, the byte highest; and its row."""
    n = len(offs) - 1
    row = np.repeat(np.arange(n), np.diff(offs))
    out = np.full(len(data) + n * (order + 1) + 8, START, np.uint8)
    out[np.arange(len(data)) + row * (order + 1) + order] = data
    out[offs[1:] + np.arange(1, n + 1) * (order + 1) - 1] = STOP
    eight = np.ndarray((len(out) - 7,), "<u8", buffer=out.data, strides=(1,))
    rows = np.repeat(np.arange(n), np.diff(offs) + 1)
    at = np.arange(len(rows)) + rows * order
    return eight[at] & _U((1 << (8 * (order + 1))) - 1), rows


class Merged:
    """Counts by key, merged block by block."""

    def __init__(self) -> None:
        self.keys, self.n, self.parts, self.size = np.zeros(0, _U), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        k, n = np.unique(keys, return_counts=True)
        self.parts.append((k, n))
        self.size += len(k)
        if self.size > 1_000_000 + len(self.keys):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.parts)])
        n = np.concatenate([self.n, *(n for _, n in self.parts)])
        if len(keys):
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self.keys, self.n = keys[first], np.add.reduceat(n, first)
        self.parts, self.size = [], 0

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        out = self.keys, self.n
        self.keys, self.n = np.zeros(0, _U), np.zeros(0, np.int64)
        return out


def _gather(docs: DataFrame, modulus: int, held: int) -> DataFrame:
    """kind (0: word, 1: byte with its context), key and n over the training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, nodes = Merged(), Merged()

        def out() -> Iterator[pa.RecordBatch]:
            for kind, m in ((0, words), (1, nodes)):
                k, n = m.take()
                for at in range(0, len(k), 100_000):
                    part = k[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part.view(np.int64)), pa.array(n[at : at + 100_000])], ["kind", "key", "n"])

        for batch in batches:
            for rows, data, offs in blocks(batch, limit=1 << 20):
                data = LOWER[data]
                words.add(np.concatenate([hash_words(data, Words(data, offs, SPACED)), np.full(rows.num_rows, END)]))
                nodes.add(windows(data, offs, ORDER)[0])
                if len(words.keys) + len(nodes.keys) > 4_000_000:
                    yield from out()
        yield from out()

    allowed = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus != held
    rows = docs.where(allowed).select("text")
    return rows.mapInArrow(count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Table:
    """A read-only open-addressing map from 64-bit numbers to rows of values, probed for whole arrays."""

    def __init__(self, keys: np.ndarray, **values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys, self.values = keys, values
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = self._slot(keys)
        out = self.slots[at].astype(np.int64)
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        at = at[todo]
        while len(todo):
            at = (at + 1) & ((1 << self.bits) - 1)
            got = self.slots[at].astype(np.int64)
            out[todo] = got
            more = (got >= 0) & (self.keys[got] != keys[todo])
            todo, at = todo[more], at[more]
        return out


class Trie:
    """The levels of a pretrained context trie, ready for lookups."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, order: int = ORDER, depth: int = ORDER, low: tuple[np.ndarray, np.ndarray] | None = None):
        """keys, n: counts of each byte with its ``order`` bytes before it; depth: the longest context to use.

        low: for a part of the trie, the counts of each byte with the byte before it in all of it."""
        self.order, self.depth = order, depth
        level: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(depth + 1):
            whole = low is not None and k < 2
            short, many = (low[0] >> _U(8 * (1 - k)), low[1]) if whole else (keys >> _U(8 * (order - k)), n)
            u, back = np.unique(short, return_inverse=True)
            level.append((u, np.bincount(back, many, len(u)).astype(np.int64)))
        self.symbols: list[Table] = []
        self.contexts: list[Table | None] = []
        total, distinct = [], []
        for k, (u, c) in enumerate(level):
            ctx = u & _U((1 << (8 * k)) - 1)
            names, back = np.unique(ctx, return_inverse=True)
            t, d = np.bincount(back, c, len(names)), np.bincount(back, minlength=len(names)).astype(float)
            total.append(t)
            distinct.append(d)
            values = {"esc": np.log10(d / 2 / t)}
            if k:  # below this context, at the next shorter one: what is left of its counts after exclusion
                parent = self.symbols[k - 1].find(u >> _U(8))
                excluded = np.bincount(back, level[k - 1][1][parent], len(names))
                above = self.contexts[k - 1].find(names >> _U(8))
                d_left = distinct[k - 1][above] - d
                left = total[k - 1][above] - excluded
                values["below"] = np.log10(np.maximum(left, 1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    values["below_esc"] = np.where(d_left > 0, np.log10(d_left / 2 / left), 0.0)
            self.contexts.append(Table(names, **values))
            # log10 of n - 1/2 and, where no longer context is known, of (n - 1/2) / total
            self.symbols.append(Table(u, log=np.log10(c - 0.5), direct=np.log10((c - 0.5) / t[back])))
        seen = int(distinct[0][0]) if len(distinct[0]) else 0
        self.uniform = -np.log10(max(1, 256 - seen))

    def code(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each byte after its context."""
        out = np.zeros(len(keys))
        if not len(self.symbols[0].keys):
            return out + self.uniform
        todo = np.arange(len(keys))
        above = np.full(len(keys), -1, np.int64)  # the known context of the next order, from which was escaped
        for k in range(self.depth, -1, -1):
            key = keys[todo] >> _U(8 * (self.order - k))
            row = self.symbols[k].find(key)
            hit = row >= 0
            excluding = above >= 0
            sym = self.symbols[k].values
            plain = hit & ~excluding
            out[todo[plain]] += sym["direct"][row[plain]]
            part = hit & excluding
            if k < self.depth:
                up = self.contexts[k + 1].values
                out[todo[part]] += sym["log"][row[part]] - up["below"][above[part]]
            miss = ~hit
            key, todo, above = key[miss], todo[miss], above[miss]
            here = self.contexts[k].find(key & _U((1 << (8 * k)) - 1))
            was = above >= 0
            if k < self.depth:
                out[todo[was]] += up["below_esc"][above[was]]
            first = ~was & (here >= 0)
            out[todo[first]] += self.contexts[k].values["esc"][here[first]]
            above = here
            if not len(todo):
                return out
        out[todo] += self.uniform
        return out


def _last_two(key: Column) -> Column:
    """The two bytes before the byte that is coded, as one number."""
    return F.shiftrightunsigned(key, 8 * (ORDER - 2)).bitwiseAND(F.lit(0xFFFF))


def _numbers(nodes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = nodes.select("key", "n").toArrow().sort_by("key")
    return got.column("key").to_numpy().astype(np.int64).view(_U), got.column("n").to_numpy()


def _ranges(nodes: DataFrame) -> list[tuple[int, int]]:
    """Ranges of the last two bytes, of MAX_NODES nodes or less (or one value); together they hold all values."""
    sizes = np.zeros(1 << 16, np.int64)
    for pair, n in nodes.groupBy(_last_two(F.col("key")).alias("pair")).count().collect():  # 2^16 rows at most
        sizes[pair] = n
    out, low, held = [], 0, 0
    for pair, n in enumerate(sizes.tolist()):
        if held and held + n > MAX_NODES:
            out.append((low, pair))
            low, held = pair, 0
        held += n
    return [*out, (low, 1 << 16)]


def _tries(nodes: DataFrame, ranges: list[tuple[int, int]]) -> Iterator[Trie]:
    """The parts of the trie, one after another, built on the driver."""
    if len(ranges) == 1:
        yield Trie(*_numbers(nodes))
        return
    low = _numbers(nodes.groupBy(F.shiftrightunsigned("key", 8 * (ORDER - 1)).alias("key")).agg(F.sum("n").alias("n")))
    for a, b in ranges:
        yield Trie(*_numbers(nodes.where(_last_two(F.col("key")).between(a, b - 1))), low=low)


def _score(trie: Trie, data: np.ndarray, offs: np.ndarray, low: int, high: int) -> np.ndarray:
    """Each row's sum over the bytes whose context ends in the range."""
    key, of = windows(data, offs, ORDER)
    if high - low < 1 << 16:
        pair = (key >> _U(8 * (ORDER - 2))) & _U(0xFFFF)
        mine = (pair >= low) & (pair < high)
        key, of = key[mine], of[mine]
    return np.bincount(of, trie.code(key), len(offs) - 1).astype(float)


def _added(rows: DataFrame, part: Trie, held_range: tuple[int, int], scratch: Scratch) -> DataFrame:
    """same and part: what a part of the trie adds to the score of the rows of one name (same, text)."""
    shared = rows.sparkSession.sparkContext.broadcast(part)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch in batches:
            for rows, data, offs in blocks(batch, limit=1 << 20):
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(_score(trie, LOWER[data], offs, *held_range))], ["same", "part"])

    scored = rows.mapInArrow(apply, "same long, part double").groupBy("same").agg(F.max("part").alias("part"))
    added = scratch.keep(scored)
    shared.unpersist()
    return added


def lm_scores(docs: DataFrame, modulus: int = 5, held: int = 1) -> DataFrame:
    """The contract's columns for every document, and n_bytes, the symbols coded."""
    with Scratch(docs.sparkSession) as scratch:
        return _lm_scores(docs.select("doc_id", "text"), modulus, held, scratch)


def _lm_scores(docs: DataFrame, modulus: int, held: int, scratch: Scratch) -> DataFrame:
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == held
    same = F.xxhash64("doc_id", "text").alias("same")  # rows equal in it get equal scores
    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("at"), "text", out.alias("held_out"), same)
    counts = scratch.keep(_gather(docs, modulus, held))
    vocabulary = counts.where("kind = 0").select(F.col("key").alias("word"), F.col("n").alias("c"))
    size = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, distinct = int(size[0]), int(size[1])
    down = total + 0.5 * (distinct + 1)
    hot = vocabulary.where(F.col("c") >= total * HOT).toArrow()  # 1 / HOT words at most
    nodes = counts.where("kind = 1")
    ranges = _ranges(nodes)
    parts = _tries(nodes, ranges)
    first = ranges[0]
    shared = docs.sparkSession.sparkContext.broadcast(
        (
            next(parts),
            Table(hot.column("word").to_numpy().astype(np.int64).view(_U), log=np.log10((hot.column("c").to_numpy().astype(float) + 0.5) / down)),
        )
    )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, words = shared.value
        for batch in batches:
            for rows, data, offs in blocks(batch, limit=1 << 20):
                data = LOWER[data]
                n = rows.num_rows
                w = Words(data, offs, SPACED)
                h = np.concatenate([hash_words(data, w), np.full(n, END)])
                row = np.concatenate([w.row(), np.arange(n)])
                at = words.find(h)
                known = at >= 0
                base = np.bincount(row[known], words.values["log"][at[known]], n).astype(float)  # without rows it counts in integers
                rest = np.flatnonzero(~known)
                rest = rest[np.argsort(row[rest], kind="stable")]
                lists = pa.ListArray.from_arrays(np.searchsorted(row[rest], np.arange(n + 1)).astype(np.int32), pa.array(h[rest].view(np.int64)))
                score = _score(trie, data, offs, *first)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), rows.column(4), rows.column(3), pa.array((w.counts + 1).astype(np.int64)), pa.array(np.bincount(row[known], minlength=n).astype(np.int64)), pa.array(base), pa.array(score), pa.array(np.diff(offs) + 1), lists],
                    ["doc_id", "at", "same", "held_out", "n_tokens", "hot_known", "hot_base", "score", "n_bytes", "rest"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    passed = numbered.mapInArrow(
        apply, f"doc_id {kind}, at long, same long, held_out boolean, n_tokens long, hot_known long, hot_base double, score double, n_bytes long, rest array<long>"
    )
    passed = scratch.keep(passed)
    shared.unpersist()
    added, whole = None, passed.drop("rest")
    for held_range, part in zip(ranges[1:], parts, strict=True):
        more = _added(docs.select(same, "text"), part, held_range, scratch)
        added = more if added is None else added.unionByName(more)
    if added is not None:
        more = added.groupBy("same").agg(F.sum("part").alias("part"))
        whole = whole.join(more, "same").withColumn("score", F.col("score") + F.col("part")).drop("part")
    rare = passed.select("at", F.explode("rest").alias("word")).join(vocabulary, "word", "left")
    log = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(down))
    sums = rare.groupBy("at").agg(F.sum(log).alias("base"), F.count("c").alias("known"))
    result = whole.join(sums, "at", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("hot_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("hot_base") + F.coalesce("base", F.lit(0.0))).alias("base_score"), "score", "n_bytes",
    )
    return cut(result)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: the scores of all documents."""
    return lm_scores(table(spark, sf_dir, "documents"))


def brute_force(docs: list[tuple[int, str | None]], order: int = ORDER) -> list[tuple]:
    """The contract on Python lists, symbol by symbol, for tests."""
    import re
    from collections import Counter, defaultdict
    from math import log10

    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None]
    held = lambda d: crc_mod([d], 5)[0] == 1
    count: Counter = Counter()
    nodes: dict = defaultdict(Counter)
    for d, t in docs:
        if not held(d):
            count.update(words(t))
            s = bytes([START] * order) + low(t).encode() + bytes([STOP])
            for i in range(order, len(s)):
                for k in range(order + 1):
                    nodes[s[i - k : i]][s[i]] += 1
    total = sum(count.values())
    down = total + 0.5 * (len(count) + 1)
    out = []
    for d, t in docs:
        s = bytes([START] * order) + low(t).encode() + bytes([STOP])
        score = 0.0
        for i in range(order, len(s)):
            gone: set = set()
            for k in range(order, -1, -1):
                here = {x: n for x, n in nodes.get(s[i - k : i], {}).items() if x not in gone}
                if not here:
                    continue
                if s[i] in here:
                    score += log10((here[s[i]] - 0.5) / sum(here.values()))
                    break
                score += log10(len(here) / 2 / sum(here.values()))
                gone |= set(here)
            else:
                score -= log10(max(1, 256 - len(gone)))
        w = words(t)
        out.append((d, held(d), len(w), sum(count[x] > 0 for x in w), total, sum(log10((count[x] + 0.5) / down) for x in w), score))
    return out
