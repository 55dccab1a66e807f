"""Candidates and verification of similar lines by the runs of words they share.

Two lines of L words (the longer one's) within k = L // 5 word edits have L - k words in common, in at most k + 1 pieces. So at least
L - k - (q - 1)(k + 1) places of each line begin a run of q words that stands in the other too: 0.4 L - 2 places for q = 3 from L = 6 on,
and 2 for q = 2 at L = 5 (below, no edit is allowed). Call that number T for a line, over all lengths a partner may have.

1. ``pack``: the words of each line become 32-bit codes. One row holds a block of text: its lines, and the codes of its distinct ones.
2. ``count``: each block sends the hashes of its runs and of its lines, in as many buckets as the corpus needs, as packed numbers (4 bytes
   each, once a block however frequent); a bucket returns to each block which of them stand more than once in the corpus (a bit each), and
   how often (up to ``MANY``). A line's runs that stand nowhere but in equal lines count as standing once.
3. ``active``: the runs of a line in one order for all (rarest first, by the count's logarithm and hash). Leaving out the most frequent ones, in fewer than T
   places, keeps the rarest shared run of every pair within the edits in both lines (prefix filtering); of the rest, those that stand
   more than once are the line's keys. Lines of unrelated text have no keys and go no further.
4. ``within``: the edit distance of many pairs at once, in a band of k diagonals, over the codes.

No pair is lost. Words equal in a 32-bit hash are taken for the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cells import sides, whole_keys
from .textkit import ALNUM, Words, blocks, hash_words, mix, shingles

_U = np.uint64
#: Runs that a bucket holds in memory; the number of buckets follows from it.
BUCKET = 1 << 21
#: So many times or more.
MANY = 255
#: Groups of words, whose numbers bound what two lines have in common.
GROUPS = 128
#: Cells of the edit distance that are computed at once, and words.
CELLS = 1 << 18
#: Pairs that are verified at once.
PAIRS = 1 << 14
#: Words of pairs that are sorted at once.
WORDS = 1 << 19


def lower(texts: pa.Array) -> pa.Array:
    """Lower case of all scripts; of A-Z alone in a batch that holds bytes that are no UTF-8."""
    try:
        return pc.utf8_lower(texts)
    except pa.ArrowInvalid:
        return pc.ascii_lower(texts)


def spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first[i] .. first[i] + n[i] - 1 of every i, one after the other."""
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


def lists(values: pa.Array) -> pa.Array:
    """One list of all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, doc_id, text) to a row a block: its lines that have words, and the distinct ones of four words or more with their codes."""
    part, count = TaskContext.get().partitionId(), 0
    for batch in batches:
        batch = batch.set_column(2, "text", lower(batch.column(2)))
        for rows, data, offs in blocks(batch):
            breaks = np.flatnonzero(data == 10)
            per = 1 + np.diff(np.searchsorted(breaks, offs))
            row = np.repeat(np.arange(len(per)), per)
            line = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
            words = Words(data, np.append(np.sort(np.concatenate([offs[:-1], breaks + 1])), len(data)), ALNUM)
            has = np.flatnonzero(words.counts)
            if not len(has):
                continue
            h = hash_words(data, words)
            first, n = words.first[:-1][has], words.counts[has]
            place = np.arange(len(h), dtype=_U) - np.repeat(first.astype(_U), n)
            node = mix(np.add.reduceat(mix(h + place * _U(0x9E3779B97F4A7C15)), first) + n.astype(_U) * _U(0xD6E8FEB86659FD93)).view(np.int64)
            _, one = np.unique(node, return_index=True)
            one = one[n[one] >= 4]
            codes = (h >> _U(32)).astype("<u4")[spans(first[one], n[one])]
            at = pa.array(row[has])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part << 33 | count]), pa.array([len(codes)]), lists(rows.column(0).take(at)), lists(rows.column(1).take(at)), lists(pa.array(line[has], pa.int32())), lists(pa.array(node)),
                    lists(pa.array(node[one])), lists(pa.array(n[one], pa.int32())), pa.array([codes.tobytes()]),
                ],
                ["chunk", "words", "doc", "doc_id", "line", "node", "nodes", "n", "codes"],
            )
            count += 1


def packed(kind: str) -> str:
    """The columns of ``pack`` for doc_ids of a kind."""
    return f"chunk long, words long, doc array<long>, doc_id array<{kind}>, line array<int>, node array<long>, nodes array<long>, n array<int>, codes binary"


def runs(n: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The line and the hash of every run on which lines meet: of 3 words from 5 words on, of 2 words at 4 and 5."""
    line = np.repeat(np.arange(len(n)), n)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(line))  # words from here to the line's end
    h = codes.astype(_U)
    three = np.flatnonzero((left >= 3) & (n >= 5)[line])
    two = np.flatnonzero((left >= 2) & (n <= 5)[line])
    return np.concatenate([line[three], line[two]]), np.concatenate([shingles(h, 3)[three], shingles(h, 2)[two]])


def shared_places(n: np.ndarray) -> np.ndarray:
    """T for runs of 3 words: in how many places at least a line of n words (5 or more) begins one that any line within the edits has too."""
    places = lambda longer: longer - 3 * (longer // 5) - 2
    ahead = -(-n // 5) * 5  # of the longer lengths that a partner may have, the least is at a multiple of 5
    return np.where(n == 5, 1, np.where(ahead - ahead // 5 <= n, np.minimum(places(n), places(ahead)), places(n)))


def marks(nodes: np.ndarray) -> np.ndarray:
    """Hashes of lines, which go with those of runs."""
    return mix(nodes.view(_U) ^ _U(0xA24BAED4963EE407))


def named(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket (it grows with the hash) and the name within it of each run."""
    return (h >> _U(32)) * _U(buckets) >> _U(32), (h & _U(0xFFFFFFFF)).astype("<u4")


def sent(buckets: int) -> Callable:
    """From blocks: (bucket, chunk, names, repeats) where repeats holds the places and numbers of those that stand more than once."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, nodes, n, codes in zip(*(batch.column(c) for c in ("chunk", "nodes", "n", "codes")), strict=True):
                _, h = runs(n.values.to_numpy(), np.frombuffer(codes.as_py(), "<u4"))
                h = np.sort(np.concatenate([h, marks(nodes.values.to_numpy())]))
                new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
                many = np.diff(np.append(new, len(h)))
                bucket, name = named(h[new], buckets)
                begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
                names, repeats = [], []
                for a, b in zip(begin, np.append(begin[1:], len(bucket)), strict=True):
                    more = np.flatnonzero(many[a:b] > 1)
                    names.append(name[a:b].tobytes())
                    repeats.append(np.stack([more, many[a:b][more]]).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[begin].astype(np.int64)), pa.array([chunk.as_py()] * len(begin), pa.int64()), pa.array(names, pa.binary()), pa.array(repeats, pa.binary())], ["bucket", "chunk", "names", "repeats"]
                )

    return send


def summed(t: pa.Table) -> pa.Table:
    """Of one bucket: for each block one bit a name, whether it stands more than once in the corpus, and how often for those."""
    names = [np.frombuffer(x.as_py(), "<u4") for x in t.column("names")]
    weights = [np.ones(len(x), np.uint32) for x in names]
    for w, x in zip(weights, t.column("repeats"), strict=True):
        place, many = np.frombuffer(x.as_py(), "<u4").reshape(2, -1)
        w[place] = many
    ends = np.cumsum([len(x) for x in names])
    weight, order = np.concatenate(weights), np.concatenate(names).astype(_U)
    del names, weights
    order <<= _U(32)  # in place, as these are the largest arrays of all tasks
    order |= np.arange(len(order), dtype=_U)
    order.sort()
    at = order.astype(np.uint32)
    order >>= _U(32)
    new = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]]))
    del order
    total = np.zeros(len(at), np.uint8)
    total[at] = np.repeat(np.minimum(np.add.reduceat(weight[at], new, dtype=np.int64), MANY).astype(np.uint8), np.diff(np.append(new, len(at))))
    flags, often = [], []
    for part in np.split(total, ends[:-1]):
        flags.append(np.packbits(part > 1).tobytes())
        often.append(part[part > 1].tobytes())
    return t.select(["bucket", "chunk"]).append_column("flags", pa.array(flags, pa.binary())).append_column("often", pa.array(often, pa.binary()))


def _alone(line: np.ndarray, h: np.ndarray, often: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Whether a run stands only in its line and in the line's copies. Not told where either number reaches MANY."""
    out = np.zeros(len(line), bool)
    some = np.flatnonzero((copies[line] > 1) & (copies[line] < MANY) & (often < MANY))
    order = some[np.lexsort((h[some], line[some]))]
    if len(order):
        new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (line[order][1:] != line[order][:-1])])
        own = np.diff(np.append(np.flatnonzero(new), len(order)))
        out[order] = often[order] == copies[line[order]] * np.repeat(own, own)
    return out


def _counts(codes: np.ndarray) -> bytes | None:
    """How many words fall in each of ``GROUPS`` groups, if a byte holds each number."""
    c = np.bincount(codes % GROUPS, minlength=GROUPS)
    return c.astype(np.uint8).tobytes() if c.max() < 256 else None


def keyed(buckets: int) -> Callable:
    """From blocks with the repeated runs: the lines that have keys."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nodes, n, codes, hits in zip(*(batch.column(c) for c in ("nodes", "n", "codes", "hits")), strict=True):
                node, n, codes = nodes.values.to_numpy(), n.values.to_numpy().astype(np.int64), np.frombuffer(codes.as_py(), "<u4")
                line, h = runs(n, codes)
                each, back = np.unique(np.concatenate([h, marks(node)]), return_inverse=True)
                bucket = named(each, buckets)[0].astype(np.int64)
                count = np.ones(len(each), np.int64)
                for x in hits.as_py():
                    begin, end = np.searchsorted(bucket, [x["bucket"], x["bucket"] + 1])
                    flags = np.unpackbits(np.frombuffer(x["flags"], np.uint8), count=end - begin).astype(bool)
                    count[begin:end][flags] = np.frombuffer(x["often"], np.uint8)
                often, copies = count[back[: len(h)]], count[back[len(h) :]]
                places = np.flatnonzero(often > 1)
                alone = _alone(line[places], h[places], often[places], copies)
                places = places[~alone]
                side = line[places] * 2 + (places >= (np.maximum(n - 2, 0) * (n >= 5)).sum())  # runs of two and of three words are counted apart
                needed = np.stack([np.where(n >= 5, shared_places(np.maximum(n, 5)), 1 << 62), np.full(len(n), 2)], axis=1).ravel()  # T
                enough = np.bincount(side, minlength=len(needed))[side] >= needed[side]
                places, side = places[enough], side[enough]
                line, h, often, spare = line[places], h[places], np.log2(often[places]).astype(np.int64), needed[side] - 1
                order = np.lexsort((h, -often, side))
                line, h, side, spare = line[order], h[order], side[order], spare[order]
                if not len(h):
                    continue
                last = np.flatnonzero(np.concatenate([(h[1:] != h[:-1]) | (side[1:] != side[:-1]), [True]]))  # of each run of a line
                begins = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]]))
                begin = begins[np.searchsorted(begins, last, "right") - 1]
                last = last[last - begin + 1 > spare[last]]
                line, h = line[last], h[last]
                if not len(h):
                    continue
                order = np.argsort(line, kind="stable")
                line, h = line[order], h[order]
                first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
                who = line[first]
                end = np.cumsum(n)
                own = [codes[end[i] - n[i] : end[i]] for i in who.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(node[who]), pa.array(n[who], pa.int32()), pa.array([x.tobytes() for x in own], pa.binary()), pa.array([_counts(x) for x in own], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.append(first, len(h)), pa.int32()), pa.array(h.view(np.int64))),
                    ],
                    ["node", "n", "codes", "counts", "keys"],
                )

    return key


def count(blocks_: DataFrame, buckets: int) -> DataFrame:
    """For each block its runs that stand more than once: chunk and hits."""
    rows = blocks_.select("chunk", "nodes", "n", "codes").mapInArrow(sent(buckets), "bucket long, chunk long, names binary, repeats binary")
    found = rows.groupBy("bucket").applyInArrow(summed, "bucket long, chunk long, flags binary, often binary")
    return found.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "flags", "often")).alias("hits"))


def active(blocks_: DataFrame, hits: DataFrame, buckets: int) -> DataFrame:
    """node, n, codes, counts and keys of the lines that may have partners."""
    rows = blocks_.select("chunk", "nodes", "n", "codes").join(hits, "chunk").select("nodes", "n", "codes", "hits")
    return rows.mapInArrow(keyed(buckets), "node long, n int, codes binary, counts binary, keys array<long>").dropDuplicates(["node"])


def word_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, codes) to node, most and tokens: a token is a word and which of its repeats in the line it is; two lines within the edits have one among the ``most``
    first of each, in any order that holds for both."""
    for batch in batches:
        codes = [np.frombuffer(x.as_py(), "<u4") for x in batch.column(1)]
        n = np.array([len(x) for x in codes], np.int64)
        key = np.sort(np.repeat(np.arange(len(n), dtype=_U), n) << _U(32) | (np.concatenate(codes).astype(_U) if codes else np.zeros(0, _U)))
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        nth = np.arange(len(key)) - np.repeat(new, np.diff(np.append(new, len(key))))
        token = ((key << _U(32)) | nth.astype(_U)).view(np.int64)
        ends = pa.array(np.append(0, np.cumsum(n)), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n // 5 + 1, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(token))], ["node", "most", "tokens"])


def finer(cells: DataFrame, tokens: DataFrame) -> DataFrame:
    """Cells (cell, node, comp) within cells: lines of different components within the edits that meet in a cell meet in one of its finer ones, too.

    Tokens are ordered by how many lines of the cell have them, and those that only one component has come first, as no such pair shares them
    (prefix filtering): common passages come last and make no cells."""
    rows = cells.join(tokens, "node").select("cell", "node", "comp", "most", F.explode("tokens").alias("token"))
    often = rows.groupBy("cell", "token").agg(F.count("*").alias("m"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    often = often.select("cell", "token", F.when(F.col("low") < F.col("high"), F.col("m")).otherwise(F.lit(0)).alias("m"))
    nth = F.row_number().over(W.partitionBy("cell", "node").orderBy("m", "token"))
    rows = rows.join(often, ["cell", "token"]).withColumn("nth", nth).where("nth <= most and m > 0")
    return rows.select(F.xxhash64("cell", "token").alias("cell"), "node", "comp")


def shared_words(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """How many words each pair of code sequences has in common, whatever their places."""
    size = np.array([len(x) + len(y) for x, y in zip(xs, ys, strict=True)], np.int64)
    out = np.zeros(len(xs), np.int64)
    slices = np.cumsum(size) // WORDS
    for a, b in zip(np.searchsorted(slices, np.unique(slices)), np.searchsorted(slices, np.unique(slices), "right"), strict=True):
        pair = np.arange(b - a, dtype=_U)
        left = [np.repeat(pair, [len(v) for v in side[a:b]]) << _U(33) | np.concatenate(side[a:b]).astype(_U) << _U(1) for side in (xs, ys)]
        both = np.sort(np.concatenate([left[0], left[1] | _U(1)]))
        if not len(both):
            continue
        word = both >> _U(1)
        new = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        of_y = np.add.reduceat((both & _U(1)).astype(np.int64), new)
        least = np.minimum(of_y, np.diff(np.append(new, len(both))) - of_y)
        out[a:b] = np.bincount((word[new] >> _U(32)).astype(np.int64), least, b - a)
    return out


def _banded(xs: list[np.ndarray], ys: list[np.ndarray], band: int, most: np.ndarray) -> np.ndarray:
    """Whether each pair's edit distance is ``most`` at most, where no ``most`` exceeds the band."""
    nx, ny = np.array([len(v) for v in xs], np.int64), np.array([len(v) for v in ys], np.int64)
    rows = int(nx.max())
    x = np.full((len(xs), rows), -1, np.int64)
    y = np.full((len(xs), rows + 2 * band + 1), -2, np.int64)
    for i in range(len(xs)):
        x[i, : nx[i]] = xs[i]
        y[i, band : band + ny[i]] = ys[i]
    offset = np.arange(-band, band + 1, dtype=np.int32)
    cost = np.tile(np.where(offset < 0, 1 << 20, offset).astype(np.int32), (len(xs), 1))
    out, who = np.zeros(len(xs), bool), np.arange(len(xs))
    out[nx == 0] = (ny <= most)[nx == 0]
    for i in range(rows):
        new = cost + (x[who, i][:, None] != y[who, i : i + 2 * band + 1] if len(who) < len(xs) else x[:, i : i + 1] != y[:, i : i + 2 * band + 1])
        np.minimum(new[:, :-1], cost[:, 1:] + 1, out=new[:, :-1])
        new -= offset
        np.minimum.accumulate(new, axis=1, out=new)
        new += offset
        cost = new
        done = nx[who] == i + 1
        if done.any():
            at = who[done]
            out[at] = cost[done, (ny - nx)[at] + band] <= most[at]
        if i % 16 == 15:  # pairs that are done, or beyond their number of edits everywhere, go
            stay = (nx[who] > i + 1) & (cost.min(axis=1) <= most[who])
            if stay.mean() < 0.8:
                who, cost = who[stay], cost[stay]
                if not len(who):
                    break
    return out


def within(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Whether each pair of code sequences is within a fifth of the longer one's length in edits: by their words, then in bands that
    grow up to that number, so that few edits cost little."""
    nx, ny = np.array([len(x) for x in xs], np.int64), np.array([len(y) for y in ys], np.int64)
    allowed, apart = np.maximum(nx, ny) // 5, np.abs(nx - ny)
    out = np.zeros(len(xs), bool)
    todo = np.flatnonzero((apart <= allowed) & (shared_words(xs, ys) >= np.maximum(nx, ny) - allowed))
    step = 6
    while len(todo):
        most = np.minimum(step, allowed)
        now = todo[apart[todo] <= most[todo]]
        now = now[np.lexsort((nx[now], most[now]))]
        at = 0
        while at < len(now):
            to = at + 1
            while to < len(now) and (to - at) * (2 * int(most[now[to]]) + 1 + int(nx[now[to]])) < CELLS and nx[now[to]] <= 2 * nx[now[at]] + 8:
                to += 1
            some = now[at:to]
            out[some] = _banded([xs[i] for i in some], [ys[i] for i in some], int(most[some].max()), most[some])
            at = to
        todo = todo[~out[todo] & (allowed[todo] > step)]
        step *= 4
    return out


def _columns(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """node, comp, n and counts of a table's rows."""
    counts = np.stack([np.frombuffer(x, np.uint8) if x is not None else np.full(GROUPS, 255, np.uint8) for x in t.column("counts").to_pylist()])
    return *(t.column(c).to_numpy() for c in ("node", "comp", "n")), counts


def _possible(i: int, j: np.ndarray, comp: np.ndarray, n: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Those of the rows j of another component than i whose numbers of words, in all and by groups, allow the edits."""
    j = j[comp[j] != comp[i]]
    j = j[np.abs(n[j] - n[i]) <= np.maximum(n[j], n[i]) // 5]
    longer = np.maximum(n[j], n[i])
    return j[np.minimum(counts[j], counts[i]).sum(axis=1, dtype=np.int64) >= longer - longer // 5]


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the groups of ``cells.deal`` the nodes that may have partners: g (now named by these nodes), node and comp."""
    for t in whole_keys(batches):
        node, comp, n, counts = _columns(t)
        names, rows = [], []
        for begin, _, left, right in sides(t):
            left, right = np.array(left) + begin, np.array(right) + begin
            found = [(i, _possible(i, right, comp, n, counts)) for i in left.tolist()]
            some = np.unique(np.concatenate([np.append(j, i) for i, j in found if len(j)] or [np.zeros(0, np.int64)]))
            if len(some):
                some = some[np.unique(node[some], return_index=True)[1]]
                names.append(np.full(len(some), mix(mix(node[some].view(_U)).sum(keepdims=True)).view(np.int64)[0]))
                rows.append(some)
        if rows:
            at = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)), pa.array(node[at]), pa.array(comp[at])], ["g", "node", "comp"])


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of groups of nodes, with their codes, links (a, b) enough to connect the components that similar lines connect."""
    for t in whole_keys(batches):
        node, comp, n, counts = _columns(t)
        codes = [np.frombuffer(x, "<u4") for x in t.column("codes").to_pylist()]
        g = t.column("g").to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]])).tolist()
        pairs: list[np.ndarray] = []
        links: list[np.ndarray] = []
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            for i in range(a + 1, b):
                j = _possible(i, np.arange(a, i), comp, n, counts)
                if len(j):
                    pairs.append(np.stack([np.full(len(j), i), j]))
            if pairs and (k == len(edges) - 2 or sum(p.shape[1] for p in pairs) > PAIRS):
                links.append(_connected(np.concatenate(pairs, axis=1), comp, np.searchsorted(edges, np.arange(len(g)), "right"), codes))
                pairs = []
        i, j = np.concatenate([np.zeros((2, 0), np.int64), *links], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(node[i], node[j])), pa.array(np.minimum(node[i], node[j]))], ["a", "b"])


def _connected(pairs: np.ndarray, comp: np.ndarray, group: np.ndarray, codes: list[np.ndarray]) -> np.ndarray:
    """Of possible pairs of rows the similar ones that are needed to connect what they connect within each group.

    Pairs are verified in rounds: of each pair of components that is not connected yet a few, twice as many each time."""
    parent: dict[tuple[int, int], tuple[int, int]] = {}

    def find(x: tuple[int, int]) -> tuple[int, int]:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    rows, names = np.unique(pairs, return_inverse=True)
    names = names.reshape(pairs.shape)
    out, quota = [np.zeros((2, 0), np.int64)], 1
    while pairs.shape[1]:
        roots: dict[tuple[int, int], int] = {}
        root = np.array([roots.setdefault(find((group[r], comp[r])), len(roots)) for r in rows.tolist()])
        x, y = np.sort(root[names], axis=0)
        apart = x != y
        pairs, names, x, y = pairs[:, apart], names[:, apart], x[apart], y[apart]
        order = np.lexsort((y, x))
        pairs, names, x, y = pairs[:, order], names[:, order], x[order], y[order]
        new = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])) if len(x) else np.zeros(0, np.int64)
        nth = np.arange(len(x)) - np.repeat(new, np.diff(np.append(new, len(x))))
        now = np.flatnonzero(nth < quota)
        good = now[within([codes[i] for i in pairs[0, now]], [codes[j] for j in pairs[1, now]])] if len(now) else now
        for i, j in pairs[:, good].T.tolist():
            p, q = find((group[i], comp[i])), find((group[j], comp[j]))
            if p != q:
                parent[p] = q
                out.append(np.array([[i], [j]]))
        rest = np.ones(len(x), bool)
        rest[now] = False
        pairs, names = pairs[:, rest], names[:, rest]
        quota *= 2
    return np.concatenate(out, axis=1)


def verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are within the edits; lines: node and codes."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(v.as_py(), "<u4") for v in batch.column(c)] for c in (2, 3))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(within(x, y)))

    rows = pairs.join(lines.select(F.col("node").alias("b"), F.col("codes").alias("y")), "b").join(lines.select(F.col("node").alias("a"), F.col("codes").alias("x")), "a")
    return rows.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")
