"""Fuzzy line dedup.

1. Lines are lower-cased and reduced to runs of letters and digits ("words"; all characters beyond ASCII count as letters). Equal ones are one node.
2. Candidates. With ``exact``, which the query and the pipeline use: lines that share a run of words that pigeonhole makes necessary
   (see ``runs``); no pair is lost, and numpy does the work. Without it: SimHash in DataFrame functions only. A node's 64-bit SimHash takes the
   majority of each bit over its words' hashes; two SimHashes that differ in at most 3 of 64 bits agree in at least 2 of 5 blocks (pigeonhole),
   so each line joins on its 10 pairs of blocks. SimHash misses most pairs with several edited words.
3. Pairs are verified: the edit distance over words is at most a fifth of the longer line's words.
   First each line against the smallest one on each of its runs, and the one that most lines meet of those it meets; the components of that; then lines of different components
   that share a key, in blocks, until all that is similar is connected. So large groups cost linear work and nothing stays apart. With ``exact``, lines that share a key with
   many others (a common passage, or three common words of short lines) are met on their rare words instead (see ``runs.finer``).
4. Of each connected group the first occurrence (by doc_id, then line) is kept; all other occurrences are removed.

Defined results. Lines are what newlines separate. Lines without words are kept as they are. A null text stays null and has no
lines; a document that loses all its lines keeps an empty text. Rows equal in doc_id and text count as one document and get the same
result. Lines equal in a 64-bit hash are taken for the same, and so are words equal in a 32-bit hash (``exact``) or in a code of a million
values (without). Extra columns are carried; the results' columns get underscores in front where their names are taken.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runs
from .cells import deal
from .common import Scratch, cut, fresh, table
from .components import components

BITS = 3
SIMILAR = 0.8
LANE = 0x0001000100010001
#: Lines of a block: pairs of blocks are compared in one task.
BLOCK = 256
#: Cells with more lines outside their largest component are cut to finer ones; these, with more than the second number, once more. The first is so small that nearly all
#: lines that can be cut are so at any size of the corpus, and their number grows in proportion; with a larger one ever more of the cells pass it.
LARGE = (4, 1024)
LONGEST = 16_000  # below 2^14, so that no lane can reach its sign bit; longer lines are summed bit by bit
_BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


#: What becomes one space: runs between words, but for a single space, which is left alone as most are.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]{2,}|[\x00-\x1F\x21-\x2F\x3A-\x60\x7B-\x7F]"


def _lines(docs: DataFrame, key: Column) -> DataFrame:
    """doc, line, node, norm (the words) and n (their number) of every line that has words."""
    rows = docs.where("text is not null").select(key.alias("doc"), "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "raw"))
    rows = rows.select("doc", "doc_id", "line", F.trim(F.regexp_replace(F.lower("raw"), _BETWEEN, " ")).alias("norm")).where("norm <> ''")
    return rows.select("doc", "doc_id", "line", F.xxhash64("norm").alias("node"), "norm", (F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) + 1).alias("n"))


def _simhash(n: Column) -> Column:
    """The majority bits, from the sums s0..s15 over n words: a lane with more than half of n reaches its 15th bit when 2^14 less that much is added."""
    more = (F.lit(0x4000).cast("long") - F.floor(n / 2) - 1) * F.lit(LANE)
    bits = [F.shiftleft(F.shiftrightunsigned((F.col(f"s{i}") + more).bitwiseAND(F.lit(LANE << 14)), 14), i) for i in range(16)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(sim: Column) -> Column:
    """The 10 join keys of a SimHash: two blocks each, and which."""
    block = [F.shiftrightunsigned(sim, at).bitwiseAND(F.lit((1 << width) - 1)) for at, width in _BLOCKS]
    return F.array(*[block[i] + F.shiftleft(block[j], 13) + F.lit(k << 26).cast("long") for k, (i, j) in enumerate(combinations(range(5), 2))])


def _code(words: Column) -> Column:
    """The words as one character each."""
    return F.decode(F.unhex(F.array_join(F.transform(words, lambda w: F.lpad(F.hex(F.pmod(F.xxhash64(w), F.lit(1 << 20)) + 0x10000), 8, "0")), "")), "UTF-32")


def _simhashes(nodes: DataFrame) -> DataFrame:
    """node and sim of every node, from its words."""
    # what stands beside the generator is evaluated for every word, so nothing is computed here but the words' hashes
    words = nodes.select("node", "n", F.explode(F.split("norm", " ", -1)).alias("w")).select("node", "n", F.xxhash64("w").alias("h"))
    lane = F.lit(LANE)
    short = words.where(F.col("n") <= LONGEST).groupBy("node", "n").agg(*[F.try_sum(F.shiftrightunsigned("h", i).bitwiseAND(lane)).alias(f"s{i}") for i in range(16)])
    long = words.where(F.col("n") > LONGEST).groupBy("node", "n").agg(*[F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(1).cast("long"))).alias(f"s{i}") for i in range(64)])
    bits = [F.shiftleft((F.col(f"s{i}") * 2 > F.col("n")).cast("long"), i) for i in range(64)]
    return short.select("node", _simhash(F.col("n")).alias("sim")).unionByName(long.select("node", reduce(lambda a, b: a.bitwiseOR(b), bits).alias("sim")))


class _BySimHash:
    """Candidates by SimHash, with DataFrame functions only."""

    def __init__(self, docs: DataFrame, key: Column, scratch: Scratch):
        self.lines = scratch.keep(_lines(docs, key))
        self.texts = scratch.keep(self.lines.groupBy("node").agg(F.min("norm").alias("norm"), F.max("n").alias("n")))
        self.scratch = scratch

    def keyed(self) -> DataFrame:
        """node and key."""
        self.sims = self.scratch.keep(_simhashes(self.texts))
        return self.sims.select("node", F.explode(_keys(F.col("sim"))).alias("key"))

    def finer(self, placed: DataFrame) -> DataFrame:
        return placed

    def across(self, dealt: DataFrame) -> DataFrame:
        """Links (a, b) of dealt groups."""
        rows = dealt.join(self.sims, "node")
        right = rows.where("is_right").select("g", F.col("node").alias("b"), F.col("comp").alias("b_comp"), F.col("sim").alias("b_sim"))
        near = (F.col("comp") != F.col("b_comp")) & (F.bit_count(F.col("sim").bitwiseXOR(F.col("b_sim"))) <= BITS)
        return self.verified(rows.where("is_left").join(right, "g").where(near).select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct())

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of nodes whose SimHashes are near and whose words are similar enough."""
        sims = lambda side: self.sims.select(F.col("node").alias(side), F.col("sim").alias(f"{side}_sim"))
        pairs = pairs.join(sims("a"), "a").join(sims("b"), "b").where(F.bit_count(F.col("a_sim").bitwiseXOR(F.col("b_sim"))) <= BITS).select("a", "b")
        codes = self.texts.select("node", _code(F.split("norm", " ", -1)).alias("code"))
        rows = pairs.join(codes.select(F.col("node").alias("b"), F.col("code").alias("y")), "b").join(codes.select(F.col("node").alias("a"), F.col("code").alias("x")), "a")
        longer, shorter = F.greatest(F.length("x"), F.length("y")), F.least(F.length("x"), F.length("y"))
        allowed = F.floor(longer * (1 - SIMILAR) + 1e-9).cast("int")
        return rows.where(longer - shorter <= allowed).withColumn("allowed", allowed).where("levenshtein(x, y, allowed) >= 0").select("a", "b")


class _ByRuns:
    """Candidates by shared runs of words: every similar pair."""

    def __init__(self, docs: DataFrame, key: Column, scratch: Scratch):
        kind = docs.schema["doc_id"].dataType.simpleString()
        self.blocks = scratch.keep(docs.where("text is not null").select(key.alias("doc"), "doc_id", "text").mapInArrow(runs.pack, runs.packed(kind)))
        self.lines = scratch.keep(self.blocks.select(F.inline(F.arrays_zip("doc", "doc_id", "line", "node"))))
        self.scratch = scratch

    def keyed(self) -> DataFrame:
        """node and key."""
        buckets = 1 + (self.blocks.agg(F.sum("words")).first()[0] or 0) // runs.BUCKET
        hits = self.scratch.keep(runs.count(self.blocks, buckets))
        self.active = self.scratch.keep(runs.active(self.blocks, hits, buckets))
        self.scratch.drop(hits)
        self.scratch.drop(self.blocks)
        return self.active.select("node", F.explode("keys").alias("key"))

    def finer(self, placed: DataFrame) -> DataFrame:
        """Cells in which the similar lines of different components meet that met in the cells (cell, node, comp). Lines of large ones meet on their rare words: first on those
        that are rare among all of them, then, in what is still large, on those that are rare there. What stays large after all is compared in blocks."""
        done, tokens = [], None
        for most in LARGE:
            shares = placed.groupBy("cell", "comp").agg(F.count("*").alias("m"))
            sizes = shares.groupBy("cell").agg((F.sum("m") - F.max("m")).alias("outside")).where("outside > 0")
            mixed = self.scratch.keep(placed.join(sizes.select("cell", (F.col("outside") > most).alias("large")), "cell").select("cell", "node", "comp", "large"))
            large = mixed.where("large").drop("large")
            done.append(mixed.where("not large").drop("large"))
            if large.isEmpty():
                return reduce(DataFrame.unionByName, done)
            if tokens is None:
                large = large.select(F.lit(0).cast("long").alias("cell"), "node", "comp").distinct()
                rows = self.active.join(large.select("node"), "node").select("node", "codes")
                tokens = self.scratch.keep(rows.mapInArrow(runs.word_tokens, "node long, most int, tokens array<long>"))
            placed = self.scratch.keep(_distinct(self.scratch.keep(runs.finer(large, tokens))).drop("least"))
        return reduce(DataFrame.unionByName, [*done, placed])

    def across(self, dealt: DataFrame) -> DataFrame:
        """Links (a, b) of dealt groups, enough to connect what similar lines connect."""
        rows = dealt.join(self.active.select("node", "n", "counts"), "node").select("g", "node", "comp", "is_left", "is_right", "n", "counts")
        some = rows.repartition("g").sortWithinPartitions("g").mapInArrow(runs.met, "g long, node long, comp long").distinct()
        rows = some.join(self.active.select("node", "n", "counts", "codes"), "node").select("g", "node", "comp", "n", "counts", "codes")
        return rows.repartition("g").sortWithinPartitions("g").mapInArrow(runs.linked, "a long, b long")

    def verified(self, pairs: DataFrame) -> DataFrame:
        return runs.verified(pairs, self.active)


def _stars(shared: DataFrame) -> DataFrame:
    """(a, b): each node and the smallest one of each of its cells, and the one in most cells among those that it shares a cell with."""
    ranked = shared.join(shared.groupBy("node").agg(F.count("*").alias("d")), "node")
    hubs = ranked.groupBy("cell").agg(F.max(F.struct("d", "node")).alias("hub"))
    best = shared.join(hubs, "cell").groupBy("node").agg(F.max("hub").alias("hub")).select("node", F.col("hub.node").alias("to"))
    pairs = best.unionByName(shared.select("node", F.col("least").alias("to"))).where("node <> to")
    return pairs.select(F.greatest("node", "to").alias("a"), F.least("node", "to").alias("b")).distinct()


def _distinct(cells: DataFrame) -> DataFrame:
    """The cells (cell, node, and more) of two lines or more, and least, the smallest of them. Of the cells on which the same lines meet one is enough."""
    groups = cells.groupBy("cell").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.sum(F.shiftright(F.xxhash64("node"), 24)).alias("name")).where("least <> most")
    groups = groups.groupBy("name", "least", "most").agg(F.min("cell").alias("cell"))
    return cells.join(groups.select("cell", "least").hint("shuffle_hash"), "cell")


def duplicate_lines(docs: DataFrame, scratch: Scratch, key: Column, exact: bool = False) -> DataFrame:
    """doc and removed (the line numbers that go) of the documents that lose lines."""
    found = (_ByRuns if exact else _BySimHash)(docs.select("doc_id", "text"), key, scratch)
    keyed = found.keyed().select(F.col("key").alias("cell"), "node").repartition("cell")
    shared = scratch.keep(_distinct(keyed).select("cell", "node", "least"))
    stars = _stars(shared)
    links = cut(found.verified(stars))
    parts = components(links)
    placed = shared.join(parts, "node", "left").select("cell", "node", F.coalesce("comp", "node").alias("comp"))
    across = cut(found.across(deal(found.finer(placed), BLOCK)).distinct())
    if not across.isEmpty():
        parts = components(links.unionByName(across))

    nodes = found.lines.groupBy("node").agg(F.min(F.struct("doc_id", "doc", "line")).alias("first"), F.count("*").alias("many"))
    grouped = scratch.keep(nodes.join(parts, "node", "left").where("many > 1 or comp is not null").select("node", "first", F.coalesce("comp", "node").alias("comp")))
    kept = grouped.groupBy("comp").agg(F.min("first").alias("keep"))
    gone = grouped.join(kept, "comp").select("node", "keep")
    same = (F.col("doc") == F.col("keep.doc")) & (F.col("line") == F.col("keep.line"))
    return found.lines.join(gone, "node").where(~same).groupBy("doc").agg(F.array_sort(F.collect_set("line")).alias("removed"))


def result_names(columns: list[str]) -> tuple[str, str]:
    """What ``dedup_lines`` calls its two columns beside columns of these names."""
    return fresh(columns, "_n_lines"), fresh(columns, "_removed")


def dedup_lines(docs: DataFrame, exact: bool = False) -> DataFrame:
    """The documents' columns with the duplicate lines gone from text, and _n_lines and _removed (the numbers of the lines that went).

    exact: find every similar pair, not only those with near SimHashes."""
    n_lines, removed = result_names(docs.columns)
    doc = fresh(docs.columns, "_doc")
    key = F.xxhash64("doc_id", "text")
    with Scratch(docs.sparkSession) as scratch:
        found = cut(duplicate_lines(docs, scratch, key, exact))
    rows = docs.withColumn(doc, key).join(found.select(F.col("doc").alias(doc), F.col("removed").alias(removed)).hint("shuffle_hash"), doc, "left").drop(doc)
    rows = rows.withColumn(removed, F.coalesce(removed, F.array().cast("array<int>")))
    pieces = F.split("text", "\n", -1)
    # removed is sorted, so the lines that stay are those of the gaps; the pieces are bound to a name, so that the text is split once
    gaps = lambda p: F.flatten(F.transform(F.sequence(F.lit(0), F.size(removed)), lambda i: _gap(p, i, removed)))
    joined = F.array_join(F.get(F.transform(F.array(pieces), gaps), F.lit(0)), "\n")
    kept = F.when(F.size(removed) == 0, F.col("text")).otherwise(joined)
    lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    return rows.withColumn(n_lines, lines).withColumn("text", F.when(F.col("text").isNotNull(), kept))


def _gap(pieces: Column, i: Column, removed: str) -> Column:
    """The lines between removed number i - 1 and removed number i."""
    begin = F.when(i == 0, F.lit(0)).otherwise(F.get(removed, i - 1) + 1)
    end = F.coalesce(F.get(removed, i), F.size(pieces))
    return F.slice(pieces, begin + 1, end - begin)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every document with its text without duplicate lines."""
    rows = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), exact=True)
    return rows.select("doc_id", F.col("_n_lines").cast("long").alias("n_lines"), F.size("_removed").cast("long").alias("n_removed"), F.col("_removed").alias("removed"), "text")
