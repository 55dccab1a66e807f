"""Which sources of a language differ from each other, and by which terms: a two-pass vocabulary automaton.

First pass: texts are normalised (A-Z lower-cased, each run of other ASCII characters one space), and the documents that hold each term are counted for every
language; a language keeps the terms of at least ``LEAST`` documents. The normalised texts are written in blocks of about ``BLOCK_BYTES``, each beside the
terms that occur in it. Second pass: every block meets those of its terms that were kept, builds an Aho-Corasick automaton of them with a delimiter on both
sides, and runs it over its texts, which finds all occurrences again, adjacent ones included. So no task ever holds the vocabulary, only a block's part of it, and
the texts are read twice however large the vocabulary is.

The counts of (lang, source, term) are sparse postings: of a pair of sources only terms with a count in both need a join. For a term that the other source lacks, its
probability there is one number, so such terms are summed by their count; terms that both lack differ by one value, times their number.

Defined results. Null texts, langs and sources are ''. Every occurring (lang, source) is compared, also without terms. Repeated rows are documents of their own. Extra columns
are ignored. Arithmetic is on integers throughout, wide ones where counts are multiplied.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, cut, table
from .oracle import LO, UP

LEAST = 10
TOP = 10
SCALE = 1_000_000_000
BLOCK_BYTES = 32 << 20
_PLAIN = bytes(b + 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_FOUND = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
_BLOCK = "block long, lang string, source string, term binary, n long, text binary"


def _blocks(docs: DataFrame) -> DataFrame:
    """The first pass's rows: for each block, language and term the documents that hold it (term, n); and for each block and source its normalised texts (text, packed)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get(), 0
        terms: dict[str, Counter] = {}
        texts: dict[tuple[str, str], list[bytes]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, size
            pack = zstandard.ZstdCompressor(level=1).compress
            block = task.partitionId() << 32 | number
            found = [(lang, None, list(c), list(c.values()), None) for lang, c in terms.items()]
            found += [(lang, source, [None], [None], pack(b" " + b" ".join(parts) + b" ")) for (lang, source), parts in texts.items()]
            for lang, source, words, n, text in found:
                same = [pa.array([x] * len(words), k) for x, k in ((block, pa.int64()), (lang, pa.string()), (source, pa.string()))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(words, pa.binary()), pa.array(n, pa.int64()), pa.array([text] * len(words), pa.binary())], ["block", "lang", "source", "term", "n", "text"])
            terms.clear()
            texts.clear()
            number, size = number + 1, 0

        for batch in batches:
            for text, lang, source in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words = text.translate(_PLAIN).split()
                texts.setdefault((lang, source), []).append(b" ".join(words))
                terms.setdefault(lang, Counter()).update(set(words))
                size += len(text)
                if size > BLOCK_BYTES:
                    yield from flush()
        if texts:
            yield from flush()

    rows = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
    return rows.mapInArrow(write, _BLOCK)


def _occurrences(key: tuple, texts: pa.Table, kept: pa.Table) -> pa.Table:
    """The occurrences of a block's kept terms in its texts: for each language and term, the sources and their counts. Bytes are read as one character each."""
    import ahocorasick

    unpack = zstandard.ZstdDecompressor().decompress
    parts = []
    langs = kept.column("lang").combine_chunks().dictionary_encode()
    code = langs.indices.to_numpy(zero_copy_only=False)
    rows = list(zip(*[texts.column(c).to_pylist() for c in ("lang", "source", "text")], strict=True))
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        mine = kept.column("term").take(pa.array(np.flatnonzero(code == k))).combine_chunks()
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, w in enumerate(mine.to_pylist()):
            automaton.add_word(f" {w.decode('latin-1')} ", i)
        automaton.make_automaton()
        own = [(source, text) for name, source, text in rows if name == lang]
        met = [np.unique(np.fromiter((i for _, i in automaton.iter(unpack(text).decode("latin-1"))), np.int64), return_counts=True) for _, text in own]
        term, counts = (np.concatenate([m[j] for m in met]) for j in (0, 1))
        order = np.argsort(term, kind="stable")
        offsets = np.searchsorted(term[order], np.arange(len(mine) + 1)).astype(np.int32)
        names = pa.array([s for s, _ in own], pa.string()).take(pa.array(np.repeat(np.arange(len(own)), [len(m[0]) for m in met])[order]))
        parts.append(pa.table({"lang": pa.array([lang] * len(mine), pa.string()), "term": mine, "sources": pa.ListArray.from_arrays(offsets, names), "counts": pa.ListArray.from_arrays(offsets, pa.array(counts[order]))}))
    return pa.concat_tables(parts) if parts else _FOUND.empty_table()


def postings(docs: DataFrame, scratch: Scratch, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups: every lang and source; kept: lang and kept term; postings: lang, source, term, n above 0)."""
    rows = scratch.keep(_blocks(docs))
    terms = rows.where("term is not null")
    kept = scratch.keep(terms.groupBy("lang", "term").agg(F.sum("n").alias("df")).where(F.col("df") >= least).select("lang", "term"))
    texts = rows.where("term is null")
    groups = scratch.keep(texts.select("lang", "source").distinct())
    mine = terms.join(kept, ["lang", "term"], "left_semi").select(*[F.col(c).alias(c) for c in ("block", "lang", "term")])
    found = texts.select("block", "lang", "source", "text").groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(_occurrences, "lang string, term binary, sources array<string>, counts array<long>")
    # one row a block and term travels; a term's counts by source are summed where it went
    found = found.repartition("lang", "term").select("lang", "term", F.inline(F.arrays_zip(F.col("sources").alias("source"), F.col("counts").alias("n"))))
    counts = scratch.keep(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")))
    scratch.drop(rows)
    return groups, kept, counts


def _p(c: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (c + 2) / (n + 2 v))."""
    wide = F.lit(SCALE).cast("decimal(10,0)") * (c + 2).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide, (n + 2 * v).cast("decimal(20,0)"))


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def compare(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank of every pair of sources of a language (part pair) and of each source's own terms (part term)."""
    with Scratch(docs.sparkSession) as scratch:
        groups, kept, counts = postings(docs, scratch, least)
        sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
        totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
        zero = F.lit(0).cast("long")
        groups = groups.join(sizes, "lang", "left").join(totals, ["lang", "source"], "left")
        groups = groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("v", "total", "terms")])
        # what a term without a count has here
        groups = scratch.keep(groups.withColumn("p0", F.when(F.col("v") > 0, _p(zero, F.col("total"), F.col("v"))).otherwise(zero)))
        post = counts.join(groups, ["lang", "source"]).withColumn("all_n", F.sum("n").over(W.partitionBy("lang", "term")))  # one row a source at most
        post = scratch.keep(post.select("lang", "source", "term", "v", "p0", "all_n", _p(F.col("n"), F.col("total"), F.col("v")).alias("p")))

        everything = groups.groupBy("lang").agg(F.sum("total").alias("all_total"))
        own = post.join(everything, "lang").withColumn("q", _p(F.col("all_n"), F.col("all_total"), F.col("v"))).where("p > q")
        own = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
        by = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        own = own.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)

        # each side's terms as if the other lacked them, by count
        side = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))
        levels = post.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
        alone = levels.join(side, "lang").where("source <> other").groupBy("lang", "source", "other").agg(F.sum(F.col("terms") * _f(F.col("p"), F.col("q0"))).alias("alone"))
        # and the terms of both
        left, right = post.select("lang", "term", "source", "p", "p0"), post.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("q"), F.col("p0").alias("q0"))
        both = left.join(right, ["lang", "term"]).where("source < other")
        extra = _f(F.col("p"), F.col("q")) - _f(F.col("p"), F.col("q0")) - _f(F.col("p0"), F.col("q"))
        both = both.groupBy("lang", "source", "other").agg(F.sum(extra).alias("extra"), F.count("*").alias("shared"))
        mirror = both.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "extra", "shared")
        pairs = groups.join(side.join(groups.select("lang", F.col("source").alias("other"), F.col("terms").alias("other_terms")), ["lang", "other"]), "lang").where("source <> other")
        pairs = pairs.join(alone, ["lang", "source", "other"], "left").join(alone.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), F.col("alone").alias("alone_other")), ["lang", "source", "other"], "left")
        pairs = pairs.join(both.unionByName(mirror), ["lang", "source", "other"], "left")
        none = F.col("v") - F.col("terms") - F.col("other_terms") + F.coalesce("shared", zero)
        value = F.coalesce("alone", zero) + F.coalesce("alone_other", zero) + F.coalesce("extra", zero) + none * F.when(F.col("v") > 0, _f(F.col("p0"), F.col("q0"))).otherwise(zero)
        pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), value.cast("long").alias("value"))
        pairs = pairs.withColumn("rank", F.row_number().over(by))
        result = cut(pairs.unionByName(own))
    return result


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the sources of all documents."""
    return compare(table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
with w as materialized (select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LO}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as words from documents),
t as materialized (select d, lang, source, term, count(*) as n from (select d, lang, source, unnest(words) as term from w) group by all),
k as materialized (select lang, term from t group by all having count(*) >= 10),
s as (select distinct lang, source from w),
v as (select l.lang, count(k.term)::hugeint as v from (select distinct lang from w) l left join k using (lang) group by l.lang),
c as materialized (select lang, source, term, sum(n)::hugeint as n from t join k using (lang, term) group by all),
g as materialized (select s.lang, s.source, v, coalesce(sum(n), 0)::hugeint as total from s join v using (lang) left join c using (lang, source) group by all),
a as materialized (select lang, term, sum(n)::hugeint as n from c group by all),
p as materialized (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (total + 2 * v) as p from g join k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
q as materialized (select a.lang, a.term, 1 + (1000000000::hugeint * (a.n + 2)) // (l.total + 2 * l.v) as q from a join (select lang, max(v) as v, sum(total)::hugeint as total from g group by lang) l using (lang)),
x as (select p.lang, p.source, o.source as item, sum(((p.p - o.p) * (p.p - o.p)) // (p.p + o.p)) as value from p join p o on o.lang = p.lang and o.term = p.term and o.source <> p.source group by all),
y as (select m.lang, m.source, o.source as item, coalesce(x.value, 0)::bigint as value from s m join s o on o.lang = m.lang and o.source <> m.source left join x on x.lang = m.lang and x.source = m.source and x.item = o.source),
z as (select p.lang, p.source, p.term as item, (((p - q) * (p - q)) // (p + q))::bigint as value from p join q using (lang, term) where n > 0 and p > q)
select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from y
union all select lang, source, 'term', item, value, (row_number() over (partition by lang, source order by value desc, item))::int as rank from z qualify rank <= 10
"""
