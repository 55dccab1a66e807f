"""Fill-in-middle, sharding and source divergence against plain versions, and their defined results in odd cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_llm import DATA, empty, odd

from tidemill.llm import divergence, infilling, sharding

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


# 11


def plain_fim(doc_id, text, seed=1):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    u = UNIT.findall(text)
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(u), "plain", None, None, text, text
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    form = "spm" if h4 % 100 < 20 else "psm"
    return doc_id, len(u), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}", text


def fim(df):
    rows = infilling.restore(infilling.transform(df)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored")
    return sorted(map(tuple, rows.collect()), key=str)


def test_fim_equals_a_plain_version(spark):
    r = random.Random(1)
    parts = ["<", ">", "P", "S", "M", "<P", "S>", "<M", "ab", "é", "你", "\U0001f600", "\n", "\x00", "7", "  ", "Zz", "x" * 5000, "<P>"]
    rows = [(i, "".join(r.choice(parts[: 18 + (i % 9 == 0)]) for _ in range(r.randrange(60)))) for i in range(700)]
    rows += [(10_000 + i, "".join(r.choice(parts[8:17]) for _ in range(20_000))) for i in range(3)] + [(20_000, "y" * 300_000), (20_001, "é" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert fim(df) == sorted((plain_fim(*x) for x in rows), key=str)


def test_fim_of_odd_rows(spark):
    assert fim(odd(spark)) == sorted((plain_fim(x[0], x[1]) for x in odd(spark).select("doc_id", "text").collect()), key=str)
    assert fim(empty(spark)) == []
    named = spark.createDataFrame([("a", "one two"), ("b", None)], "doc_id string, text string")
    assert fim(named) == sorted([plain_fim("a", "one two"), plain_fim("b", None)], key=str)
    kept = infilling.restore(infilling.transform(odd(spark)).withColumn("restored", F.lit(1)).withColumn("text", F.lit("t")))
    assert "text" in kept.columns and kept.where("restored is null").isEmpty()


def test_ropes_split_and_join(spark):
    import numpy as np

    text = ("word, Ünï <" * 3000).encode()
    ropes = infilling.Ropes(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    whole, units = ropes.rope(0), UNIT.findall(text.decode())
    assert (whole.units, whole.chars, whole.left is not None) == (len(units), len(text.decode()), True)
    for rank in (-1, 0, 1, 7, 1000, len(units) - 1, len(units), len(units) + 5):
        a, b = infilling.split(whole, rank)
        k = min(max(rank, 0), len(units))
        assert infilling.written(a).decode() == "".join(units[:k]) and infilling.written(b).decode() == "".join(units[k:])
        assert (a.units, b.units, a.chars + b.chars) == (k, len(units) - k, len(text.decode()))


# 12


def checked_shards(df, shards=16, **how):
    """The rows of ``shard`` as a list, after what holds for every result."""
    want = Counter()
    for x in df.select("doc_id", "text").collect():
        t = (x["text"] or "").encode()
        want[x["doc_id"], len(t) + 1, zlib.crc32(t)] += 1
    rows = sharding.shard(df, shards, **how).collect()
    assert Counter((x["doc_id"], x["size"], x["text_crc32"]) for x in rows) == want
    slots = defaultdict(list)
    for x in rows:
        slots[x["shard"]].append(x["slot"])
        assert x["law"] == "bytes" and x["grown_shard"] is None and 0 <= x["shard"] < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return rows


def bytes_of(rows, shards=16):
    size = Counter({k: 0 for k in range(shards)})
    for x in rows:
        size[x["shard"]] += x["size"]
    return size


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_shards_hold_nearly_equal_bytes_and_whole_groups(spark, sf):
    rows = checked_shards(spark.read.parquet(f"{DATA}/{sf}/documents.parquet"))
    size, share = bytes_of(rows), sum(x["size"] for x in rows) / 16
    largest = max(x["size"] for x in rows)
    assert all(abs(n - share) <= largest + 0.02 * share for n in size.values())
    where = defaultdict(set)
    for x in rows:
        where[x["text_crc32"], x["size"]].add(x["shard"])
    hot = {k for x in rows if x["hot"] >= 0 for k in [(x["text_crc32"], x["size"])]}
    assert all(len(s) == 1 for k, s in where.items() if k not in hot)


def test_hot_groups_of_a_shard_spread(spark):
    """A third of all rows have one text, another third none: both are cut, and all shards are equal."""
    df = spark.range(12_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one text for all of them").when(F.col("id") % 3 == 1, F.concat(F.lit("text of its own "), F.col("id"))).alias("text"))
    rows = checked_shards(df)
    size, share = bytes_of(rows), sum(x["size"] for x in rows) / 16
    assert all(abs(n - share) < 0.03 * share for n in size.values())
    per_range = Counter((x["range"], x["hot"], x["slice"]) for x in rows)
    assert max(per_range.values()) < 40


def test_rows_without_ids_spread(spark):
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    rows = checked_shards(df, ranges=64)
    assert max(bytes_of(rows).values()) < 1.25 * sum(x["size"] for x in rows) / 16


def test_shards_of_odd_rows(spark):
    assert checked_shards(empty(spark)) == []
    assert len(checked_shards(odd(spark))) == odd(spark).count()
    assert sorted(map(str, checked_shards(odd(spark)))) == sorted(map(str, checked_shards(odd(spark))))
    one = checked_shards(spark.createDataFrame([("a", "x")], "doc_id string, text string"))
    assert len(one) == 1


# 13


def plain_divergence(rows, least=10, top=10):
    """rows: text, lang, source."""
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = {c: c + 32 for c in range(65, 91)}
    df, n, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = term.findall((text or "").translate(low))
        groups.add((lang, source))
        df[lang].update(set(words))
        n[lang, source].update(words)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, k in df[lang].items() if k >= least]
        sources = sorted((s for g, s in groups if g == lang), key=str.encode)
        total = lambda counts: sum(counts[t] for t in kept)  # noqa: B023, E731
        prob = lambda counts: (lambda N: {t: 1 + 10**9 * (counts[t] + 2) // (N + 2 * len(kept)) for t in kept})(total(counts))  # noqa: B023, E731
        f = lambda p, q: (p - q) ** 2 // (p + q)
        whole = Counter()
        for s in sources:
            whole.update(n[lang, s])
        q, p = prob(whole), {s: prob(n[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return sorted(out, key=str)


def diverged(df, **how):
    return sorted(map(tuple, divergence.compare(df, **how).select("lang", "source", "part", "item", "value", "rank").collect()), key=str)


def test_divergence_equals_a_plain_version(spark, monkeypatch):
    r = random.Random(2)
    words = ["a", "the", "The", "café", "ÉTÉ", "你好", "naïve\u0085x", "x", "ab", "aba", "b", " nb"] + [f"w{chr(97 + i)}" for i in range(12)]
    gap = [" ", "  ", "\n", "1", "-", "_", "\x00", "\x7f"]
    rows = [("".join(r.choice(words[: 6 + k % 19]) + r.choice(gap) for _ in range(r.randrange(30))), r.choice(["en", "fr", None, ""]), r.choice(["s1", "s2", "é", None])) for k in range(400)]
    rows += [(None, "en", "none"), ("", "xx", "only"), ("only once", "yy", "a"), ("other", "yy", "b"), (None, None, None)] + [("again again", "en", "s1")] * 30
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    extra = df.select("*", *[F.lit(1).alias(c) for c in ("doc_id", "term", "n", "block", "p", "v", "item", "other", "value")])
    assert diverged(extra) == plain_divergence(rows)
    assert diverged(df, least=3, top=4) == plain_divergence(rows, 3, 4)


def test_divergence_over_many_blocks(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    rows = [(t + " " + t, lang, s) for t, lang, s in docs.select("text", "lang", "source").collect() for _ in range(2)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(7)
    assert diverged(df) == plain_divergence(rows)


def test_divergence_of_odd_rows(spark):
    assert diverged(empty(spark)) == []
    rows = [(x["text"], "en", "s") for x in odd(spark).collect()]
    assert diverged(odd(spark), least=1) == plain_divergence(rows, 1)


def test_probabilities_of_large_counts(spark):
    """Counts whose product with the scale passes 64 bits."""
    row = spark.createDataFrame([(10**13, 3 * 10**13, 10**7)], "c long, n long, v long").select(divergence._p(F.col("c"), F.col("n"), F.col("v")).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (10**13 + 2) // (3 * 10**13 + 2 * 10**7)
