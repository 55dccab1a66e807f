"""The training-data operators against brute force, and their defined results in odd cases."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import classifier, components, decontamination, jaccard, knn, language, licenses, lines, mixing, registry, scoring

DATA = "/root/testdata"
#: null and empty texts, repeated rows, equal texts, a null id, very long words and texts
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "One two THREE four five six seven eight nine ten eleven"), (4, "One two THREE four five six seven eight nine ten eleven"),
    (5, "one two three four five six seven eight nine ten eleven"), (None, "One two THREE four five six seven eight nine ten eleven twelve"), (None, None), (6, "x" * 20_000), (7, "lorem ipsum " * 20_000), (8, "é 你好 \U0001f600 Ünïcode"), (9, "!!! ???"),
]


def docs_of(spark, sf="sf0.001"):
    return [tuple(r) for r in spark.read.parquet(f"{DATA}/{sf}/documents.parquet").select("doc_id", "text").collect()]


def odd(spark, rows=ODD):
    """Odd rows with extra columns whose names operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", F.lit("s").alias("source"), F.lit("en").alias("lang"), *[F.lit(1).alias(c) for c in ("n", "node", "size", "key", "score", "word", "row", "a", "b", "n_chars")])


def empty(spark):
    return odd(spark).limit(0)


def write(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    d = f"{DATA}/sf0.001"
    df = registry.queries()[name](spark, d)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels", "pages"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    found = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    want = sorted(str(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())
    assert sorted(str(tuple(r)) for r in df.select(*columns).collect()) == want


# 1


def brute_top(rows, queries, k):
    out = []
    for q, v in rows:
        if q in queries:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["ties", "clusters", "long"])
def test_top_k(spark, kind):
    r = random.Random(2)
    if kind == "ties":
        rows = [(i, [float(r.randrange(3)), 1.0]) for i in range(120)]
    elif kind == "clusters":
        rows = [(i, [r.gauss(20 * (i % 5 == j), 0.3) for j in range(5)]) for i in range(300)]
    else:
        rows = [(i, [float(r.randrange(-(1 << 22), 1 << 22)) for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = knn.top_k(df, F.col("vec_id") % 7 == 0, k=9, pivots=8, block=40)
    whole = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows]
    assert sorted(map(tuple, got.collect())) == brute_top(whole, {i for i, _ in rows if i % 7 == 0}, 9)


def test_top_k_odd(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0]), (6, [1.0, 2.0]), (6, [1.0, 2.0]), (None, [1.0, 1.0]), (7, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("vec", F.lit(1))
    got = knn.top_k(df, F.col("vec_id") == 0)
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == [(1, 6, 64 * 64 * 5), (2, 5, 64 * 64), (3, 7, 0)]
    assert knn.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert knn.top_k(df, F.lit(False)).count() == 0


# 2


def test_licenses(spark):
    rows = docs_of(spark, "sf0.01") + ODD + [(20, "GNU general\npublic, license! gnu GENERAL public license; cc-by cc by. Apache License MIT")]
    got = licenses.digest(licenses.scan(odd(spark, rows)))
    assert sorted((str(tuple(r)[:6]) for r in got.collect())) == sorted(map(str, licenses.brute_force(rows)))
    assert licenses.digest(licenses.scan(empty(spark))).count() == 0


def test_license_notice_with_edits(spark):
    text = dict(licenses.NOTICES)["mit-notice"]
    words = text.split()
    rows = [(1, "before " + text + " after"), (2, " ".join(words[:20] + ["inserted", "words"] + words[20:30] + words[32:])), (3, " ".join(words[:8])), (4, " ".join(reversed(words)))]
    got = {r["doc_id"]: (r["labels"], round(r["score"], 2)) for r in licenses.digest(licenses.scan(odd(spark, rows))).collect()}
    assert got[1] == ("mit-notice", 1.0) and got[2][0] == "mit-notice" and 0.7 <= got[2][1] < 1
    assert got[3] == ("", 0.0) or got[3][0] == ""
    assert got[4][0] == ""


# 3


def test_line_dedup(spark):
    base = "the quick brown fox jumps over the lazy dog and then runs far away into the deep dark forest by the river where nobody has ever seen it again"
    near = base.replace("river", "lake")
    rows = [(1, f"{base}\nown line of one"), (2, f"own line of two here\n{base.upper()}!"), (3, f"{near}\n\n--\n--"), (4, None), (5, ""), (6, "own line of one\n" * 3), (6, "own line of one\n" * 3), (None, "nothing like it")]
    got = {(r["doc_id"], r["text"]) for r in lines.dedup_lines(odd(spark, rows)).collect()}
    assert (1, f"{base}\nown line of one") in got and (2, "own line of two here") in got and (4, None) in got and (5, "") in got
    assert (6, "") in got and (None, "nothing like it") in got
    assert lines.dedup_lines(empty(spark)).count() == 0
    assert set(odd(spark).columns) <= set(lines.dedup_lines(odd(spark)).columns)
    assert lines.dedup_lines(odd(spark)).count() == len(ODD)


def simhash_reference(spark, text):
    row = spark.createDataFrame([(1, text)], "doc_id long, text string")
    words = [r[0] for r in row.select(F.explode(F.split(F.lower("text"), " "))).select(F.xxhash64("col")).collect()]
    out = 0
    for b in range(64):
        if 2 * sum((w >> b) & 1 for w in words) > len(words):
            out |= 1 << b
    return out


def test_simhash_and_keys(spark):
    text = "some words that make up a line of text"
    words = spark.createDataFrame([(text,)], "t string").select(F.explode(F.split("t", " ")).alias("w")).select(F.xxhash64("w").alias("h"))
    lane = F.lit(lines.LANE)
    sums = words.agg(*[F.sum(F.shiftrightunsigned("h", i).bitwiseAND(lane)).alias(f"s{i}") for i in range(16)], F.count("*").alias("n"))
    sim = sums.select(lines._simhash(F.col("n"))).first()[0]
    assert sim & ((1 << 64) - 1) == simhash_reference(spark, text)
    r = random.Random(1)
    pairs = []
    for _ in range(200):  # two SimHashes within 3 bits share a key
        x = r.getrandbits(64)
        y = x
        for b in r.sample(range(64), 3):
            y ^= 1 << b
        pairs.append((lines._signed(x), lines._signed(y)))
    rows = spark.createDataFrame(pairs, "x long, y long").select(F.arrays_overlap(lines._keys(F.col("x")), lines._keys(F.col("y"))))
    assert all(r[0] for r in rows.collect())


def test_line_groups_against_brute_force(spark):
    """Same pairs as comparing all lines: at most 3 bits apart, at most a fifth of the words edited."""
    r = random.Random(8)
    base = [[r.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]) + str(r.randrange(30)) for _ in range(40)] for _ in range(12)]
    rows = []
    for i in range(90):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 1, 1, 2])):
            w[r.randrange(len(w))] = "new" + str(r.randrange(9))
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = {t: simhash_reference(spark, t) for _, t in rows}
    names = sorted(hashes)
    parent = {t: t for t in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if bin(hashes[a] ^ hashes[b]).count("1") <= 3 and edits(a.split(), b.split()) <= 0.2 * 40:
                parent[find(a)] = find(b)
    keep = {}
    for i, t in rows:
        keep.setdefault(find(t), i)
    got = {r["doc_id"] for r in lines.dedup_lines(df).where("text <> ''").collect()}
    assert got == set(keep.values())


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def kept_by_edit_distance(rows):
    """The rows that stay, by comparing all lines (one a row) by edit distance alone."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    words = [t.split() for _, t in rows]
    for i, a in enumerate(words):
        for j in range(i):
            if edit_distance(a, words[j]) <= max(len(a), len(words[j])) // 5:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {d for k, (d, _) in enumerate(rows) if find(k) == k}


def test_line_recall_against_edit_distance(spark):
    """No pair within a fifth of edits is lost, whatever the length and the kind of edit."""
    r = random.Random(5)
    rows = []
    for n in [1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 14, 15, 16, 17, 20, 25, 27, 40, 50, 100]:
        base = [f"w{r.randrange(10**6)}" for _ in range(n)]
        rows.append(base)
        for share in (1, 1, 2):
            w = list(base)
            for e in range(share * n // 10 if share < 2 else n // 5):
                at = min(len(w) - 1, int((e + 0.5) * 5)) if share == 2 else r.randrange(len(w))
                kind = r.choice(["change", "change", "drop", "add"]) if share == 1 else "change"
                if kind == "add":
                    w.insert(at, f"new{r.randrange(10**6)}")
                elif kind == "drop":
                    del w[at]
                else:
                    w[at] = f"new{r.randrange(10**6)}"
            rows.append(w)
        rows.append([f"x{i}" if i % 4 == 0 else x for i, x in enumerate(base)])  # more than a fifth
        rows.append([*base[: n // 2], *[f"own{n}x{i}" for i in range(n)]])  # a shared passage only
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    want = kept_by_edit_distance(rows)
    assert len(want) < len(rows) - 30
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["doc_id"] for x in lines.dedup_lines(df, exact=True).where("text <> ''").collect()} == want


def test_line_matches_do_not_depend_on_length_or_repeats(spark):
    """Near copies match though their rows are repeated a thousand times, or hold more words than 16,000."""
    short, long = [f"w{i}" for i in range(17)], [f"v{i}" for i in range(17_000)]
    change = lambda w: " ".join([*w[:-1], "other"])
    rows = [(1, " ".join(short))] * 1000 + [(2, change(short))] + [(3, " ".join(long)), (4, change(long))]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), exact=True).where("text <> ''")
    assert {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()} == {1: 1000, 3: 1}


# 4


def test_mixing(spark):
    got = mixing.pareto_mix(odd(spark))
    rows = got.collect()
    assert len(rows) == len(ODD) and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert sorted(map(str, mixing.pareto_mix(odd(spark)).collect())) == sorted(map(str, rows))
    assert mixing.pareto_mix(empty(spark)).count() == 0
    nothing = mixing.pareto_mix(odd(spark, [(1, None), (2, "")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in nothing] == [(0, 0.0, 0)] * 2
    none = odd(spark).withColumn("source", F.when(F.col("doc_id") < 6, "a").when(F.col("doc_id") == 7, "b"))
    by = defaultdict(int)
    for r in mixing.pareto_mix(none).collect():
        by[r["source"], r["target"]] += r["taken"]
    assert {s for s, _ in by} == {"a", "b", None} and all(abs(t - target) <= 0.5 for (_, target), t in by.items())


def test_targets_stop_at_three_times(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 5)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 30 and abs(sum(got.values()) - 2015) < 1e-6 and abs(got["b"] / got["c"] - 2) < 1e-9
    assert got[None] == 15


def test_mixing_of_pages_of_copies_meets_targets(spark):
    rows = [(i, "w " * (1 + i % 50), f"s{i % 4}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by = defaultdict(int)
    for r in mixing.pareto_mix(df).collect():
        by[r["source"], r["target"]] += r["taken"]
    assert len(by) == 4 and all(abs(t - target) <= 0.5 for (_, target), t in by.items())


# 5


def test_scores(spark):
    rows = docs_of(spark)[:60] + ODD
    got = scoring.lm_scores(odd(spark, rows)).collect()
    want = scoring.brute_force([(d if d is not None else "", t) for d, t in rows])
    want = [(None if d == "" else d, *rest) for d, *rest in want]
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    for a, b in zip(sorted((tuple(r)[:7] for r in got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9)


def test_scores_with_trie_in_parts(spark, monkeypatch):
    """The context keeps its full length when the trie is larger than what is sent at once; repeated rows and null ids too."""
    rows = docs_of(spark)[:25] + [r for r in ODD if len(r[1] or "") < 1000]
    monkeypatch.setattr(scoring, "MAX_NODES", 4000)
    got = scoring.lm_scores(odd(spark, rows)).collect()
    want = [(None if d == "" else d, *rest) for d, *rest in scoring.brute_force([(d if d is not None else "", t) for d, t in rows])]
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    for a, b in zip(sorted((tuple(r)[:7] for r in got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9)


def test_scores_without_training(spark):
    held = [(i, "abc") for i in range(60) if scoring.crc_mod([i], 5)[0] == 1][:2]
    for r in scoring.lm_scores(odd(spark, held)).collect():
        assert r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 and r["score"] == pytest.approx(4 * np.log10(1 / 256))
    assert scoring.lm_scores(empty(spark)).count() == 0


# 7


def test_languages(spark):
    d = f"{DATA}/sf0.01"
    truth = dict(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect())
    rows = [r for r in language.query(spark, d).collect() if r["held_out"]]
    assert len(rows) > 100 and np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in rows]) > 0.97


def test_language_odd(spark):
    model = language.train(odd(spark))
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.predict(odd(spark), model).collect()]
    assert len(got) == len(ODD)
    assert {d for d, p, _ in got if p == "und"} == {1, 2, 3, None, 9} and all(0 <= s <= 1 for *_, s in got)
    assert language.predict(empty(spark), language.train(empty(spark))).count() == 0
    assert {r["lang_pred"] for r in language.predict(odd(spark), language.train(odd(spark).withColumn("lang", F.lit(None).cast("string")))).collect()} == {"und"}


def test_bloom_filters_have_many_languages():
    r = np.random.default_rng(1)
    grams = r.choice(1 << 31, 70 * 40, replace=False).astype(np.uint64)
    lang = np.repeat(np.arange(70), 40)
    f = language.Filters([f"l{k:02}" for k in range(70)], grams, lang)
    counts = f.counts(grams, np.arange(0, 70 * 40 + 1, 40))
    assert (counts.argmax(axis=1) == np.arange(70)).all() and (counts.max(axis=1) > 39.9).all()


# 8


def test_decontamination(spark):
    rows = docs_of(spark, "sf0.01")[:400] + ODD
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.01/benchmark.parquet").select("item_id", "text").collect()]
    items += [(900, "one TWO three"), (901, ""), (902, None), (None, "four five"), (903, "ünïcode"), (904, "one two three four five six seven eight nine ten eleven twelve"), (900, "nine ten eleven")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit(1))
    want = sorted(map(str, decontamination.brute_force(rows, items)))
    assert sorted(str(tuple(r)) for r in decontamination.digest(decontamination.contaminated_spans(odd(spark, rows), bench)).collect()) == want
    clean = decontamination.drop_contaminated(odd(spark, rows), bench, block_words=200)
    assert clean.columns == odd(spark).columns and clean.count() == sum("True" not in x for x in want)
    assert decontamination.digest(decontamination.contaminated_spans(empty(spark), bench)).count() == 0
    assert decontamination.digest(decontamination.contaminated_spans(odd(spark), bench.limit(0))).where("contaminated").count() == 0


def test_benchmark_in_blocks(spark):
    rows = docs_of(spark, "sf0.01")[:300]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.01/benchmark.parquet").select("item_id", "text").collect()]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.digest(decontamination.contaminated_spans(odd(spark, rows), bench, block_words=300))
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, decontamination.brute_force(rows, items)))


def test_benchmark_in_blocks_keeps_every_row(spark):
    """Repeated rows, other texts of one id and null ids each get a result, as with one block."""
    text = "one two three four five six seven eight nine ten eleven"
    rows = [*ODD, (4, "own words"), (4, None), (None, text), (None, "alpha beta gamma")]
    items = [(1, text), (2, "alpha beta gamma"), (3, "lorem ipsum lorem")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.digest(decontamination.contaminated_spans(odd(spark, rows), bench, block_words=3))
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, decontamination.brute_force(rows, items)))


# 9


def near_copies(seed, bases=10, each=12, vocabulary=300):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    out = []
    for _ in range(bases):
        t = [r.choice(words) for _ in range(r.choice([3, 5, 9, 20, 60, 150, 500]))]
        for _ in range(each):
            x = list(t)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3]) * max(1, len(t) // 60)):
                x[r.randrange(len(x))] = r.choice(words)
            if r.random() < 0.3:
                x = x[: int(len(x) * r.uniform(0.86, 1))] or x
            out.append((len(out), " ".join(x)))
    return out


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 4, 85), (2, 4, 85), (3, 5, 80), (4, 2, 60)])
def test_jaccard(spark, seed, k, percent):
    rows = near_copies(seed)
    got = jaccard.classes(odd(spark, rows), k, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(jaccard.brute_force(rows, k, percent))


def test_jaccard_blocks_of_cells(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rows = near_copies(9, bases=3, each=40)
    got = jaccard.classes(odd(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(jaccard.brute_force(rows))


def test_jaccard_odd(spark):
    got = jaccard.classes(odd(spark)).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (0, 3) and by[4] == (8, 4) and by[5] == (8, 4) and by[6] == (1, 6) and by[7] == (2, 7)
    assert jaccard.classes(empty(spark)).count() == 0
    kept = jaccard.one_of_each(odd(spark), 4, 85)
    assert kept.columns == odd(spark).columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, 3, 6, 7, 8, 9, None, None]) or kept.count() == 9


def test_rtree_bound_never_loses_a_pair():
    r = np.random.default_rng(5)
    sets = []
    for _ in range(60):
        base = np.unique(r.integers(0, 1 << 62, 200, dtype=np.uint64))
        for _ in range(3):
            sets.append(np.unique(np.concatenate([base[r.random(len(base)) > 0.05], r.integers(0, 1 << 62, 8, dtype=np.uint64)])))
    n = len(sets)
    sizes = [len(s) for s in sets]
    packed = [jaccard.packed_counts(s) for s in sets]
    for i in range(0, n, 7):
        found = jaccard.search(list(range(n)), sizes, packed, [i], list(range(n)), 85)
        true = {j for j in range(n) if j != i and jaccard.similar(sets[i], sets[j], 85)}
        assert true <= found and len(found) < n / 10


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)] + [(400, i) for i in range(401, 440)] + [(7, 7)]
    parent = {x: x for p in links for x in p if p[0] != p[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in parent)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 10


def test_classifier_held_out(spark):
    d = f"{DATA}/sf0.1"
    truth = dict(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality").collect())
    rows = [(r["score"], truth[r["doc_id"]]) for r in classifier.query(spark, d).collect() if r["held_out"] and r["doc_id"] in truth]
    good, bad = [s for s, y in rows if y == 1], [s for s, y in rows if y == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    assert np.mean([s >= classifier.THRESHOLD for s in good]) > 0.98


def test_classifier_odd(spark):
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 1), (5, 0, 0), (7, 1, 0), (8, None, 0), (None, 1, 0), (9, 3, 0)], "doc_id long, quality int, toxic int")
    rows = classifier.score(odd(spark), classifier.train(odd(spark), labels)).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert {r["score"] for r in classifier.score(odd(spark), classifier.train(odd(spark), labels.limit(0))).collect()} == {0.5}
    assert classifier.score(empty(spark), classifier.train(empty(spark), labels)).count() == 0


def test_network_gradients():
    r = np.random.default_rng(4)
    net = classifier.Network(3)
    chunks = r.integers(0, 256, (5, classifier.CHUNK)).astype(np.uint8)
    first, y = np.array([0, 2]), np.array([1, 0], np.float32)
    for k in net.NAMES:
        setattr(net, k, getattr(net, k).astype(np.float64))
    _, g = net.step(chunks, first, y)
    for name, at in (("filters", (5, 3)), ("units", (2, 4)), ("last", (1,)), ("bias", (3,)), ("embed", (int(chunks[0, 0]), 2))):
        p, eps = getattr(net, name), 1e-5
        p[at] += eps
        up = net.step(chunks, first, y)[0]
        p[at] -= 2 * eps
        down = net.step(chunks, first, y)[0]
        p[at] += eps
        assert g[name][at] == pytest.approx((up - down) / (2 * eps), abs=2e-4)


def test_chunks_cover_the_text():
    for n in (0, 1, 511, 512, 513, 1000, 5000):
        data = np.arange(n) % 251
        start, size, first = classifier._chunks(data.astype(np.uint8), np.array([0, n]))
        assert first.tolist() == [0, len(start)] and set().union(*(range(a, a + s) for a, s in zip(start, size))) == set(range(n))


# the pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    src = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").limit(250)
    d = write(spark, tmp_path, documents=src, labels=spark.read.parquet(f"{DATA}/sf0.01/labels.parquet"), benchmark=spark.read.parquet(f"{DATA}/sf0.01/benchmark.parquet"))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    at = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at[-1], d)
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{d}/{k}")
        at.append(spark.read.parquet(f"{d}/{k}"))
    ids = [{r[0] for r in x.select("doc_id").collect()} for x in at]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    scored = classifier.score(docs, classifier.train(docs, spark.read.parquet(f"{d}/labels.parquet")))
    assert ids[1] == {r["doc_id"] for r in scored.collect() if r["predicted"]}
    texts = [tuple(r) for r in at[2].select("doc_id", "text").collect()]
    assert ids[3] == {c for _, _, c in jaccard.brute_force(texts, 5, 80)}
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    texts = [tuple(r) for r in at[3].select("doc_id", "text").collect()]
    assert ids[4] == {r[0] for r in decontamination.brute_force(texts, items) if not r[5]}
    assert at[5].count() == at[4].count()
    whole = corpus_pipeline.run(spark, d)
    assert sorted(map(str, whole.collect())) == sorted(map(str, at[5].collect()))


def test_pipeline_odd(spark, tmp_path):
    import corpus_pipeline

    rows = odd(spark).select("doc_id", "text", "lang", "source", F.lit(1).cast("long").alias("n_chars"))
    labels = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "lorem ipsum lorem")], "item_id long, text string")
    d = write(spark, tmp_path, documents=rows, labels=labels, benchmark=bench)
    assert corpus_pipeline.run(spark, d).count() >= 5
    d = write(spark, tmp_path / "none", documents=rows.limit(0), labels=labels.limit(0), benchmark=bench.limit(0))
    assert corpus_pipeline.run(spark, d).count() == 0


def test_hashes_of_words_do_not_depend_on_blocks():
    from tidemill.llm.textkit import ALNUM, SPACED, Words, hash_words

    text = "short and averyveryverylongword indeed ünï".encode()
    data = np.frombuffer(text, np.uint8)
    for table in (SPACED, ALNUM):
        w = Words(data, np.array([0, len(data)]), table)
        alone = [hash_words(d, Words(d, np.array([0, len(d)]), table))[0] for a, b in zip(w.starts, w.ends) for d in [data[a:b]]]
        assert hash_words(data, w).tolist() == alone
    assert hashlib.sha256(text).hexdigest()


# 6


def test_fixity(spark):
    from tidemill.llm import fixity

    rows = [(i, f"http://h/{i}", "<p>" + "é" * (i % 7) + "</p>") for i in range(700)] + [(None, None, None), (None, "u", "x"), (5, "http://h/5", "again")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("at", "n", "digest", "length", "file")})
    assert fixity.audit(pages, pages).count() == 0
    other = pages.where("page_id is null or page_id not in (3, 650)").withColumn("html", F.when(F.col("page_id") == 300, "changed").otherwise(F.col("html")))
    other = other.unionByName(pages.where("page_id = 9")).unionByName(pages.limit(1).withColumn("page_id", F.lit(5_000_000).cast("long"))).where("url is null or url <> 'u'")
    got = {r["page_id"]: (r["kind"], r["n_expected"], r["n_found"]) for r in fixity.audit(pages, other).collect()}
    assert got == {3: ("missing", 1, 0), 650: ("missing", 1, 0), 300: ("changed", 1, 1), 9: ("repeated", 1, 2), 5_000_000: ("extra", 0, 1), None: ("repeated", 2, 1)}
    record = {r["page_id"]: r["r"].encode() for r in pages.where("page_id is not null and html <> 'again'").select("page_id", fixity.record().alias("r")).collect()}
    bad = next(r for r in fixity.audit(pages, other).collect() if r["page_id"] == 300)
    assert bad["sha256_expected"] == hashlib.sha256(record[300]).hexdigest() and bad["length"] == len(record[300])
    again = len(pages.where("html = 'again'").select(fixity.record().alias("r")).first()[0])
    assert bad["offset"] == sum(len(record[i]) for i in range(300)) + again
    assert fixity.audit(pages.limit(0), pages.limit(0)).count() == 0 and fixity.audit(pages.limit(0), pages.where("page_id < 3")).count() == 3
