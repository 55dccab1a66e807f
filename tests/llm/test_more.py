"""More of the training-data operators against brute force: large values, small sets, long texts, names in use, learned models by plain loops."""

import math
import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from test_llm import DATA, brute_top, docs_of, kept_by_edit_distance, odd, write

from tidemill.llm import classifier, decontamination, jaccard, knn, language, licenses, lines, mixing, runs

MASK = (1 << 64) - 1


# 1


def test_top_k_of_any_size(spark):
    """Components up to the largest double take part exactly; scores beyond 64 bits keep their order."""
    r = random.Random(3)
    rows = [(i, [r.choice([1e18, -1e18, 2.0**40, 3.0, -0.5, 1e300, 1.7e308]) * r.choice([1, 0.5]), float(r.randrange(5))]) for i in range(60)]
    rows += [(i, [float(r.randrange(9)), 1.0]) for i in range(60, 90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, knn.top_k(df, F.col("vec_id") % 7 == 0, k=9, pivots=8, block=40).collect()))
    whole = [(i, [int(x) * 64 if abs(x) >= 2**50 else math.floor(64 * x) for x in v]) for i, v in rows]
    clamp = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    assert got == [(q, n, i, clamp(s)) for q, n, i, s in brute_top(whole, {i for i, _ in rows if i % 7 == 0}, 9)]


def test_top_k_of_different_vectors_under_one_id(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [1.0]), (1, [2.0]), (1, [2.0]), (2, [1.5])], "vec_id long, embedding array<double>")
    got = knn.top_k(df, F.col("vec_id") == 0, k=5)
    assert sorted((x["rank"], x["vec_id"], x["score"]) for x in got.collect()) == [(1, 1, 64 * 128), (2, 2, 64 * 96), (3, 1, 64 * 64)]


# 2


def test_license_texts_with_edits(spark):
    r = random.Random(5)
    rows = []
    for k, (_, text) in enumerate(licenses.NOTICES):
        w = text.split()
        rows.append((10 * k, "start " + text + " end"))
        for e in range(2):
            v = list(w)
            for _ in range(max(1, len(w) // 25)):
                at = r.randrange(len(v))
                v[at : at + r.choice([0, 1])] = r.choice([[], ["other"], ["two", "words"]])
            rows.append((10 * k + 1 + e, " ".join(v)))
    rows += [(900, licenses.NOTICES[5][1][:80] + " and " + licenses.NOTICES[5][1][:80]), (901, None), (902, "")]
    got = {x["doc_id"]: set(x["labels"].split(",")) - {""} for x in licenses.digest(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    base = {x[0]: set(x[5].split(",")) - {""} for x in licenses.brute_force(rows)}
    assert got == {d: found | base[d] for d, found in licenses.brute_force_notices(rows)}


# 3


@pytest.mark.parametrize("n", [8, 12, 20, 40, 80])
def test_line_recall_by_length(spark, n):
    """One changed word in a line of n: every pair is found."""
    r = random.Random(n)
    rows = []
    for i in range(60):
        w = [f"w{r.randrange(3000)}" for _ in range(n)]
        rows.append((2 * i, " ".join(w)))
        w[r.randrange(n)] = "changed"
        rows.append((2 * i + 1, " ".join(w)))
    found = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), exact=True).where("text <> ''")
    assert {x["doc_id"] for x in found.collect()} == set(range(0, 120, 2))


def test_lines_that_share_a_passage(spark):
    """Many lines with one long passage and words of their own stay; near copies among them go."""
    r = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(50))
    own = lambda: " ".join(f"o{r.randrange(10**6)}" for _ in range(30))
    texts = [f"{passage} {own()}" for _ in range(700)]
    rows = list(enumerate([*texts, *(t.replace("p7 ", "x ") for t in texts[:40])]))
    found = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), exact=True).where("text <> ''")
    assert {x["doc_id"] for x in found.collect()} == set(range(700))


def test_short_lines_that_share_three_words_make_few_pairs(spark, monkeypatch):
    """4,000 unrelated lines of six words share three: what is dealt grows with the lines, not with their square; near copies among them are found."""
    r = random.Random(9)
    own = [[f"o{r.randrange(40_000)}" for _ in range(3)] for _ in range(4000)]
    rows = [(i, " ".join(["click", "here", "to", *w])) for i, w in enumerate(own)]
    rows += [(4000 + i, " ".join(["click", "here", "to", *w[:2], f"new{i}"])) for i, w in enumerate(own[:50])]
    dealt, across = [], lines._ByRuns.across
    monkeypatch.setattr(lines._ByRuns, "across", lambda self, rows: (dealt.append(rows.count()), across(self, rows))[1])
    found = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), exact=True).where("text <> ''")
    assert {x["doc_id"] for x in found.collect()} == set(range(4000))
    assert dealt[0] < 8 * len(rows)


def test_lines_that_are_cut_grow_in_proportion(spark, monkeypatch):
    """Of five times as many unrelated lines that share three words five times as many meet on their rare words."""
    seen, finer = [], runs.finer
    monkeypatch.setattr(runs, "finer", lambda cells, tokens: (seen.append(cells.count()), finer(cells, tokens))[1])
    for many in (50, 250):
        rows = [(i, f"click here to a{i} b{i} c{i}") for i in range(many)]
        found = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), exact=True).where("text <> ''")
        assert found.count() == many
    assert seen == [50, 250]


@pytest.mark.parametrize("large", [(0, 0), (3, 0)])
def test_finer_cells_lose_no_pair(spark, monkeypatch, large):
    """However many lines count as a large cell, the lines that stay are those by edit distance alone."""
    monkeypatch.setattr(lines, "LARGE", large)
    r = random.Random(11)
    passage = [f"p{i}" for i in range(12)]
    rows = []
    for n in (3, 3, 6, 12, 30):
        for _ in range(12):
            base = [*passage[: min(12, 2 * n)], *[f"o{r.randrange(40)}" for _ in range(n)]]
            rows.append(base)
            for _ in range(2):
                w = list(base)
                for _ in range(r.randrange(1, len(w) // 5 + 2)):
                    at = r.randrange(len(w))
                    w[at : at + r.choice([0, 1, 1])] = r.choice([[], ["p3"], [f"o{r.randrange(40)}"]])
                rows.append(w)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    found = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), exact=True).where("text <> ''")
    assert {x["doc_id"] for x in found.collect()} == kept_by_edit_distance(rows)


def test_edit_distances_of_batches():
    r = random.Random(7)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    xs, ys = [], []
    for _ in range(1500):
        x = [r.randrange(1, r.choice([4, 1000])) for _ in range(r.randrange(0, 60))]
        y = list(x)
        for _ in range(r.randrange(0, len(x) // 4 + 2)):
            at = r.randrange(len(y) + 1)
            y[at : at + r.choice([0, 1])] = [r.randrange(1, 9)] * r.choice([0, 1])
        xs.append(np.array(x, "<u4"))
        ys.append(np.array(y, "<u4"))
    assert runs.within(xs, ys).tolist() == [edits(a.tolist(), b.tolist()) <= max(len(a), len(b)) // 5 for a, b in zip(xs, ys, strict=True)]


def test_shared_places_are_a_lower_bound():
    for n in range(5, 400):
        partners = [m for m in range(max(n, 6), 2 * n + 5) if m - m // 5 <= n]
        assert runs.shared_places(np.array([n]))[0] == min(m - 3 * (m // 5) - 2 for m in partners) >= 1


# 7


def test_languages_by_plain_loops(spark):
    """Predictions recomputed one n-gram at a time from the learned filters."""
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    f = language.train(docs)

    def mixed(x):
        x &= MASK
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
        return x ^ (x >> 31)

    def plain(text):
        if text is None or not regex.search(r"\pL", text):
            return "und", 0.0
        b = (" " + regex.sub(r"[^\pL]+", " ", text.lower()) + " ").encode()
        grams = [int.from_bytes(b[i : i + 4], "little") for i in range(len(b) - 3)]
        n = [0] * len(f.names)
        for g in grams:
            h = mixed(g * 0x9E3779B97F4A7C15 + 1)
            slots = [h >> (language.SLOT_BITS * j) & ((1 << language.SLOT_BITS) - 1) for j in range(language.HASHES)]
            for k in range(len(n)):
                n[k] += all(int(f.table[k // 64][s]) >> (k % 64) & 1 for s in slots)
        n = [max(0.0, (c - len(grams) * p) / (1 - p)) for c, p in zip(n, f.false, strict=True)]
        best = max(range(len(n)), key=lambda k: n[k])
        return f.names[best], (n[best] / sum(n) if sum(n) else 1 / len(n))

    some = docs.where("length(text) < 600").limit(40).unionByName(odd(spark).where("length(text) < 100 or text is null").select(*[F.col(c).cast(t) for c, t in docs.dtypes]))
    got = sorted((str(x["doc_id"]), x["lang_pred"], round(x["score"], 9)) for x in language.predict(some, f).collect())
    want = sorted((str(x["doc_id"]), a, round(b, 9)) for x in some.collect() for a, b in [plain(x["text"])])
    assert got == want


# 9


def test_small_unrelated_sets_stay_apart(spark):
    """Short documents do not all meet: what meets grows with the documents, not with their square."""
    r = random.Random(9)
    sets = [np.unique(np.array([r.getrandbits(64) for _ in range(r.randrange(5, 9))], np.uint64)) for _ in range(20_000)]
    known = {}
    keys = [int(k) for s in sets for x in jaccard.schemes_of(len(s), 85, known) for k in x.keys(s)]
    assert len(keys) == len(set(keys)) and len(keys) < 20 * len(sets)


@pytest.mark.parametrize("percent", [80, 85])
def test_small_sets_lose_no_link(percent):
    r = random.Random(percent)
    known = {}
    for _ in range(4000):
        a = {r.getrandbits(64) for _ in range(r.randrange(1, 24))}
        b = set(a)
        for _ in range(r.randrange(0, 5)):
            b ^= {r.choice(sorted(a))} if r.random() < 0.5 else {r.getrandbits(64)}
        if b and 100 * len(a & b) >= percent * len(a | b):
            x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
            keys = [{int(k) for scheme in jaccard.schemes_of(len(s), percent, known) for k in scheme.keys(s)} for s in (x, y)]
            assert keys[0] & keys[1]


def test_cells_too_large_to_hold(spark, monkeypatch):
    rows = [(i, f"the same four words {'and' if i % 2 else 'or'} more of them here {i // 300}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, jaccard.classes(df).select("doc_id", "component_id").collect()))
    monkeypatch.setattr(jaccard, "HELD", 1)
    assert sorted(map(tuple, jaccard.classes(df).select("doc_id", "component_id").collect())) == want


# 10


def test_quality_by_plain_loops(spark):
    """Scores recomputed one position and one filter at a time from the learned weights."""
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    m = classifier.train(docs, labels)

    def plain(text):
        b = (text or "").encode()
        tops = []
        for at in classifier.chunk_starts(len(b)):
            chunk = b[at : at + classifier.CHUNK].ljust(classifier.CHUNK, b"\0")
            z = [-math.inf] * classifier.FILTERS
            for p in range(0, classifier.CHUNK - classifier.WIDTH + 1, classifier.STRIDE):
                seen = np.concatenate([m.embed[c] for c in chunk[p : p + classifier.WIDTH]])
                z = np.maximum(z, seen @ m.filters)
            tops.append(np.maximum(np.maximum(z + m.bias, 0) @ m.units + m.unit_bias, 0))
        return 1 / (1 + math.exp(-float(np.max(tops, axis=0) @ m.last + m.last_bias[0])))

    rows = [*docs_of(spark)[:8], (1, None), (2, "")]
    got = classifier.score(spark.createDataFrame(rows, "doc_id long, text string"), m).collect()
    assert sorted(round(x["score"], 4) for x in got) == sorted(round(plain(t), 4) for _, t in rows)


def test_long_labelled_texts_are_learned_whole(spark):
    n = 40 * classifier.HOP
    docs = spark.createDataFrame([(1, "a" * n + "end"), (2, "b"), (1, "a"), (3, "c" * n)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (None, 1), (2, None)], "doc_id long, quality int")
    got = classifier.labelled_sample(docs, labels, held=-1)
    assert [(len(c), y) for c, y in got] == [(1, 1), (1, 0), (len(classifier.chunk_starts(n)), 0)]
    few = classifier.labelled_sample(docs, labels, held=-1, most=1)
    assert 1 <= len(few) <= 3


# names in use


def test_names_that_documents_use(spark, tmp_path):
    """Columns called like the operators' own come through every stage as they are."""
    import corpus_pipeline

    names = ("_score", "_removed", "_n_lines", "_doc", "_h", "_row", "g", "comp", "cell", "hits", "score")
    rows = odd(spark).select("doc_id", "text", "lang", "source", F.lit(1).cast("long").alias("n_chars"), *[F.lit(i).alias(c) for i, c in enumerate(names)])
    d = write(spark, tmp_path, labels=spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame([(1, "lorem ipsum lorem")], "item_id long, text string"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, d)
        assert out.columns == rows.columns, name
        assert {tuple(x[c] for c in names) for x in out.collect()} == {tuple(range(len(names)))}, name


def test_pipeline_stages_against_plain_versions(spark):
    """The line stage and the mix against independent computations."""
    import corpus_pipeline

    r = random.Random(12)
    base = [" ".join(f"w{r.randrange(500)}" for _ in range(14)) for _ in range(30)]
    texts = ["\n".join(r.choice(base) if r.random() < 0.4 else " ".join(f"u{r.randrange(10**6)}" for _ in range(9)) for _ in range(6)) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, "s" + str(i % 3), len(t)) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_chars long")
    seen, want = set(), {}
    for i, t in enumerate(texts):
        keep = []
        for line in t.split("\n"):
            if line not in seen:
                keep.append(line)
            seen.add(line)
        if keep:
            want[i] = "\n".join(keep)
    got = corpus_pipeline.dedup_lines(spark, docs, "").collect()
    assert {x["doc_id"]: x["text"] for x in got} == want
    assert all(x["n_chars"] == len(x["text"]) for x in got)
    mix = corpus_pipeline.mix(spark, docs, "").collect()
    size = {i: len(t.split()) for i, t in enumerate(texts)}
    of = {s: sum(n for i, n in size.items() if f"s{i % 3}" == s) for s in ("s0", "s1", "s2")}
    total, weight, target, left = sum(size.values()), {"s0": 5, "s1": 2, "s2": 1}, {}, {"s0", "s1", "s2"}
    while True:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 3 * of[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * of[s] for s in over}
        left -= over
    assert {x["source"]: round(x["target"], 6) for x in mix} == {s: round(t, 6) for s, t in target.items()}
    assert all(x["size"] == size[x["doc_id"]] and x["source_size"] == of[x["source"]] and 0 <= x["taken"] <= 3 * x["size"] for x in mix)
    for s, t in target.items():
        assert abs(sum(x["taken"] for x in mix if x["source"] == s) - t) <= max(size.values())


def test_many_equal_windows(spark):
    docs = [(1, "a b c d e f g h i j k"), (2, "nothing")]
    items = [(i, "a b c d e f g h i j") for i in range(300)]
    found = decontamination.digest(decontamination.contaminated_spans(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert sorted(map(tuple, found.collect())) == sorted(decontamination.brute_force(docs, items))


def test_mix_of_nothing(spark):
    assert mixing.pareto_mix(odd(spark).limit(0)).count() == 0


# the classifier's sample, ids of any type


def test_a_text_that_does_not_fit_is_left_out_alone(spark):
    """300 labelled texts, one of them larger than all that may be taken, wherever it stands: all others stay."""
    order = [r[0] for r in spark.range(300).orderBy(F.xxhash64(F.col("id").cast("string"))).collect()]
    labels = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    for huge in (order[0], order[1], order[-1]):
        docs = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") == huge, F.repeat(F.lit("x "), 100_000)).otherwise("a short text").alias("text"))
        got = classifier.labelled_sample(docs, labels, held=-1, most=100_000)
        assert len(got) == 299 and {y for _, y in got} == {0, 1}
        assert isinstance(classifier.train(docs.where(F.col("doc_id") < 20), labels), classifier.Network)


def test_a_rare_label_is_in_the_sample(spark):
    labels = spark.range(500).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 77, 1).otherwise(0).alias("quality"))
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 77, F.repeat(F.lit("y"), 5000)).otherwise("z").alias("text"))
    assert sorted(y for _, y in classifier.labelled_sample(docs, labels, held=-1, limit=40, most=1000))[-1] == 1


def test_items_with_text_ids(spark):
    words = " ".join(f"w{i}" for i in range(12))
    docs = [(1, f"before {words} after"), (2, "w0 w1"), (3, "only this"), (4, None)]
    items = [("b-2", words), ("a/1", "Only THIS"), (None, "w0"), ("c", None)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    for size in (500_000, 3):
        found = decontamination.contaminated_spans(*frames, block_words=size)
        assert sorted(map(tuple, decontamination.digest(found).collect())) == sorted(decontamination.brute_force(docs, items))
        assert {i for r in found.collect() for i in r["item_ids"]} == {"b-2", "a/1"}
