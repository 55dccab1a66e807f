"""License scans by diagonal voting, with DataFrame functions only.

Every template (short phrases, notices of licenses, and whole short licenses) is a list of words. Its word k-grams (pairs for phrases, triples
for notices) are hashed with their positions into a small fixed table. All rolling word pairs of all documents are
joined with it by hash, the words themselves compared (and the third one for notices). A match votes for the diagonal
document position - template position. A phrase stands where one diagonal has all its pairs. For notices, neighbouring
diagonals (gaps of up to ``GAP`` words: insertions and deletions) are merged, and the span is verified: enough of the
template's k-grams, each counted once, within a span not much longer than the template.

One scan, no text is shuffled: only matches and one row a document are. The template table is broadcast; it may have ``MOST_GRAMS`` rows at most.

Defined results. Null and empty texts have 0 words, no labels and score 0. Labels of a document without any are empty strings.
Repeated rows each get a result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table
from .notices import TEXTS

#: Fixed phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices, as their licenses word them, and their labels.
NOTICES = [
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit-released", "Released under the MIT License."),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    *TEXTS,
]
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = 3
COVERED = 0.7
MOST_GRAMS = 100_000
STRETCH = 1.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(_UPPER, _LOWER)))


def templates(phrases: dict[str, str], notices: list[tuple[str, str]]) -> list[tuple]:
    """(template, base, label, tpos, w0, w1, w2, grams, length) of every k-gram; template -1 matches each document's own mark."""
    rows: list[tuple] = [(-1, False, None, 0, "", "", None, 0, 0)]
    for k, (words, label, base) in enumerate([(words_of(p), label, True) for p, label in phrases.items()] + [(words_of(t), label, False) for label, t in notices]):
        n = len(words) - (1 if base else 2)
        rows += [(k, base, label, i, words[i], words[i + 1], None if base else words[i + 2], n, len(words)) for i in range(n)]
    return rows


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """row, doc_id, n_words and the array ``found`` of (label, base, first, last, score): verified places in words."""
    spark = docs.sparkSession
    schema = "t int, base boolean, label string, tpos int, t0 string, t1 string, t2 string, grams int, length int"
    grams = templates(PHRASES if phrases is None else phrases, NOTICES if notices is None else notices)
    if len(grams) > MOST_GRAMS:
        raise ValueError(f"the templates have {len(grams)} grams, more than {MOST_GRAMS}")
    masks = range(1 + max(r[3] for r in grams) // 64)  # a bit for every place in a template
    known = spark.createDataFrame(grams, schema)
    gram = lambda a, b: F.when(F.col(a) == "", F.lit(0)).otherwise(F.xxhash64(a, b))
    known = F.broadcast(known.withColumn("h", gram("t0", "t1")))
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(F.array(F.lit("")), words).alias("w"))  # the mark, then the words
    rows = rows.withColumn("n_words", F.size("w").cast("long") - 1)
    rows = rows.select("row", "doc_id", "n_words", F.posexplode(F.arrays_zip(F.col("w").alias("w0"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("w1"), F.slice("w", 3, F.greatest(F.size("w"), F.lit(1))).alias("w2"))).alias("pos", "g"))
    rows = rows.select("row", "doc_id", "n_words", (F.col("pos") - 1).alias("pos"), "g.w0", "g.w1", "g.w2").withColumn("h", gram("w0", "w1"))
    same = (F.col("t") == -1) | ((F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1")) & (F.col("t2").isNull() | (F.col("w2") == F.col("t2"))))
    hits = rows.join(known, "h").where(same)
    # votes: the places of the template that match on one diagonal
    place = lambda k: F.when(F.floor(F.col("tpos") / 64) == k, F.expr("shiftleft(1L, tpos % 64)")).otherwise(F.lit(0).cast("long"))
    votes = hits.groupBy("row", "t", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        *(F.bit_or(place(k)).alias(f"m{k}") for k in masks), F.min("pos").alias("low"), F.max("pos").alias("high"),
        *(F.first(c).alias(c) for c in ("doc_id", "n_words", "base", "label", "grams", "length")),
    )
    by = W.partitionBy("row", "t").orderBy("diagonal")
    jump = F.col("base") | (F.col("t") == -1) | (F.col("diagonal") - F.lag("diagonal").over(by) > GAP)
    votes = votes.withColumn("run", F.sum(F.coalesce(jump, F.lit(True)).cast("int")).over(by))
    spans = votes.groupBy("row", "t", "run").agg(
        reduce(lambda a, b: a + b, [F.bit_count(F.bit_or(f"m{k}")) for k in masks]).alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("diagonal").alias("diagonal"),
        *(F.first(c).alias(c) for c in ("doc_id", "n_words", "base", "label", "grams", "length")),
    )
    covered = F.col("n") / F.col("grams")
    stands = F.when(F.col("base"), F.col("n") == F.col("grams")).otherwise((covered >= COVERED) & (F.col("high") + 3 - F.col("low") <= STRETCH * F.col("length")))
    place = F.struct(
        "label", "base", F.when(F.col("base"), F.col("diagonal")).otherwise(F.col("low")).cast("long").alias("first"),
        F.when(F.col("base"), F.col("diagonal") + F.col("length") - 1).otherwise(F.col("high") + 2).cast("long").alias("last"), covered.alias("score"),
    )
    return spans.groupBy("row").agg(F.max(F.when(F.col("t") == -1, F.struct("doc_id", "n_words"))).alias("d"), F.collect_list(F.when((F.col("t") >= 0) & stands, place)).alias("found")).select("row", "d.doc_id", "d.n_words", "found")


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns."""
    base = F.filter("found", lambda x: x["base"])
    joined = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda x: x["label"]))), ",")
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(F.transform(base, lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["first"])).alias("last_word"), joined(base).alias("base_labels"), joined(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0)).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the licenses of every document."""
    return digest(scan(table(spark, sf_dir, "documents")))


def brute_force(docs: list[tuple[int, str | None]]) -> list[tuple]:
    """doc_id, n_words, n_base, first_word, last_word and base_labels, for tests."""
    out = []
    for d, t in docs:
        w = words_of(t or "")
        at = [(i, label) for p, label in PHRASES.items() for n in [len(p.split())] for i in range(len(w) - n + 1) if w[i : i + n] == p.split()]
        places = [i for i, _ in at]
        out.append((d, len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))))
    return out


def brute_force_notices(docs: list[tuple[int, str | None]]) -> list[tuple]:
    """doc_id and the set of notices found in each document, by comparing every place with every place of every notice, for tests."""
    out = []
    for d, t in docs:
        w, found = words_of(t or ""), set()
        for label, text in NOTICES:
            v = words_of(text)
            places: dict[int, set[int]] = {}
            spans: dict[int, list[int]] = {}
            for i in range(len(w) - 2):
                for j in range(len(v) - 2):
                    if w[i : i + 3] == v[j : j + 3]:
                        places.setdefault(i - j, set()).add(j)
                        spans.setdefault(i - j, []).append(i)
            run: list[int] = []
            for g in [*sorted(places), None]:
                if run and (g is None or g - run[-1] > GAP):
                    low, high = min(min(spans[x]) for x in run), max(max(spans[x]) for x in run)
                    share = len(set().union(*(places[x] for x in run))) / (len(v) - 2)
                    if share >= COVERED and high + 3 - low <= STRETCH * len(v):
                        found.add(label)
                    run = []
                run.append(g)
        out.append((d, found))
    return out
