"""Language identification by bit-sliced Bloom filters over byte n-grams.

Every text is lower-cased, everything but letters becomes one space, and its n-grams of ``N`` bytes are taken.
Training counts the n-grams of every language over all training documents; an n-gram belongs to a language if its
share of that language's n-grams reaches ``SHARE``, which behaves alike at every size and bounds each language to
``1 / SHARE`` n-grams. The filters of all languages are stored bit-sliced: slot s holds a bitmask with one bit a language, so
one probe of ``HASHES`` slots, and-ed together, returns all the languages that contain an n-gram.

Prediction adds up, for each language, the n-grams whose mask holds its bit, subtracts the false positives that its
filter's fill lets expect, and takes the language with the largest share. The share is the score.

Defined results. A text that is null or has no letter gets `und` and score 0. Rows whose lang is null teach nothing.
Without training rows every text is `und`. Ties go to the smaller name. Repeated rows each get a result.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .textkit import blocks, column, mix

N = 4
SHARE = 5e-5
HASHES = 3
SLOT_BITS = 20
_SPACE = 0x20


def _clean(texts: pa.Array) -> pa.Array:
    """Lower-cased texts in which each run of what is no letter is one space."""
    texts = pc.fill_null(texts, "")
    return pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\pL]+", " ")


def _grams(rows: pa.RecordBatch, index: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a block of rows as 32-bit numbers, and the first of each row (with one space around each text)."""
    data, offs = column(pc.binary_join_element_wise("", _clean(rows.column(index)), "", " ").cast(pa.string()))
    padded = np.concatenate([data, np.zeros(N, np.uint8)])
    four = np.ndarray((len(padded) - 3,), "<u4", buffer=padded.data, strides=(1,))
    keep = np.ones(len(data), bool)
    for back in range(1, N):  # no n-gram reaches into the next row
        at = offs[1:] - back
        keep[at[(at >= offs[:-1])]] = False
    place = np.flatnonzero(keep)
    return four[place], np.searchsorted(place, offs)


def _has_letter(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)


class Filters:
    """The bit-sliced filters of all languages."""

    def __init__(self, names: list[str], grams: np.ndarray, lang: np.ndarray):
        self.names = names
        self.words = max(1, -(-len(names) // 64))
        self.table = np.zeros((self.words, 1 << SLOT_BITS), np.uint64)
        for k in range(len(names)):
            for s in self.slots(grams[lang == k]):
                self.table[k // 64][s] |= np.uint64(1 << (k % 64))
        fill = np.array([np.mean(self.table[k // 64] >> np.uint64(k % 64) & np.uint64(1)) for k in range(len(names))])
        self.false = fill**HASHES

    def slots(self, grams: np.ndarray) -> list[np.ndarray]:
        h = mix(grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        m = np.uint64((1 << SLOT_BITS) - 1)
        return [(h >> np.uint64(SLOT_BITS * j) & m).astype(np.int64) for j in range(HASHES)]

    def counts(self, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each row and language, the n-grams that it contains, less the expected false positives."""
        slots = self.slots(grams)
        n = np.diff(first).astype(float)
        out = np.zeros((len(n), len(self.names)))
        for w in range(self.words):
            mask = self.table[w][slots[0]]
            for s in slots[1:]:
                mask &= self.table[w][s]
            for k in range(64 * w, min(64 * (w + 1), len(self.names))):
                total = np.concatenate([[0], np.cumsum(mask >> np.uint64(k % 64) & np.uint64(1), dtype=np.int64)])
                out[:, k] = total[first[1:]] - total[first[:-1]]
        return np.maximum(0, (out - n[:, None] * self.false) / (1 - np.minimum(self.false, 0.999)))


def train(docs: DataFrame, modulus: int = 3, held: int = 1) -> Filters:
    """Filters from all rows with a lang whose crc32(doc_id) does not leave the held-out remainder."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, (g, n) in totals.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])
            totals.clear()

        for batch in batches:
            for rows, _, _ in blocks(batch):
                grams, first = _grams(rows, 1)
                lang = rows.column(0).dictionary_encode()
                code = np.repeat(lang.indices.to_numpy(zero_copy_only=False), np.diff(first))
                for k, name in enumerate(lang.dictionary.to_pylist()):
                    g, n = np.unique(grams[code == k], return_counts=True)
                    if name in totals:
                        g, back = np.unique(np.concatenate([totals[name][0], g]), return_inverse=True)
                        n = np.bincount(back, np.concatenate([totals[name][1], n])).astype(np.int64)
                    totals[name] = (g, n)
                if sum(len(g) for g, _ in totals.values()) > 4_000_000:
                    yield from flush()
        yield from flush()

    allowed = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus != held
    rows = docs.where(allowed).where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), "text")
    grams = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = grams.groupBy("lang").agg(F.sum("n").alias("total"))
    often = grams.join(total, "lang").where(F.col("n") >= F.col("total") * SHARE).select("lang", "gram").toArrow()  # 1 / SHARE a language at most
    names = sorted(set(often.column("lang").to_pylist()), key=lambda s: s.encode())
    code = {s: k for k, s in enumerate(names)}
    return Filters(names, often.column("gram").to_numpy().astype(np.uint64), np.array([code[s] for s in often.column("lang").to_pylist()], np.int64))


def predict(docs: DataFrame, filters: Filters, modulus: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, and n_grams, the n-grams it was judged by."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, _ in blocks(batch):
                n = rows.num_rows
                name, score, many = np.full(n, "und", object), np.zeros(n), np.zeros(n, np.int64)
                some = _has_letter(rows.column(1))
                if filters.names and some.any():
                    grams, first = _grams(rows, 1)
                    counts = filters.counts(grams, first)
                    many = np.diff(first)
                    sums = counts.sum(axis=1)
                    share = np.where(sums[:, None] > 0, counts / np.maximum(sums, 1e-12)[:, None], 1 / len(filters.names))
                    best = share.argmax(axis=1)
                    name = np.where(some, np.array(filters.names, object)[best], "und")
                    score = np.where(some, np.clip(share.max(axis=1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(name.tolist(), pa.string()), pa.array(score), pa.array(many)], ["doc_id", "held_out", "lang_pred", "score", "n_grams"])

    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == held
    docs = docs.select("doc_id", "text", out.alias("held_out"))
    return docs.mapInArrow(apply, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, n_grams long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: the language of every document."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs))
