"""Quality classifier: a byte-level convolutional network in numpy.

The whole text is covered by chunks of ``CHUNK`` bytes that overlap by ``CHUNK - HOP``. Bytes are embedded;
learned filters run over each chunk and are max-pooled over its positions; a learned layer turns a chunk's
maxima into units, which are max-pooled over all chunks of the document and combined into one probability.

Training runs on the driver over a bounded sample of labelled rows: of the ``TRAIN_DOCS`` with the smallest hashes, in that order, the whole
texts that still fit ``TRAIN_BYTES`` bytes, and some of each label at any rate. All chunks of a text are learned from. Scoring reads
every byte of every document, where the rows already are, without a shuffle. Seeds are fixed; reruns agree.

Defined results. A null or empty text is one chunk of padding. Labels that are null or neither 0 nor 1 are left
out; several labels of one doc_id count once (the smallest), and so do several texts. Without both labels every score is the share of
label 1 (without any, 0.5). Extra columns are ignored; with ``keep``, the score's column gets underscores in front if its name is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, table
from .textkit import blocks

CHUNK, HOP = 512, 384
WIDTH, STRIDE, EMBED, FILTERS, UNITS = 8, 4, 8, 24, 12
TRAIN_DOCS, TRAIN_BYTES = 4000, 32 << 20
#: Of each label so many documents are looked at however rare it is.
FEW = 32
THRESHOLD = 0.3
_STEP = 64  # chunks convolved at once


def chunk_starts(length: int) -> np.ndarray:
    """Where the chunks of a text of so many bytes begin; the last one reaches its end."""
    return np.arange(max(1, -(-(length - (CHUNK - HOP)) // HOP))) * HOP


def _chunks(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a block of rows: each chunk's first byte, its length, and the first chunk of each row."""
    lengths = np.diff(offs)
    many = np.maximum(1, -(-(lengths - (CHUNK - HOP)) // HOP))
    first = np.concatenate([[0], np.cumsum(many)])
    row = np.repeat(np.arange(len(lengths)), many)
    at = (np.arange(first[-1]) - first[row]) * HOP
    return offs[row] + at, np.minimum(CHUNK, lengths[row] - at), first


def _gather(padded: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The chunks as rows of CHUNK bytes, zero beyond their length."""
    grid = np.arange(CHUNK)
    return np.where(grid[None, :] < size[:, None], padded[start[:, None] + grid[None, :]], 0).astype(np.uint8)


class Network:
    """Embedding, filters, chunk units and the final combination."""

    NAMES = ("embed", "filters", "bias", "units", "unit_bias", "last", "last_bias")

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = np.float32
        self.embed = (r.normal(size=(256, EMBED)) * 0.5).astype(f)
        self.filters = (r.normal(size=(WIDTH * EMBED, FILTERS)) * (2 / (WIDTH * EMBED)) ** 0.5).astype(f)
        self.bias = np.zeros(FILTERS, f)
        self.units = (r.normal(size=(FILTERS, UNITS)) * (2 / FILTERS) ** 0.5).astype(f)
        self.unit_bias = np.full(UNITS, 0.1, f)
        self.last = (r.normal(size=UNITS) * 0.3).astype(f)
        self.last_bias = np.zeros(1, f)

    def convolve(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The maxima of the filters over each chunk (before ReLU), and their positions."""
        e = np.ascontiguousarray(self.embed[chunks])
        n, p = len(chunks), (CHUNK - WIDTH) // STRIDE + 1
        view = np.lib.stride_tricks.as_strided(e, (n, p, WIDTH * EMBED), (e.strides[0], STRIDE * e.strides[1], e.strides[2]))
        z = (view.reshape(n * p, -1) @ self.filters).reshape(n, p, FILTERS)
        return z.max(axis=1) + self.bias, z.argmax(axis=1) if self.train else None

    train = False

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        return np.maximum(np.maximum(self.convolve(chunks)[0], 0) @ self.units + self.unit_bias, 0)

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each row of a block."""
        start, size, first = _chunks(data, offs)
        padded = np.concatenate([data, np.zeros(CHUNK, np.uint8)])
        units = np.concatenate([self.pooled(_gather(padded, start[i : i + _STEP], size[i : i + _STEP])) for i in range(0, len(start), _STEP)])
        logit = np.maximum.reduceat(units, first[:-1], axis=0) @ self.last + self.last_bias
        return 1 / (1 + np.exp(-np.clip(logit.astype(float), -30, 30)))

    def step(self, chunks: np.ndarray, first: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients of a batch of documents (first: each one's first chunk)."""
        self.train = True
        z, where = (np.concatenate(x) for x in zip(*(self.convolve(chunks[i : i + _STEP]) for i in range(0, len(chunks), _STEP)), strict=True))
        self.train = False
        a = np.maximum(z, 0)
        h = np.maximum(a @ self.units + self.unit_bias, 0)
        top = np.maximum.reduceat(h, first, axis=0)
        p = 1 / (1 + np.exp(-np.clip(top @ self.last + self.last_bias, -30, 30)))
        loss = float(-np.mean(y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7)))
        d = ((p - y) / len(y)).astype(np.float32)
        g = {"last": top.T @ d, "last_bias": d.sum(keepdims=True)}
        row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(chunks))))
        best = (h == top[row]) & (h > 0)
        share = np.maximum(np.add.reduceat(best.astype(np.float32), first, axis=0), 1)
        dh = best * (d[:, None] * self.last[None, :] / share)[row]
        g["units"], g["unit_bias"] = a.T @ dh, dh.sum(0)
        dz = (dh @ self.units.T) * (z > 0)
        g["bias"] = dz.sum(0)
        live = np.flatnonzero(np.abs(dz).sum(1) > 0)
        grid = where[live][:, :, None] * STRIDE + np.arange(WIDTH)
        bytes_at = chunks[live][np.arange(len(live))[:, None, None], grid]  # live x filters x width
        seen = self.embed[bytes_at].reshape(len(live), FILTERS, -1)
        g["filters"] = np.einsum("nfk,nf->kf", seen, dz[live])
        de = dz[live][:, :, None] * self.filters.T[None]
        g["embed"] = np.zeros_like(self.embed)
        flat = bytes_at.ravel()
        for j, column in enumerate(de.reshape(-1, EMBED).T):
            g["embed"][:, j] = np.bincount(flat, column, 256)
        return loss, g

    def fit(self, docs: list[tuple[np.ndarray, int]], epochs: int = 14, batch: int = 32, rate: float = 4e-3, seed: int = 11) -> Network:
        """Adam over shuffled batches; docs: (chunks, label)."""
        r, t = np.random.default_rng(seed), 0
        mean = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        square = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        for epoch in range(epochs):
            now = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 1e-4
            order = r.permutation(len(docs))
            for at in range(0, len(order), batch):
                part = [docs[i] for i in order[at : at + batch]]
                first = np.cumsum([0] + [len(c) for c, _ in part[:-1]])
                _, g = self.step(np.concatenate([c for c, _ in part]), first, np.array([y for _, y in part], np.float32))
                t += 1
                for k in self.NAMES:
                    mean[k] = 0.9 * mean[k] + 0.1 * g[k]
                    square[k] = 0.999 * square[k] + 0.001 * g[k] ** 2
                    move = now * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.999**t)) + 1e-8)
                    setattr(self, k, (getattr(self, k) - move).astype(np.float32))
        return self


def labelled_sample(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, limit: int = TRAIN_DOCS, most: int = TRAIN_BYTES) -> list[tuple[np.ndarray, int]]:
    """(chunks, label) of labelled documents outside the held-out ones, in the order of a hash: at most ``limit``, and of those all that fit ``most`` bytes together; a text
    that doesn't fit is left out alone. If both labels have documents, both are in the sample: the first ``FEW`` of each label are always looked at, and the smallest text of a label that
    would be missing is taken beyond ``most``."""
    allowed = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus != held
    marked = labels.where("quality in (0, 1) and doc_id is not null").where(allowed).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    order = F.xxhash64(F.col("doc_id").cast("string"))
    first = lambda rows, n: rows.orderBy(order, "doc_id").limit(n)
    chosen = first(marked, limit)
    for quality in (0, 1):
        chosen = chosen.unionByName(first(marked.where(F.col("quality") == quality), FEW))
    chosen = chosen.distinct()  # so many ids at most are broadcast
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.keep(rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text")))
        sizes = rows.select("doc_id", "quality", F.octet_length("text").alias("size"), order.alias("h")).orderBy("h", "doc_id").collect()  # ``limit`` and twice ``FEW`` at most
        total, taken = 0, []
        for r in sizes:
            if total + r["size"] <= most:
                total += r["size"]
                taken.append(r)
        for quality in {r["quality"] for r in sizes} - {r["quality"] for r in taken}:
            taken.append(min((r for r in sizes if r["quality"] == quality), key=lambda r: (r["size"], r["h"])))
        if not taken:
            return []
        names = docs.sparkSession.createDataFrame([(r["doc_id"],) for r in taken], docs.select("doc_id").schema)
        got = rows.join(F.broadcast(names), "doc_id").select("doc_id", "quality", F.col("text").cast("binary").alias("text")).toArrow().sort_by("doc_id")
    out = []
    for text, y in zip(got.column("text").to_pylist(), got.column("quality").to_pylist(), strict=True):
        start, size, _ = _chunks(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        out.append((_gather(np.frombuffer(text + bytes(CHUNK), np.uint8), start, size), int(y)))
    return out


class Constant:
    """The score where there is nothing to learn."""

    def __init__(self, p: float):
        self.p = p

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return np.full(len(offs) - 1, self.p)


def train(docs: DataFrame, labels: DataFrame) -> Network | Constant:
    sample = labelled_sample(docs, labels)
    positive = sum(y for _, y in sample)
    if not 0 < positive < len(sample):
        return Constant(positive / len(sample) if sample else 0.5)
    network = Network()
    network.last_bias[:] = np.log(positive / (len(sample) - positive))
    return network.fit(sample)


def score(docs: DataFrame, model: Network | Constant, *, keep: bool = False) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; keep: the documents' own columns with ``_score`` instead."""
    name = fresh(docs.columns, "_score") if keep else "score"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in blocks(batch, limit=1 << 20):
                s = pa.array(model.scores(data, offs))
                columns = dict(zip(rows.schema.names, rows.columns, strict=True))
                yield pa.RecordBatch.from_pydict(columns | {name: s} if keep else {"doc_id": columns["doc_id"], "held_out": columns["held_out"], "score": s})

    if keep:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
        return docs.mapInArrow(apply, f"{fields}, `{name}` double")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text", held.alias("held_out")).mapInArrow(apply, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the quality of every document."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
