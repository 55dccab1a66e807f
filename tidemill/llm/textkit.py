"""Vectorised byte-level text kernels over Arrow string columns.

All kernels work on the UTF-8 bytes of a whole block of rows at once. Every byte of a non-ASCII
character is >= 0x80, so the two word classes below, which hold all non-ASCII characters, can be
decided byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 4 << 20
_U = np.uint64

#: Words `[^\x20\x09-\x0D]+`.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of texts whose A-Z are lower-cased.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_MASK = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], dtype=_U)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public-domain splitmix64 one): every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def column(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and its n + 1 row offsets."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def blocks(batch: pa.RecordBatch, text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``limit`` text bytes; a longer row makes a block of its own."""
    if not batch.num_rows:
        return
    data, offs = column(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        to = min(to, batch.num_rows)
        yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


class Words:
    """Where the words of a block stand: byte spans, and the range of words of each row."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, word: np.ndarray):
        flag = word[data]
        rows = offs[:-1][offs[:-1] < len(data)]
        before = np.zeros(len(data), bool)
        before[1:] = flag[:-1]
        before[rows] = False
        self.starts = np.flatnonzero(flag & ~before)
        after = np.zeros(len(data), bool)
        after[:-1] = flag[1:]
        after[rows[rows > 0] - 1] = False
        self.ends = np.flatnonzero(flag & ~after) + 1
        self.first = np.searchsorted(self.starts, offs)
        self.counts = np.diff(self.first)

    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def hash_words(data: np.ndarray, words: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes, taken 8 at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", buffer=padded.data, strides=(1,))
    left = words.ends - words.starts
    out = left.astype(_U) * _U(0x9E3779B97F4A7C15)
    live, at = np.arange(len(left)), words.starts
    while len(live):
        piece = eight[at] & _MASK[np.minimum(left, 8)]
        out[live] = mix(out[live] ^ (piece * _U(0xD6E8FEB86659FD93) + _U(0x2545F4914F6CDD1D)))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return out


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words; run i begins at word i."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    acc = np.full(n, _U(k * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF), _U)
    for j in range(k):
        acc = (acc ^ h[j : j + n]) * _U(0x9FB21C651E98DF25)
        acc ^= acc >> _U(29)
    return mix(acc)


def words_hash(words: list[bytes]) -> np.ndarray:
    """``hash_words`` of single words."""
    data = np.frombuffer(b" ".join(words), np.uint8) if words else np.zeros(0, np.uint8)
    return hash_words(data, Words(data, np.array([0, len(data)]), SPACED))


def crc_mod(ids, m: int) -> np.ndarray:
    """crc32 of each id's text modulo m (null: the empty text's)."""
    import zlib

    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % m for i in ids], np.int64)
