"""Fill-in-the-middle examples by ropes.

A text is a rope: its leaves are stretches of about ``LEAF`` bytes that end between two units (a run of ASCII letters, or any other code
point alone), and every node caches how many units and code points lie below it. Two unit ranks drawn from doc_id cut the text into
prefix, middle and suffix: the tree is split at them on one path from the root each, and the subtrees are concatenated in the order
of the form with sentinels between, so no text is copied before the output is written. ``restore`` goes back the same way: the output's own rope is
split at the ranks of its sentinels, and the subtrees are put back in order.

A sentinel begins with `<` and ends with `>`, which no other part of it holds, and texts that contain one stay plain; so the first `<S>` or `<M>` of an
output is always the sentinel itself, whatever stands beside it.

Defined results. A null text is empty; an empty text stays plain. A null doc_id draws as the empty text would. Repeated rows each get a
result. Extra columns are ignored. Very long texts are ropes of many leaves; a run of letters of any length is one unit and never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .textkit import blocks

LEAF = 4096
#: Fixed sentinels and shares, in percent.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_PERCENT, SPM_PERCENT = 10, 20
SENTINEL_UNITS = 3
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


class Rope:
    """A stretch of text: a leaf holds bytes, an inner node two ropes. Both know their units and code points."""

    __slots__ = ("chars", "data", "left", "right", "units")

    def __init__(self, units: int, chars: int, data: memoryview | bytes = b"", left: Rope | None = None, right: Rope | None = None):
        self.units, self.chars, self.data, self.left, self.right = units, chars, data, left, right


EMPTY = Rope(0, 0)


def _starts(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where the units of a block of UTF-8 texts begin; ``rows`` are the first bytes of the texts in it."""
    letter = _LETTER[data]
    begins = (data & 0xC0) != 0x80
    begins[1:] &= ~(letter[1:] & letter[:-1])
    begins[rows] = True
    return np.flatnonzero(begins)


def sentinel(text: str) -> Rope:
    return Rope(SENTINEL_UNITS, len(text), text.encode())


def concat(a: Rope, b: Rope) -> Rope:
    if not a.units or not b.units:
        return a if a.units else b
    return Rope(a.units + b.units, a.chars + b.chars, left=a, right=b)


def joined(parts: list[Rope]) -> Rope:
    """Parts one after the other, as a balanced tree."""
    while len(parts) > 1:
        parts = [concat(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else EMPTY


def split(rope: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first ``rank`` units, and the rest: one path down the tree, and one leaf cut on it."""
    if rank <= 0:
        return EMPTY, rope
    if rank >= rope.units:
        return rope, EMPTY
    if rope.left is not None:
        if rank < rope.left.units:
            a, b = split(rope.left, rank)
            return a, concat(b, rope.right)
        a, b = split(rope.right, rank - rope.left.units)
        return concat(rope.left, a), b
    data = np.frombuffer(rope.data, np.uint8)
    at = int(_starts(data, np.zeros(1, int))[rank])
    chars = int(np.count_nonzero((data[:at] & 0xC0) != 0x80))
    return Rope(rank, chars, rope.data[:at]), Rope(rope.units - rank, rope.chars - chars, rope.data[at:])


def written(rope: Rope) -> bytes:
    """The text of a rope."""
    parts, waiting = [], [rope]
    while waiting:
        node = waiting.pop()
        if node.left is None:
            parts.append(node.data)
        else:
            waiting += (node.right, node.left)
    return b"".join(parts)


class Ropes:
    """The ropes of a block of texts; the units and code points of all leaves are counted at once."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs, self.view = data, offs, memoryview(data)
        full = offs[:-1][np.diff(offs) > 0]
        self.starts = _starts(data, full)
        self.first = np.searchsorted(self.starts, offs)
        cuts = [full]
        for i in np.flatnonzero(np.diff(offs) > LEAF):
            targets = np.searchsorted(self.starts, np.arange(offs[i] + LEAF, offs[i + 1], LEAF))
            cuts.append(self.starts[targets[targets < self.first[i + 1]]])
        self.cuts = np.unique(np.concatenate(cuts))
        self.leaf = np.searchsorted(self.cuts, offs)
        self.ends = np.append(self.cuts[1:], len(data))
        self.units = np.diff(np.append(np.searchsorted(self.starts, self.cuts), len(self.starts)))
        self.chars = np.add.reduceat((data & 0xC0) != 0x80, self.cuts, dtype=np.int64) if len(self.cuts) else np.zeros(0, np.int64)

    def units_of(self) -> np.ndarray:
        return np.diff(self.first)

    def rank(self, row: int, byte: int) -> int:
        """The rank of the unit of a row that begins at a byte of the block."""
        return int(np.searchsorted(self.starts, byte) - self.first[row])

    def rope(self, row: int) -> Rope:
        leaves = range(int(self.leaf[row]), int(self.leaf[row + 1]))
        return joined([Rope(int(self.units[k]), int(self.chars[k]), self.view[self.cuts[k] : self.ends[k]]) for k in leaves])


def rearranged(rope: Rope, a: int, b: int, form: str) -> tuple[Rope, int, int]:
    """A text in its form, and the code points of its prefix and middle; the prefix ends after ``a`` units, the middle after ``b``."""
    head, suffix = split(rope, b)
    prefix, middle = split(head, a)
    parts = [(PREFIX, prefix), (SUFFIX, suffix)] if form == "psm" else [(SUFFIX, suffix), (PREFIX, prefix)]
    return joined([r for name, part in [*parts, (MIDDLE, middle)] for r in (sentinel(name), part)]), prefix.chars, middle.chars


def put_back(rope: Rope, second: int, third: int, form: str) -> Rope:
    """The text of a rearranged rope, whose second and third sentinels have these ranks."""
    head, tail = split(rope, third)
    one, two = split(head, second)
    bare = [split(part, SENTINEL_UNITS)[1] for part in (one, two, tail)]
    prefix, suffix = bare[:2] if form == "psm" else bare[1::-1]
    return joined([prefix, bare[2], suffix])


def _draw(k: int, seed: int) -> Column:
    """The k-th eight digits of the hash of seed and doc_id, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def transform(docs: DataFrame, seed: int = 1, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of every document row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = (text == "") | F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE)) | (_draw(3, seed) % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(_draw(4, seed) % 100 < spm_percent, "spm").otherwise("psm")
    rows = docs.select("doc_id", text.alias("text"), form.alias("form"), _draw(1, seed).alias("h1"), _draw(2, seed).alias("h2"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, data, offs in blocks(batch):
                ropes = Ropes(data, offs)
                units = ropes.units_of()
                ends = np.sort(np.stack([c.to_numpy() % (units + 1) for c in some.columns[3:5]]), axis=0)
                output, prefix, middle = [], [], []
                for i, form in enumerate(some.column(2).to_pylist()):
                    if form == "plain":
                        rope, p, m = ropes.rope(i), None, None
                    else:
                        rope, p, m = rearranged(ropes.rope(i), int(ends[0, i]), int(ends[1, i]), form)
                    output.append(written(rope))
                    prefix.append(p)
                    middle.append(m)
                columns = [some.column(0), pa.array(units.astype(np.int64)), some.column(2), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(apply, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(rows: DataFrame) -> DataFrame:
    """Rows with form and output, and ``restored``, the text that they were made of. All other columns stay; one called restored is replaced."""
    rows = rows.select(*[c for c in rows.columns if c.lower() != "restored"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, data, offs in blocks(batch, "output"):
                ropes, whole, texts = Ropes(data, offs), data.tobytes(), []
                for i, form in enumerate(some.column(some.schema.get_field_index("form")).to_pylist()):
                    rope = ropes.rope(i)
                    if form != "plain":
                        start, stop = int(offs[i]), int(offs[i + 1])
                        second = whole.index((SUFFIX if form == "psm" else PREFIX).encode(), start, stop)
                        third = whole.index(MIDDLE.encode(), second, stop)
                        rope = put_back(rope, ropes.rank(i, second), ropes.rank(i, third), form)
                    texts.append(written(rope))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.string())], [*some.schema.names, "restored"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(apply, f"{fields}, restored string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: all documents rearranged, and restored from what was made of them."""
    rows = restore(transform(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE_SQL = r"""
with t as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
d as (select *, len(u) as n, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2, ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from t),
f as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from d),
p as (select *, array_to_string(u[1:a], '') as prefix, array_to_string(u[a + 1:b], '') as middle, array_to_string(u[b + 1:n], '') as suffix from f)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(prefix) end::bigint as prefix_chars, case when form <> 'plain' then length(middle) end::bigint as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(text) as restored_sha256
from p
"""
