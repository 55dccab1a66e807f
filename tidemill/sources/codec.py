"""The wire codec of trip events: 37 bytes, little-endian (version 1, event time, zone, cents, milli, publish time).

Built-in functions have no little-endian packer, so both directions are vectorised over Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed layout.
WIRE = np.dtype([("version", "u1"), ("event_time_ms", "<i8"), ("zone", "<i4"), ("fare_cents", "<i8"), ("distance_milli", "<i8"), ("publish_ms", "<i8")])
VERSION = 1
_FIELDS = WIRE.names[1:]
# type objects, not DDL: they need no session when the module is imported
_DECODED = T.StructType([T.StructField("ok", T.BooleanType())] + [T.StructField(n, T.IntegerType() if n == "zone" else T.LongType()) for n in _FIELDS])


@F.pandas_udf(T.BinaryType())
def _encode(t: pd.Series, zone: pd.Series, fare: pd.Series, distance: pd.Series, publish: pd.Series) -> pd.Series:
    out = np.zeros(len(t), WIRE)
    out["version"] = VERSION
    for name, values in zip(_FIELDS, (t, zone, fare, distance, publish), strict=True):
        out[name] = values.to_numpy()
    raw = out.tobytes()
    return pd.Series([raw[i : i + WIRE.itemsize] for i in range(0, len(raw), WIRE.itemsize)])


def parse(value: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Which records are well formed, and the fields of all (of others: zeros)."""
    ok = value.map(lambda b: b is not None and len(b) == WIRE.itemsize and b[0] == VERSION).to_numpy(bool)
    rows = np.zeros(len(value), WIRE)
    if ok.any():
        rows[ok] = np.frombuffer(b"".join(value.to_numpy()[ok]), WIRE)
    return ok, rows


@F.pandas_udf(_DECODED)
def _decode(value: pd.Series) -> pd.DataFrame:
    ok, rows = parse(value)
    return pd.DataFrame({"ok": ok} | {name: rows[name] for name in _FIELDS})


def encode(*columns: str) -> Column:
    """The record of event_time_ms, zone, fare_cents, distance_milli and publish_ms."""
    return _encode(*[F.col(c) for c in columns])


def decode(value: str) -> Column:
    """The record's fields as a struct; null if its length or version is wrong."""
    d = _decode(F.col(value))
    return F.when(d["ok"], F.struct(*[d[name].alias(name) for name in _FIELDS]))


def key(zone: str) -> Column:
    """The record's key: the zone as decimal text."""
    return F.col(zone).cast("string").cast("binary")
