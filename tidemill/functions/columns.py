"""Scalar functions as Columns; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_to(t: Column | str, width: int = 60_000) -> Column:
    """The start of the bucket that holds t, also for negative t."""
    t = F.col(t) if isinstance(t, str) else t
    return t - F.pmod(t, F.lit(width).cast("long"))


def scaled(amount: Column | str, factor: int) -> Column:
    """An amount as a scaled long: half added in floating point, then cut towards zero."""
    amount = F.col(amount) if isinstance(amount, str) else amount
    return (amount * factor + 0.5).cast("long")


def ratio(above: Column, below: Column) -> Column:
    """above / below, 0 where below is 0."""
    return F.when(below == 0, F.lit(0.0)).otherwise(above / F.when(below != 0, below))


def mean_of(total: str, count: str, scale: float) -> Column:
    """A total in units of ``scale`` for each one counted, 0 without any."""
    return F.when(F.col(count) == 0, 0.0).otherwise(F.col(total) / F.lit(scale) / F.when(F.col(count) != 0, F.col(count)))


def share_of(part: str, whole: str, parts: float) -> Column:
    """A total against a 1/``parts`` of another: trips of 5 minutes against a twelfth of those of 60."""
    return ratio(F.col(part).cast("double"), F.col(whole) / F.lit(parts))


def hour_angle(ms: Column | str) -> Column:
    """The hour of day as an angle."""
    ms = F.col(ms) if isinstance(ms, str) else ms
    return F.pmod(F.floor(ms / 3_600_000), F.lit(24)) * (2 * F.pi()) / 24


def round2(x: Column | str) -> Column:
    """Two decimals, halves away from zero in binary floating point."""
    x = F.col(x) if isinstance(x, str) else x
    return F.signum(x) * F.floor(F.abs(x) * 100 + 0.5) / 100


def epoch_ms(ts: Column | str) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MILLISECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)


def from_epoch_ms(ms: Column | str) -> Column:
    """The timestamp without zone of milliseconds since 1970."""
    ms = F.col(ms) if isinstance(ms, str) else ms
    return F.timestamp_add("MILLISECOND", ms, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))


def parse_moment(text: Column | str) -> Column:
    """Milliseconds since 1970 of a month (YYYY-MM, its first moment in UTC) or of an RFC 3339 time; null for anything else."""
    text = F.col(text) if isinstance(text, str) else text
    month = text.rlike(r"^\d{4}-\d{2}$")
    full = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$")
    whole = F.when(month, F.concat(text, F.lit("-01T00:00:00Z"))).when(full, text)
    return F.unix_millis(F.try_to_timestamp(whole))


def address_map(text: Column | str) -> Column:
    """`id=host:port,...` as a map."""
    return F.str_to_map(F.col(text) if isinstance(text, str) else text, F.lit(","), F.lit("="))


def id_list(text: Column | str) -> Column:
    """Comma-separated numbers as an array; what is no number becomes null."""
    return F.transform(F.split(text, ","), lambda s: F.trim(s).try_cast("int"))


def thousands(x: Column | str, digits: int = 0) -> Column:
    return F.format_number(x, digits)
