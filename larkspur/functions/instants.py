"""Canonical timestamps (text to the millisecond, ending in Z), days in a zone, and elapsed time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
SHAPE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}Z$"


def instant(text: Column) -> Column:
    """Timestamp of a canonical text; null unless it names a real instant in exactly that form."""
    return F.when(text.rlike(SHAPE), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSX")))


def millis(text: Column) -> Column:
    return F.unix_millis(instant(text))


def is_invalid(text: Column) -> Column:
    return instant(text).isNull()


def canonical(ts: Column) -> Column:
    """Canonical text of a timestamp, cut to the millisecond, in a session whose zone is UTC."""
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def normalize(text: Column) -> Column:
    """Canonical text of an ISO timestamp; one without a zone is taken as UTC; null if invalid."""
    t = F.trim(text)
    t = F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.concat(t, F.lit("T00:00:00"))).otherwise(t)
    zoned = F.when(t.rlike(r"(?i)(Z|[+-][0-9]{2}:[0-9]{2})$"), t).otherwise(F.concat(t, F.lit("Z")))
    return canonical(F.try_to_timestamp(F.date_trunc("millisecond", F.try_to_timestamp(zoned)).cast("string")))


def day_in(ts: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), zone))


def days_between(later_ms: Column, earlier_ms: Column) -> Column:
    """Whole days, rounded down."""
    return F.floor((later_ms - earlier_ms) / F.lit(DAY_MS)).cast("long")


def within_day(elapsed_ms: Column, day: int) -> Column:
    """Elapsed time in the half-open window from 0 to the end of day ``day`` (0 is the first 24 hours)."""
    return (elapsed_ms >= 0) & (elapsed_ms < F.lit((day + 1) * DAY_MS))


def on_day(elapsed_ms: Column, day: int) -> Column:
    return (elapsed_ms >= F.lit(day * DAY_MS)) & (elapsed_ms < F.lit((day + 1) * DAY_MS))


def skewed(occurred_ms: Column, received_ms: Column, allowance_ms: int = 300_000) -> Column:
    return occurred_ms > received_ms + F.lit(allowance_ms)


def valid_date(text: Column) -> Column:
    """Whether text is a real date as yyyy-mm-dd."""
    return text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull()
