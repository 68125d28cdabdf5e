"""Instants: ISO 8601 text in its usual spellings to microseconds since the epoch, independent of the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = r"^\d{4}-\d{2}-\d{2}$"
NO_SECONDS = r"^(\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2})(?!:)"
ZONE = r"(?:[Zz]|[+-]\d{2}:?\d{2})$"


def instant_micros(at: Column) -> Column:
    """BIGINT microseconds of the instant that `at` denotes: a date alone is midnight UTC, a time without zone is UTC, an
    offset is applied, a fraction is kept to microseconds. Null where `at` is null or no such text."""
    s = F.trim(at)
    s = F.when(s.rlike(DAY), F.concat(s, F.lit("T00:00:00Z"))).otherwise(F.regexp_replace(s, NO_SECONDS, "$1:00"))
    s = F.when(s.rlike(ZONE), s).otherwise(F.concat(s, F.lit("Z")))
    return F.unix_micros(F.try_to_timestamp(s))
