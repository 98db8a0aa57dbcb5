"""Dates that do not depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_date(ts: Column) -> Column:
    """The calendar day in UTC of an instant."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_micros(ts) / 86_400_000_000).cast("int"))
