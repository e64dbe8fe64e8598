"""Dates out of raw strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for an unknown date.
UNDEFINED = ("0101-01-01", "0100-01-01")


def day_of(raw: Column) -> Column:
    """The calendar day of an ISO date or time, as it was written, whatever its offset; null if there is none, or if the text
    stands for an unknown date. Works on strings, dates and timestamps."""
    text = F.trim(raw.cast("string"))
    known = text.rlike(r"^\d{4}-\d{2}-\d{2}") & ~text.rlike("^(" + "|".join(UNDEFINED) + ")")
    return F.when(known, F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))


def dashed(raw: Column) -> Column:
    """A camera's date (2020:01:31 10:00:00) with dashes in its day, as ISO has it; any other text stays."""
    return F.regexp_replace(raw, r"^(\d{4}):(\d{2}):(\d{2})", "$1-$2-$3")


def month_of(raw: Column) -> Column:
    """The first seven characters: year and month."""
    return F.substring(raw.cast("string"), 1, 7)
