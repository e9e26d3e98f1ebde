"""Dates kept as ISO text; the day of the run is a parameter, so that reruns agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_date(c: Column) -> Column:
    """A date where the text is a valid YYYY-MM-DD, else null."""
    return F.when(F.rlike(c, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.try_to_date(c, "yyyy-MM-dd"))


def iso_date(c: Column) -> Column:
    """The day that leads an ISO date or time; null where there is none."""
    day = F.regexp_extract(F.trim(F.coalesce(c, F.lit(""))), r"^(\d{4}-\d{2}-\d{2})", 1)
    return F.when(day != "", day)


def rfc_date(c: Column) -> Column:
    """The day of an RFC 2822 date, else of an ISO one."""
    day = F.regexp_extract(F.coalesce(c, F.lit("")), r"(\d{1,2} [A-Z][a-z]{2} \d{4})", 1)
    return F.coalesce(F.date_format(F.try_to_date(F.when(day != "", day), "d MMM yyyy"), "yyyy-MM-dd"), iso_date(c))


def expired(deadline: Column, as_of: str) -> Column:
    return F.coalesce(as_date(deadline) < F.lit(as_of).cast("date"), F.lit(False))


def due_within(deadline: Column, as_of: str, days: int) -> Column:
    return F.coalesce(F.datediff(as_date(deadline), F.lit(as_of).cast("date")).between(0, days), F.lit(False))
