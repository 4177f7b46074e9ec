"""Date text parsing and day arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_FMT = "dd-MM-yyyy"


def parse_date(c, fmt: str = DATE_FMT) -> Column:
    """``to_datetime(errors='coerce')``: wrong format or impossible date -> null.
    (ANSI mode is on, so plain ``to_date`` would raise.)"""
    c = F.col(c) if isinstance(c, str) else c
    return F.try_to_timestamp(c, F.lit(fmt)).cast("date")


def days_between(later, earlier) -> Column:
    return F.datediff(later, earlier)


def age_years(as_of: str, d) -> Column:
    """Age in years = days/365.25, missing -> 0, floored at 0."""
    days = F.datediff(F.lit(as_of).cast("date"), d)
    return F.greatest(F.coalesce(days / F.lit(365.25), F.lit(0.0)), F.lit(0.0))
