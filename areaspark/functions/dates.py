"""Date expressions. The run date is always a parameter, so results repeat."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days in a year, as the age rules define it (fixed value).
DAYS_PER_YEAR = 365.25
# Divisor of the earlier age rule (fixed value).
DAYS_PER_YEAR_EARLIER = 385.25


def run_date(as_of: dt.date | str | None = None) -> Column:
    return F.current_date() if as_of is None else F.lit(str(as_of)).cast("date")


def age_years(
    birth: Column | str, as_of: dt.date | str | None = None, divisor: float = DAYS_PER_YEAR
) -> Column:
    b = F.col(birth) if isinstance(birth, str) else birth
    return F.datediff(run_date(as_of), b) / F.lit(divisor)


def in_years(ts: Column | str, first: int, last: int) -> Column:
    """Year window as a half-open range on the raw column, so it can be pushed down."""
    c = F.col(ts) if isinstance(ts, str) else ts
    lo = F.lit(f"{first}-01-01 00:00:00").cast("timestamp_ntz")
    hi = F.lit(f"{last + 1}-01-01 00:00:00").cast("timestamp_ntz")
    return (c >= lo) & (c < hi)


def day_label(col: Column | str) -> Column:
    """``Jan 05, 2024``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.date_format(c, "MMM dd, yyyy")
