"""Text to time, without time zone: civic records carry local wall-clock dates."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from tractlake.functions.text import col_of

# ``M/d/y`` takes one- and two-digit months and days, and any year as written.
US_DATE = "M/d/y"
LENIENT_FORMATS = (
    "M/d/yyyy",
    "M/d/yyyy h:mm:ss a",
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy h:mm a",
    "M/d/yyyy H:mm",
    "yyyy/M/d",
    "d MMM yyyy",
    "d-MMM-yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
)


def strict_date(column: Column | str, pattern: str = US_DATE, name: str = "date") -> Column:
    """Null stays null; a text that does not fit the pattern ends the run."""
    value = col_of(column)
    bad = F.concat(F.lit(f"{name}: not a date of form {pattern}: "), value)
    parsed = F.try_to_date(value, pattern)
    return F.coalesce(parsed, F.when(value.isNotNull(), F.raise_error(bad))).cast("timestamp_ntz")


def lenient_timestamp(
    column: Column | str, formats: Sequence[str] = LENIENT_FORMATS
) -> Column:
    """ISO text or the first fitting format; anything else becomes null.

    Text without a digit, such as ``n/a``, is not tried: a failed parse is slow.
    """
    value = col_of(column)
    parsed = F.coalesce(
        value.try_cast("timestamp_ntz"),
        *[F.try_to_timestamp(value, F.lit(f)).cast("timestamp_ntz") for f in formats],
    )
    return F.when(value.rlike("[0-9]"), parsed)


def iso_timestamp(column: Column | str) -> Column:
    return col_of(column).try_cast("timestamp_ntz")


def run_clock(now: datetime | None = None) -> datetime:
    """The one instant a run stamps on its rows; pass ``now`` for stable output."""
    return now or datetime.now(timezone.utc)


def iso_text(now: datetime | None = None) -> Column:
    return F.lit(run_clock(now).isoformat())


def snapshot_stamp(now: datetime | None = None) -> str:
    return run_clock(now).strftime("%Y%m%d_%H%M%S")


def run_timestamp(now: datetime | None = None) -> Column:
    return F.lit(run_clock(now).strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def run_date(now: datetime | None = None) -> Column:
    """The fixed date when ``now`` is given, else the session's current date."""
    return F.lit(now.date()) if now else F.current_date()
