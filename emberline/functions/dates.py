"""Date expressions over ISO text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_epoch(stamp: Column) -> Column:
    """UTC seconds of an ISO timestamp or date; missing and unreadable text count as 0.

    A year or a month alone is no date.
    """
    dated = F.when(stamp.rlike(r"^\s*\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(stamp))
    return F.coalesce(F.unix_timestamp(dated), F.lit(0).cast("bigint"))


def days_before(stamp: Column, reference: Column) -> Column:
    """Whole days from the date written in the stamp (its own offset) to the reference."""
    return F.datediff(reference, F.try_to_date(F.substring(stamp, 1, 10), "yyyy-MM-dd"))


def relative_date(stamp: Column, reference: Column) -> Column:
    days = days_before(stamp, reference)
    return (F.when(days.isNull(), "").when(days == 0, "today").when(days == 1, "1 day ago")
            .otherwise(F.concat(days.cast("string"), F.lit(" days ago"))))
