"""Weeks run Monday to Sunday and are named ``YYYY-MM-DD,YYYY-MM-DD``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from learnlens.schema import DISPLAY_ZONE, LOOKBACK_WEEKS


def week_start(day: Column) -> Column:
    """Monday of the week a date falls in; date arithmetic only, so no time zone is involved."""
    return F.trunc(day, "week")


def week_label(day: Column) -> Column:
    monday = week_start(day)
    return F.concat(monday.cast("string"), F.lit(","), F.date_add(monday, 6).cast("string"))


def seconds_between(start: Column, end: Column) -> Column:
    """Difference of two timestamps in seconds, keeping the microseconds.

    Subtracting keeps zone-less timestamps zone-less, so daylight saving in the session zone is harmless.
    """
    return (end - start).cast("interval second").cast("decimal(18,6)").cast("double")


def instant(moment: dt.datetime) -> Column:
    """A zone-less timestamp literal; passed as text so that no time zone is applied on the way."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def display_time(utc: Column) -> Column:
    """A UTC timestamp in the zone the reports are read in."""
    return F.from_utc_timestamp(utc.cast("timestamp"), DISPLAY_ZONE)


def default_start(as_of: dt.date) -> dt.date:
    """First day shown when no range is chosen: the latest Monday and the five weeks before it."""
    monday = as_of - dt.timedelta(days=as_of.weekday())
    return monday - dt.timedelta(weeks=LOOKBACK_WEEKS)


def week_ids(start: dt.date, end: dt.date) -> list[str]:
    """Week labels from the week of ``start`` to the week of ``end``, newest first."""
    first = start - dt.timedelta(days=start.weekday())
    last = end - dt.timedelta(days=end.weekday())
    mondays = [last - dt.timedelta(weeks=i) for i in range((last - first).days // 7 + 1)]
    return [f"{m.isoformat()},{(m + dt.timedelta(days=6)).isoformat()}" for m in mondays]


def week_calendar(bounds: DataFrame, start: str, end: str) -> DataFrame:
    """One row per week between two date columns of a one-row frame, with its id and caption."""
    mondays = F.sequence(
        week_start(F.col(end)), week_start(F.col(start)), F.expr("interval -7 days")
    )
    return (
        bounds.select(F.explode(mondays).alias("week_start"))
        .withColumn("week_end", F.date_add("week_start", 6))
        .select(
            week_label(F.col("week_start")).alias("week_id"),
            F.concat(
                F.date_format("week_start", "dd MMM"),
                F.lit(" to "),
                F.date_format("week_end", "dd MMM yyyy"),
            ).alias("week_name"),
            "week_start",
            "week_end",
        )
        .orderBy(F.col("week_start").desc())
    )
