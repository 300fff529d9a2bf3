"""Times in words for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_time(at: Column) -> Column:
    """``Nov 5, 2001, 12:00 AM``; a dash for null."""
    return F.coalesce(F.date_format(at, "MMM d, yyyy, h:mm a"), F.lit("—"))


def time_ago(at: Column, now: Column) -> Column:
    """How long ago a time was, in rounded words; ``Never`` for null.

    Below thirty days by minutes, hours and days; below a year by months of thirty days; then by years: about (the next three
    months), over (six more), almost the next.
    """
    seconds = F.unix_seconds(now) - F.unix_seconds(at)
    minutes = F.floor(seconds / 60 + 0.5)
    calendar = (F.year(now) - F.year(at)) * 12 + F.month(now) - F.month(at)
    months = calendar - (now - F.make_interval(months=calendar) < at).cast("int")
    years = F.floor(months / 12)
    part = lambda n: F.floor(minutes / n + 0.5).cast("string")
    named = lambda n: F.concat(n.cast("string"), F.when(n == 1, " year ago").otherwise(" years ago"))
    return (
        F.when(at.isNull(), "Never")
        .when(seconds < 30, "less than a minute ago")
        .when(minutes < 2, "1 minute ago")
        .when(minutes < 45, F.concat(minutes.cast("string"), F.lit(" minutes ago")))
        .when(minutes < 90, "about 1 hour ago")
        .when(minutes < 1440, F.concat(F.lit("about "), part(60), F.lit(" hours ago")))
        .when(minutes < 2520, "1 day ago")
        .when(minutes < 43200, F.concat(part(1440), F.lit(" days ago")))
        .when(minutes < 64800, "about 1 month ago")
        .when(minutes < 86400, "about 2 months ago")
        .when(months < 12, F.concat(part(43200), F.lit(" months ago")))
        .when(months % 12 < 3, F.concat(F.lit("about "), named(years)))
        .when(months % 12 < 9, F.concat(F.lit("over "), named(years)))
        .otherwise(F.concat(F.lit("almost "), named(years + 1)))
    )
