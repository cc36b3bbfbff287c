"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_date(text: Column) -> Column:
    """The ISO date that a string starts with; null if it does not."""
    return F.try_to_date(F.substring(F.trim(text), 1, 10), "yyyy-MM-dd")


def utc_date(ts: Column) -> Column:
    """UTC date of an ISO timestamp string, naive ones being UTC; null if malformed.  Needs a UTC session."""
    return F.to_date(F.try_to_timestamp(ts))


def freshness(days: Column, scale: float = 14.0) -> Column:
    """exp(-days / scale), 1 for the future."""
    return F.exp(-F.greatest(days, F.lit(0)) / scale)


def period_labels(day: Column) -> list[Column]:
    """ISO week, month, half-year, year and five-year period of a date."""
    year = F.year(day)
    half = F.when(F.month(day) <= 6, "H1").otherwise("H2")
    five = year - year % 5
    return [
        F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), day), F.weekofyear(day)).alias("week"),
        F.date_format(day, "yyyy-MM").alias("month"),
        F.concat_ws("-", year, half).alias("half_year"),
        year.cast("string").alias("year"),
        F.concat_ws("-", five, five + 4).alias("five_years"),
    ]
