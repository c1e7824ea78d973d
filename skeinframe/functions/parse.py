"""Lenient parsing of numbers, units, coordinates, times and dates (survey P-11 to P-16, P-56)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast("double")


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), pattern, group), F.lit(""))


def dms(c: Column) -> Column:
    """Degrees of the first angle in a text such as 57°30'15"N; south and west are negative."""
    pattern = r"(\d+(?:\.\d+)?)\s*[°d]\s*(?:(\d+(?:\.\d+)?)\s*['′m]\s*)?(?:(\d+(?:\.\d+)?)\s*[\"″s]\s*)?([NSEWnsew])"
    part = lambda k: F.coalesce(_number(_found(c, pattern, k)), F.lit(0.0))
    sign = F.when(F.upper(_found(c, pattern, 4)).isin("S", "W"), -1.0).otherwise(1.0)
    return F.when(_found(c, pattern, 1).isNotNull(), sign * (part(1) + part(2) / 60 + part(3) / 3600))


def area_km2(c: Column) -> Column:
    """Square kilometres of a text with km², hectares or m²; the first of these units that it has."""
    n = r"([\d,]+(?:\.\d+)?)\s*"
    return F.coalesce(_number(_found(c, n + r"(?i:km2|km²|sq\.? ?km)")), _number(_found(c, n + r"(?i:ha\b|hectares?)")) / 100, _number(_found(c, n + r"(?i:m2|m²|sq\.? ?m\b)")) / 1e6)


def population(c: Column) -> Column:
    return F.replace(_found(c, r"(?i)\bpop(?:ulation)?\b[^\d]{0,12}([\d,]+)"), F.lit(","), F.lit("")).try_cast("long")


def elevation_m(c: Column, low: float = -50, high: float = 2000) -> Column:
    """Metres of a text such as '120', '120 m' or '400 ft'; null outside the range."""
    n = _number(_found(c, r"^\s*(-?[\d,]+(?:\.\d+)?)\s*(?:m|ft|feet|metres?|meters?|')?\s*$"))
    m = F.when(F.lower(F.trim(c)).rlike(r"(ft|feet|')$"), n * 0.3048).otherwise(n)
    return F.when(m.between(low, high), m)


def lenient_int(c: Column) -> Column:
    return F.replace(F.when(F.trim(c).isin("", "-", ".."), None).otherwise(F.trim(c)), F.lit(","), F.lit("")).try_cast("long")


def clock_minutes(c: Column) -> Column:
    """Minutes of a day of HH:MM[:SS]; hours beyond 23 run into the next day."""
    return F.pmod(_found(c, r"^\s*(\d+):\d\d").try_cast("int"), F.lit(24)) * 60 + _found(c, r"^\s*\d+:(\d\d)").try_cast("int")


def compact_date(c: Column) -> Column:
    """The date of YYYYMMDD; null if it is none."""
    return F.try_to_timestamp(_found(c, r"^(\d{8})$"), F.lit("yyyyMMdd")).cast("date")


def stale(verified: Column, today: Column, days: int = 180) -> Column:
    """Whether a date is over ``days`` old; null dates are."""
    return F.coalesce(F.datediff(today, verified) > days, F.lit(True))
