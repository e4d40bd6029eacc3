"""Dates and times as Column expressions. The day that counts as today is always an argument."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Portuguese and English months by their first three letters.
PT_MONTHS = ("jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez")
EN_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
# How the venues write days and times
DAY_MONTH = r"(?U)(\d{1,2})\s+(\w{3})"
HOURS_MINUTES = r"^(\d{1,2})h(\d{2})"
DAY_MONTH_YEAR = r"(\d{1,2})\s+([A-Za-z]{3,})\s+(\d{4})"
COLON_TIME = r"\b(\d{1,2}):(\d{2})\b"
SEVERAL_DAYS = r"[–—]|\d\s*-\s*\d"
DAYS = r"(\d{1,2})\s+([A-Za-z]{3,})\s*[–—-]\s*(\d{1,2})\s+([A-Za-z]{3,})\s+(\d{4})"
HEADING = r"^(\w+)\s+(\d+)\s+(\d{4}),\s*\w+,\s*(\d+:\d+)(?:\s*\((\d+)'?\))?"
SLASHED = r"(\d{2})/(\d{2})/(\d{4}),\s*(\d{2})h(\d{2})"
LONG_RUNTIME, SHORT_RUNTIME = r"^(\d+)h(\d+)", r"^(\d+)min"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once for a row, however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def month_number(name: Column, months: tuple[str, ...] = EN_MONTHS) -> Column:
    """1 to 12 by the first three letters, else null."""
    return F.nullif(F.array_position(F.array(*map(F.lit, months)), F.substring(F.lower(name), 1, 3)), F.lit(0))


def iso(year: Column, month: Column, day: Column) -> Column:
    """YYYY-MM-DD, or null where there is no such day."""
    written = F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int"))
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull() & F.try_to_timestamp(written, F.lit("yyyy-MM-dd")).isNotNull(), written)


def digits(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of a pattern as an int, null without a match."""
    return F.regexp_extract(text, pattern, group).try_cast("int")


def rolled_date(day: Column, month: Column, asof: Column, days: int = 60) -> Column:
    """a day and month without a year: this year's, or next year's if that is more than `days` past."""
    near = iso(F.year(asof), month, day)
    return F.when(F.datediff(asof, near.try_cast("date")) > days, iso(F.year(asof) + 1, month, day)).otherwise(near)


def pt_date(text: Column, asof: Column) -> Column:
    """`qua, 25 mar` as YYYY-MM-DD."""
    low = F.lower(text)
    return rolled_date(digits(low, DAY_MONTH), month_number(F.regexp_extract(low, DAY_MONTH, 2), PT_MONTHS), asof)


def clock(text: Column, pattern: str) -> Column:
    """HH:MM from a pattern of two groups, null without a match."""
    hour, minute = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    return F.when(hour != "", F.concat(F.lpad(hour, 2, "0"), F.lit(":"), minute))


def pt_time(text: Column) -> Column:
    """`21h00` as 21:00."""
    return clock(F.btrim(text), HOURS_MINUTES)


def en_date_time(text: Column) -> Column:
    """F16: struct(date, time) of `13 MAY 2026 WED 19:00`; nulls for a range of days or without a time."""
    time = clock(text, COLON_TIME)
    day = iso(digits(text, DAY_MONTH_YEAR, 3), month_number(F.regexp_extract(text, DAY_MONTH_YEAR, 2)), digits(text, DAY_MONTH_YEAR, 1))
    whole = ~text.rlike(SEVERAL_DAYS) & time.isNotNull() & day.isNotNull()
    return F.struct(F.when(whole, day).alias("date"), F.when(whole, time).alias("time"))


def ranged_days(text: Column) -> Column:
    """every day of `30 APR – 10 MAY 2026` as a date; empty if it cannot be read or runs backwards."""
    day = lambda y, m, d: F.when(y != "0000", F.concat(y, F.lit("-"), month_number(m).cast("string"), F.lit("-"), d).try_cast("date"))
    parts = lambda t: F.struct(*[F.regexp_extract(t, DAYS, k).alias(f"p{k}") for k in range(1, 6)])
    ends = lambda p: F.struct(day(p["p5"], p["p2"], p["p1"]).alias("a"), day(p["p5"], p["p4"], p["p3"]).alias("z"))
    days = lambda r: F.when(r["a"] <= r["z"], F.sequence(r["a"], r["z"])).otherwise(F.array().cast("array<date>"))
    return bound(text, lambda t: bound(parts(t), lambda p: bound(ends(p), days)))


def day_range(text: Column) -> Column:
    """every day of `30 APR – 10 MAY 2026`; empty if it cannot be read or runs backwards."""
    return F.transform(ranged_days(text), lambda d: d.cast("string"))


def heading_time(text: Column) -> Column:
    """struct(date, time, duration) of `May 02 2026, Saturday, 15:00 (96')`."""
    part = lambda k: F.regexp_extract(text, HEADING, k)
    return F.struct(iso(part(3).try_cast("int"), month_number(part(1)), part(2).try_cast("int")).alias("date"), F.nullif(part(4), F.lit("")).alias("time"), part(5).try_cast("int").alias("duration"))


def slashed_date_time(text: Column) -> Column:
    """struct(date, time) of `25/03/2026, 15h30`."""
    part = lambda k: F.regexp_extract(text, SLASHED, k)
    there = part(1) != ""
    return F.struct(F.when(there, F.concat_ws("-", part(3), part(2), part(1))).alias("date"), F.when(there, F.concat_ws(":", part(4), part(5))).alias("time"))


def iso_parts(text: Column) -> Column:
    """struct(date, time) of an ISO timestamp, as written."""
    return F.struct(F.substring(text, 1, 10).alias("date"), F.substring(text, 12, 5).alias("time"))


def lisbon_time(utc: Column, civil: bool = False) -> Column:
    """an instant as Lisbon's clock shows it, without a zone, so whatever the session's zone is; unless `civil`, one hour
    ahead of the civil clock, as the listings have it."""
    local = F.convert_timezone(None, F.lit("Europe/Lisbon"), utc)
    return local if civil else local + F.expr("interval 1 hour")


def minutes(text: Column) -> Column:
    """`2h02` or `95min` in minutes, else null."""
    hours, rest = digits(text, LONG_RUNTIME, 1), digits(text, LONG_RUNTIME, 2)
    return F.coalesce(hours * 60 + rest, digits(text, SHORT_RUNTIME, 1))


def leading_int(text: Column, length: int | None = None) -> Column:
    """the number at the head of a text, or its first characters as a number."""
    return F.substring(text, 1, length).try_cast("int") if length else digits(text, r"^\s*(\d+)", 1)
