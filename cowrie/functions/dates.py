"""Calendar dates as Column expressions; ``today`` is always an argument."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from cowrie.functions.numbers import let
from cowrie.functions.text import strip_accents

# Month names and their numbers.
MONTHS = {
    "jan": 1, "janv": 1, "janvier": 1, "january": 1,
    "fev": 2, "fevr": 2, "fevrier": 2, "feb": 2, "february": 2,
    "mar": 3, "mars": 3, "march": 3,
    "avr": 4, "avril": 4, "apr": 4, "april": 4,
    "mai": 5, "may": 5,
    "juin": 6, "jun": 6, "june": 6,
    "juil": 7, "juillet": 7, "jul": 7, "july": 7,
    "aou": 8, "aout": 8, "aug": 8, "august": 8,
    "sep": 9, "sept": 9, "septembre": 9, "september": 9,
    "oct": 10, "octobre": 10, "october": 10,
    "nov": 11, "novembre": 11, "november": 11,
    "dec": 12, "decembre": 12, "december": 12,
}
# Patterns of written dates.
ISO = r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b"
NUMERIC = r"\b(\d{1,2})\s*[/.\-]\s*(\d{1,2})(?:\s*[/.\-]\s*(\d{2}|\d{4}))?\b"
DAY_MONTH = r"\b(\d{1,2})(?:er|st|nd|rd|th)?\s+([a-z]{3,9})\.?(?:\s+(\d{2}|\d{4}))?\b"
MONTH_DAY = r"\b([a-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?(?:,?\s+(\d{4}))?\b"


def as_date(today: Column | dt.date | str) -> Column:
    return today if isinstance(today, Column) else F.lit(today).cast("date")


def week_start(d: Column) -> Column:
    """Monday of the week."""
    return F.date_trunc("WEEK", d).cast("date")


def each_day(start: Column, end: Column) -> Column:
    """All days from start to end as an array; empty if the end comes first, null if either is."""
    return F.when(start <= end, F.sequence(start, end)).when(start > end, F.array().cast("array<date>"))


def iso_weekday(d: Column) -> Column:
    """1 (Monday) to 7."""
    return F.weekday(d) + 1


def is_iso_date(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


def _build(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), text.try_cast("date"))


def written_date(p: Column, now: Column) -> Column:
    """The date of a struct (y, m, d, open); null if there is none.

    If ``open``, a month beyond 12 changes places with the day and a year below
    100 is of this century. Without a year it is the latest such day that is not
    after tomorrow.
    """
    swap = p["open"] & (p["m"] > 12) & (p["d"] <= 12)
    month, day = F.when(swap, p["d"]).otherwise(p["m"]), F.when(swap, p["m"]).otherwise(p["d"])
    year = F.when(p["open"] & (p["y"] < 100), p["y"] + 2000).otherwise(p["y"])
    this = _build(F.year(now), month, day)
    inferred = F.when(this <= F.date_add(now, 1), this).otherwise(_build(F.year(now) - 1, month, day))
    return F.when(p.isNotNull(), F.when(year.isNotNull(), _build(year, month, day)).otherwise(inferred))


def parse_loose_date(text: Column, today: Column | dt.date | str) -> Column:
    """A date as traders write it, day first; null if it is not clear.

    The first shape that a text has decides: ISO, numeric day-month (swapped
    only if it cannot be otherwise), "14 juillet", "July 14". Without a year it
    is the latest such day that is not after tomorrow. Null gives null.
    """
    now = as_date(today)
    months = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])

    def parts(s: Column) -> Column:
        num = lambda pattern, i: F.nullif(F.regexp_extract(s, pattern, i), F.lit("")).try_cast("int")
        month = lambda pattern, i: F.try_element_at(months, F.regexp_extract(s, pattern, i))
        ymd = lambda y, m, d, open_year=True: F.struct(y.alias("y"), m.alias("m"), d.alias("d"), F.lit(open_year).alias("open"))
        return (
            F.when(s.rlike(ISO), ymd(num(ISO, 1), num(ISO, 2), num(ISO, 3), False))
            .when(s.rlike(NUMERIC), ymd(num(NUMERIC, 3), num(NUMERIC, 2), num(NUMERIC, 1)))
            .when(month(DAY_MONTH, 2).isNotNull(), ymd(num(DAY_MONTH, 3), month(DAY_MONTH, 2), num(DAY_MONTH, 1)))
            .when(month(MONTH_DAY, 1).isNotNull(), ymd(num(MONTH_DAY, 3), month(MONTH_DAY, 1), num(MONTH_DAY, 2)))
        )

    found = let(let(F.trim(strip_accents(F.lower(text))), parts), lambda p: written_date(p, now))
    return F.when(text.rlike("[0-9]"), found)  # every shape has a digit


def resolve_date(text: Column, guess: Column, today: Column | dt.date | str) -> Column:
    """The written date, else the reader's guess if it is a real date."""
    return F.coalesce(parse_loose_date(text, today), F.when(is_iso_date(guess), F.try_to_date(guess, "yyyy-MM-dd")))
