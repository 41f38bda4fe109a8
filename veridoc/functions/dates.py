"""Dates as documents print them, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def full_year(year: Column) -> Column:
    """Two digits below 50 are of this century, others of the last."""
    return F.when(year < 50, year + 2000).when(year < 100, year + 1900).otherwise(year)


def is_leap(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def days_in(month: Column, year: Column) -> Column:
    return F.when(month == 2, F.when(is_leap(year), 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def is_day(day: Column, month: Column, year: Column) -> Column:
    return month.between(1, 12) & (day >= 1) & (day <= days_in(month, year))


def day_parts(c: Column) -> list[Column]:
    """Day, month and full year of a date of numbers; nulls for anything else."""
    group = lambda k: F.regexp_extract(F.trim(c), r"\A([0-9]{1,2})[/.\-]([0-9]{1,2})[/.\-]([0-9]{2,4})\z", k).try_cast("int")
    return [group(1), group(2), full_year(group(3))]


def same_day(a: Column, b: Column) -> Column:
    """Whatever the separators and the width of the year; what isn't a date contradicts nothing."""
    x, y = day_parts(a), day_parts(b)
    equal = (x[0] == y[0]) & (x[1] == y[1]) & (x[2] == y[2])
    return F.coalesce(equal, F.lit(True))


def whole_day_end(day: Column) -> Column:
    """The last millisecond of a day."""
    return F.date_trunc("day", day) + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 0.001 SECOND")


def pdf_date(c: Column) -> Column:
    """D:YYYYMMDDHHmmSS with an offset, as YYYY-MM-DD HH:MM:SS and the offset; anything else as it is."""
    pattern = r"\A(?:D:)?([0-9]{4})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})(?:(Z).*|([+\-])([0-9]{2})'?([0-9]{2})'?|)\z"
    group = lambda k: F.regexp_extract(c, pattern, k)
    zone = F.when(group(8) != "", F.concat(F.lit(" "), group(8), group(9), F.lit(":"), group(10))).otherwise(" UTC")
    return F.when(group(1) != "", F.concat(group(1), F.lit("-"), group(2), F.lit("-"), group(3), F.lit(" "), group(4), F.lit(":"), group(5), F.lit(":"), group(6), zone)).otherwise(c)


def moment(c: Column) -> Column:
    """Seconds since 1970 of a date that pdf_date prints; null for anything else."""
    return F.unix_seconds(F.try_to_timestamp(F.regexp_replace(F.regexp_replace(F.trim(c), " UTC\\z", "Z"), r" (?=[+\-][0-9]{2}:[0-9]{2}\z)", "")))


#: Seconds by which two stamps of one write may differ.
TOLERANCE = 60


def stamp_code(created: Column, modified: Column) -> Column:
    """Null where either is missing or unreadable or they agree."""
    delta = moment(modified) - moment(created)
    return F.when(delta < -TOLERANCE, "REDFLAG_TIMESTAMP_ORDER").when(delta > TOLERANCE, "REDFLAG_MODIFIED_AFTER_CREATE")


def first_date(text: Column) -> Column:
    """The first date of a day, a month and a year between 1900 and 2100, as printed."""
    found = F.regexp_extract_all(text, F.lit(r"\b[0-9]{1,2}[/.\-][0-9]{1,2}[/.\-][0-9]{4}\b"), 0)

    def fits(d: Column) -> Column:
        day, month, year = (F.regexp_extract(d, r"([0-9]+)[/.\-]([0-9]+)[/.\-]([0-9]+)", k).cast("int") for k in (1, 2, 3))
        return day.between(1, 31) & month.between(1, 12) & year.between(1900, 2100)

    return F.get(F.filter(found, fits), F.lit(0))


def impossible_dates(text: Column) -> Column:
    """Dates that no calendar has, neither day first nor month first, as printed; each once, in order.

    A digit before it, or a dot or comma after one, makes it a part of a number; a year of two digits in a longer chain is
    none, and the date behind it counts. Years are of 1900 to 2100. With a
    year of two digits and a part over 39 it is a time or noise, unless a label says date. A year of five digits, 19 or
    20 first, counts after such a label, or if the day is real.
    """
    pair = r"[0-9]{1,2}[/.\-][0-9]{1,2}[/.\-]"
    label = r"(?:dated?|dt|dob|d\.o\.b|doj|birth|joining)\b[^0-9\n]{0,20}"
    found = F.regexp_extract_all(text, F.lit(rf"(?i)(?=[0-9dbj])(?<![0-9])(?<![0-9][.,])(?:\b{label})?(?<![0-9])(?<![0-9][.,])(?:{pair}[0-9]{{2}}(?![/.\-]?[0-9])|{pair}[0-9]{{3,4}}(?![0-9])|(?<!/){pair}[0-9]{{5}}(?![0-9]))"), 0)
    raw = lambda d: F.regexp_extract(d, r"([0-9]{1,2}[/.\-][0-9]{1,2}[/.\-][0-9]{2,5})\z", 1)

    def bad(d: Column) -> Column:
        groups = lambda v: F.struct(*[F.regexp_extract(v, r"([0-9]+)[/.\-]([0-9]+)[/.\-]([0-9]+)", k).alias(f"g{k}") for k in (1, 2, 3)])
        return let(let(raw(d), groups), lambda g: judged(d, g))

    def judged(d: Column, g: Column) -> Column:
        c = g["g3"]
        x, y, width = g["g1"].cast("int"), g["g2"].cast("int"), F.length(c)
        year = F.when(width == 2, full_year(c.cast("int"))).otherwise(c.cast("int"))
        labelled = F.length(d) > F.length(raw(d))
        real = is_day(x, y, year) | is_day(y, x, year)
        noise = (width == 2) & (F.greatest(x, y) > 39) & ~labelled
        of_2000 = F.lit(2000)
        five = (width == 5) & F.substring(c, 1, 2).isin("19", "20") & (labelled | is_day(x, y, of_2000) | is_day(y, x, of_2000))
        return five | ((width != 5) & year.between(1900, 2100) & ~real & ~noise)

    return F.array_distinct(F.transform(F.filter(found, bad), raw))
