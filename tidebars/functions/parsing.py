"""Text to dates and numbers, tolerant of dirty input: bad values become null."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = r"^\d{4}-\d{2}-\d{2}$"
SLASHED = r"^\d{2}/\d{2}/\d{4}$"
LOOSE_SLASHED = r"^(\d{1,2})/(\d{1,2})/(\d{4})"


def iso_text(raw: Column) -> Column:
    """ISO date text from an ISO or MM/DD/YYYY prefix, null otherwise.

    Dates that do not exist (month 13) are null too.
    """
    s = F.substring(F.trim(raw), 1, 10)
    day = F.coalesce(
        F.when(s.rlike(ISO), F.try_to_date(s, "yyyy-MM-dd")),
        F.when(s.rlike(SLASHED), F.try_to_date(s, "MM/dd/yyyy")),
    )
    return F.date_format(day, "yyyy-MM-dd")


def iso_or_same(raw: Column) -> Column:
    """As ``iso_text``, but unrecognised text is returned trimmed and a null becomes empty."""
    s = F.coalesce(F.trim(raw), F.lit(""))
    return F.coalesce(iso_text(raw), s)


def padded_date(raw: Column) -> Column:
    """As ``iso_text``, and month or day may lack their leading zero."""
    s = F.trim(raw)
    parts = [F.regexp_extract(s, LOOSE_SLASHED, i) for i in (1, 2, 3)]
    padded = F.concat_ws("-", parts[2], F.lpad(parts[0], 2, "0"), F.lpad(parts[1], 2, "0"))
    loose = F.when(s.rlike(LOOSE_SLASHED), F.date_format(F.try_to_date(padded, "yyyy-MM-dd"), "yyyy-MM-dd"))
    return F.coalesce(iso_text(raw), loose)


def to_day(raw: Column) -> Column:
    """Date value of a raw cell."""
    return F.to_date(padded_date(raw), "yyyy-MM-dd")


def number(raw: Column) -> Column:
    """Double from text with optional thousands separators; blank, bad and NaN are null."""
    value = F.regexp_replace(F.trim(raw), ",", "").try_cast("double")
    return F.when(~F.isnan(value), value)


# What the suffixes of volumes stand for.
SUFFIXES = {"K": 1e3, "M": 1e6, "B": 1e9}


def volume(raw: Column) -> Column:
    """Volume from text such as 52.00M, 450k or 1,234; anything unreadable is 0."""
    s = F.upper(F.regexp_replace(F.trim(raw), ",", ""))
    last = F.right(s, F.lit(1))
    factor, has_suffix = F.lit(1.0), F.lit(False)
    for suffix, size in SUFFIXES.items():
        factor = F.when(last == suffix, F.lit(size)).otherwise(factor)
        has_suffix = has_suffix | (last == suffix)
    digits = F.when(has_suffix, F.left(s, F.length(s) - 1)).otherwise(s)
    value = digits.try_cast("double")
    return F.coalesce(F.when(~F.isnan(value), value * factor), F.lit(0.0))
