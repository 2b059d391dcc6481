"""Typing and tidying of dirty text columns. A value that cannot be read becomes null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spellings read as true, and the fields that hold comma lists.
TRUE_WORDS = ["true", "1", "yes", "on"]
LIST_FIELDS = ["genres", "production_countries", "spoken_languages", "keywords", "production_companies"]
WHITE_SPACE = " \t\n\r\v\f\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
FIRST_FILM_YEAR = 1888
YEARS_AHEAD = 10


def strip(c: Column) -> Column:
    """Remove any white space at both ends (plain ``trim`` removes only spaces)."""
    return F.trim(c.cast("string"), F.lit(WHITE_SPACE))


def finite(d: Column) -> Column:
    """Null instead of NaN and the infinities. (NaN sorts above infinity.)"""
    return F.when(F.abs(d) < F.lit(float("inf")), d)


def safe_double(c: Column, only_finite: bool = False) -> Column:
    """Number or null. Java's ``1d`` and ``1f`` suffixes are no numbers here."""
    value = F.regexp_replace(strip(c), "(?<![iI][nN])[dDfF]$", "?").try_cast("double")
    return finite(value) if only_finite else value


def safe_int(c: Column) -> Column:
    """Whole part of a number, cut toward zero, or null."""
    return safe_double(c).try_cast("bigint")


def strict_int64(c: Column) -> Column:
    """Integral numbers only: ``1e3`` is 1000, ``4.5`` is null. Whole numbers are read as such, not as doubles."""
    value = safe_double(c)
    whole = F.when(strip(c).rlike(r"^[+-]?\d+$"), strip(c).try_cast("bigint"))
    return F.coalesce(whole, F.when((value % 1 == 0) & ~strip(c).rlike(r"^[+-]?\d+$"), value.try_cast("bigint")))


def safe_string(c: Column) -> Column:
    text = strip(c)
    return F.when(text != "", text)


def safe_bool(c: Column) -> Column:
    """True for the usual spellings of yes, false for any other text, null for null."""
    return F.when(c.isNotNull(), F.lower(strip(c)).isin(TRUE_WORDS))


def bool_flag(c: Column) -> Column:
    """True or false only when spelt so; anything else is null."""
    word = F.lower(strip(c))
    return F.when(word == "true", F.lit(True)).when(word == "false", F.lit(False))


DATE_FORMS = ("M/d/yyyy", "M-d-yyyy", "yyyy/M/d", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "yyyyMMdd")


def parse_date(c: Column, fmt: str | None = None) -> Column:
    """Date or null. Without a format: ISO first, then the usual other forms, month before day."""
    text = F.trim(c.cast("string"))
    if fmt:
        return F.try_to_timestamp(text, F.lit(fmt)).cast("date")
    return F.coalesce(F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMS]).cast("date")


def release_year(d: Column, as_of_year: int) -> Column:
    """Year of a date when it is plausible for a film."""
    year = F.year(d)
    return F.when(year.between(FIRST_FILM_YEAR, as_of_year + YEARS_AHEAD), year)


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def date_ordinal(d: Column) -> Column:
    """Days since the first of January of year 1, which is day 1."""
    return F.date_diff(d, F.lit("0001-01-01").cast("date")) + 1


def split_list(c: Column) -> Column:
    """Comma list to array: trimmed, blanks dropped, null gives an empty array."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip)
    return F.filter(parts, lambda x: x != "")


def norm_language(c: Column) -> Column:
    return F.lower(safe_string(c))


def map_values(c: Column, mapping: dict, null_value=None) -> Column:
    """Recode by a small dictionary; values outside it become null."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    coded = F.try_element_at(F.create_map(*pairs), c)
    if null_value is None:
        return coded
    return F.when(c.isNull(), F.lit(null_value)).otherwise(coded)


def row_sum(*cols: Column) -> Column:
    """Sum across columns with nulls as zero."""
    total = F.lit(0.0)
    for c in cols:
        total = total + F.coalesce(c.cast("double"), F.lit(0.0))
    return total


def percent_error(truth: Column, approx: Column) -> Column:
    """100 times the relative error; null where the true value is zero."""
    return F.abs(F.try_divide(truth - approx, truth)) * 100
