"""Dates of partial precision, as Column builders."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what counts as a date of three parts.
DATE_PARTS = r"^\s*(\d{1,4})/(\d{1,2})/(\d{1,4})\s*$"


def iso_date(text: Column) -> Column:
    """Date of a strict ``YYYY-MM-DD`` text that exists in the calendar, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def placeholder(date: Column, precision: Column) -> Column:
    """Whether a journal date has unknown parts: by its precision, or by a part of three that is zero."""
    zero = [F.try_to_number(F.nullif(F.regexp_extract(date, DATE_PARTS, i), F.lit("")), F.lit("9999")) == 0 for i in (1, 2, 3)]
    return F.coalesce(precision.isin("month", "year", "unknown"), F.lit(False)) | F.coalesce(zero[0] | zero[1] | zero[2], F.lit(False))


def lenient_date(text: str, what: str) -> dt.date:
    """A bound given by a user, with or without leading zeros; an error names it."""
    try:
        return dt.datetime.strptime(text.strip(), "%Y-%m-%d").date()
    except ValueError as e:
        raise ValueError(f"Invalid {what}: {text!r}") from e


def period(date: Column, freq: str) -> Column:
    return F.date_trunc({"M": "month", "Q": "quarter", "Y": "year"}[freq], date).cast("date")


def period_label(start: Column, freq: str) -> Column:
    year = F.year(start).cast("string")
    if freq == "M":
        return F.concat(F.month(start).cast("string"), F.lit("-"), year)
    return F.concat(F.lit("Q"), F.quarter(start).cast("string"), F.lit("-"), year) if freq == "Q" else year


def full_year(text: Column) -> Column:
    """Year of two or four digits; 70 and above of two digits are of the last century."""
    n = text.cast("int")
    return F.when(F.length(text) == 4, n).when(n >= 70, 1900 + n).otherwise(2000 + n)


def date_parts(month: Column, day: Column, year_text: Column) -> Column:
    """Struct of year, month, day, date_precision, date_sort of a heading; no check against the calendar."""
    y = full_year(year_text)
    unknown = (month == 0) & (day == 0) & year_text.isin("0", "00", "0000")
    only_year = (month == 0) & (day == 0) & ~unknown
    only_month = (day == 0) & (month != 0)
    none = F.lit(None).cast("int")
    return F.struct(
        F.when(unknown, none).otherwise(y).alias("year"),
        F.when(unknown | only_year, none).otherwise(month).alias("month"),
        F.when(unknown | only_year | only_month, none).otherwise(day).alias("day"),
        F.when(unknown, "unknown").when(only_year, "year").when(only_month, "month").otherwise("day").alias("date_precision"),
        F.when(unknown, F.lit(None).cast("string")).when(only_year, F.format_string("%04d-01-01", y)).when(only_month, F.format_string("%04d-%02d-01", y, month)).otherwise(F.format_string("%04d-%02d-%02d", y, month, day)).alias("date_sort"),
    )
