"""Date helpers.  All are built-in expressions and never raise under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTH_DAYS = 30.44  # average month length used to turn loan age into a calendar month


def mmyyyy_to_date(c: Column) -> Column:
    """'MMYYYY' (text or integer, leading zero optional) -> first of the month, else null.

    Month and year are the number's parts, so longer numbers have no month.
    """
    number = c.try_cast("long")
    month, year = F.floor(number / 10_000), F.pmod(number, F.lit(10_000))
    text = F.format_string("%04d-%02d-01", year, month)
    return F.when(month.between(1, 12) & (year >= 1), text.try_cast("date"))


def act_period(origination: Column, time: Column) -> Column:
    """Calendar month of an observation as 'MMYYYY'."""
    days = ((time + 1) * MONTH_DAYS).cast("int")
    return F.date_format(F.date_add(origination, days), "MMyyyy")


def lenient_date(c: Column) -> Column:
    """Date or ISO text -> date; unparsable text -> null."""
    return c.try_cast("date")


def lenient_timestamp(c: Column) -> Column:
    return c.try_cast("timestamp")


def quarter_label(d: Column) -> Column:
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))


def quarter_start(label: Column) -> Column:
    """'2017Q1' -> 2017-01-01; null when the label is not a quarter."""
    month = (F.substring(label, 6, 1).try_cast("int") - 1) * 3 + 1
    text = F.concat_ws("-", F.substring(label, 1, 4),
                       F.lpad(month.cast("string"), 2, "0"), F.lit("01"))
    return F.when(label.rlike("^[0-9]{4}Q[1-4]$"), text.try_cast("date"))


def month_of_act_period(c: Column) -> Column:
    """'MMYYYY' -> date.  Use it to order months: the text sorts by month first."""
    return F.try_to_date(c, "MMyyyy")
