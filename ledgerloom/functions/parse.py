"""Cells of files as columns: hours, dates, payment lists, card dates, amounts for print."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hours(text: Column) -> Column:
    """"7h30", "7:30", "7,5" or "7" as hours; null for anything else, and for minutes of 60 or more."""
    clock = r"^\s*(\d{1,2})\s*[hH:]\s*(\d{0,2})\s*$"
    whole, minutes = F.regexp_extract(text, clock, 1), F.regexp_extract(text, clock, 2)
    m = F.coalesce(F.nullif(minutes, F.lit("")).try_cast("int"), F.lit(0))
    plain = F.translate(text, ",", ".").try_cast("decimal(6,2)")
    timed = (whole.try_cast("decimal(4,0)") + (m / F.lit(60)).cast("decimal(8,4)")).cast("decimal(6,2)")
    return F.when(text.rlike(clock), F.when(m < 60, timed)).when(text.rlike(r"^\s*\d{1,2}([.,]\d{1,2})?\s*$"), plain)


def shown_hours(value: Column) -> Column:
    minutes = F.round(value * 60).cast("int")
    return F.concat(F.floor(minutes / 60).cast("string"), F.lit("h"), F.lpad((minutes % 60).cast("string"), 2, "0"))


#: The day before the first, by which a workbook counts.
SERIALS = {1900: "1899-12-30", 1904: "1904-01-01"}


def day(text: Column, order: str = "dmy", epoch: int = 1900) -> Column:
    """A date in one order of its parts, with two- or four-digit years, or a workbook's serial number."""
    parts = r"^\s*(\d{1,4})[/.\-](\d{1,2})[/.\-](\d{1,4})\s*$"
    at = {p: F.regexp_extract(text, parts, i + 1).try_cast("int") for i, p in enumerate(order)}
    year = F.when(at["y"] < 100, at["y"] + F.when(at["y"] < 70, 2000).otherwise(1900)).otherwise(at["y"])
    made = F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(at["m"].cast("string"), 2, "0"), F.lpad(at["d"].cast("string"), 2, "0")), "yyyy-MM-dd")
    serial = F.date_add(F.lit(SERIALS[epoch]).cast("date"), F.floor(text.try_cast("double")).cast("int"))
    return F.when(text.rlike(parts), made).when(text.rlike(r"^\s*\d{4,5}(\.\d+)?\s*$"), serial)


def payments(cell: Column) -> Column:
    """array<struct<method, amount>> of a cell like "CB(4,50)/Cash(2,00)"; null if any of it does not read."""
    whole = r"^\s*[^()/]+\(-?\d+([.,]\d{1,2})?\)(\s*/\s*[^()/]+\(-?\d+([.,]\d{1,2})?\))*\s*$"
    names = F.regexp_extract_all(cell, F.lit(r"([^()/]+)\((-?\d+(?:[.,]\d{1,2})?)\)"), F.lit(1))
    amounts = F.regexp_extract_all(cell, F.lit(r"([^()/]+)\((-?\d+(?:[.,]\d{1,2})?)\)"), F.lit(2))
    read = F.zip_with(names, amounts, lambda n, a: F.struct(F.trim(n).alias("method"), F.translate(a, ",", ".").cast("decimal(12,2)").alias("amount")))
    return F.when(cell.rlike(whole), read)


def card_date(label: Column, booked: Column) -> Column:
    """The day of a card payment in its label ("CARTE 28/12"): the year is the booking's, or the one before where the day
    would lie after the booking."""
    d, m = (F.regexp_extract(label, r"\b(\d{2})/(\d{2})\b", i).try_cast("int") for i in (1, 2))
    of = lambda y: F.try_to_date(F.concat_ws("-", y.cast("string"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")
    same = of(F.year(booked))
    return F.when(same > booked, of(F.year(booked) - 1)).otherwise(same)


def grouped(x: Column, places: int = 2) -> Column:
    """An amount with a space between thousands and a decimal comma."""
    return F.translate(F.format_number(x, places), ",.", " ,")


def of_partial_date(word: str, column: Column) -> Column:
    """Whether a day is in "2025", "09/2025" or is "12/07/2026"; false for another word."""
    parts = word.split("/")
    if not all(p.isdigit() for p in parts) or len(parts) > 3 or len(parts[-1]) != 4:
        return F.lit(False)
    out = F.year(column) == int(parts[-1])
    out = out & (F.month(column) == int(parts[-2])) if len(parts) > 1 else out
    return out & (F.dayofmonth(column) == int(parts[0])) if len(parts) > 2 else out
