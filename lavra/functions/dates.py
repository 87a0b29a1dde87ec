"""Dates of a running text with their places, and dates of message headers."""

from __future__ import annotations

import calendar
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Months in Portuguese and English, the years that count as a date's, and the year from which two digits
# mean the century before.
MONTHS = ["janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro"]
ENGLISH = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
FIRST_YEAR, LAST_YEAR, PIVOT = 1980, 2035, 70

DATES = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("data", "precisao", "bruto")] + [T.StructField(n, T.IntegerType()) for n in ("inicio", "fim")]))

_MONTH = {name: k for k, name in enumerate(MONTHS, 1)} | {"marco": 3}
_WORD = "(?:" + "|".join(_MONTH) + ")"
#: One scan for all ways of writing: a day in words, in figures between equal signs, or a month with its year.
_WRITTEN = re.compile(
    rf"\b(?P<day>\d\d?)(?:[ºo°])?\s+de\s+(?P<name>{_WORD})\s+de\s+(?P<year>\d{{4}})\b"
    rf"|(?<![-/.\d])(?P<figures>\d\d?(?P<sign>[-/.])\d\d?(?P=sign)(?:\d{{4}}|\d\d))(?![-/.]?\d)"
    rf"|\b(?P<month>{_WORD})(?:\s+de)?\s+(?P<of>\d{{4}})\b",
    re.I,
)


def _iso(year: int, month: int, day: int | None = None) -> str | None:
    """The date if there is such a day in the years that count."""
    if not FIRST_YEAR <= year <= LAST_YEAR or not 1 <= month <= 12:
        return None
    if day is None:
        return f"{year}-{month:02d}"
    return f"{year}-{month:02d}-{day:02d}" if 1 <= day <= calendar.monthrange(year, month)[1] else None


def _scan(text: str) -> Iterator[tuple[str, str, str, int, int]]:
    at = 0
    while match := _WRITTEN.search(text, at):
        at = match.end()
        if match["name"]:
            found, precision = _iso(int(match["year"]), _MONTH[match["name"].lower()], int(match["day"])), "dia"
            if not found:
                at = match.start("name")  # without its day it may still name a month
                continue
        elif match["figures"]:
            day, month, year = map(int, match["figures"].split(match["sign"]))
            if year < 100:
                year = (year + (1900 if year >= PIVOT else 2000)) if match["sign"] == "/" else 0
            found, precision = _iso(year, month, day), "dia"
        else:
            found, precision = _iso(int(match["of"]), _MONTH[match["month"].lower()]), "mes"
        if found:
            yield found, precision, match[0], match.start(), match.end()


def dates_in(text: str | None) -> list[tuple[str, str, str, int, int]]:
    """Date (ISO, of day or month precision), precision, as written, begin and end; by place. Impossible days
    and years outside 1980-2035 don't count; years of two digits count after slashes only."""
    return list(_scan(text or ""))


@F.pandas_udf(DATES)
def dates(text: pd.Series) -> pd.Series:
    names = ("data", "precisao", "bruto", "inicio", "fim")
    return pd.Series([[dict(zip(names, d)) for d in dates_in(t)] for t in text])


def header_dates(raw: Column) -> Column:
    """The date of a header in wall-clock time: YYYY-MM-DDTHH:MM, or YYYY-MM-DD where it names no time. The form of
    mail programs (day, English month, year, time) comes first, else the first day of the text and a time behind it."""
    mail = r"(?i)^\s*(?:[a-z]{3,9}\s*,\s*)?(\d{1,2})\s+(" + "|".join(ENGLISH) + r")[a-z]*\s+(\d{4})\s+(\d{1,2}):(\d{2})"
    part = lambda k: F.regexp_extract(raw, mail, k)
    number = F.array_position(F.array(*map(F.lit, ENGLISH)), F.lower(part(2)))
    by_program = F.try_to_timestamp(F.concat_ws(" ", F.concat_ws("-", part(3), F.lpad(number.cast("string"), 2, "0"), F.lpad(part(1), 2, "0")), F.concat_ws(":", F.lpad(part(4), 2, "0"), part(5))), F.lit("yyyy-MM-dd HH:mm"))
    day = F.try_element_at(F.filter(dates(raw), lambda d: d["precisao"] == "dia"), F.lit(1))
    clock = F.regexp_extract(F.substring(raw, day["fim"] + 1, F.length(raw)), r"\b(?:([01]?\d|2[0-3])[:h]([0-5]\d))\b", 0)
    hour = F.split(clock, "[:hH]")
    by_day = F.when(clock == "", day["data"]).otherwise(F.concat(day["data"], F.lit("T"), F.lpad(hour[0], 2, "0"), F.lit(":"), F.try_element_at(hour, F.lit(2))))
    return F.when(F.trim(raw) != "", F.coalesce(F.date_format(by_program, "yyyy-MM-dd'T'HH:mm"), by_day))
