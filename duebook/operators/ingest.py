"""Imported payment rows: parsing of text cells, natural keys, duplicates and counters."""

from __future__ import annotations

import contextlib
import datetime
import functools
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

#: Accepted date formats, in order.
DATES = ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyy-M-d", "yyyy/M/d", "MMM d, yyyy", "MMMM d, yyyy")
#: The same as shapes, with the places of year, month and day; names of the months.
DATE_SHAPES = {
    r"^(\d{1,2})([/.-])(\d{1,2})\2(\d{4})$": (4, 3, 1), r"^(\d{1,2}) ([A-Za-z]+) (\d{4})$": (3, 2, 1), r"^(\d{4})([/-])(\d{1,2})\2(\d{1,2})$": (1, 3, 4), r"^([A-Za-z]+) (\d{1,2}), (\d{4})$": (3, 1, 2),
}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: Currency words and signs around an amount, its grouping, and the punctuation and suffixes of a company's name.
CURRENCIES = r"(?:INR|USD|CAD|EUR|GBP|AUD|RS\.?)"
SIGNS = r"[₹$€£\s]"
NUMBER = r"^(\d+|\d{1,3}(,\d{3})+|\d{1,3}(,\d{2})*,\d{3})(\.\d+)?$"
PUNCTUATION = r"[.,;:()\[\]{}]+"
LIMITED = r"(^|\s)(pvt ltd|pvt limited|private ltd)$"


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def _casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t).casefold())


def is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def compatible(text: Column) -> Column:
    """Unicode compatibility form (NFKC); built-in functions have none, but ASCII is in it already."""
    return F.coalesce(_nfkc(F.when(~is_ascii(text), text)), text)


def shaped_day(text: str, shapes: dict[str, tuple[int, int, int]]) -> datetime.date | None:
    """The first of ``shapes`` that fits and names a day; months by number, name or its first three letters."""
    for shape, places in shapes.items():
        found = re.match(shape, text)
        if found:
            year, month, day = (found.group(k) for k in places)
            month = int(month) if month.isdigit() else next((k for k, name in enumerate(MONTHS, 1) if month.lower() in (name, name[:3])), 0)
            with contextlib.suppress(ValueError):
                return datetime.date(int(year), month, int(day))
    return None


#: What a day in any of the shapes begins with; what doesn't isn't parsed.
_DAY_BEGINS = re.compile(r"(?i)[ :#-]*(?:\d{1,4}(?:st|nd|rd|th)*[-/.\s]|[a-z]+\s)")


@functools.lru_cache(1 << 16)
def _day_number(text: str, shapes: tuple[tuple[str, tuple[int, int, int]], ...], years: tuple[int, int]) -> int | None:
    """The day of a text in days since 1970; texts of days recur."""
    bare = re.sub(r"\s+", " ", re.sub(r"(?i)(\d)(st|nd|rd|th)\b", r"\1", text.strip(" :#-")))
    day = shaped_day(bare, dict(shapes))
    return (day - datetime.date(1970, 1, 1)).days if day and years[0] <= day.year <= years[1] else None


def days_of(shapes: dict[str, tuple[int, int, int]], years: tuple[int, int] = (1, 9999)) -> Callable[[Column], Column]:
    """A function from an array of texts to an array of their days, null for what is none; built-in parsers throw for each format that fails."""
    known = tuple(shapes.items())

    def every(texts: pd.Series) -> pd.Series:
        return texts.map(lambda v: None if v is None else [_day_number(t, known, years) if _DAY_BEGINS.match(t) else None for t in v.split("\0")])

    numbers = F.pandas_udf(every, ArrayType(IntegerType()))

    def days(texts: Column) -> Column:
        # one text for each row, since arrays of texts go to Python and back far more slowly; a zero is in no day
        said = F.array_join(F.transform(texts, lambda t: F.replace(t, F.lit("\0"), F.lit("?"))), "\0", "")
        found = F.transform(numbers(F.when(F.size(texts) > 0, said)), F.date_from_unix_date)
        return F.when(F.size(texts) > 0, found).otherwise(F.transform(texts, lambda t: F.lit(None).cast("date")))

    return days


def folded(text: Column) -> Column:
    """NFKC and full case folding."""
    return F.coalesce(_casefold(F.when(~is_ascii(text), text)), F.lower(text))


def parse_date(text: Column, plain: bool = False) -> Column:
    """Day-first dates, ISO dates and times, and month names; null where none fits. ``plain``: the text is in NFKC already."""
    clean = F.regexp_replace(F.trim(text if plain else compatible(text)), r"(?i)(\d)(st|nd|rd|th)\b", "$1")
    timed = F.when(clean.rlike(r"^\d{4}-\d{2}-\d{2}[ T]."), F.to_date(clean.try_cast("timestamp")))
    return F.when(clean.rlike(r"^\d{4}-\d{2}-\d{2}[ T]"), timed).otherwise(F.coalesce(*(F.try_to_date(clean, f) for f in DATES)))


def parse_amount(text: Column, plain: bool = False) -> Column:
    """Plain, western and Indian grouping, with currency words and signs; rounded half-even to cents.

    Null unless finite and above 0, so also for a negative sign or parentheses. ``plain``: the text is in NFKC already.
    """
    bare = F.trim(text if plain else compatible(text))
    bare = F.regexp_replace(F.regexp_replace(bare, rf"(?i)^\s*{CURRENCIES}\s*", ""), rf"(?i)\s*{CURRENCIES}\s*$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, SIGNS, ""), r"^\+", "")
    value = F.when(bare.rlike(NUMBER), F.regexp_replace(bare, ",", "")).try_cast("decimal(38,18)")
    return F.when(value > 0, F.bround(value, 2).try_cast("decimal(14,2)"))


def reference_key(text: Column) -> Column:
    return F.regexp_replace(folded(text), r"\s+", "")


def company_name(text: Column) -> Column:
    """Punctuation to spaces, one space, folded case, ``pvt ltd`` forms to ``private limited``; empty is null."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(folded(text), PUNCTUATION, " "), r"\s+", " "))
    return F.nullif(F.regexp_replace(flat, LIMITED, "$1private limited"), F.lit(""))


def natural_key_duplicates(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``duplicate``: the second and later row of a key, in order."""
    return rows.withColumn("duplicate", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) > 1)


def rate_limited(events: DataFrame, window: str = "1 day", limit: int = 3) -> DataFrame:
    """(user_id, window_start, hits, refused): fixed windows; hits beyond the limit are refused."""
    counted = events.groupBy("user_id", F.window("ts", window).alias("w")).agg(F.count("*").alias("hits"))
    return counted.select("user_id", F.col("w.start").alias("window_start"), "hits", F.greatest(F.col("hits") - limit, F.lit(0)).cast("long").alias("refused"))


def whole_percentages(rows: DataFrame, group: str, item: str, value: str) -> DataFrame:
    """(group, item, percent): whole percentages that add up to 100, by largest remainders, ties by item."""
    total = F.sum(value).over(Window.partitionBy(group))
    rows = rows.withColumn("exact", (100 * F.col(value) / total).cast("double")).withColumn("base", F.floor("exact"))
    missing = 100 - F.sum("base").over(Window.partitionBy(group))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(F.round(F.col("exact") - F.col("base"), 9)), item))
    return rows.select(group, item, (F.col("base") + F.when(rank <= missing, 1).otherwise(0)).cast("long").alias("percent"))
