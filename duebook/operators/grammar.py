"""Labelled values in texts: a small grammar that builds expressions from tables of labels, a separator and kinds of values.

Expressions see Unicode words and only line feeds as ends of lines. A value may stand on the line after its label.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Currencies with their marks, the marks that may stand before an amount, words that end in a dot when shortened.
CURRENCIES = {"INR": ("₹", "INR", "RS.", "RS ", "RUPEES"), "USD": ("US$", "USD", "$"), "CAD": ("C$", "CAD"), "EUR": ("EUR", "€"), "GBP": ("GBP", "£"), "AUD": ("A$", "AUD")}
MONEY_MARKS = ("₹", "$", "€", "£", "US$", "C$", "A$", "INR", "USD", "CAD", "EUR", "GBP", "AUD", "Rs.", "Rs", "Indian Rupees", "Indian Rupee")
SHORTENED = ("no", "inv", "doc")

FLAGS = "(?iUd)"
#: Between a label and its value.
GAP = r"\s*[:#-]?\s*"

_NTH = r"\d{1,2}(?:st|nd|rd|th)?"
_MONTH = "[A-Za-z]{3,9}"
_CUT = "[-/.]"
#: Kinds of values: days by numbers or with a month's name, amounts with or without groups, codes.
DAY = "|".join((rf"\d{{4}}{_CUT}\d{{1,2}}{_CUT}\d{{1,2}}", rf"\d{{1,2}}{_CUT}\d{{1,2}}{_CUT}\d{{2,4}}", rf"(?:{_NTH}\s+)?{_MONTH}\s+{_NTH},?\s+\d{{4}}", rf"{_NTH}\s+{_MONTH},?\s+\d{{4}}"))
CENTS = r"(?:\.\d{1,2})?"
MONEY = rf"\d+(?:,\s*\d{{2,3}})*{CENTS}"
CODE = "[A-Z0-9][A-Z0-9/_.-]"


def quoted(words: str) -> str:
    return re.sub(r"([.$|()/*+?\[\]])", r"\\\1", words)


def any_of(phrases: tuple[str, ...] | dict[str, object], space: str = r"\s+") -> str:
    """One of ``phrases``; shortened words may end in a dot."""
    said = (space.join(quoted(w) + (r"\.?" if w in SHORTENED else "") for w in p.split()) for p in phrases)
    return "(?:" + "|".join(said) + ")"


def labelled(label: str, value: str, before: str = "") -> str:
    """The value, as group 1, behind a label that stands as a word."""
    return rf"{FLAGS}{before}\b{label}\b{GAP}({value})"


def every(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def shown(text: Column) -> Column:
    """``text`` in the one case in which patterns compare it, to ask for words before patterns are tried."""
    return bound(text, lambda t: F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.lower(F.upper(F.translate(t, "İı", "ii")))))


def scored_said(text: Column, low: Column, words: str, pattern: str, score: float) -> Column:
    """``scored`` of ``every`` for a pattern that begins with ``words``: texts whose ``shown`` form ``low`` lacks them aren't searched, and give null."""
    return F.when(low.contains(words), scored(every(text, pattern), score))


def together(found: list[Column]) -> Column:
    """The candidates of all arrays that aren't null, in order."""
    return F.flatten(F.array_compact(F.array(*found)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first(text: Column, pattern: str, group: int = 1) -> Column:
    return bound(F.regexp_extract(text, pattern, group), lambda v: F.when(v != "", v))


def first_said(text: Column, low: Column, words: tuple[str, ...], pattern: str) -> Column:
    """``first`` for a pattern that begins with one of ``words``: texts whose ``shown`` form ``low`` lacks them aren't searched."""
    return F.when(reduce(Column.__or__, (low.contains(w) for w in words)), first(text, pattern))


def scored(values: Column, score: float) -> Column:
    """An array of candidates (value, score)."""
    return F.transform(values, lambda v: F.struct(v.alias("value"), F.lit(score).alias("score")))


def best(candidates: Column) -> Column:
    """The candidate of the highest score, the first of equals; null of none."""
    turns = F.transform(candidates, lambda c, k: F.struct(c["score"].alias("score"), (-k).alias("turn"), c["value"].alias("value")))
    return bound(F.array_max(turns), lambda top: F.when(top.isNotNull(), F.struct(top["value"].alias("value"), top["score"].alias("score"))))


def stripped(text: Column, chars: str = " :#-") -> Column:
    return F.btrim(text, F.lit(chars))
