"""Dates in running text, found by looking at its words and numbers in a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.functions.text import let

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
YEAR, DAY = "^(19|20)[0-9]{2}$", "^[0-9]{1,2}$"


def date_words(text: Column) -> Column:
    """Lower-case words and numbers in order; "3rd" is 3."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), r"([0-9])(st|nd|rd|th)\b", "$1"), F.lit("[a-z]+|[0-9]+"), F.lit(0))


def _month(word: Column) -> Column:
    return F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, i)])[word]


def _first(words: Column, order: str) -> Column:
    """The date at the first place where words stand in ``order``: d, m and y for day, month and year."""
    at = {part: i for i, part in enumerate(order)}

    def holds(i: Column) -> Column:
        test = _month(F.get(words, i + at["m"])).isNotNull() & F.get(words, i + at["y"]).rlike(YEAR)
        return test & F.get(words, i + at["d"]).rlike(DAY) if "d" in at else test

    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), holds)
    day = lambda place: F.get(words, place + at["d"]) if "d" in at else F.lit("1")
    written = lambda place: F.when(place.isNotNull(), F.concat_ws("-", F.get(words, place + at["y"]), _month(F.get(words, place + at["m"])).cast("string"), day(place)))
    return F.try_to_date(let(F.get(places, F.lit(0)), written), "yyyy-M-d")


def find_date(text: Column) -> Column:
    """The first full date, day or month first, else the first month with a year, as its first day; null without any."""
    return let(date_words(text), lambda words: F.coalesce(_first(words, "dmy"), _first(words, "mdy"), _first(words, "my")))
