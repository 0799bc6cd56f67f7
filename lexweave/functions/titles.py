"""Titles of laws: what names the document, and what tells its version."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.functions.dates import find_date
from lexweave.functions.text import let

# How a closing phrase about the version begins; the last is a whole phrase.
OPENINGS = (
    "update", "updated", "re-update", "re-updated", "reupdate", "reupdated", "as of",
    "as modified to", "as modified up to", "as amended to", "as amended up to", "as revised to", "as revised up to",
    "applicable from", "effective from", "in force from", "to be applicable from", "to be effective from", "to be in force from",
    "w.e.f",
)
STATE = "being updated"
# Plurals of part nouns that are no "s" alone, and column heads that name nothing.
PLURALS = {"appendices": "appendix", "annexes": "annex"}
NAMELESS = ("sr no", "s no", "sr", "no", "number", "#", "serial no", "item", "items")
#: Closing phrases that are taken off one after the other.
ROUNDS = 4

_OPEN = "(?:" + "|".join(x.replace(".", r"\.").replace(" ", r"\s+") for x in sorted(OPENINGS, key=len, reverse=True)) + r")(?![A-Za-z0-9_])"
_BRACKETED = rf"(?i)^(.*?)\s*\(\s*((?:{_OPEN})[^()]*?|{STATE.replace(' ', r'\s+')})\s*\)\s*$"
_LED = rf"(?i)^(.*?)\s*[,;-]\s*((?:{_OPEN}).*|{STATE.replace(' ', r'\s+')})$"


def tidy(text: Column) -> Column:
    """Straight quotes and hyphens, single blanks, none around a slash."""
    plain = F.translate(F.coalesce(text, F.lit("")), "’‘–—", "''--")
    return F.regexp_replace(F.trim(F.regexp_replace(plain, r"(?U)\s+", " ")), r"\s*/\s*", "/")


def split_title(title: Column) -> Column:
    """(name, version): the name without closing version phrases, and the outermost of these or null."""
    start = F.struct(tidy(title).alias("name"), F.lit(None).cast("string").alias("version"))

    def strip(found: Column, _: Column) -> Column:
        name = found["name"]
        pattern = F.when(name.rlike(_BRACKETED), F.lit(_BRACKETED)).when(name.rlike(_LED), F.lit(_LED))

        def cut(pattern: Column) -> Column:
            part = lambda i: F.trim(F.call_function("regexp_extract", name, pattern, F.lit(i)))
            return F.when(pattern.isNull(), found).otherwise(F.struct(part(1).alias("name"), F.coalesce(found["version"], part(2)).alias("version")))

        return let(pattern, cut)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, strip, lambda found: F.struct(F.rtrim(found["name"], F.lit(" .,-")).alias("name"), found["version"].alias("version")))


def identity(title: Column) -> Column:
    """What editions of one document share: the name in lower case."""
    return F.lower(split_title(title)["name"])


def effective_from(title: Column) -> Column:
    """The day from which a title says that it applies; a date of revision is none."""
    applies = r"^(to\s+be\s+)?(applicable|effective|in\s+force)\s+from\b"
    return let(F.lower(split_title(title)["version"]), lambda version: F.when(version.rlike(applies), find_date(version)))


def part_noun(head: Column) -> Column:
    """A column's head as the noun of its parts, in the singular, first letters large; null if it names nothing."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(tidy(head)), r"\.", " "), r"\s+", " "), F.lit(" :-"))

    def noun(plain: Column) -> Column:
        odd = F.create_map(*[F.lit(x) for kv in PLURALS.items() for x in kv])[plain]
        plural = (F.length(plain) > 3) & plain.endswith("s") & ~plain.endswith("ss")
        single = F.when(plural, F.left(plain, F.length(plain) - 1)).otherwise(plain)
        return F.when((plain != "") & ~plain.isin(*NAMELESS), F.initcap(F.coalesce(odd, single)))

    return let(F.trim(F.regexp_replace(plain, r"\s*(no|number)$", "")), noun)


def law_label(parent: Column, part: Column, title: Column) -> Column:
    """``Parent - Part: Title`` for a part of a known parent, the title alone otherwise."""
    return F.when(parent.isNotNull() & (F.coalesce(part, F.lit("")) != ""), F.concat(parent, F.lit(" - "), part, F.lit(": "), title)).otherwise(title)


def identifying_names(title: Column, least_words: int = 3) -> Column:
    """The names by which running text may cite a document: the whole title of enough words, and "fe manual" for three."""

    def names(words: Column) -> Column:
        short = F.concat(F.left(F.get(words, F.lit(0)), F.lit(1)), F.left(F.get(words, F.lit(1)), F.lit(1)), F.lit(" "), F.get(words, F.lit(2)))
        found = F.array(F.when(F.size(words) >= least_words, F.array_join(words, " ")), F.when((F.size(words) == 3) & (F.length(short) >= 8), short))
        return F.array_compact(found)

    return let(F.regexp_extract_all(F.lower(title), F.lit("[a-z0-9]+"), F.lit(0)), names)
